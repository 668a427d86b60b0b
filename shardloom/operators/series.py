"""Ordered series: running values, plateaus, stalls, trends, islands and as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import group_rank


def _by(by: list[str], order: list[str]):
    return Window.partitionBy(*by).orderBy(*order)


def running_best(df: DataFrame, by: list[str], order: list[str], value: str, out: str = "best") -> DataFrame:
    """The greatest value so far, nulls ignored."""
    return df.withColumn(out, F.max(value).over(_by(by, order).rowsBetween(Window.unboundedPreceding, 0)))


def rolling_band(df: DataFrame, by: list[str], order: list[str], value: str, width: int = 5) -> DataFrame:
    """``mean, spread`` of the last ``width`` rows (population deviation); below two values the value itself and 0."""
    w = _by(by, order).rowsBetween(-(width - 1), 0)
    enough = F.count(value).over(w) >= 2
    return df.withColumn("mean", F.when(enough, F.avg(value).over(w)).otherwise(F.col(value))).withColumn("spread", F.when(enough, F.stddev_pop(value).over(w)).otherwise(F.lit(0.0)))


def tail(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows of each group, ``back`` 1 the last."""
    w = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def plateau(df: DataFrame, by: list[str], order: list[str], value: str, patience: int = 4, threshold: float = 0.01) -> DataFrame:
    """``by..., n, state``: of the last ``patience`` rows; short, regression (last below first), plateau or moving."""
    t = tail(df, by, order, patience).groupBy(*by).agg(
        F.count(value).alias("n"), F.max_by(value, "back").alias("first"), F.min_by(value, "back").alias("last"), F.max(value).alias("top")
    )
    state = F.when(F.col("n") < patience, "short").when(F.col("last") < F.col("first"), "regression").when(F.col("top") - F.col("first") < threshold, "plateau").otherwise("moving")
    return t.select(*by, "n", state.alias("state"))


def since_best(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """``by..., best, since``: the greatest value and the rows since, the earliest of ties."""
    placed = df.where(F.col(value).isNotNull()).withColumn("i", F.row_number().over(_by(by, order)))
    return placed.groupBy(*by).agg(F.max(value).alias("best"), (F.max("i") - F.max_by(F.col("i"), F.struct(F.col(value), -F.col("i")))).alias("since"))


def early_stop(df: DataFrame, by: list[str], order: list[str], value: str, patience: int = 3, min_delta: float = 0.0) -> DataFrame:
    """``by..., stop_at``: the row (from 1) at which no new high by more than ``min_delta`` had come for ``patience`` rows; null if never.

    The high only moves with an improvement that counts, so this is a fold in order.
    """
    start = F.struct(F.lit(None).cast("double").alias("high"), F.lit(0).alias("wait"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("stop"))

    def step(s: Column, x: Column) -> Column:
        better = s["high"].isNull() | (x["v"] > s["high"] + min_delta)
        wait = F.when(better, F.lit(0)).otherwise(s["wait"] + 1)
        i = s["i"] + 1
        stop = F.when(s["stop"].isNotNull(), s["stop"]).when(wait >= patience, i)
        return F.struct(F.when(better, x["v"]).otherwise(s["high"]).alias("high"), wait.alias("wait"), i.alias("i"), stop.alias("stop"))

    rows = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("v")))).alias("o"))
    return rows.select(*by, F.aggregate("o", start, step)["stop"].alias("stop_at"))


def overtrained(df: DataFrame, by: list[str], order: list[str], gap: str, loss: str, k: int = 3) -> DataFrame:
    """``by..., overtrained``: over the last ``k`` rows the gap falls strictly while the loss never rises and ends lower."""
    t = tail(df, by, order, k)
    w = Window.partitionBy(*by).orderBy(F.desc("back"))
    stepped = t.withColumn("dg", F.col(gap) - F.lag(gap).over(w)).withColumn("dl", F.col(loss) - F.lag(loss).over(w))
    falls = F.coalesce(F.every((F.col("dg") < 0) & (F.col("dl") <= 0)), F.lit(False))
    return stepped.groupBy(*by).agg(((F.count(F.lit(1)) == k) & falls & (F.min_by(loss, "back") < F.max_by(loss, "back"))).cast("int").alias("overtrained"))


def delta_to_previous(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """``delta`` to the last value before that is not null."""
    before = F.last(value, ignorenulls=True).over(_by(by, order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("delta", F.col(value) - before)


def trend_label(df: DataFrame, by: list[str], order: list[str], value: str, share: float = 0.02) -> DataFrame:
    """``by..., trend`` from the last three values: up or down by more than ``share`` of the first, else flat."""
    t = tail(df.where(F.col(value).isNotNull()), by, order, 3).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max_by(value, "back").alias("a"), F.min_by(value, "back").alias("c"))
    change = (F.col("c") - F.col("a")) / F.greatest(F.abs("a"), F.lit(1e-9))
    return t.select(*by, F.when(F.col("n") < 3, "short").when(change > share, "up").when(change < -share, "down").otherwise("flat").alias("trend"))


def settled_statistics(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Mean and deviation of the rows after the first two fifths."""
    placed = df.withColumn("i", F.row_number().over(_by(by, order))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    kept = placed.where(F.col("i") > F.floor(2 * F.col("n") / 5))
    return kept.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("spread"))


def trailing_streak(df: DataFrame, by: list[str], order: list[str], status: str, failed: str, success: str, skip: str) -> DataFrame:
    """``by..., streak``: failed rows from the end back to the last success; rows in flight do not count."""
    t = df.where(F.col(status) != skip).withColumn("ok", F.sum((F.col(status) == success).cast("int")).over(Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)))
    return t.groupBy(*by).agg(F.count_if((F.col("ok") == 0) & (F.col(status) == failed)).alias("streak"))


def trend_summary(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """``n, mean, low, high, first, last, slope`` by group; the slope is the least-squares one on 0, 1, 2 ..., 0 for one row."""
    placed = group_rank(df, by, [F.asc(c) for c in order], "__k", "__t").withColumn("i", F.col("__k") - 1)
    return placed.groupBy(*by).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
        F.min_by(value, "i").alias("first"),
        F.max_by(value, "i").alias("last"),
        F.coalesce(F.regr_slope(F.col(value), F.col("i")), F.lit(0.0)).alias("slope"),
    )


def alerts(summary: DataFrame, rules: DataFrame, key: str = "metric") -> DataFrame:
    """``key, kind, fired``: rules above, below, spike and drop against a summary; spike and drop need three values.

    Above and below compare the last value with the threshold; a spike is a
    last value above threshold times the mean, a drop one below threshold times the maximum.
    """
    joined = summary.join(F.broadcast(rules), key)
    fired = (
        F.when(F.col("kind") == "above", F.col("last") > F.col("threshold"))
        .when(F.col("kind") == "below", F.col("last") < F.col("threshold"))
        .when(F.col("kind") == "spike", (F.col("n") >= 3) & (F.col("last") > F.col("threshold") * F.col("mean")))
        .when(F.col("kind") == "drop", (F.col("n") >= 3) & (F.col("last") < F.col("threshold") * F.col("high")))
    )
    return joined.select(key, "kind", F.coalesce(fired, F.lit(False)).cast("int").alias("fired"))


def islands(df: DataFrame, by: list[str], order: list[str], state: Column) -> DataFrame:
    """``state, run``: runs of rows of equal state are numbered within a group."""
    w = _by(by, order)
    marked = df.withColumn("state", state).withColumn("__s", F.lag("state").over(w))
    return marked.withColumn("run", F.sum(F.when(F.col("state").eqNullSafe(F.col("__s")), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__s")


def sustained(df: DataFrame, by: list[str], order: list[str], value: str, threshold: float, rows: int) -> DataFrame:
    """``by..., fired``: how often the value stayed above the threshold for ``rows`` rows; after firing the count starts anew."""
    runs = islands(df, by, order, F.coalesce(F.col(value) > threshold, F.lit(False))).where("state").groupBy(*by, "run").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy(*by).agg(F.sum(F.floor(F.col("n") / rows)).cast("bigint").alias("fired"))


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, right_at: str, take: str, out: str) -> DataFrame:
    """``out`` for every left row: ``take`` of the last right row strictly before it, null if there is none.

    Both sides are laid out in one order and the last right value is carried
    forward, so no row meets another but its predecessor.
    """
    l = left.withColumn("__t", F.col(at)).withColumn("__side", F.lit(0)).withColumn("__v", F.lit(None).cast(right.schema[take].dataType))
    r = right.select(*by, F.col(right_at).alias("__t"), F.lit(1).alias("__side"), F.col(take).alias("__v"))
    w = Window.partitionBy(*by).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, -1)
    both = l.unionByName(r, allowMissingColumns=True).withColumn(out, F.last("__v", ignorenulls=True).over(w))
    return both.where("__side = 0").drop("__t", "__side", "__v")
