"""Ranks over a whole table without one task seeing all of it, top-k cuts and seeded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

def _laid_out(df: DataFrame, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """The rows in ranges of a total order, with ``__r`` the range and ``__p`` the place in it, and per range how many rows lie before it.

    Ranges come from a sample of all order columns together, so that neither a
    long tail nor a value or group of a third of all rows fills one range. Only
    the table of ranges is ordered as a whole.
    """
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # the number of the range and the place in it
    laid = stage(laid.withColumn("__m", F.monotonically_increasing_id()), "ranked")
    laid = laid.withColumn("__r", F.shiftright("__m", 33)).withColumn("__p", F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).drop("__m")
    over = Window.partitionBy(F.lit(0)).orderBy("__r")  # one row per range
    counts = laid.groupBy("__r").agg(F.count(F.lit(1)).alias("__n"))
    return laid, counts.select("__r", (F.sum("__n").over(over.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__b"), F.sum("__n").over(Window.partitionBy(F.lit(0))).alias("__t"))


def global_rank(df: DataFrame, value: Column, tiebreak: str, rank: str = "rank", total: str = "total") -> DataFrame:
    """``rank`` from 1 by ``value`` descending, then ``tiebreak`` ascending, and the number ranked.

    Rows whose value is null are not ranked: their rank is null. A row's rank is
    the number of rows in earlier ranges plus its place in its own.
    """
    keyed = df.withColumn("__v", value)
    laid, offsets = _laid_out(keyed.where("__v IS NOT NULL"), [F.desc("__v"), F.asc(tiebreak)])
    # rank and total may have any names, also those used here
    own = [F.col(f"`{c}`") for c in df.columns if c not in (rank, total)]
    ranked = laid.join(F.broadcast(offsets), "__r").select(*own, (F.col("__b") + F.col("__p") + 1).alias(rank), F.col("__t").alias(total))
    rest = keyed.where("__v IS NULL").drop("__v").withColumn(rank, F.lit(None).cast("bigint")).withColumn(total, F.lit(None).cast("bigint"))
    return ranked.unionByName(rest)


def ordered_place(df: DataFrame, order: list[Column], place: str = "place") -> DataFrame:
    """``place`` from 0 of every row in a total order."""
    laid, offsets = _laid_out(df, order)
    own = [F.col(f"`{c}`") for c in df.columns if c != place]
    return laid.join(F.broadcast(offsets), "__r").select(*own, (F.col("__b") + F.col("__p")).alias(place))


def group_rank(df: DataFrame, group: list[str], order: list[Column], rank: str = "rank", total: str = "total") -> DataFrame:
    """``rank`` from 1 inside each group by a total order, and the group's size, without a task per group.

    Rows lie in ranges of group and order; a rank is the place in the whole
    less the group's first one. A null group is a group.
    """
    laid, offsets = _laid_out(df, [*[F.asc(g) for g in group], *order])
    placed = laid.join(F.broadcast(offsets.drop("__t")), "__r").withColumn("__x", F.col("__b") + F.col("__p"))
    firsts = placed.groupBy(*group).agg(F.min("__x").alias("__f"), F.count(F.lit(1)).alias(total))
    renamed = firsts.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], "__f", total)
    same = None
    for i, g in enumerate(group):
        c = F.col(g).eqNullSafe(F.col(f"__g{i}"))
        same = c if same is None else same & c
    return placed.join(renamed, same).withColumn(rank, F.col("__x") - F.col("__f") + 1).drop("__r", "__p", "__b", "__x", "__f", *[f"__g{i}" for i in range(len(group))])


def group_index_values(df: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """``group, n, <name>...``: of every group the value at index floor(share * n), from 0, of its ordered values; nulls are left out."""
    ranked = group_rank(df.where(F.col(value).isNotNull()).select(group, value), [group], [F.asc(value)], "__k", "__n")
    at = lambda s: F.least(F.col("__n"), F.floor(F.col("__n") * s) + 1)
    return ranked.groupBy(group).agg(F.max("__n").alias("n"), *[F.max(F.when(F.col("__k") == at(s), F.col(value))).alias(name) for name, s in shares.items()])


def top_share(rank: Column, total: Column, percent: float) -> Column:
    """Among the first max(1, floor(total * percent / 100)) ranks; false for unranked rows."""
    return F.coalesce(rank <= F.greatest(F.lit(1), F.floor(total * F.lit(percent) / 100)), F.lit(False))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group; the order has to be total. Spark cuts to k before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def seeded_order(key: str | Column, seed: int) -> Column:
    """A random but repeatable number of 60 bits by key: the first digits of the MD5 of key and seed, as any engine can make it."""
    text = F.concat_ws(":", (F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def seeded_slice(df: DataFrame, group: str, key: str, index: int, of: int, seed: int = 42, ranges: int = 256) -> DataFrame:
    """Slice ``index`` (from 1) of ``of`` of each group in a seeded order; slices are disjoint and together whole."""
    keyed = df.withColumn("__h", seeded_order(key, seed)).withColumn("__r", F.shiftright("__h", 52))
    counts = keyed.groupBy(group, "__r").agg(F.count(F.lit(1)).alias("__n"))
    by = Window.partitionBy(group)
    before = by.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "__r", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__b"), F.sum("__n").over(by).alias("__t"))
    inside = Window.partitionBy(group, "__r").orderBy("__h", key)
    placed = keyed.join(offsets, [group, "__r"]).withColumn("__p", F.col("__b") + F.row_number().over(inside) - 1)
    low = F.floor(F.lit(index - 1) * F.col("__t") / of)
    high = F.floor(F.lit(index) * F.col("__t") / of)
    return placed.where((F.col("__p") >= low) & (F.col("__p") < high)).select(*df.columns)


def weighted_sample(df: DataFrame, key: str, weight: Column, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows drawn without replacement with probability by weight: greatest u ** (1 / w). Null and zero weights are never drawn."""
    u = (seeded_order(key, seed) + 1) / F.lit(float(1 << 60))
    return df.withColumn("__k", F.when(weight > 0, F.ln(u) / weight)).where("__k IS NOT NULL").orderBy(F.desc("__k"), key).limit(n).drop("__k")


def reservoir(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """A uniform sample of ``n`` rows, the same for the same seed."""
    return df.orderBy(seeded_order(key, seed), key).limit(n)


def stride_sample(df: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """Every (size // n)-th row of a group in order of key, the first ``n`` of them."""
    by = Window.partitionBy(group)
    ranked = df.withColumn("__p", F.row_number().over(by.orderBy(key)) - 1).withColumn("__t", F.count(F.lit(1)).over(by))
    step = F.greatest(F.lit(1), F.floor(F.col("__t") / n))
    return ranked.where((F.col("__p") % step == 0) & (F.col("__p") / step < n)).drop("__p", "__t")


def with_replacement(main: DataFrame, others: dict[str, tuple[DataFrame, float]], key: str, seed: int = 42) -> DataFrame:
    """``key, part``: the main rows once each (part ``main``), and rows drawn with replacement so that part ``name`` has its share of the whole.

    ``others`` gives a table and a share for each further part; shares of 1 or
    more together are an error. A part draws floor(main * share / (1 - sum of
    shares)) rows by a seeded number; an empty part draws none.
    """
    shares = sum(share for _, share in others.values())
    if shares >= 1 or any(share < 0 for _, share in others.values()):
        raise ValueError("the shares of the other parts must be below 1 together")
    spark, n = main.sparkSession, main.count()
    out = main.select(F.col(key), F.lit("main").alias("part"))
    for name, (rows, share) in others.items():
        draws = int(n * share / (1 - shares) + 1e-9)
        placed = global_rank(rows.select(key), F.lit(0), key)
        size = rows.count()
        if draws and size:
            drawn = spark.range(draws).select((F.pmod(seeded_order("id", seed), F.lit(size)) + 1).alias("rank"))
            out = out.union(drawn.join(placed, "rank").select(key, F.lit(name).alias("part")))
    return out
