"""Observation logs: running means by role, contrastive attribution, mixes and drifts.

An observation log has shard, campaign, iteration, role (included or excluded)
and measured values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clamp, redistribute


def running_fold(log: DataFrame, by: list[str], order: list[str], value: str, alpha: float | None = None) -> DataFrame:
    """``by..., n, mean``: the mean as an observer keeps it, one observation after another.

    Every observation counts, also a null one, which leaves the mean as it is;
    the first value after nulls becomes the mean outright. ``alpha`` gives an
    exponential mean instead of 1/n. A group's values are folded in order, so
    memory is that of the group's values.
    """
    state = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("double").alias("m"))

    def step(s: Column, x: Column) -> Column:
        v = x["v"]
        n = s["n"] + 1
        rate = F.lit(alpha) if alpha is not None else 1.0 / n
        m = F.when(v.isNull(), s["m"]).when(s["m"].isNull(), v).otherwise(s["m"] + (v - s["m"]) * rate)
        return F.struct(n.alias("n"), m.alias("m"))

    rows = log.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("v")))).alias("o"))
    return rows.select(*by, F.aggregate("o", state, step).alias("s")).select(*by, F.col("s.n").alias("n"), F.col("s.m").alias("mean"))


def role_means(log: DataFrame, by: list[str], value: str, role: str = "role") -> DataFrame:
    """Plain means and counts per role: ``by..., included_mean, excluded_mean, included_n, excluded_n``."""
    side = lambda r: F.when(F.col(role) == r, F.col(value))
    return log.groupBy(*by).agg(
        F.avg(side("included")).alias("included_mean"),
        F.avg(side("excluded")).alias("excluded_mean"),
        F.count(side("included")).alias("included_n"),
        F.count(side("excluded")).alias("excluded_n"),
    )


def attribution_by_source(log: DataFrame, value: str, min_obs: int = 2, trusted: int = 5, campaign: str = "campaign", shard: str = "shard", source: str = "source") -> DataFrame:
    """``source, shards, attribution, spread, ubiquity, trusted``.

    Within a campaign a shard's attribution is its included minus its excluded
    mean, if both rest on ``min_obs`` observations; a source's is the mean over
    its shards and campaigns. Ubiquity is the share of campaigns it occurs in.
    """
    per = role_means(log, [campaign, source, shard], value).where((F.col("included_n") >= min_obs) & (F.col("excluded_n") >= min_obs))
    per = per.withColumn("a", F.col("included_mean") - F.col("excluded_mean"))
    campaigns = log.select(campaign).distinct().count()
    return per.groupBy(source).agg(
        F.count(F.lit(1)).alias("shards"),
        F.round(F.avg("a"), 4).alias("attribution"),
        F.round(F.stddev_pop("a"), 4).alias("spread"),
        F.round(F.countDistinct(campaign) / F.lit(max(1, campaigns)), 4).alias("ubiquity"),
        (F.count(F.lit(1)) >= trusted).cast("int").alias("trusted"),
    )


def confidence(included_n: Column, excluded_n: Column, min_obs: int) -> Column:
    """0 unless both counts reach ``min_obs``, else their harmonic mean by it, at most 1."""
    harmonic = 2.0 * included_n * excluded_n / (included_n + excluded_n)
    return F.when((included_n >= min_obs) & (excluded_n >= min_obs), F.least(F.lit(1.0), harmonic / min_obs)).otherwise(F.lit(0.0))


#: Weights of the three signals, the least loss and the span of losses, and what hard records and a long loss tail change.
REF_WEIGHT, COND_WEIGHT, LOSS_WEIGHT = 0.20, 0.65, 0.15
LOSS_LOW, LOSS_SPAN = 0.3, 2.7
HARD_BONUS, HARD_SCALE = 0.05, 50.0
TAIL_MALUS, TAIL_LOW, TAIL_HIGH = 0.05, 1.5, 4.5


def composite(ref: Column, cond: Column, loss: Column | None = None) -> Column:
    """Weighted mean of the signals that are present, each brought to 0..1; null without any.

    Gaps run from -0.5 to 0.5, losses from 0.3 (best) to 3.0; what lies beyond counts as the end.
    """
    parts = [(clamp(ref + 0.5), REF_WEIGHT), (clamp(cond + 0.5), COND_WEIGHT)]
    if loss is not None:
        parts.append((1.0 - clamp((loss - LOSS_LOW) / LOSS_SPAN), LOSS_WEIGHT))
    return redistribute(parts, 1.0)


def effective(raw: Column, sure: Column, attributed: Column, hard: Column | None = None, tail: Column | None = None) -> Column:
    """Raw score plus trusted attribution, a bonus for hard records and a malus for a long loss tail, within 0 and 1.

    Without attribution or confidence the raw score is the start; a null raw score stays null.
    """
    score = F.when(attributed.isNotNull() & (sure > 0), clamp(raw + sure * attributed)).otherwise(raw)
    if hard is not None:
        score = score + HARD_BONUS * F.least(F.lit(1.0), F.coalesce(hard, F.lit(0)) / HARD_SCALE)
    if tail is not None:
        score = score - TAIL_MALUS * F.coalesce(clamp((tail - TAIL_LOW) / (TAIL_HIGH - TAIL_LOW)), F.lit(0.0))
    return clamp(score)


def observation_fold(log: DataFrame, by: list[str], order: list[str], values: list[str], role: str = "role") -> DataFrame:
    """Per group and role the number of observations, the means of the values and their last ones that are not null.

    ``by..., n_<role>, <value>_<role>, last_<value>_<role>`` for the roles
    included and excluded. Equal-weighted means do not depend on the order, so
    nothing is folded; last values are by ``order``, which has to be total.
    """
    aggs = []
    for r in ("included", "excluded"):
        own = F.col(role) == r
        aggs.append(F.count_if(own).alias(f"n_{r}"))
        for v in values:
            aggs.append(F.avg(F.when(own, F.col(v))).alias(f"{v}_{r}"))
            aggs.append(F.max_by(v, F.when(own & F.col(v).isNotNull(), F.struct(*order))).alias(f"last_{v}_{r}"))
    return log.groupBy(*by).agg(*aggs)


def latest_observation(log: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The last row of each group."""
    w = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return log.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def iteration_mix(log: DataFrame, iteration: str, source: str) -> DataFrame:
    """``iteration, source, n, share`` of included observations."""
    n = log.groupBy(iteration, source).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(iteration)), 4))


def share_drift(log: DataFrame, iteration: str, source: str, flagged: float = 0.02, least: int = 6) -> DataFrame:
    """``source, first_share, last_share, change, drifted``: shares in the first and last third of the iterations.

    With fewer than ``least`` iterations there is no row.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(iteration)  # one row per iteration
    steps = log.select(iteration).distinct()
    placed = steps.withColumn("i", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    third = F.when(F.col("i") <= F.floor(F.col("n") / 3), "first").when(F.col("i") > F.col("n") - F.floor(F.col("n") / 3), "last")
    thirds = placed.where(F.col("n") >= least).select(iteration, third.alias("part")).where("part IS NOT NULL")
    counts = log.join(F.broadcast(thirds), iteration).groupBy(source).agg(F.count_if(F.col("part") == "first").alias("f"), F.count_if(F.col("part") == "last").alias("l"))
    whole = Window.partitionBy(F.lit(0))  # one row per source
    first, last = F.col("f") / F.sum("f").over(whole), F.col("l") / F.sum("l").over(whole)
    return counts.select(source, F.round(first, 4).alias("first_share"), F.round(last, 4).alias("last_share"), F.round(last - first, 4).alias("change"), (F.abs(last - first) > flagged).cast("int").alias("drifted"))
