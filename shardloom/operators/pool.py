"""The scored pool: its rows, campaigns over it, and comparisons of selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import finite, redistribute
from ..io import latest_rows
from .ranking import global_rank, top_share

SCORES = ("light_score", "final_value_score", "training_loss_normalized", "aesthetic_avg", "caption_quality", "diversity_score")


def load_pool(shards: DataFrame) -> DataFrame:
    """One row per shard, the latest indexed; NaN scores are missing; a missing score falls back to the unified one."""
    pool = latest_rows(shards, "shard_id", "indexed_at")
    for s in SCORES:
        pool = pool.withColumn(s, finite(F.col(s)))
    return pool.withColumn("light_score", F.coalesce("light_score", "final_value_score")).withColumn("source", F.coalesce(F.lower(F.trim("source")), F.lit("unknown")))


def all_keep(pool: DataFrame) -> DataFrame:
    """Every shard that is not discarded."""
    return _flag(pool, F.coalesce("light_decision", F.lit("keep")) != "discard")


def top_percent(pool: DataFrame, percent: float = 80) -> DataFrame:
    """The best shards by value, of those with a value above 0."""
    ranked = global_rank(pool, F.when(F.col("final_value_score") > 0, F.col("final_value_score")), "shard_id")
    return _flag(ranked, top_share(F.col("rank"), F.col("total"), percent)).drop("rank", "total")


def source_boost(pool: DataFrame, source: str, percent: float = 50) -> DataFrame:
    """All of one source, and the best of the rest."""
    own = F.col("source") == source.lower()
    ranked = global_rank(pool, F.when(~own & (F.col("final_value_score") > 0), F.col("final_value_score")), "shard_id")
    return _flag(ranked, own | top_share(F.col("rank"), F.col("total"), percent)).drop("rank", "total")


def balanced(pool: DataFrame, percent: float = 50) -> DataFrame:
    """The best share of each source, at least one shard of each that has a value above 0."""
    value = F.when(F.col("final_value_score") > 0, F.col("final_value_score"))
    bucket = F.floor(value * 1023)
    by = Window.partitionBy("source")
    counts = pool.where(value.isNotNull()).groupBy("source", bucket.alias("__r")).agg(F.count(F.lit(1)).alias("__n"))
    down = by.orderBy(F.desc("__r")).rowsBetween(Window.unboundedPreceding, 0)
    offsets = counts.select("source", "__r", (F.sum("__n").over(down) - F.col("__n")).alias("__b"), F.sum("__n").over(by).alias("__t"))
    inside = Window.partitionBy("source", "__r").orderBy(F.desc("final_value_score"), "shard_id")
    ranked = pool.withColumn("__r", bucket).join(offsets, ["source", "__r"], "left")
    rank = F.when(value.isNotNull(), F.col("__b") + F.row_number().over(inside))
    return _flag(ranked, top_share(rank, F.col("__t"), percent)).drop("__r", "__b", "__t")


def hard_focus(pool: DataFrame, percent: float = 50) -> DataFrame:
    """The hardest shards by loss, else by low light score, of those with a value above 0."""
    hard = F.coalesce("training_loss_normalized", 1.0 - F.coalesce("light_score", F.lit(0.0)))
    ranked = global_rank(pool, F.when(F.col("final_value_score") > 0, hard), "shard_id")
    return _flag(ranked, top_share(F.col("rank"), F.col("total"), percent)).drop("rank", "total")


def _flag(df: DataFrame, on: Column) -> DataFrame:
    return df.withColumn("decision", F.when(F.coalesce(on, F.lit(False)), F.lit("include")).otherwise(F.lit("exclude")))


def diversity_weighted(pool: DataFrame, weight: float = 0.3) -> DataFrame:
    """``reweighted``: diversity with its weight; the rest 65 to 35 between light score and loss, over what is there."""
    w = max(0.0, min(0.99, weight))
    value = redistribute([(F.col("diversity_score"), w), (F.col("light_score"), (1 - w) * 0.65), (F.col("training_loss_normalized"), (1 - w) * 0.35)], 1.0)
    return pool.withColumn("reweighted", value)


def compare_selections(left: DataFrame, right: DataFrame) -> DataFrame:
    """``shard_id, side`` for every shard that either includes: both, left or right."""
    a = left.where("decision = 'include'").select("shard_id").distinct().withColumn("a", F.lit(1))
    b = right.where("decision = 'include'").select("shard_id").distinct().withColumn("b", F.lit(1))
    side = F.when(F.col("a").isNull(), "right").when(F.col("b").isNull(), "left").otherwise("both")
    return a.join(b, "shard_id", "full_outer").select("shard_id", side.alias("side"))


def selection_checksum(selection: DataFrame, prefix: int = 3) -> DataFrame:
    """``part, checksum``: SHA-256 of the ordered (id, decision) pairs that share an id prefix.

    The whole selection's checksum is that of its parts; so no task holds every
    id. A null decision counts as empty.
    """
    pair = F.struct("shard_id", F.coalesce("decision", F.lit("")).alias("decision"))
    parts = selection.groupBy(F.substring("shard_id", 1, prefix).alias("part")).agg(F.array_sort(F.collect_list(pair)).alias("p"))
    text = F.array_join(F.transform("p", lambda x: F.concat_ws(":", x["shard_id"], x["decision"])), ";")
    return parts.select("part", F.sha2(text, 256).alias("checksum"))
