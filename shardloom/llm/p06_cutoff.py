"""Problem 6: a score cutoff per source that keeps a target share of its records.

Method: distinct scores are counted per source (the count combines before the
shuffle), the compact frequencies are summed from the top, and the cutoff is
the highest score at which the target share is reached. The running sum has
two levels, over score ranges and inside a range, so that a source with a third
of all records is no single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..io import table
from .shardtable import CURRENT_SQL, current_shards, listed_sources, unit_score

#: Ranges into which the scores from 0 to 1 are cut for the running sum.
RANGES = 4096


def score_cutoffs(scored: DataFrame, targets: DataFrame, group: str = "source_key", score: str = "score", percent: str = "keep_pct") -> DataFrame:
    """``group, percent, cutoff, n_scored, n_kept``, one row per row of ``targets``.

    The cutoff is the highest score of the group at which at least ``percent``
    percent of its records lie at or above it; ties at the cutoff are kept. A
    null group or score is not counted. A group without scored records has a
    null cutoff and zero counts. A target of 0 or less keeps the records of the
    highest score (the smallest non-empty choice); above 100 and null keep
    none. ``targets`` has one row per group.
    """
    counts = (
        scored.where(F.col(group).isNotNull() & F.col(score).isNotNull())
        .groupBy(F.col(group).alias("g"), F.col(score).alias("s"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("range", F.floor(F.col("s") * RANGES))
    )
    above = Window.partitionBy("g").orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("g")
    ranges = (
        counts.groupBy("g", "range").agg(F.sum("n").alias("in_range"))
        .withColumn("before", F.coalesce(F.sum("in_range").over(above), F.lit(0)))
        .withColumn("total", F.sum("in_range").over(every))
        .drop("in_range")
    )
    down = Window.partitionBy("g", "range").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    running = counts.join(ranges, ["g", "range"]).withColumn("reached", F.col("before") + F.sum("n").over(down))
    wanted = targets.select(F.col(group).alias("g"), F.col(percent).alias("p"))
    best = (
        running.join(wanted, "g")
        .where(F.col("reached") * 100 >= F.col("p") * F.col("total"))
        .groupBy("g")
        .agg(F.max(F.struct("s", "reached")).alias("best"))
    )
    totals = ranges.groupBy("g").agg(F.max("total").alias("total"))
    return (
        wanted.join(totals, "g", "left")
        .join(best, "g", "left")
        .select(
            F.col("g").alias(group),
            F.col("p").alias(percent),
            F.col("best.s").alias("cutoff"),
            F.coalesce("total", F.lit(0)).alias("n_scored"),
            F.coalesce("best.reached", F.lit(0)).alias("n_kept"),
        )
    )


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    score = F.coalesce(unit_score(F.col("final_value_score")), unit_score(F.col("light_score")))
    return current_shards(table(spark, folder, "shards")).select("shard_id", "source_key", score.alias("score"))


def p6_cutoffs(spark: SparkSession, folder: str) -> DataFrame:
    """The cutoff of every listed source, with the numbers scored and kept."""
    targets = listed_sources(table(spark, folder, "source_targets"))
    cutoffs = score_cutoffs(_scored(spark, folder), targets)
    names = targets.select("source_key", "source")
    return cutoffs.join(names, "source_key").select("source", "keep_pct", "cutoff", "n_scored", "n_kept")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The kept shards."""
    scored = _scored(spark, folder)
    cutoffs = score_cutoffs(scored, listed_sources(table(spark, folder, "source_targets")))
    return scored.join(cutoffs, "source_key").where("score >= cutoff").select("shard_id")


QUERIES = {"p6_found": p6_found, "p6_cutoffs": p6_cutoffs}

_SCORED_SQL = f"""WITH {CURRENT_SQL},
valid AS (
  SELECT shard_id, source_key,
         CASE WHEN NOT isnan(final_value_score) AND final_value_score BETWEEN 0 AND 1 THEN final_value_score
              WHEN NOT isnan(light_score) AND light_score BETWEEN 0 AND 1 THEN light_score END AS score
  FROM cur
),
scored AS (
  SELECT v.*, l.source, l.keep_pct FROM valid v JOIN listed l USING (source_key) WHERE score IS NOT NULL
),
reach AS (
  SELECT *, count(*) OVER (PARTITION BY source_key ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reached,
         count(*) OVER (PARTITION BY source_key) AS total
  FROM scored
),
cuts AS (
  SELECT source_key, max(score) AS cutoff FROM reach WHERE reached * 100 >= keep_pct * total GROUP BY source_key
)
"""

SQL = {
    "p6_found": _SCORED_SQL + "SELECT shard_id FROM scored JOIN cuts USING (source_key) WHERE score >= cutoff",
    "p6_cutoffs": _SCORED_SQL
    + """SELECT l.source, l.keep_pct, c.cutoff, count(s.shard_id) AS n_scored, count(*) FILTER (s.score >= c.cutoff) AS n_kept
FROM listed l LEFT JOIN cuts c USING (source_key) LEFT JOIN scored s USING (source_key)
GROUP BY l.source, l.keep_pct, c.cutoff""",
}
