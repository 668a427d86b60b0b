"""Queries over the scored pool: the boolean language, strategies, selections, rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dsl.compiler import decide, evaluate
from ..io import latest_rows, table
from ..operators import pool as P
from ..operators import ranking as R

POOL_SQL = """pool AS (
  SELECT shard_id, path, coalesce(lower(trim(source, ' ')), 'unknown') AS source, n_images, file_size_bytes, has_light_score,
         coalesce(CASE WHEN NOT isnan(light_score) THEN light_score END, CASE WHEN NOT isnan(final_value_score) THEN final_value_score END) AS light_score, light_decision,
         CASE WHEN NOT isnan(aesthetic_avg) THEN aesthetic_avg END AS aesthetic_avg, CASE WHEN NOT isnan(caption_quality) THEN caption_quality END AS caption_quality, has_unified,
         CASE WHEN NOT isnan(final_value_score) THEN final_value_score END AS final_value_score, CASE WHEN NOT isnan(training_loss_normalized) THEN training_loss_normalized END AS training_loss_normalized,
         CASE WHEN NOT isnan(diversity_score) THEN diversity_score END AS diversity_score, diversity_source, indexed_at
  FROM (SELECT *, row_number() OVER (PARTITION BY shard_id ORDER BY indexed_at DESC NULLS LAST) AS rn FROM shards WHERE shard_id IS NOT NULL) WHERE rn = 1
)"""
VALUE_RANK = """vr AS (
  SELECT shard_id, row_number() OVER (ORDER BY final_value_score DESC, shard_id) AS r, count(*) OVER () AS n FROM pool WHERE final_value_score > 0
)"""


def _pool(spark: SparkSession, folder: str) -> DataFrame:
    return P.load_pool(table(spark, folder, "shards"))


QUERIES: dict = {}
SQL: dict[str, str] = {}


def _expression(name: str, text: str, where: str, ctes: str = "") -> None:
    """A query that lists the shards an expression selects, and its SQL."""
    QUERIES[name] = lambda spark, folder: evaluate(_pool(spark, folder), text).where("included").select("shard_id")
    SQL[name] = f"WITH {POOL_SQL}{', ' + ctes if ctes else ''} SELECT shard_id FROM pool p {where}"


_expression("dsl_top_pct_not_source", "top_pct(35) AND NOT source:artscan", "JOIN vr USING (shard_id) WHERE r <= greatest(1, floor(n * 0.35)) AND source <> 'artscan'", VALUE_RANK)
_expression("dsl_top_n", "top_n(25)", "JOIN vr USING (shard_id) WHERE r <= 25", VALUE_RANK)
_expression("dsl_keep", "keep AND all_unified", "WHERE coalesce(light_decision, 'keep') <> 'discard' AND coalesce(has_unified, 0) <> 0")
_expression("dsl_thresholds", "min_score(0.4) OR min_light(.7) AND NOT min_loss(0.6)", "WHERE coalesce(final_value_score >= 0.4, false) OR (coalesce(light_score >= 0.7, false) AND NOT coalesce(training_loss_normalized >= 0.6, false))")
_expression("dsl_nulls_as_zero", "min_aesthetic(0.3) AND min_caption(.3) AND NOT min_diversity(0.6)", "WHERE coalesce(aesthetic_avg, 0) >= 0.3 AND coalesce(caption_quality, 0) >= 0.3 AND NOT coalesce(diversity_score, 0) >= 0.6")
_expression("dsl_low_caption", "low_caption AND NOT (source:openalt OR src(herbaria))", "WHERE coalesce(caption_quality, 0) < 0.45 AND NOT (source = 'openalt' OR source = 'herbaria')")
_expression(
    "dsl_hard_focus",
    "hard_focus(30) AND NOT top_pct(10)",
    """JOIN hr USING (shard_id) LEFT JOIN vr USING (shard_id)
WHERE hr.r <= greatest(1, floor(hr.n * 0.3)) AND NOT coalesce(vr.r <= greatest(1, floor(vr.n * 0.1)), false)""",
    VALUE_RANK + """, hr AS (
  SELECT shard_id, row_number() OVER (ORDER BY coalesce(training_loss_normalized, 1 - coalesce(light_score, 0)) DESC, shard_id) AS r, count(*) OVER () AS n FROM pool
)""",
)
_expression(
    "dsl_high_diversity",
    "high_diversity(20)",
    "JOIN dr USING (shard_id) WHERE r <= greatest(1, floor(n * 0.2))",
    "dr AS (SELECT shard_id, row_number() OVER (ORDER BY diversity_score DESC, shard_id) AS r, count(*) OVER () AS n FROM pool WHERE diversity_score IS NOT NULL)",
)


def dsl_campaign_reference(spark: SparkSession, folder: str) -> DataFrame:
    """An expression over a stored selection, and overrides with a base and a floor."""
    pool = _pool(spark, folder)
    stored = {"best": P.top_percent(pool, 40).select("shard_id", "decision")}
    chosen = evaluate(pool, "best AND NOT source:promptgen OR campaign(best) AND min_light(0.8)", stored)
    return decide(chosen, include=["0000001", "0000002"], exclude=["0000003"], floor=0.2, base=stored["best"])


QUERIES["dsl_campaign_reference"] = dsl_campaign_reference
SQL["dsl_campaign_reference"] = f"""WITH {POOL_SQL}, {VALUE_RANK},
flagged AS (SELECT p.*, coalesce(r <= greatest(1, floor(n * 0.4)), false) AS best FROM pool p LEFT JOIN vr USING (shard_id))
SELECT shard_id, CASE WHEN shard_id IN ('0000001', '0000002') THEN 'include' WHEN shard_id = '0000003' THEN 'exclude'
  WHEN ((best AND source <> 'promptgen') OR (best AND coalesce(light_score >= 0.8, false))) AND best AND coalesce(final_value_score, 0) >= 0.2 THEN 'include'
  ELSE 'exclude' END AS decision FROM flagged"""


def _strategy(name: str, make, decision: str, ctes: str = VALUE_RANK) -> None:
    QUERIES[name] = lambda spark, folder: make(_pool(spark, folder)).select("shard_id", "decision")
    SQL[name] = f"WITH {POOL_SQL}, {ctes} SELECT p.shard_id, CASE WHEN coalesce({decision}, false) THEN 'include' ELSE 'exclude' END AS decision FROM pool p LEFT JOIN vr USING (shard_id)"


_strategy("strategy_all_keep", P.all_keep, "coalesce(light_decision, 'keep') <> 'discard'")
_strategy("strategy_top_pct", P.top_percent, "r <= greatest(1, floor(n * 0.8))")
_strategy(
    "strategy_source_boost",
    lambda pool: P.source_boost(pool, "openalt", 30),
    "source = 'openalt' OR r <= greatest(1, floor(n * 0.3))",
    "vr AS (SELECT shard_id, row_number() OVER (ORDER BY final_value_score DESC, shard_id) AS r, count(*) OVER () AS n FROM pool WHERE final_value_score > 0 AND source <> 'openalt')",
)
_strategy(
    "strategy_balanced",
    P.balanced,
    "r <= greatest(1, floor(n * 0.5))",
    "vr AS (SELECT shard_id, row_number() OVER (PARTITION BY source ORDER BY final_value_score DESC, shard_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM pool WHERE final_value_score > 0)",
)
_strategy(
    "strategy_hard_focus",
    P.hard_focus,
    "r <= greatest(1, floor(n * 0.5))",
    "vr AS (SELECT shard_id, row_number() OVER (ORDER BY coalesce(training_loss_normalized, 1 - coalesce(light_score, 0)) DESC, shard_id) AS r, count(*) OVER () AS n FROM pool WHERE final_value_score > 0)",
)

QUERIES["diversity_weighted"] = lambda spark, folder: P.diversity_weighted(_pool(spark, folder)).select("shard_id", F.round("reweighted", 10).alias("reweighted"))
SQL["diversity_weighted"] = f"""WITH {POOL_SQL}, w AS (
  SELECT shard_id, CASE WHEN diversity_score IS NULL THEN 0 ELSE 0.3 END AS a, CASE WHEN light_score IS NULL THEN 0 ELSE 0.455 END AS b,
         CASE WHEN training_loss_normalized IS NULL THEN 0 ELSE 0.245 END AS c, coalesce(diversity_score, 0) AS d, coalesce(light_score, 0) AS l, coalesce(training_loss_normalized, 0) AS t FROM pool)
SELECT shard_id, CASE WHEN a + b + c > 0 THEN round((d * 0.3 + l * 0.455 + t * 0.245) / (a + b + c)::DOUBLE, 10) END AS reweighted FROM w"""


def manifest_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Shards of two selections by side, with counts."""
    pool = _pool(spark, folder)
    return P.compare_selections(P.top_percent(pool, 50), P.balanced(pool, 40)).groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.min("shard_id").alias("first_id"))


QUERIES["manifest_diff"] = manifest_diff
SQL["manifest_diff"] = f"""WITH {POOL_SQL}, {VALUE_RANK},
br AS (SELECT shard_id, row_number() OVER (PARTITION BY source ORDER BY final_value_score DESC, shard_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM pool WHERE final_value_score > 0),
a AS (SELECT shard_id FROM vr WHERE r <= greatest(1, floor(n * 0.5))), b AS (SELECT shard_id FROM br WHERE r <= greatest(1, floor(n * 0.4)))
SELECT CASE WHEN a.shard_id IS NULL THEN 'right' WHEN b.shard_id IS NULL THEN 'left' ELSE 'both' END AS side, count(*) AS n, min(coalesce(a.shard_id, b.shard_id)) AS first_id
FROM a FULL JOIN b ON a.shard_id = b.shard_id GROUP BY 1"""

QUERIES["manifest_checksum"] = lambda spark, folder: P.selection_checksum(P.all_keep(_pool(spark, folder)))
SQL["manifest_checksum"] = f"""WITH {POOL_SQL}
SELECT substring(shard_id, 1, 3) AS part, sha256(string_agg(shard_id || ':' || CASE WHEN coalesce(light_decision, 'keep') <> 'discard' THEN 'include' ELSE 'exclude' END, ';' ORDER BY shard_id)) AS checksum
FROM pool GROUP BY 1"""


def manifest_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of the included shards: extremes, mean, 10th and 90th value by index, median."""
    pool = P.top_percent(_pool(spark, folder), 60).where("decision = 'include'")
    ends = R.group_index_values(pool, "source", "final_value_score", {"p10": 0.1, "p90": 0.9})
    per = pool.groupBy("source").agg(*[F.round(f("final_value_score"), 10).alias(n) for n, f in (("mean", F.avg), ("median", F.median), ("low", F.min), ("high", F.max))])
    return ends.join(per, "source").select("source", "n", "mean", "median", F.round("p10", 10).alias("p10"), F.round("p90", 10).alias("p90"), "low", "high")


QUERIES["manifest_stats"] = manifest_stats
SQL["manifest_stats"] = f"""WITH {POOL_SQL}, {VALUE_RANK},
g AS (SELECT source, list_sort(list(final_value_score)) AS v, avg(final_value_score) AS m, median(final_value_score) AS md FROM pool JOIN vr USING (shard_id) WHERE r <= greatest(1, floor(n * 0.6)) GROUP BY source)
SELECT source, len(v) AS n, round(m, 10) AS mean, round(md, 10) AS median, round(v[floor(len(v) * 0.1)::INT + 1], 10) AS p10, round(v[floor(len(v) * 0.9)::INT + 1], 10) AS p90,
  round(list_min(v), 10) AS low, round(list_max(v), 10) AS high FROM g"""


def source_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Per source: shards, bytes, mean scores, kept and scored shards."""
    pool = _pool(spark, folder)
    return pool.groupBy("source").agg(
        F.count(F.lit(1)).alias("shards"),
        F.sum("file_size_bytes").alias("bytes"),
        *[F.round(F.avg(c), 10).alias(f"avg_{c}") for c in ("light_score", "aesthetic_avg", "caption_quality", "final_value_score")],
        F.count_if(F.coalesce("light_decision", F.lit("keep")) != "discard").alias("kept"),
        F.round(F.avg(F.when(F.col("has_unified") != 0, F.col("diversity_score"))), 10).alias("unified_diversity"),
    )


QUERIES["source_rollup"] = source_rollup
SQL["source_rollup"] = f"""WITH {POOL_SQL}
SELECT source, count(*) AS shards, sum(file_size_bytes)::BIGINT AS bytes, round(avg(light_score), 10) AS avg_light_score, round(avg(aesthetic_avg), 10) AS avg_aesthetic_avg,
  round(avg(caption_quality), 10) AS avg_caption_quality, round(avg(final_value_score), 10) AS avg_final_value_score,
  count(*) FILTER (coalesce(light_decision, 'keep') <> 'discard') AS kept, round(avg(diversity_score) FILTER (has_unified <> 0), 10) AS unified_diversity
FROM pool GROUP BY source"""


def source_fraction(spark: SparkSession, folder: str) -> DataFrame:
    """Each source's share of the pool."""
    counts = _pool(spark, folder).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    return counts.select("source", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6).alias("share"))


QUERIES["source_fraction"] = source_fraction
SQL["source_fraction"] = f"WITH {POOL_SQL} SELECT source, count(*) AS n, round(count(*) / (SELECT count(*) FROM pool), 6) AS share FROM pool GROUP BY source"


def unified_score(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted score of what is present, weights of missing signals shared out, min-max scaled loss."""
    from ..functions.numeric import clamp, redistribute

    pool = _pool(spark, folder)
    low, high = pool.agg(F.min("training_loss_normalized"), F.max("training_loss_normalized")).first()
    scaled = F.lit(0.5) if low is None or low == high else (F.col("training_loss_normalized") - low) / (high - low)
    loss = F.when(F.col("training_loss_normalized").isNotNull(), scaled)
    value = redistribute([(F.col("light_score"), 0.35), (F.col("aesthetic_avg"), 0.15), (F.col("caption_quality"), 0.15), (F.col("diversity_score"), 0.15), (loss, 0.2)], 1.0)
    return pool.select("shard_id", F.round(clamp(value), 10).alias("unified"))


QUERIES["unified_score"] = unified_score
SQL["unified_score"] = f"""WITH {POOL_SQL},
mm AS (SELECT min(training_loss_normalized) AS lo, max(training_loss_normalized) AS hi FROM pool),
p AS (SELECT shard_id, [light_score, aesthetic_avg, caption_quality, diversity_score, CASE WHEN training_loss_normalized IS NOT NULL THEN CASE WHEN lo = hi THEN 0.5 ELSE (training_loss_normalized - lo) / (hi - lo) END END] AS v,
  [0.35::DOUBLE, 0.15, 0.15, 0.15, 0.2] AS w FROM pool, mm),
s AS (SELECT shard_id, list_sum([CASE WHEN v[i] IS NULL THEN 0 ELSE w[i] END FOR i IN [1, 2, 3, 4, 5]]) AS have, list_sum([coalesce(v[i] * w[i], 0) FOR i IN [1, 2, 3, 4, 5]]) AS val FROM p)
SELECT shard_id, CASE WHEN have > 0 THEN round(greatest(0, least(1, val / have)), 10) END AS unified FROM s"""


def index_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Quartiles by floor index of every source's light scores."""
    per = R.group_index_values(_pool(spark, folder), "source", "light_score", {f"p{int(x * 100)}": x for x in (0.25, 0.5, 0.75)})
    return per.select("source", *[F.round(c, 10).alias(c) for c in ("p25", "p50", "p75")])


QUERIES["index_percentiles"] = index_percentiles
SQL["index_percentiles"] = f"""WITH {POOL_SQL}, g AS (SELECT source, list_sort(list(light_score)) AS v FROM pool WHERE light_score IS NOT NULL GROUP BY source)
SELECT source, round(v[floor(len(v) * 0.25)::INT + 1], 10) AS p25, round(v[floor(len(v) * 0.5)::INT + 1], 10) AS p50, round(v[floor(len(v) * 0.75)::INT + 1], 10) AS p75 FROM g"""


def light_pool_report(spark: SparkSession, folder: str) -> DataFrame:
    """Per source: share kept and whether the source is judged strictly or leniently."""
    pool = _pool(spark, folder)
    kept = F.count_if(F.coalesce("light_decision", F.lit("keep")) != "discard")
    share = kept / F.count(F.lit(1))
    return pool.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(share * 100, 2).alias("kept_pct"),
        F.when(share < 0.5, "strict").when(share > 0.95, "lenient").otherwise("even").alias("judgement"),
        F.round(F.avg("light_score"), 10).alias("mean_light"),
    )


QUERIES["light_pool_report"] = light_pool_report
SQL["light_pool_report"] = f"""WITH {POOL_SQL}, g AS (SELECT source, count(*) AS n, count(*) FILTER (coalesce(light_decision, 'keep') <> 'discard') / count(*) AS s, avg(light_score) AS m FROM pool GROUP BY source)
SELECT source, n, round(s * 100, 2) AS kept_pct, CASE WHEN s < 0.5 THEN 'strict' WHEN s > 0.95 THEN 'lenient' ELSE 'even' END AS judgement, round(m, 10) AS mean_light FROM g"""


def unified_pool_report(spark: SparkSession, folder: str) -> DataFrame:
    """Coverage by unified scores and the gap between unified and light scores, per source."""
    pool = _pool(spark, folder)
    unified = F.col("has_unified") != 0
    return pool.groupBy("source").agg(
        F.round(F.avg(F.when(unified, 1.0).otherwise(0.0)), 10).alias("coverage"),
        F.round(F.avg(F.when(unified & F.col("training_loss_normalized").isNotNull(), 1.0).otherwise(0.0)), 10).alias("with_loss"),
        F.round(F.avg(F.col("final_value_score") - F.col("light_score")), 10).alias("gap"),
    )


QUERIES["unified_pool_report"] = unified_pool_report
SQL["unified_pool_report"] = f"""WITH {POOL_SQL}
SELECT source, round(avg(CASE WHEN has_unified <> 0 THEN 1.0 ELSE 0.0 END), 10) AS coverage, round(avg(CASE WHEN has_unified <> 0 AND training_loss_normalized IS NOT NULL THEN 1.0 ELSE 0.0 END), 10) AS with_loss,
  round(avg(final_value_score - light_score), 10) AS gap FROM pool GROUP BY source"""


def index_vs_previous(spark: SparkSession, folder: str) -> DataFrame:
    """Shards that only the earlier or only the later half of the index knows (two anti joins)."""
    shards = table(spark, folder, "shards").where("shard_id IS NOT NULL")
    early = shards.where("indexed_at < timestamp '2025-07-01'").select("shard_id").distinct()
    late = shards.where("indexed_at >= timestamp '2025-07-01'").select("shard_id").distinct()
    gone = early.join(late, "shard_id", "left_anti").withColumn("side", F.lit("only_early"))
    return gone.union(late.join(early, "shard_id", "left_anti").withColumn("side", F.lit("only_late")))


QUERIES["index_vs_previous"] = index_vs_previous
SQL["index_vs_previous"] = """WITH e AS (SELECT DISTINCT shard_id FROM shards WHERE indexed_at < TIMESTAMP '2025-07-01' AND shard_id IS NOT NULL), l AS (SELECT DISTINCT shard_id FROM shards WHERE indexed_at >= TIMESTAMP '2025-07-01' AND shard_id IS NOT NULL)
SELECT shard_id, 'only_early' AS side FROM e WHERE shard_id NOT IN (SELECT shard_id FROM l) UNION ALL SELECT shard_id, 'only_late' FROM l WHERE shard_id NOT IN (SELECT shard_id FROM e)"""


def top_bottom_preview(spark: SparkSession, folder: str) -> DataFrame:
    """The three highest and three lowest valued shards of each source."""
    from pyspark.sql import Window

    pool = _pool(spark, folder).where("final_value_score IS NOT NULL").select("source", "shard_id", "final_value_score")
    high = Window.partitionBy("source").orderBy(F.desc("final_value_score"), "shard_id")
    low = Window.partitionBy("source").orderBy(F.asc("final_value_score"), "shard_id")
    top = pool.withColumn("place", F.row_number().over(high)).where("place <= 3").withColumn("side", F.lit("top"))
    return top.unionByName(pool.withColumn("place", F.row_number().over(low)).where("place <= 3").withColumn("side", F.lit("bottom"))).drop("final_value_score")


QUERIES["top_bottom_preview"] = top_bottom_preview
SQL["top_bottom_preview"] = f"""WITH {POOL_SQL}, s AS (SELECT source, shard_id, final_value_score AS f FROM pool WHERE final_value_score IS NOT NULL)
SELECT source, shard_id, place, 'top' AS side FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY f DESC, shard_id) AS place FROM s) WHERE place <= 3
UNION ALL SELECT source, shard_id, place, 'bottom' FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY f, shard_id) AS place FROM s) WHERE place <= 3"""


def stale_assignments(spark: SparkSession, folder: str) -> DataFrame:
    """Rollup of stored cluster numbers: records, latest time as age in days behind the newest."""
    stored = latest_rows(table(spark, folder, "assignments"), "rec_id", "assigned_at").where("cluster IS NOT NULL")
    newest = stored.agg(F.max(F.to_date("assigned_at"))).first()[0]
    return stored.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min(F.datediff(F.lit(newest), F.to_date("assigned_at"))).alias("days_behind"))


QUERIES["stale_assignments"] = stale_assignments
SQL["stale_assignments"] = """WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY assigned_at DESC NULLS LAST, cluster DESC NULLS LAST) AS r FROM assignments WHERE rec_id IS NOT NULL) WHERE r = 1 AND cluster IS NOT NULL)
SELECT cluster, count(*) AS n, min(date_diff('day', assigned_at::DATE, (SELECT max(assigned_at::DATE) FROM c))) AS days_behind FROM c GROUP BY cluster"""
