"""Queries of the curation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..io import table
from ..operators import curation as C
from ..operators import pool as P
from ..operators import similarity as SI
from .pool_queries import POOL_SQL

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return keep


def _pool(spark, folder) -> DataFrame:
    return P.load_pool(table(spark, folder, "shards"))


@query()
def neardup_incremental(spark, folder):
    """Vectors of odd ids against those of even ids and each other, as one arriving batch."""
    e = table(spark, folder, "embeddings")
    return C.near_duplicates(e.where("vec_id % 2 = 1").withColumn("o", F.col("vec_id")), e.where("vec_id % 2 = 0"), "vec_id", "embedding", "o", 0.35).withColumn("cos", F.round("cos", 6))


WEIGHTS = [("default", 0.5, 0.3, 0.2, 0.45), ("openalt", 0.2, 0.5, 0.3, 0.5), ("artscan", 0.6, 0.2, 0.2, 0.4)]


@query(f"""WITH {POOL_SQL}, w AS (SELECT * FROM (VALUES ('openalt', 0.2::DOUBLE, 0.5::DOUBLE, 0.3::DOUBLE, 0.5::DOUBLE), ('artscan', 0.6, 0.2, 0.2, 0.4)) t(source, a, b, c, th)),
j AS (SELECT shard_id, [light_score, aesthetic_avg, caption_quality] AS v, [coalesce(a, 0.5), coalesce(b, 0.3), coalesce(c, 0.2)] AS w, coalesce(th, 0.45) AS th FROM pool LEFT JOIN w USING (source)),
s AS (SELECT shard_id, th, list_sum([coalesce(v[i] * w[i], 0) FOR i IN [1, 2, 3]]) AS t, list_sum([CASE WHEN v[i] IS NULL THEN 0 ELSE w[i] END FOR i IN [1, 2, 3]]) AS h FROM j)
SELECT shard_id, CASE WHEN h > 0 THEN round(t / h, 10) END AS combined, CASE WHEN h > 0 AND t / h >= th THEN 'keep' ELSE 'discard' END AS decision FROM s""")
def weighted_decisions(spark, folder):
    w = spark.createDataFrame(WEIGHTS, "source string, w_light_score double, w_aesthetic_avg double, w_caption_quality double, threshold double")
    out = C.weighted_decisions(_pool(spark, folder), w, "source", ["light_score", "aesthetic_avg", "caption_quality"])
    return out.select("shard_id", F.round("combined", 10).alias("combined"), "decision")


@query(f"WITH {POOL_SQL}, n AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS i, count(*) OVER () AS c FROM (SELECT DISTINCT source FROM pool)) SELECT source, count(*) AS shards FROM pool WHERE source <> (SELECT source FROM n WHERE i = 11 % c) GROUP BY 1")
def source_holdout(spark, folder):
    return C.rotating_holdout(_pool(spark, folder), "source", 11).groupBy("source").agg(F.count(F.lit(1)).alias("shards"))


@query("""WITH r AS (SELECT p_brand AS arm, p_type AS metric, avg(p_retailprice) AS v FROM part GROUP BY 1, 2), f AS (SELECT metric, v AS ref FROM r WHERE arm = 'Brand#1')
SELECT arm, metric, round((CASE WHEN lower(metric) IN ('economy', 'promo') THEN 1 ELSE -1 END) * (v - ref) / CASE WHEN ref = 0 THEN 1 ELSE abs(ref) END, 6) + 0.0 AS change,
  CASE WHEN (CASE WHEN lower(metric) IN ('economy', 'promo') THEN 1 ELSE -1 END) * (v - ref) / CASE WHEN ref = 0 THEN 1 ELSE abs(ref) END > 0.03 THEN 1 ELSE 0 END AS failed FROM r JOIN f USING (metric) WHERE arm <> 'Brand#1'""")
def regression_gate(spark, folder):
    r = table(spark, folder, "part").groupBy(F.col("p_brand").alias("arm"), F.col("p_type").alias("metric")).agg(F.avg("p_retailprice").alias("value"))
    return C.relative_regressions(r, "Brand#1", lower_better=("economy", "promo"))


@query("""WITH b AS (SELECT s_nationkey, max(s_acctbal) AS m FROM supplier GROUP BY 1), k AS (SELECT s_nationkey, m, min(s_suppkey) AS k FROM b JOIN supplier USING (s_nationkey) WHERE s_acctbal = m GROUP BY 1, 2),
i AS (SELECT s_nationkey, min(s_suppkey) AS ik FROM supplier GROUP BY 1), h AS (SELECT i.s_nationkey, ik, s_acctbal AS ib FROM i JOIN supplier s ON s.s_suppkey = ik)
SELECT k.s_nationkey AS family, CASE WHEN m - ib < 500 THEN ik ELSE k END AS champion, CASE WHEN ik = CASE WHEN m - ib < 500 THEN ik ELSE k END THEN 0 ELSE 1 END AS changed FROM k JOIN h USING (s_nationkey)""")
def champion_hysteresis(spark, folder):
    s = table(spark, folder, "supplier")
    held = s.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("s_suppkey"))
    return C.champion(s, "s_nationkey", "s_suppkey", "s_acctbal", held, 500).withColumnRenamed("s_nationkey", "family")


@query("""WITH n AS (SELECT o_orderkey, o_totalprice, o_orderkey % 13 AS side, lead(o_totalprice) OVER w AS m, lead(CASE WHEN o_orderstatus <> 'P' THEN o_orderkey % 13 END) OVER w AS s, lead(o_orderkey) OVER w AS k FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_orderkey FROM n WHERE k IS NOT NULL AND m > o_totalprice AND (s IS NULL OR s > side)""")
def supersede(spark, folder):
    o = table(spark, folder, "orders").withColumn("side", F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey") % 13)).withColumn("own", F.col("o_orderkey") % 13)
    return C.superseded(o, "o_custkey", "o_orderkey", ["o_orderdate", "o_orderkey"], "o_totalprice", "own", "side")


@query("""WITH o AS (SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders WHERE o_orderdate < TIMESTAMP '1998-06-01' GROUP BY 1), n AS (SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1998-06-01' GROUP BY 1)
SELECT coalesce(o.k, n.k) AS o_custkey, CASE WHEN o.v IS NULL THEN 'added' WHEN n.v IS NULL THEN 'removed' WHEN n.v > o.v THEN 'advanced' ELSE 'back' END AS change FROM o FULL JOIN n ON o.k = n.k WHERE o.v IS DISTINCT FROM n.v""")
def snapshot_changes(spark, folder):
    o = table(spark, folder, "orders")
    cut = F.to_timestamp(F.lit("1998-06-01"))
    side = lambda df: df.groupBy("o_custkey").agg(F.max("o_orderkey").alias("v"))
    return C.snapshot_changes(side(o.where(F.col("o_orderdate") < cut)), side(o.where(F.col("o_orderdate") >= cut)), "o_custkey", "v")


@query("""SELECT event_id, event_type FROM events WHERE event_type <> 'error' UNION ALL (SELECT event_id, event_type FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 100)""")
def issue_rotation(spark, folder):
    """All open events and the hundred newest resolved ones."""
    e = table(spark, folder, "events").withColumn("resolved", F.col("event_type") == "error")
    return C.rotate_issues(e, "event_id", "resolved", "ts", 100).select("event_id", "event_type")


@query("""SELECT severity, count(*) AS n FROM (SELECT CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'warning' WHEN 'view' THEN 'odd' ELSE 'info' END AS severity FROM events) WHERE severity IN ('critical', 'error', 'warning') GROUP BY 1""")
def severity_filter(spark, folder):
    s = F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "purchase", "warning").when(F.col("event_type") == "view", "odd").otherwise("info")
    return C.at_least_severe(table(spark, folder, "events").withColumn("severity", s), "severity", "warning").groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT n_name AS item, row_number() OVER (ORDER BY CASE n_name WHEN 'NATION_9' THEN 1 WHEN 'NATION_3' THEN 2 ELSE 99 END, n_nationkey) AS new_place FROM nation""")
def queue_reorder(spark, folder):
    return C.reordered(table(spark, folder, "nation").withColumnRenamed("n_name", "item"), "item", "n_nationkey", ["NATION_9", "NATION_3"]).select("item", F.col("new_place").cast("bigint").alias("new_place"))


@query("SELECT p_partkey FROM part WHERE p_size > 20 AND p_retailprice <= 1200")
def condition_filter(spark, folder):
    return C.conditions_hold(table(spark, folder, "part"), [("p_size", ">", 20.0), ("p_retailprice", "<=", 1200.0), ("no_such", "<", 1.0)]).select("p_partkey")


@query("SELECT 6 AS pairs, round((corr(l_quantity, l_extendedprice) + corr(l_quantity, l_discount) + corr(l_quantity, l_tax) + corr(l_extendedprice, l_discount) + corr(l_extendedprice, l_tax) + corr(l_discount, l_tax)) / 6, 6) AS mean_corr FROM lineitem")
def pairwise_correlation(spark, folder):
    return C.mean_correlation(table(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]).withColumn("mean_corr", F.round("mean_corr", 6))


@query("""WITH i AS (SELECT DISTINCT date_trunc('month', l_shipdate) AS m FROM lineitem ORDER BY m DESC LIMIT 30), s AS (SELECT l_suppkey AS shard FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, l_suppkey LIMIT 20)
SELECT s.shard, strftime(i.m, '%Y-%m') AS month, CASE WHEN EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.shard AND date_trunc('month', l.l_shipdate) = i.m AND l.l_returnflag <> 'R') THEN 1 ELSE 0 END AS chosen FROM s, i""")
def selection_heatmap(spark, folder):
    """The twenty most used shards by the last thirty months: chosen or not."""
    l = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("shard"), F.date_format("l_shipdate", "yyyy-MM").alias("month"), (F.col("l_returnflag") != "R").cast("int").alias("c"))
    months = [r.month for r in l.select("month").distinct().orderBy(F.desc("month")).limit(30).collect()]
    top = l.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "shard").limit(20).select("shard")
    wide = l.join(F.broadcast(top), "shard").groupBy("shard").pivot("month", months).agg(F.max("c")).na.fill(0)
    return wide.select("shard", F.explode(F.array(*[F.struct(F.lit(m).alias("month"), F.col(m).alias("chosen")) for m in months])).alias("x")).select("shard", "x.month", "x.chosen")


@query("""WITH d AS (SELECT DISTINCT lpad(l_suppkey::VARCHAR, 6, '0') AS id FROM lineitem), p AS (SELECT lpad(s_suppkey::VARCHAR, 6, '0') AS id FROM supplier)
SELECT (SELECT count(*) FROM p) AS pool, count(*) AS overlap, CASE WHEN (SELECT count(*) FROM p) > 10 AND count(*) < 0.1 * (SELECT count(*) FROM p) THEN 1 ELSE 0 END AS mismatch FROM p WHERE id IN (SELECT id FROM d)""")
def padded_overlap(spark, folder):
    """How many ids of a pool a log knows, both padded to six digits."""
    pad = lambda c: F.lpad(F.col(c).cast("string"), 6, "0").alias("id")
    p = table(spark, folder, "supplier").select(pad("s_suppkey"))
    hit = p.join(table(spark, folder, "lineitem").select(pad("l_suppkey")).distinct().withColumn("h", F.lit(1)), "id", "left")
    g = hit.agg(F.count(F.lit(1)).alias("pool"), F.count("h").alias("overlap"))
    return g.select("pool", "overlap", ((F.col("pool") > 10) & (F.col("overlap") < 0.1 * F.col("pool"))).cast("int").alias("mismatch"))


@query("""WITH s AS (SELECT floor(l_quantity / 10)::INT AS scale, l_discount AS a, CASE WHEN l_tax > 0.02 THEN l_tax END AS b FROM lineitem) SELECT scale, count(*) AS n, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b FROM s GROUP BY 1""")
def scale_means(spark, folder):
    """Means per scale over the rows that have the metric."""
    l = table(spark, folder, "lineitem")
    return l.groupBy(F.floor(F.col("l_quantity") / 10).cast("int").alias("scale")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_discount"), 6).alias("mean_a"), F.round(F.avg(F.when(F.col("l_tax") > 0.02, F.col("l_tax"))), 6).alias("mean_b"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings), p AS (SELECT a.label AS x, b.label AS y, list_cosine_similarity(a.v, b.v) AS c FROM e a JOIN e b ON a.vec_id < b.vec_id AND a.label <> b.label WHERE list_cosine_similarity(a.v, b.v) >= 0.3)
SELECT least(x, y) AS shard_a, greatest(x, y) AS shard_b, count(*) AS links FROM p GROUP BY 1, 2""")
def shard_connectivity(spark, folder):
    """Links of cosine 0.3 or more between the vectors of two shards, counted in blocks."""
    import numpy as np
    import pandas as pd

    from ..session import stage

    e = stage(SI.usable(table(spark, folder, "embeddings"), "embedding").select("vec_id", "label", F.col("embedding").alias("v")), "vectors")
    blocks = max(1, -(-e.count() // SI.BLOCK))
    placed = e.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    tasks = placed.select("label", "v", F.least("b", "o").alias("b1"), F.greatest("b", "o").alias("b2"), "b")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x, lab = SI._unit(part["v"]), part["label"].to_numpy("i8")
        one = part["b1"].iloc[0] == part["b2"].iloc[0]
        left = np.flatnonzero((part["b"] == part["b1"]).to_numpy())
        right = left if one else np.flatnonzero((part["b"] != part["b1"]).to_numpy())
        names, code = np.unique(lab, return_inverse=True)
        counts = np.zeros((len(names), len(names)), "i8")
        for start in range(0, len(left), 1024):
            rows = left[start : start + 1024]
            r, c = np.nonzero((x[rows] @ x[right].T) >= 0.3)
            a, b = rows[r], right[c]
            ok = (a < b) if one else np.ones(len(a), bool)
            np.add.at(counts, (np.minimum(code[a], code[b])[ok], np.maximum(code[a], code[b])[ok]), 1)
        i, j = np.nonzero(np.triu(counts, 1))
        return pd.DataFrame({"shard_a": names[i], "shard_b": names[j], "links": counts[i, j]})

    out = tasks.groupBy("b1", "b2").applyInPandas(run, "shard_a bigint, shard_b bigint, links bigint")
    return out.groupBy("shard_a", "shard_b").agg(F.sum("links").alias("links"))


@query("""WITH c AS (SELECT avg(x) AS m, i FROM (SELECT generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE label = 0) GROUP BY i), v AS (SELECT list(m ORDER BY i) AS c FROM c),
s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], v.c) AS prior FROM embeddings, v WHERE label <> 0) SELECT vec_id, round(prior, 6) AS prior FROM s ORDER BY prior, vec_id LIMIT 25""")
def far_from_prior(spark, folder):
    """The 25 vectors least like the mean of one label."""
    from ..functions.vector import cosine

    e = table(spark, folder, "embeddings")
    sums = e.where("label = 0").select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m")).orderBy("i").collect()  # one row per dimension
    centre = F.array(*[F.lit(r.m) for r in sums])
    return e.where("label <> 0").select("vec_id", F.round(cosine(F.col("embedding"), centre), 12).alias("p")).orderBy("p", "vec_id").limit(25).select("vec_id", F.round("p", 6).alias("prior"))
