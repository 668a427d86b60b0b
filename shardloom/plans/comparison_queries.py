"""Queries of comparisons, rules and subset picks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..io import latest_rows, table
from ..operators import comparison as C
from ..operators import ranking as R
from ..operators import similarity as SI
from ..streaming.streams import windowed_counts

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return keep


@query("""WITH r AS (SELECT l_returnflag AS arm, round(avg(l_quantity), 6) AS quantity, round(avg(l_discount), 8) AS discount, round(avg(l_tax), 8) AS tax FROM lineitem GROUP BY 1), l AS (SELECT arm, unnest(['quantity', 'discount', 'tax']) AS metric, unnest([quantity, discount, tax]) AS v FROM r),
w AS (SELECT metric, max(v) FILTER (arm = 'A') AS a, max(v) FILTER (arm = 'N') AS b FROM l GROUP BY 1)
SELECT metric, a, b, round(b - a, 8) AS delta, CASE WHEN abs(b - a) <= 1e-9 THEN 'tie' WHEN (b - a) * CASE WHEN metric = 'tax' THEN -1 ELSE 1 END > 0 THEN 'N' ELSE 'A' END AS winner FROM w""")
def compare_pair(spark, folder):
    r = table(spark, folder, "lineitem").groupBy(F.col("l_returnflag").alias("arm")).agg(F.round(F.avg("l_quantity"), 6).alias("quantity"), F.round(F.avg("l_discount"), 8).alias("discount"), F.round(F.avg("l_tax"), 8).alias("tax"))
    return C.compare_pair(r, "A", "N", ["quantity", "discount", "tax"], lower_better=("tax",)).withColumn("delta", F.round("delta", 8))


@query("""SELECT id, unnest(list_filter([CASE WHEN width = 0 OR height = 0 THEN 'no_size' END, CASE WHEN status = 'failed' AND error IS NULL THEN 'silent_failure' END, CASE WHEN status = 'done' AND local_path IS NULL THEN 'no_file' END, CASE WHEN width > 8 * height AND height > 0 THEN 'banner' END], lambda x: x IS NOT NULL)) AS rule
FROM (SELECT DISTINCT id, width, height, status, error, local_path FROM images)""")
def anomaly_rules(spark, folder):
    i = table(spark, folder, "images").select("id", "width", "height", "status", "error", "local_path").distinct()
    return C.fired_rules(
        i,
        "id",
        {
            "no_size": (F.col("width") == 0) | (F.col("height") == 0),
            "silent_failure": (F.col("status") == "failed") & F.col("error").isNull(),
            "no_file": (F.col("status") == "done") & F.col("local_path").isNull(),
            "banner": (F.col("width") > 8 * F.col("height")) & (F.col("height") > 0),
        },
    )


@query("""WITH v AS (SELECT o_custkey AS cache, o_orderkey AS version, o_orderstatus = 'F' AS cur, o_orderstatus <> 'P' AS complete, o_orderkey % 3 AS n, o_orderdate AS made FROM orders),
p AS (SELECT cache, version, made, CASE WHEN cur AND n > 0 THEN 2 WHEN complete THEN 1 ELSE 0 END AS p FROM v), r AS (SELECT *, row_number() OVER (PARTITION BY cache ORDER BY p DESC, made DESC, version DESC) AS k FROM p)
SELECT cache, CASE WHEN p > 0 THEN version::VARCHAR ELSE 'flat' END AS version FROM r WHERE k = 1""")
def resolve_version(spark, folder):
    o = table(spark, folder, "orders").select(F.col("o_custkey").alias("cache"), F.col("o_orderkey").alias("v"), (F.col("o_orderstatus") == "F").alias("cur"), (F.col("o_orderstatus") != "P").alias("complete"), (F.col("o_orderkey") % 3).alias("n"), F.col("o_orderdate").alias("made"))
    best = C.resolve_version(o, "cache", "v", "cur", "complete", "n", "made")
    return best.select("cache", F.col("version").cast("string").alias("version"))


@query("""WITH a AS (SELECT rec_id, 0 AS part FROM neighbors UNION ALL SELECT rec_id, 1 FROM assignments UNION ALL SELECT rec_id, 2 FROM style_vectors) SELECT rec_id, min(part) AS part FROM a WHERE rec_id IS NOT NULL GROUP BY 1""")
def cache_consolidation(spark, folder):
    return C.first_source_wins([table(spark, folder, t).select("rec_id") for t in ("neighbors", "assignments", "style_vectors")], "rec_id")


@query("""SELECT r_name AS region, lr, rank, row_number() OVER (PARTITION BY r_name ORDER BY lr, rank) AS run FROM region, (VALUES (0.1), (0.01), (0.001)) l(lr), (VALUES (8), (16)) k(rank)""")
def grid_product(spark, folder):
    g = C.parameter_grid(table(spark, folder, "region").select(F.col("r_name").alias("region")), {"lr": [0.1, 0.01, 0.001], "rank": [8, 16]})
    return g.withColumn("run", F.row_number().over(Window.partitionBy("region").orderBy("lr", "rank")).cast("bigint"))


@query("""WITH s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY shard_id ORDER BY indexed_at DESC NULLS LAST) AS rn FROM shards WHERE shard_id IS NOT NULL) WHERE rn = 1), v AS (SELECT coalesce(lower(trim(source, ' ')), 'unknown') AS source, shard_id, CASE WHEN NOT isnan(final_value_score) THEN final_value_score END AS f FROM s)
SELECT source, shard_id, row_number() OVER (PARTITION BY source ORDER BY f DESC NULLS LAST, shard_id) AS place FROM v""")
def priority_order(spark, folder):
    """Shards of every source: the scored ones by score, then the others by id."""
    s = latest_rows(table(spark, folder, "shards"), "shard_id", "indexed_at")
    f = F.when(~F.isnan("final_value_score"), F.col("final_value_score"))
    s = s.select(F.coalesce(F.lower(F.trim("source")), F.lit("unknown")).alias("source"), "shard_id", f.alias("f"))
    ranked = R.group_rank(s, ["source"], [F.desc_nulls_last("f"), F.asc("shard_id")], "place")
    return ranked.select("source", "shard_id", F.col("place").cast("bigint").alias("place"))


@query("""SELECT event_type AS metric, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY 1""")
def metric_spread(spark, folder):
    p = table(spark, folder, "events").groupBy(F.col("event_type").alias("metric")).agg(F.round(F.avg("value"), 6).alias("mean"), F.percentile("value", [0.1, 0.9]).alias("p"))
    return p.select("metric", "mean", F.round(F.col("p")[0], 6).alias("p10"), F.round(F.col("p")[1], 6).alias("p90"))


@query("""SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2""")
def hourly_events(spark, folder):
    """Tumbling windows (an extension)."""
    e = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed_counts(e, "ts", "event_type", "value").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("""SELECT event_type, (props->>'k')::INT AS k, count(*) AS n FROM events GROUP BY 1, 2""")
def json_rollup(spark, folder):
    """Counts by a field of a JSON column; broken JSON counts as null."""
    return table(spark, folder, "events").groupBy("event_type", F.from_json("props", "k int")["k"].alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.vec_id, b.vec_id AS other, round(list_cosine_similarity(a.v[1:32], b.v[1:32]), 9) AS l, round(list_cosine_similarity(a.v[33:64], b.v[33:64]), 9) AS c FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c, other) AS place FROM p WHERE l >= 0.2) SELECT vec_id, other, round(l, 6) AS look_cos, round(c, 6) AS content_cos, place FROM r WHERE place <= 3""")
def look_neighbours(spark, folder):
    """Of the vectors alike in their first half, the three least alike in the second, for every id divisible by 50."""
    e = table(spark, folder, "embeddings").select("vec_id", F.slice("embedding", 1, 32).alias("l"), F.slice("embedding", 33, 32).alias("c"))
    out = C.rated_neighbours(e, e.where("vec_id % 50 = 0"), "vec_id", "l", "c", 0.2, 3)
    return out.select("vec_id", "other", F.round("look_cos", 6).alias("look_cos"), F.round("content_cos", 6).alias("content_cos"), "place")


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.vec_id AS seed, b.vec_id, round(list_cosine_similarity(a.v, b.v), 9) AS cos FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY cos DESC, vec_id) AS place FROM p), t AS (SELECT * FROM r WHERE place <= 15), b AS (SELECT seed FROM t GROUP BY 1 ORDER BY avg(cos) DESC, seed LIMIT 1) SELECT vec_id, place, round(cos, 6) AS cos FROM t WHERE seed = (SELECT seed FROM b)""")
def densest_subset(spark, folder):
    e = table(spark, folder, "embeddings")
    return C.densest_subset(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 15).withColumn("cos", F.round("cos", 6))


@query()
def separated_labels(spark, folder):
    """Labels picked tightest first whose centres lie apart."""
    e = table(spark, folder, "embeddings")
    spread = {r.label: r.mean_cosine for r in SI.group_spread(e, "label", "embedding").collect()}  # one row per label
    centres = [(str(r.label), spread[r.label] or 0.0, np.array(r.centroid)) for r in SI.centroids(e, "label", "embedding").collect()]
    return spark.createDataFrame([(int(x), i) for i, x in enumerate(C.separated_groups(centres, 0.55, 5))], "label int, place int")
