"""Queries of joins, rollups, samples, filters and vector reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vector import dot
from ..io import table
from ..operators import comparison as C
from ..operators import dedup_index as DI
from ..operators import filters as FI
from ..operators import pool as P
from ..operators import ranking as R
from ..operators import similarity as SI
from ..operators import vectorsets as VS
from ..operators.skyline import pareto_front
from .data_queries import EMB
from .log_queries import LOG, _log
from .pool_queries import POOL_SQL
from .register import register, seeded_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = register(QUERIES, SQL)


def _pool(spark, folder) -> DataFrame:
    return P.load_pool(table(spark, folder, "shards"))


def _shards(spark, folder) -> DataFrame:
    """supplier as the table of shards with their sources."""
    return table(spark, folder, "supplier").select(F.col("s_suppkey").alias("shard"), F.col("s_nationkey").alias("origin"), "s_acctbal")


# joins

_UPDATES = f"{LOG}, u AS (SELECT log.*, s_nationkey AS origin FROM log JOIN supplier ON shard = s_suppkey)"


@query(f"WITH {_UPDATES} SELECT origin, role, count(*) AS n, round(avg(cond_gap), 6) AS mean FROM u GROUP BY 1, 2")
def updates_with_shards(spark, folder):
    """Observations joined to their shards, by source and role."""
    u = _log(spark, folder).join(_shards(spark, folder), "shard")
    return u.groupBy("origin", "role").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("cond_gap"), 6).alias("mean"))


@query(f"WITH {_UPDATES} SELECT strftime(iteration, '%Y-%m') AS iteration, origin, count(*) AS n FROM u WHERE role = 'included' GROUP BY 1, 2")
def mix_with_shards(spark, folder):
    """Included shards by iteration and source."""
    u = _log(spark, folder).where("role = 'included'").join(_shards(spark, folder), "shard")
    return u.groupBy(F.date_format("iteration", "yyyy-MM").alias("iteration"), "origin").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH b AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders WHERE o_orderstatus = 'F')
SELECT o_custkey, o_orderkey AS champion, round(o_totalprice, 2) AS score, c_mktsegment AS segment FROM b LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 WHERE r = 1 AND NOT (lower(coalesce(c_mktsegment, '')) LIKE 'test%' OR lower(coalesce(c_mktsegment, '')) LIKE 'smoke%')""")
def champions_with_summary(spark, folder):
    """The best finished run of every campaign, with the campaign's summary where there is one, trials left out."""
    best = table(spark, folder, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max(F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k"))).alias("b"))
    c = table(spark, folder, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    return best.join(c, "o_custkey", "left").where(~FI.ephemeral(F.col("segment"))).select("o_custkey", (-F.col("b.k")).alias("champion"), F.round("b.o_totalprice", 2).alias("score"), "segment")


@query("""WITH v AS (SELECT l_partkey, l_discount, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC) AS r FROM lineitem) SELECT p_partkey, round(l_discount, 4) AS validation FROM part LEFT JOIN v ON p_partkey = l_partkey AND r = 1""")
def experiments_with_validation(spark, folder):
    """Experiments with their last validation; some have none."""
    last = table(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max_by("l_discount", F.struct("l_orderkey", "l_linenumber")).alias("v"))
    return table(spark, folder, "part").join(last, "p_partkey", "left").select("p_partkey", F.round("v", 4).alias("validation"))


@query("""WITH s AS (SELECT o_orderkey, '[' || string_agg(l_suppkey::VARCHAR, ',') || ']' AS ids FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1), e AS (SELECT o_orderkey, unnest(ids::BIGINT[]) AS shard FROM s)
SELECT coalesce(CASE WHEN s_acctbal > 0 THEN 'nation-' || s_nationkey END, 'unknown') AS source, count(*) AS n FROM e LEFT JOIN supplier ON s_suppkey = shard GROUP BY 1""")
def selected_source_mix(spark, folder):
    """Lists of selected ids, kept as JSON, by the source of each id."""
    ids = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.collect_list("l_suppkey")).alias("ids"))
    one = ids.select(F.explode(F.from_json("ids", "array<bigint>")).alias("shard"))
    names = _shards(spark, folder).where("s_acctbal > 0").select("shard", F.concat(F.lit("nation-"), F.col("origin").cast("string")).alias("source"))
    return one.join(names, "shard", "left").groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {LOG}, t AS (SELECT shard, loss FROM log ORDER BY loss DESC, l_orderkey, l_linenumber LIMIT 200) SELECT s_nationkey AS origin, shard, count(*) AS hard, round(avg(loss), 6) AS mean_loss FROM t JOIN supplier ON s_suppkey = shard GROUP BY 1, 2""")
def hard_example_shards(spark, folder):
    """The shards that the two hundred hardest records come from."""
    top = _log(spark, folder).orderBy(F.desc("loss"), "l_orderkey", "l_linenumber").limit(200)
    return top.join(_shards(spark, folder), "shard").groupBy("origin", "shard").agg(F.count(F.lit(1)).alias("hard"), F.round(F.avg("loss"), 6).alias("mean_loss"))


@query("""WITH p AS (SELECT user_id, avg(value / 50 - 1) AS w FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT c_custkey, round(greatest(0, least(1, round(0.4 + 0.2 * coalesce(w, 0), 6))), 6) AS blended FROM customer LEFT JOIN p ON user_id = c_custkey""")
def preference_lookup(spark, folder):
    """A base score of every item blended with its preference, if there is one."""
    p = table(spark, folder, "events").where("event_type = 'purchase'").groupBy(F.col("user_id").alias("c_custkey")).agg(F.avg(F.col("value") / 50 - 1).alias("w"))
    b = F.round(0.4 + 0.2 * F.coalesce("w", F.lit(0.0)), 6)
    return table(spark, folder, "customer").select("c_custkey").join(p, "c_custkey", "left").select("c_custkey", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), b)), 6).alias("blended"))


@query(f"""WITH {POOL_SQL}, v AS (SELECT shard_id, CASE WHEN shard_id::INT % 4 = 0 THEN 'openalt' WHEN shard_id::INT % 4 = 1 THEN source END AS label FROM pool) SELECT shard_id, source AS indexed, label AS relabelled FROM pool JOIN v USING (shard_id) WHERE label IS NOT NULL AND label <> source""")
def relabelled_sources(spark, folder):
    """Shards whose indexed source differs from what their provenance says."""
    p = _pool(spark, folder)
    n = F.col("shard_id").cast("int") % 4
    v = p.select("shard_id", F.when(n == 0, F.lit("openalt")).when(n == 1, F.col("source")).alias("label"))
    return p.join(v, "shard_id", "left").where("label IS NOT NULL AND label != source").select("shard_id", F.col("source").alias("indexed"), F.col("label").alias("relabelled"))


@query("""SELECT rec_id FROM style_vectors WHERE rec_id IS NOT NULL INTERSECT SELECT rec_id FROM assignments INTERSECT SELECT rec_id FROM neighbors""")
def shared_records(spark, folder):
    """Records that all three stores know."""
    ids = [table(spark, folder, t).where("rec_id IS NOT NULL").select("rec_id") for t in ("style_vectors", "assignments", "neighbors")]
    return ids[0].intersect(ids[1]).intersect(ids[2])


@query("""WITH p AS (SELECT DISTINCT rec_id, shard_id FROM style_vectors WHERE rec_id IS NOT NULL), c AS (SELECT DISTINCT rec_id FROM neighbors) SELECT shard_id, count(*) AS pool, count(c.rec_id) AS covered, round(100.0 * count(c.rec_id) / count(*), 2) AS pct FROM p LEFT JOIN c USING (rec_id) GROUP BY 1""")
def cache_coverage(spark, folder):
    """How many of a shard's records the cache has, and the percentage."""
    p = table(spark, folder, "style_vectors").where("rec_id IS NOT NULL").select("rec_id", "shard_id").distinct()
    c = table(spark, folder, "neighbors").select("rec_id").distinct().withColumn("c", F.lit(1))
    g = p.join(c, "rec_id", "left").groupBy("shard_id").agg(F.count(F.lit(1)).alias("pool"), F.count("c").alias("covered"))
    return g.select("shard_id", "pool", "covered", F.round(100.0 * F.col("covered") / F.col("pool"), 2).alias("pct"))


# rollups

@query("""WITH s AS (SELECT l_returnflag AS encoder, l_linestatus AS version, l_suppkey AS shard, count(*) AS n FROM lineitem GROUP BY 1, 2, 3) SELECT encoder, version, count(*) AS shards, sum(n)::BIGINT AS records, count(*) FILTER (n >= 20) AS whole FROM s GROUP BY 1, 2""")
def coverage_rollup(spark, folder):
    """Per encoder and version the shards, their records, and the shards that are complete."""
    s = table(spark, folder, "lineitem").groupBy(F.col("l_returnflag").alias("encoder"), F.col("l_linestatus").alias("version"), "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return s.groupBy("encoder", "version").agg(F.count(F.lit(1)).alias("shards"), F.sum("n").alias("records"), F.count_if(F.col("n") >= 20).alias("whole"))


@query("""SELECT p_size // 10 AS bucket, count(*) AS steps, round(sum(p_retailprice), 2) AS loss, round(sum(p_partkey % 60) / 60.0, 6) AS minutes, round(count(*) * 60 / nullif(sum(p_partkey % 60), 0)::DOUBLE, 6) AS per_minute FROM part GROUP BY 1""")
def bucket_throughput(spark, folder):
    """Steps, loss and time by size bucket."""
    secs = F.col("p_partkey") % 60
    return table(spark, folder, "part").groupBy(F.floor(F.col("p_size") / 10).cast("int").alias("bucket")).agg(
        F.count(F.lit(1)).alias("steps"), F.round(F.sum("p_retailprice"), 2).alias("loss"), F.round(F.sum(secs) / 60.0, 6).alias("minutes"), F.round(F.try_divide(F.count(F.lit(1)) * 60, F.sum(secs)), 6).alias("per_minute")
    )


@query(f"""WITH {POOL_SQL}, e AS (SELECT shard_id, coalesce(final_value_score, light_score) AS s, unnest([shard_id::INT % 9, shard_id::INT % 9, shard_id::INT % 4 + 20]) AS archive FROM pool WHERE coalesce(final_value_score, light_score) IS NOT NULL)
SELECT archive, round(avg(s), 10) AS score, count(*) AS n_shards, string_agg(shard_id, ',' ORDER BY shard_id) AS shards FROM e GROUP BY 1""")
def archive_scores(spark, folder):
    """Mean score of the shards built from every archive, and the shards; one that is listed twice counts twice."""
    p = _pool(spark, folder).withColumn("s", F.coalesce("final_value_score", "light_score")).where("s IS NOT NULL")
    n = F.col("shard_id").cast("int")
    e = p.select("shard_id", "s", F.explode(F.array(n % 9, n % 9, n % 4 + 20)).alias("archive"))
    return e.groupBy("archive").agg(F.round(F.avg("s"), 10).alias("score"), F.count(F.lit(1)).alias("n_shards"), F.array_join(F.array_sort(F.collect_list("shard_id")), ",").alias("shards"))


@query(f"""WITH {POOL_SQL} SELECT shard_id, source, round(light_score, 6) AS light_score FROM pool WHERE light_decision = 'discard' AND light_score IS NOT NULL ORDER BY pool.light_score, shard_id LIMIT 10""")
def lowest_discarded(spark, folder):
    """The ten discarded shards of the lowest scores."""
    low = _pool(spark, folder).where("light_decision = 'discard' AND light_score IS NOT NULL").orderBy("light_score", "shard_id").limit(10)
    return low.select("shard_id", "source", F.round("light_score", 6).alias("light_score"))


@query(f"""WITH {POOL_SQL} SELECT source, count(*) AS n, round(avg(light_score), 10) AS light, round(avg(final_value_score) FILTER (has_unified <> 0), 10) AS unified, round(avg(final_value_score) FILTER (has_unified <> 0) - avg(light_score), 10) + 0.0 AS delta,
round(100.0 * count(*) FILTER (diversity_source = 'embedding') / count(*), 2) AS dynamic_pct FROM pool GROUP BY 1""")
def unified_delta_report(spark, folder):
    """By source the light and unified means, what lies between them, and the share with a measured diversity."""
    u = F.avg(F.when(F.col("has_unified") != 0, F.col("final_value_score")))
    return _pool(spark, folder).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("light_score"), 10).alias("light"), F.round(u, 10).alias("unified"), (F.round(u - F.avg("light_score"), 10) + F.lit(0.0)).alias("delta"),
        F.round(100.0 * F.count_if(F.col("diversity_source") == "embedding") / F.count(F.lit(1)), 2).alias("dynamic_pct"),
    )


@query("""WITH c AS (SELECT max(ts) AS now FROM events), h AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1) SELECT user_id, date_diff('second', date_trunc('second', last), date_trunc('second', now)) AS age, date_diff('second', date_trunc('second', last), date_trunc('second', now)) > 86400 AS stale FROM h, c""")
def heartbeat_staleness(spark, folder):
    """Seconds since every key's last event, against the newest of all, and whether that is too long."""
    e = table(spark, folder, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    now = e.agg(F.max(F.unix_seconds("ts"))).first()[0]
    age = F.lit(now) - F.col("last")
    return e.groupBy("user_id").agg(F.max(F.unix_seconds("ts")).alias("last")).select("user_id", age.alias("age"), (age > 86400).alias("stale"))


@query("""WITH i AS (SELECT id, max(updated_at) AS changed FROM images WHERE status = 'done' GROUP BY 1), s AS (SELECT id, max(updated_at) AS scored FROM images WHERE status <> 'pending' AND id % 3 <> 0 GROUP BY 1) SELECT i.id FROM i LEFT JOIN s USING (id) WHERE scored IS NULL OR changed > scored""")
def rescore_due(spark, folder):
    """Records changed since they were scored, or never scored."""
    i = table(spark, folder, "images")
    changed = i.where("status = 'done'").groupBy("id").agg(F.max("updated_at").alias("changed"))
    scored = i.where("status != 'pending' AND id % 3 != 0").groupBy("id").agg(F.max("updated_at").alias("scored"))
    return changed.join(scored, "id", "left").where("scored IS NULL OR changed > scored").select("id")


@query(f"""WITH {LOG}, n AS (SELECT campaign, iteration, count(DISTINCT shard) AS n FROM log GROUP BY 1, 2) SELECT campaign, list_sort(list(n))[count(*) // 2 + 1] AS upper_median FROM n GROUP BY 1""")
def upper_median_counts(spark, folder):
    """The upper median of the shards per iteration, by campaign."""
    from ..functions.numeric import upper_median

    n = _log(spark, folder).groupBy("campaign", "iteration").agg(F.countDistinct("shard").alias("n"))
    return n.groupBy("campaign").agg(F.array_sort(F.collect_list("n")).alias("v")).select("campaign", upper_median(F.col("v")).alias("upper_median"))


@query("""WITH r AS (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS v FROM orders), p AS (SELECT o_orderkey, v - last_value(v IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS d FROM r)
SELECT o_orderkey, CASE WHEN d > 0 THEN 'up' WHEN d < 0 THEN 'down' WHEN d = 0 THEN 'same' ELSE 'none' END AS direction FROM p""")
def direction_labels(spark, folder):
    """Whether a value is above or below the last one that is not null."""
    from ..operators import series as S

    o = table(spark, folder, "orders").withColumn("v", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")))
    d = F.col("delta")
    return S.delta_to_previous(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "v").select("o_orderkey", F.when(d > 0, "up").when(d < 0, "down").when(d == 0, "same").otherwise("none").alias("direction"))


# samples and packing

@query(f"""WITH c AS (SELECT DISTINCT rec_id, shard_id FROM style_vectors WHERE rec_id IN (SELECT rec_id FROM assignments)), r AS (SELECT *, row_number() OVER (PARTITION BY shard_id ORDER BY {seeded_sql("rec_id", 42)}, rec_id) AS k FROM c) SELECT shard_id, rec_id FROM r WHERE k <= 2""")
def random_cap(spark, folder):
    """Two records of every shard in seeded order, of those on an allow-list."""
    v = table(spark, folder, "style_vectors").where("rec_id IS NOT NULL").select("shard_id", "rec_id").distinct()
    return FI.random_cap(v, "shard_id", "rec_id", 2, allowed=table(spark, folder, "assignments"))


@query(f"SELECT doc_id FROM documents ORDER BY {seeded_sql('doc_id', 42)}, doc_id LIMIT 64")
def reservoir(spark, folder):
    """Sixty-four documents, each as likely as any other."""
    return R.reservoir(table(spark, folder, "documents").select("doc_id"), "doc_id", 64)


@query("""WITH r AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS k, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber) - 1 AS p, count(*) OVER (PARTITION BY l_suppkey) AS t FROM lineitem)
SELECT l_suppkey, k FROM r WHERE p % greatest(1, t // 8) = 0 AND p // greatest(1, t // 8) < 8""")
def stride_sample(spark, folder):
    """Eight records of every shard at equal strides."""
    l = table(spark, folder, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"))
    return R.stride_sample(l, "l_suppkey", "k", 8)


@query(f"""WITH a AS (SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_suppkey) AS r, count(*) OVER () AS t FROM supplier WHERE s_acctbal < 0), h AS (SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_suppkey) AS r, count(*) OVER () AS t FROM supplier WHERE s_acctbal > 5000),
n AS (SELECT count(*) AS n FROM customer), d AS (SELECT unnest(range(floor(n * 0.1 / 0.7 + 1e-9)::BIGINT)) AS i FROM n), e AS (SELECT unnest(range(floor(n * 0.2 / 0.7 + 1e-9)::BIGINT)) AS i FROM n),
u AS (SELECT c_custkey AS id, 'main' AS part FROM customer UNION ALL SELECT a.id, 'anchor' FROM d JOIN a ON a.r = {seeded_sql("i", 42)} % a.t + 1 UNION ALL SELECT h.id, 'hard' FROM e JOIN h ON h.r = {seeded_sql("i", 42)} % h.t + 1)
SELECT part, id, count(*) AS times FROM u GROUP BY 1, 2""")
def mixed_epoch(spark, folder):
    """Main records once each, a tenth of anchors and a fifth of hard ones drawn with replacement."""
    main = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"))
    s = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), "s_acctbal")
    out = R.with_replacement(main, {"anchor": (s.where("s_acctbal < 0"), 0.1), "hard": (s.where("s_acctbal > 5000"), 0.2)}, "id")
    return out.groupBy("part", "id").agg(F.count(F.lit(1)).alias("times"))


@query("""WITH d AS (SELECT DISTINCT id FROM images WHERE status = 'done' AND local_path IS NOT NULL), p AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS p FROM d) SELECT p // 300 AS bin, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM p GROUP BY 1""")
def packed_in_order(spark, folder):
    """Downloaded records in order of id, in shards of three hundred; those without a file are left out."""
    d = table(spark, folder, "images").where("status = 'done' AND local_path IS NOT NULL").select("id").distinct()
    return FI.pack_in_order(d, "id", 300).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


# filters

_WEB = """w AS (SELECT id, min(url) AS url, min(caption) AS text, min(width) AS width, min(height) AS height, CASE WHEN id % 11 <> 0 THEN (id % 70) / 10.0 END AS aesthetic, (id % 50) / 100.0 + 0.1 AS similarity, CASE WHEN id % 13 <> 0 THEN (id % 7) / 10.0 END AS nsfw, (id % 5) / 8.0 AS watermark FROM images GROUP BY id)"""


def _crawl(spark, folder) -> DataFrame:
    one = table(spark, folder, "images").groupBy("id").agg(*[F.min(c).alias(n) for c, n in (("url", "url"), ("caption", "text"), ("width", "width"), ("height", "height"))])
    i = F.col("id")
    return one.withColumns({"aesthetic": F.when(i % 11 != 0, i % 70 / 10.0), "similarity": i % 50 / 100.0 + 0.1, "nsfw": F.when(i % 13 != 0, i % 7 / 10.0), "watermark": i % 5 / 8.0})


@query(f"""WITH {_WEB} SELECT id, url, text AS caption FROM w WHERE coalesce(url, '') <> '' AND coalesce(text, '') <> '' AND coalesce(aesthetic, 0) >= 4.5 AND least(coalesce(width, 0), coalesce(height, 0)) >= 512 AND similarity >= 0.3
AND coalesce(nullif(nsfw, 0), 1) <= 0.3 AND coalesce(nullif(watermark, 0), 1) <= 0.3 ORDER BY id LIMIT 400""")
def web_filter(spark, folder):
    """The first four hundred crawl rows with good scores (the cap is the operator's)."""
    return FI.web_filter(_crawl(spark, folder), "id", 400)


@query(f"""WITH {_WEB} SELECT id, url, text AS caption FROM w WHERE coalesce(CASE WHEN id % 3 = 0 THEN nullif(aesthetic, 0) END, aesthetic, 0) >= 5.5 AND coalesce(width, 0) >= 512 AND coalesce(height, 0) >= 512 AND coalesce(url, '') <> '' AND coalesce(text, '') <> '' ORDER BY id LIMIT 400""")
def aliased_web_filter(spark, folder):
    """The same over columns that go by several names."""
    w = _crawl(spark, folder).withColumn("AESTHETIC_SCORE", F.col("aesthetic")).withColumn("score", F.when(F.col("id") % 3 == 0, F.col("aesthetic"))).drop("aesthetic")
    names = {"aesthetic": ["score", "AESTHETIC_SCORE", "missing"], "width": ["W", "width"], "height": ["height"], "url": ["link", "url"], "text": ["text"]}
    return FI.aliased_web_filter(w, "id", names, 400)


@query("SELECT id FROM (SELECT DISTINCT id, domain FROM images) WHERE domain IS NULL OR lower(domain) NOT IN (SELECT lower(domain) FROM images WHERE domain IS NOT NULL GROUP BY 1 HAVING count(*) >= 60)")
def blocklisted_domains(spark, folder):
    """Records but those of the domains that are too frequent; records without a domain stay."""
    i = table(spark, folder, "images").select("id", F.lower("domain").alias("d"))
    blocked = i.where("d IS NOT NULL").groupBy("d").agg(F.count(F.lit(1)).alias("n")).where("n >= 60")
    rows = table(spark, folder, "images").select("id", "domain").distinct().select("id", F.lower("domain").alias("d"))
    return FI.without(rows, blocked, "d").select("id")


@query("""WITH i AS (SELECT DISTINCT id, caption, domain FROM images), w AS (SELECT *, 'a picture of many words found in the index at ' || coalesce(domain, 'a place that nobody knows') AS other FROM i),
n AS (SELECT *, len(list_filter(regexp_split_to_array(coalesce(caption, ''), '\\s+'), lambda w: w <> '')) AS a, len(list_filter(regexp_split_to_array(other, '\\s+'), lambda w: w <> '')) AS b FROM w) SELECT id, CASE WHEN a < 10 AND b >= 10 THEN other ELSE caption END AS caption FROM n""")
def short_captions_replaced(spark, folder):
    """Captions of fewer than ten words replaced by another of ten or more."""
    other = F.concat(F.lit("a picture of many words found in the index at "), F.coalesce("domain", F.lit("a place that nobody knows")))
    return table(spark, folder, "images").select("id", "caption", "domain").distinct().select("id", FI.replace_short(F.col("caption"), other).alias("caption"))


@query("""SELECT doc_id, CASE WHEN source IS NOT NULL AND trim(source) <> '' AND lang IS NOT NULL AND trim(lang) <> '' THEN 'a ' || trim(lang) || ' painting in the style of ' || trim(source) WHEN source IS NOT NULL AND trim(source) <> '' THEN 'a painting in the style of ' || trim(source)
WHEN lang IS NOT NULL AND trim(lang) <> '' THEN 'a ' || trim(lang) || ' painting' ELSE 'a painting' END AS caption FROM documents""")
def captions_from_labels(spark, folder):
    return table(spark, folder, "documents").select("doc_id", FI.described(F.col("source"), F.col("lang")).alias("caption"))


@query("SELECT id, url, caption, NULL::VARCHAR AS hash FROM images")
def resolved_columns(spark, folder):
    """Columns found by lists of names; one that has none is null."""
    return FI.resolve_columns(table(spark, folder, "images"), {"id": ["ID", "key"], "url": ["URL", "link"], "caption": ["text", "CAPTION", "alt"], "hash": ["md5", "hash"]})


@query(f"WITH {POOL_SQL} SELECT shard_id, CASE WHEN lower(source) LIKE 'smoke%' OR lower(source) LIKE 'test%' THEN 'trial' ELSE 'campaign' END AS kind FROM pool WHERE has_unified > 0 AND light_decision <> 'discard'")
def scored_not_superseded(spark, folder):
    """Scored shards that are not discarded, trials told by their name."""
    return _pool(spark, folder).where("has_unified > 0 AND light_decision != 'discard'").select("shard_id", F.when(FI.ephemeral(F.col("source")), "trial").otherwise("campaign").alias("kind"))


@query("SELECT i.id, i.url FROM (SELECT DISTINCT id, url, width, height FROM images) i WHERE NOT (coalesce(width, 0) < 256 OR coalesce(height, 0) < 256)")
def without_small_images(spark, folder):
    """The index rewritten without records below the least side."""
    i = table(spark, folder, "images").select("id", "url", "width", "height").distinct()
    small = (F.coalesce("width", F.lit(0)) < 256) | (F.coalesce("height", F.lit(0)) < 256)
    return i.where(~small).select("id", "url")


# vectors

@query(f"""WITH {EMB}, p AS (SELECT a.vec_id, b.vec_id AS other, round(list_cosine_similarity(a.v, b.v), 9) AS cos FROM e a JOIN e b ON b.vec_id % 4 < a.vec_id % 4), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cos DESC, other) AS k FROM p)
SELECT vec_id, other AS "of", round(cos, 6) AS cos FROM r WHERE k = 1 AND cos >= 0.35""")
def batch_duplicates(spark, folder):
    """Vectors of four batches near one of an earlier batch."""
    e = table(spark, folder, "embeddings").withColumn("batch", F.col("vec_id") % 4)
    return DI.batch_duplicates(e, "vec_id", "embedding", "batch", 0.35).withColumn("cos", F.round("cos", 6))


@query(f"""WITH {EMB}, x AS (SELECT vec_id, label, generate_subscripts(v, 1) AS i, unnest(v) / sqrt(list_dot_product(v, v)) AS y FROM e), n AS (SELECT label, count(*) AS n FROM e GROUP BY 1), s AS (SELECT label, i, sum(y) AS s FROM x GROUP BY 1, 2),
c AS (SELECT label, list(s ORDER BY i) AS c FROM s GROUP BY 1), m AS (SELECT label, n, (list_dot_product(c, c) - n) / (n * (n - 1))::DOUBLE AS m FROM c JOIN n USING (label) WHERE n > 1),
k AS (SELECT a.label, round(list_cosine_similarity(a.c, b.c), 9) AS cos, row_number() OVER (PARTITION BY a.label ORDER BY list_cosine_similarity(a.c, b.c) DESC) AS r FROM c a JOIN c b ON a.label <> b.label),
t AS (SELECT label, greatest(0, least(1, 1 - avg(cos))) AS t FROM k WHERE r <= 5 GROUP BY 1), z AS (SELECT *, min(t) OVER () AS lo, max(t) OVER () AS hi FROM t)
SELECT label, round(1 - m, 4) AS intra, round((t - lo) / (hi - lo), 4) AS inter, round(greatest(0, least(1, 0.4 * (1 - m) + 0.6 * (t - lo) / (hi - lo))), 4) AS diversity FROM z JOIN m USING (label)""")
def embedding_diversity(spark, folder):
    """Diversity within labels and between them, and their blend."""
    d = VS.embedding_diversity(table(spark, folder, "embeddings"), "label", "embedding", 5, 0.4)
    return d.select("label", *[F.round(c, 4).alias(c) for c in ("intra", "inter", "diversity")])


@query(f"""WITH {EMB}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS p, count(*) OVER (PARTITION BY label) AS t FROM e), k AS (SELECT * FROM r WHERE p % greatest(1, t // 16) = 0 AND p // greatest(1, t // 16) < 16),
x AS (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) / sqrt(list_dot_product(v, v)) AS y FROM k), s AS (SELECT label, i, sum(y) AS s FROM x GROUP BY 1, 2), l AS (SELECT label, sqrt(sum(s * s)) AS l FROM s GROUP BY 1)
SELECT label, i, round(s / l, 6) + 0.0 AS mean FROM s JOIN l USING (label)""")
def shard_mean_vectors(spark, folder):
    """The mean direction of sixteen vectors of every label at equal strides."""
    m = VS.group_means(table(spark, folder, "embeddings"), "label", "vec_id", "embedding", 16)
    return m.select("label", F.posexplode("mean").alias("i", "x")).select("label", (F.col("i") + 1).cast("bigint").alias("i"), (F.round("x", 6) + F.lit(0.0)).alias("mean"))


@query(f"""WITH {EMB}, p AS (SELECT a.vec_id, b.vec_id AS o, a.label, b.label AS m, round(list_cosine_similarity(a.v, b.v), 9) AS c FROM e a JOIN e b ON a.vec_id <> b.vec_id), s AS (SELECT vec_id, label, count(*) FILTER (c >= 0.3 AND c <= 0.95) AS n FROM p GROUP BY 1, 2),
g AS (SELECT label, count(*) AS n, round(avg(CASE WHEN n >= 2 THEN 1.0 ELSE 0 END), 6) AS pair_rich FROM s GROUP BY 1), l AS (SELECT label, count(DISTINCT m) FILTER (m <> label AND c >= 0.3 AND c <= 0.95) AS connectivity, avg(c) FILTER (m = label) AS w FROM p GROUP BY 1)
SELECT label, n, round(sqrt(greatest(2 - 2 * w, 0)), 4) AS diversity, pair_rich, connectivity FROM g JOIN l USING (label)""")
def style_report(spark, folder):
    """Diversity, share of vectors with strong neighbours, and connections of every label."""
    r = VS.style_report(table(spark, folder, "embeddings"), "vec_id", "label", "embedding", 0.3, least=2)
    return r.withColumn("diversity", F.round("diversity", 4)).withColumn("pair_rich", F.round("pair_rich", 6))


@query(f"""WITH {EMB}, p AS (SELECT a.vec_id, round(list_cosine_similarity(a.v, b.v), 9) AS c, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 9) DESC, b.vec_id) AS k FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
n AS (SELECT avg(sqrt(greatest(2 - 2 * c, 0))) AS n FROM p WHERE k <= 5), o AS (SELECT vec_id, v, lead(v) OVER (ORDER BY {seeded_sql("vec_id", 42)}, vec_id) AS w, row_number() OVER (ORDER BY {seeded_sql("vec_id", 42)}, vec_id) AS k FROM e),
r AS (SELECT avg(sqrt(greatest(2 - 2 * list_cosine_similarity(v, w), 0))) AS r FROM o WHERE w IS NOT NULL AND k <= 400) SELECT round(n, 5) AS nearest, round(r, 5) AS random, round(n / r, 5) AS ratio FROM n, r""")
def neighbour_quality(spark, folder):
    """Distance to near neighbours against that of random pairs."""
    e = table(spark, folder, "embeddings")
    near = SI.search(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 5)
    q = VS.neighbour_quality(near, e, "vec_id", "embedding", 400)
    return q.select(*[F.round(c, 5).alias(c) for c in ("nearest", "random", "ratio")])


_NEAR = f"""{EMB}, q AS (SELECT a.vec_id AS seed, b.vec_id, round(list_cosine_similarity(a.v, b.v), 9) AS cos, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 9) DESC, b.vec_id) AS place FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)"""


@query(f"""WITH {_NEAR}, z AS (SELECT v AS prior FROM e WHERE vec_id = 3), p AS (SELECT vec_id, list_cosine_similarity(v, prior) AS p FROM e, z), t AS (SELECT * FROM q JOIN p USING (vec_id) WHERE place <= 12),
s AS (SELECT seed, round(avg(cos) - 2 * avg(p), 9) AS score FROM t GROUP BY 1 HAVING avg(cos) >= 0.2 ORDER BY score DESC, seed LIMIT 1) SELECT vec_id, place, round(cos, 6) AS cos, round(score, 6) AS score FROM t JOIN s USING (seed)""")
def far_subset(spark, folder):
    """Twelve coherent vectors far from a prior."""
    e = table(spark, folder, "embeddings")
    prior = [float(x) for x in e.where("vec_id = 3").select("embedding").first()[0]]
    out = VS.far_subset(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", F.array(*[F.lit(x) for x in prior]), 12, floor=0.2)
    return out.select("vec_id", "place", F.round("cos", 6).alias("cos"), F.round("score", 6).alias("score"))


@query(f"""WITH {EMB}, q AS (SELECT a.vec_id AS seed, b.vec_id, round(list_cosine_similarity(a.v[1:32], b.v[1:32]), 9) AS cos, list_cosine_similarity(a.v[33:64], b.v[33:64]) AS c, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v[1:32], b.v[1:32]), 9) DESC, b.vec_id) AS place FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
t AS (SELECT * FROM q WHERE place <= 12), s AS (SELECT seed, round(avg(cos) - 0.5 * avg(c), 9) AS score FROM t GROUP BY 1 HAVING avg(cos) >= 0.3 ORDER BY score DESC, seed LIMIT 1) SELECT vec_id, place, round(cos, 6) AS cos, round(score, 6) AS score FROM t JOIN s USING (seed)""")
def look_subset(spark, folder):
    """Twelve vectors alike in their first half and unlike in the second."""
    e = table(spark, folder, "embeddings").select("vec_id", F.slice("embedding", 1, 32).alias("l"), F.slice("embedding", 33, 32).alias("c"))
    out = VS.look_subset(e, e.where("vec_id % 50 = 0"), "vec_id", "l", "c", 12, floor=0.3, weight=0.5)
    return out.select("vec_id", "place", F.round("cos", 6).alias("cos"), F.round("score", 6).alias("score"))


@query()
def label_exemplars(spark, folder):
    """The vector nearest the centre of every label picked tightest first and apart from the others."""
    return VS.exemplars(table(spark, folder, "embeddings"), "label", "vec_id", "embedding").withColumn("cos", F.round("cos", 6))


@query()
def label_silhouettes(spark, folder):
    """How well the labels fit the vectors."""
    return VS.silhouettes(table(spark, folder, "embeddings"), "label", "embedding").withColumn("silhouette", F.round("silhouette", 5))


@query(f"""WITH {EMB}, x AS (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) / sqrt(list_dot_product(v, v)) AS y FROM e), s AS (SELECT label, i, sum(y) AS s FROM x GROUP BY 1, 2), c AS (SELECT label, list(s ORDER BY i) AS c FROM s GROUP BY 1),
p AS (SELECT e.vec_id, c.label, round(list_cosine_similarity(e.v, c.c), 9) AS cos FROM e, c WHERE vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cos DESC, label) AS place FROM p),
w AS (SELECT *, exp((cos - max(cos) OVER (PARTITION BY vec_id)) / 0.02) AS u FROM r WHERE place <= 3), z AS (SELECT *, u / sum(u) OVER (PARTITION BY vec_id) AS w FROM w), m AS (SELECT *, max(w) OVER (PARTITION BY vec_id) AS top FROM z)
SELECT vec_id, label, round(CASE WHEN top >= 0.9 THEN 1.0 ELSE w END, 4) AS weight FROM m WHERE top < 0.9 OR place = 1""")
def style_retrieval(spark, folder):
    """The label centres nearest to each asked vector with their weights; one alone where it has nine tenths."""
    e = table(spark, folder, "embeddings")
    centres = SI.centroids(e, "label", "embedding").agg(F.collect_list(F.struct("label", "centroid")).alias("cs"))  # one row, as many entries as labels
    q = e.where("vec_id % 50 = 0").crossJoin(F.broadcast(centres))
    from ..functions.vector import norm

    near = q.select("vec_id", F.explode("cs").alias("x"), "embedding").select("vec_id", "x.label", F.round(dot(F.col("embedding"), F.col("x.centroid")) / norm(F.col("embedding")), 9).alias("cos"))
    return C.retrieval_weights(near, "vec_id", "label", "cos", 3, 0.02, 0.9).withColumn("weight", F.round("weight", 4))


@query("""WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS a, CASE WHEN p_partkey % 5 <> 0 THEN p_size END AS b FROM part), f AS (SELECT * FROM p WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT k AS p_partkey FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.a >= f.a AND g.b >= f.b AND (g.a > f.a OR g.b > f.b))""")
def pareto2_null_excluded(spark, folder):
    """A front of two objectives; rows that miss one are out."""
    p = table(spark, folder, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice")).alias("a"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_size")).alias("b"))
    return pareto_front(p, "p_partkey", ["a", "b"])
