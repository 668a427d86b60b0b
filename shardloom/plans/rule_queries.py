"""Queries of selections, manifests, verdicts, alarms and small expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from ..io import table
from ..operators import manifests as MA
from ..operators import pool as P
from ..operators import ranking as R
from ..operators import search as SE
from ..operators import selection as SL
from ..operators import verdicts as V
from ..session import shared_dir
from ..sources import sidecars as SC
from .pool_queries import POOL_SQL, VALUE_RANK
from .register import register, seeded_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = register(QUERIES, SQL)


def _pool(spark, folder) -> DataFrame:
    return P.load_pool(table(spark, folder, "shards"))


POLICY = SL.Policy(performance=0.4, diversity=0.2, schedule=(("through", 2, 0.5), ("after", 2, 0.1)), per_source={"openalt": 6, "artscan": 5})


@query(f"""WITH {POOL_SQL}, p AS (SELECT shard_id, source, final_value_score AS eff, light_score AS comp, shard_id::INT % 4 AS n_selected, coalesce(has_unified, 0) AS n_scored, count(*) OVER () AS total FROM pool),
b AS (SELECT *, CASE WHEN coalesce(nullif(eff, 0), nullif(comp, 0), 0.3) > 0 THEN coalesce(nullif(eff, 0), nullif(comp, 0), 0.3) ELSE 0.3 END AS base FROM p),
w AS (SELECT *, CASE WHEN n_selected > 0 THEN base * (1 - 0.3::DOUBLE * least(1, n_selected / 1.0::DOUBLE)) ELSE base END AS w FROM b),
p1 AS (SELECT shard_id, source, 'performance' AS phase FROM w WHERE (eff IS NOT NULL OR comp IS NOT NULL) AND total > 32 ORDER BY w.w DESC, shard_id LIMIT 12), h AS (SELECT source, count(*) AS held FROM p1 GROUP BY 1),
p2 AS (SELECT shard_id, source, 'diversity' AS phase FROM w LEFT JOIN h USING (source) WHERE total > 32 AND shard_id NOT IN (SELECT shard_id FROM p1) ORDER BY coalesce(held, 0), shard_id LIMIT 6),
a2 AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2), k AS (SELECT CASE WHEN avg(CASE WHEN n_scored = 0 THEN 1.0 ELSE 0 END) > 0.3 THEN 9 ELSE 3 END AS k FROM p),
r3 AS (SELECT shard_id, source, n_selected, min(n_selected) OVER () AS least, row_number() OVER (ORDER BY n_selected, CASE WHEN n_selected = 0 THEN {seeded_sql("shard_id", 42)} END, shard_id) AS r FROM w WHERE total > 32 AND shard_id NOT IN (SELECT shard_id FROM a2)),
p3 AS (SELECT shard_id, source, 'exploration' AS phase FROM r3, k WHERE r <= k AND (least > 0 OR n_selected = 0)), a3 AS (SELECT * FROM a2 UNION ALL SELECT * FROM p3),
n4 AS (SELECT least(6 - (SELECT count(*) FROM a3 WHERE source = 'openalt'), 32 - (SELECT count(*) FROM a3)) AS n),
p4 AS (SELECT shard_id, source, 'source' AS phase FROM (SELECT *, row_number() OVER (ORDER BY w.w DESC, shard_id) AS r FROM w WHERE total > 32 AND source = 'openalt' AND shard_id NOT IN (SELECT shard_id FROM a3)), n4 WHERE r <= n), a4 AS (SELECT * FROM a3 UNION ALL SELECT * FROM p4),
n5 AS (SELECT least(5 - (SELECT count(*) FROM a4 WHERE source = 'artscan'), 32 - (SELECT count(*) FROM a4)) AS n),
p5 AS (SELECT shard_id, source, 'source' AS phase FROM (SELECT *, row_number() OVER (ORDER BY w.w DESC, shard_id) AS r FROM w WHERE total > 32 AND source = 'artscan' AND shard_id NOT IN (SELECT shard_id FROM a4)), n5 WHERE r <= n), a5 AS (SELECT * FROM a4 UNION ALL SELECT * FROM p5),
f AS (SELECT shard_id, 'fill' AS phase, row_number() OVER (ORDER BY ln(({seeded_sql("shard_id", 43)} + 1) / 1152921504606846976.0::DOUBLE) / greatest(0.001, w.w) DESC, shard_id) AS r FROM w WHERE total > 32 AND shard_id NOT IN (SELECT shard_id FROM a5))
SELECT shard_id, phase FROM a5 UNION ALL SELECT shard_id, phase FROM f WHERE r <= 32 - (SELECT count(*) FROM a5) UNION ALL SELECT shard_id, 'all' FROM p WHERE total <= 32""")
def select_shards(spark, folder):
    """Thirty-two shards for the third iteration, in six phases."""
    pool = _pool(spark, folder).select(
        "shard_id", "source", F.col("final_value_score").alias("effective"), F.col("light_score").alias("composite"), (F.col("shard_id").cast("int") % 4).alias("n_selected"), F.coalesce("has_unified", F.lit(0)).alias("n_scored")
    )
    return SL.select_shards(pool, 32, POLICY, iteration=3)


@query(f"""WITH {POOL_SQL}, s AS (SELECT shard_id, coalesce(nullif(final_value_score, 0), nullif(light_score, 0), 0.3) AS s, shard_id::INT % 5 AS n FROM pool)
SELECT shard_id, round(CASE WHEN n > 0 THEN s * (1 - 0.25::DOUBLE * least(1, n / (6 / 4.0::DOUBLE))) ELSE s END, 9) AS weight FROM s WHERE s > 0""")
def recency_penalty(spark, folder):
    """Scores of shards less what their recent selections take off."""
    s = SL.shard_score(F.col("final_value_score"), F.col("light_score"))
    p = _pool(spark, folder).withColumn("s", s).where("s > 0")
    return p.select("shard_id", F.round(SL.recency_weight(F.col("s"), F.col("shard_id").cast("int") % 5, 6, 4, 0.25), 9).alias("weight"))


@query("SELECT * FROM (VALUES (0, 0.15::DOUBLE), (1, 0.5), (2, 0.5), (3, 0.1), (4, 0.3)) t(iteration, rate)")
def exploration_schedule(spark, folder):
    """The exploration rate by iteration; the last of a pool that is mostly unscored."""
    rates = [(i, SL.exploration_rate(POLICY, i, 0.9 if i == 4 else 0.1)) for i in range(5)]
    return spark.createDataFrame(rates, "iteration int, rate double")


@query(f"""WITH {POOL_SQL} SELECT sha256('[' || string_agg('["' || shard_id || '","' || CASE WHEN coalesce(light_decision, 'keep') <> 'discard' THEN 'include' ELSE 'exclude' END || '"]', ',' ORDER BY shard_id) || ']') AS checksum FROM pool""")
def selection_digest(spark, folder):
    """One digest of a whole selection."""
    return MA.selection_digest(P.all_keep(_pool(spark, folder)))


@query(f"""WITH {POOL_SQL} SELECT CASE WHEN coalesce(light_decision, 'keep') <> 'discard' THEN 'include' ELSE 'exclude' END AS decision, count(*) AS n, round(sum(coalesce(light_score, 0)), 6) AS light FROM pool GROUP BY 1""")
def manifest_written(spark, folder):
    """Both decisions of a selection written as a manifest, read back and checked against its digest."""
    entries = P.all_keep(_pool(spark, folder)).select("shard_id", "decision", "light_score")
    path = MA.write_manifest(entries, f"{shared_dir(spark).rstrip('/')}/manifests", "all_keep")
    return MA.read_manifest(spark, path, entries.schema).groupBy("decision").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.coalesce("light_score", F.lit(0.0))), 6).alias("light"))


@query(f"""WITH {POOL_SQL}, {VALUE_RANK}, br AS (SELECT shard_id, row_number() OVER (PARTITION BY source ORDER BY final_value_score DESC, shard_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM pool WHERE final_value_score > 0),
a AS (SELECT shard_id FROM vr WHERE r <= greatest(1, floor(n * 0.5))), b AS (SELECT shard_id FROM br WHERE r <= greatest(1, floor(n * 0.4))),
s AS (SELECT coalesce(a.shard_id, b.shard_id) AS shard_id, CASE WHEN a.shard_id IS NULL THEN 'right' WHEN b.shard_id IS NULL THEN 'left' ELSE 'both' END AS side FROM a FULL JOIN b ON a.shard_id = b.shard_id),
r AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY shard_id) AS k, count(*) OVER (PARTITION BY side) AS n FROM s) SELECT side, any_value(n) AS n, string_agg(shard_id, ',' ORDER BY shard_id) FILTER (k <= 5) AS first_ids FROM r GROUP BY side""")
def manifest_overlap(spark, folder):
    """What two selections share and do not, with the first five shards of each side."""
    pool = _pool(spark, folder)
    return MA.selection_overlap(P.compare_selections(P.top_percent(pool, 50), P.balanced(pool, 40)))


_PATHS = """CASE doc_id % 6 WHEN 0 THEN '/raw/JourneyDB/' || (doc_id % 9) || '.tgz' WHEN 1 THEN '/raw/wikiart/a' || (doc_id % 4) || '.tar' WHEN 2 THEN '/raw/laion/' || (doc_id % 3) || '.tar' WHEN 3 THEN '/raw/jdb-x/part_' || (doc_id % 5) || '.tar' WHEN 4 THEN '/raw/other/' || (doc_id % 2) || '.tar' END"""


def _built(spark, folder) -> DataFrame:
    """Documents as records with the file they came from; some have none."""
    d = table(spark, folder, "documents")
    n = lambda k: (F.col("doc_id") % k).cast("string")
    path = (
        F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("/raw/JourneyDB/"), n(9), F.lit(".tgz")))
        .when(F.col("doc_id") % 6 == 1, F.concat(F.lit("/raw/wikiart/a"), n(4), F.lit(".tar")))
        .when(F.col("doc_id") % 6 == 2, F.concat(F.lit("/raw/laion/"), n(3), F.lit(".tar")))
        .when(F.col("doc_id") % 6 == 3, F.concat(F.lit("/raw/jdb-x/part_"), n(5), F.lit(".tar")))
        .when(F.col("doc_id") % 6 == 4, F.concat(F.lit("/raw/other/"), n(2), F.lit(".tar")))
    )
    return d.select((F.col("doc_id") % 40).alias("shard"), "doc_id", path.alias("path"), "n_chars")


_KIND = "CASE WHEN contains(lower(path), 'journeydb') OR contains(lower(path), 'jdb') THEN 'jdb' WHEN contains(lower(path), 'wikiart') THEN 'wikiart' WHEN contains(lower(path), 'laion') THEN 'laion' WHEN contains(lower(path), 'coyo') THEN 'coyo' ELSE 'unknown' END"


@query(f"""WITH d AS (SELECT DISTINCT doc_id % 40 AS shard, {_PATHS} AS path FROM documents), k AS (SELECT shard, path, {_KIND} AS kind, try_cast(regexp_extract(path, '([^/.]*)\\.[^.]*$', 1) AS INT) AS n FROM d WHERE path IS NOT NULL)
SELECT s.shard, count(path) AS n, coalesce(string_agg(kind || ':' || path || CASE WHEN kind = 'jdb' AND n IS NOT NULL THEN '#' || n ELSE '' END, ' ' ORDER BY path), '') AS sources FROM (SELECT DISTINCT shard FROM d) s LEFT JOIN k USING (shard) GROUP BY 1""")
def provenance_sidecars(spark, folder):
    """The files every shard was built from."""
    one = lambda x: F.concat(x["type"], F.lit(":"), x["path"], F.coalesce(F.concat(F.lit("#"), x["number"].cast("string")), F.lit("")))
    return MA.provenance(_built(spark, folder), "shard", "path").select("shard", F.size("sources").cast("bigint").alias("n"), F.array_join(F.transform("sources", one), " ").alias("sources"))


@query(f"""WITH p AS (SELECT DISTINCT {_PATHS} AS path FROM documents), b AS (SELECT path, lower(path) AS low, lower(regexp_extract(path, '[^/]*$')) AS name FROM p WHERE path IS NOT NULL)
SELECT path, {_KIND} AS built, CASE WHEN contains(name, 'laion') THEN 'laion' WHEN contains(name, 'wikiart') THEN 'wikiart' WHEN contains(name, 'jdb') OR contains(name, 'journey') THEN 'jdb' WHEN contains(name, 'anchor') THEN 'anchor' ELSE 'unknown' END AS by_name,
  CASE WHEN contains(low, 'journeydb') OR contains(low, 'jdb') THEN 'journeydb' WHEN contains(low, 'wikiart') THEN 'wikiart' WHEN contains(low, 'laion') THEN 'laion' WHEN length(path) % 2 = 0 THEN 'journeydb' ELSE 'unknown' END AS scored FROM b""")
def source_rules(spark, folder):
    """The three rules that tell a source, the third with a provenance of one kind or of two."""
    p = _built(spark, folder).select("path").where("path IS NOT NULL").distinct()
    kinds = F.when(F.length("path") % 2 == 0, F.array(F.lit("jdb"), F.lit("unknown"))).otherwise(F.array(F.lit("jdb"), F.lit("coyo")))
    return p.select("path", T.source_when_built(F.col("path")).alias("built"), T.source_by_name(F.col("path")).alias("by_name"), T.source_when_scored(F.col("path"), kinds).alias("scored"))


_SIDE = "shard_id, source, light_score, light_decision, aesthetic_avg, caption_quality, final_value_score, training_loss_normalized, diversity_score, diversity_source, has_light_score, has_unified"


def _documents(spark, folder) -> DataFrame:
    """The pool's scores as the documents they came from: light ones, unified ones, provenance; one in seven unified ones is broken."""
    p = _pool(spark, folder)
    light = F.to_json(F.struct("source", F.col("light_decision").alias("decision"), F.struct(F.col("light_score").alias("combined_score"), "aesthetic_avg", "caption_quality").alias("light_scores")))
    div = F.struct(F.col("diversity_score").alias("value"), F.col("diversity_source").alias("source"))
    unified = F.to_json(F.struct(F.lit("mixed").alias("source"), "final_value_score", "training_loss_normalized", F.struct(div.alias("diversity")).alias("components")))
    number = F.col("shard_id").cast("int")
    prov = F.to_json(F.struct("shard_id", F.array(F.struct(F.lit("jdb").alias("type")), F.struct(F.lit("coyo").alias("type")), F.struct(F.lit("unknown").alias("type"))).alias("sources")))
    return p.select(
        "shard_id",
        F.when(F.col("has_light_score") == 1, light).alias("light"),
        F.when(F.col("has_unified") == 1, F.when(number % 7 == 0, F.substring(unified, 1, 20)).otherwise(unified)).alias("unified"),
        F.when(number % 3 == 0, prov).alias("provenance"),
    )


_TEXTS = f"""WITH {POOL_SQL}, d AS (SELECT *, coalesce(has_light_score, 0) = 1 AS l, coalesce(has_unified, 0) = 1 AND shard_id::INT % 7 <> 0 AS u FROM pool)"""


@query(_TEXTS + """SELECT shard_id, CASE WHEN shard_id::INT % 3 = 0 THEN 'coyo+journeydb' WHEN u THEN 'mixed' WHEN l THEN source ELSE 'unknown' END AS source, l::INT AS has_light_score, CASE WHEN l THEN coalesce(light_score, 0) END AS light_score,
CASE WHEN l THEN coalesce(light_decision, 'unknown') ELSE 'unknown' END AS light_decision, u::INT AS has_unified, CASE WHEN u THEN coalesce(final_value_score, 0) WHEN l THEN coalesce(light_score, 0) END AS final_value_score,
CASE WHEN u THEN diversity_score END AS diversity_score, CASE WHEN u AND diversity_score IS NOT NULL THEN coalesce(diversity_source, 'source_rarity') END AS diversity_source FROM d""")
def sidecar_index(spark, folder):
    """Index rows from the score documents of every shard."""
    return SC.index_rows(_documents(spark, folder)).drop("aesthetic_avg", "caption_quality", "training_loss_normalized")


@query(_TEXTS + """SELECT shard_id, CASE WHEN u THEN 'mixed' WHEN l THEN source ELSE 'unknown' END AS source, CASE WHEN l THEN coalesce(light_score, 0) ELSE 0 END AS light_score,
CASE WHEN u AND coalesce(CASE WHEN l THEN light_decision END, 'unknown') = 'unknown' THEN 'keep' ELSE coalesce(CASE WHEN l THEN light_decision END, 'unknown') END AS light_decision, u::INT AS has_unified,
CASE WHEN u THEN coalesce(final_value_score, 0) WHEN l THEN coalesce(light_score, 0) ELSE 0 END AS final_value_score FROM d""")
def sidecar_fallback(spark, folder):
    """The same documents read where there is no index."""
    return SC.fallback_rows(_documents(spark, folder))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN nullif(value, 0) WHEN event_id % 4 = 1 THEN value END AS clip_i FROM events WHERE event_id % 4 <= 1 AND (event_id % 4 = 1 OR value <> 0)""")
def evaluation_results(spark, folder):
    """Scores from result documents, of which some have one name for it, some the other, some none, and some are broken."""
    e = table(spark, folder, "events")
    doc = F.when(F.col("event_id") % 4 == 0, F.to_json(F.struct(F.col("value").alias("clip_i_mean")))).when(F.col("event_id") % 4 == 1, F.to_json(F.struct(F.lit(0.0).alias("clip_i_mean"), F.col("value").alias("clip_i")))).when(F.col("event_id") % 4 == 2, F.lit("{broken")).otherwise(F.lit("{}"))
    return SC.evaluation_results(e.select("event_id", doc.alias("t")), "event_id", "t")


# verdicts and alarms

_RESULTS = "SELECT p_brand AS run, p_type AS metric, avg(p_retailprice) FILTER (p_size % 2 = 0) AS cur, avg(p_retailprice) FILTER (p_size % 2 = 1) AS prev FROM part GROUP BY 1, 2"


def _gated(spark, folder) -> DataFrame:
    p = table(spark, folder, "part")
    side = lambda k: p.where(F.col("p_size") % 2 == k).groupBy(F.col("p_brand").alias("run"), F.col("p_type").alias("metric")).agg(F.avg("p_retailprice").alias("value"))
    every = p.select(F.col("p_brand").alias("run"), F.col("p_type").alias("metric")).distinct().join(side(0), ["run", "metric"], "left")
    return V.quality_gate(every, side(1), ["run"], lower_better=("PROMO", "ECONOMY"))


_GATED = f"""WITH r AS ({_RESULTS}), g AS (SELECT run, metric, abs(cur - prev) / CASE WHEN prev = 0 THEN 1 ELSE abs(prev) END AS change, (cur - prev) * CASE WHEN metric IN ('PROMO', 'ECONOMY') THEN -1 ELSE 1 END AS gain FROM r),
q AS (SELECT run, metric, change, CASE WHEN change IS NULL THEN 'no_baseline' WHEN change <= 0.01 THEN 'neutral' WHEN gain > 0 THEN 'improved' ELSE 'regressed' END AS status FROM g) """


@query(_GATED + "SELECT run, metric, round(change, 6) AS change, status FROM q")
def quality_gate(spark, folder):
    return _gated(spark, folder).withColumn("change", F.round("change", 6))


@query(_GATED + "SELECT run, CASE WHEN bool_and(status = 'no_baseline') THEN 'NO_BASELINE' WHEN bool_or(status = 'regressed') THEN 'REGRESSION' WHEN bool_or(status = 'improved') THEN 'IMPROVED' ELSE 'NEUTRAL' END AS verdict FROM q GROUP BY 1")
def gate_verdicts(spark, folder):
    return V.gate_verdict(_gated(spark, folder), ["run"])


_PAIRS = "SELECT l_suppkey AS run, CASE WHEN l_suppkey % 5 <> 0 THEN l_discount * 3.5 END AS clip_i, CASE WHEN l_quantity > 5 THEN l_tax - l_suppkey % 3 * 0.02 END AS adapter_delta, l_tax AS clip_t, l_suppkey % 17 = 0 AS broken FROM lineitem"


@query(f"""WITH p AS ({_PAIRS}), g AS (SELECT run, avg(clip_i) AS c, avg(adapter_delta) AS d, avg(clip_t) AS t, count(*) AS n_pairs, bool_or(broken) AS b FROM p GROUP BY 1)
SELECT run, CASE WHEN b THEN 'FAIL' WHEN c IS NULL THEN 'WARN' WHEN c > 0.2 AND coalesce(d > 0.05, true) THEN 'PASS' WHEN c > 0.15 AND coalesce(d > 0, true) THEN 'WARN' ELSE 'FAIL' END AS verdict,
  round(c, 4) AS mean_clip_i, CASE WHEN c IS NOT NULL THEN round(d, 4) END AS mean_adapter_delta, CASE WHEN c IS NULL THEN round(t, 4) END AS mean_clip_t, n_pairs FROM g""")
def validation_verdicts(spark, folder):
    l = table(spark, folder, "lineitem")
    pairs = l.select(
        F.col("l_suppkey").alias("run"), F.when(F.col("l_suppkey") % 5 != 0, F.col("l_discount") * 3.5).alias("clip_i"), F.when(F.col("l_quantity") > 5, F.col("l_tax") - F.col("l_suppkey") % 3 * 0.02).alias("adapter_delta"),
        F.col("l_tax").alias("clip_t"), (F.col("l_suppkey") % 17 == 0).alias("broken"),
    )
    return V.validation_verdict(pairs, ["run"], broken="broken")


def _snapshots(spark, folder) -> DataFrame:
    """Orders of a customer as the snapshots of a run; some values are missing."""
    o = table(spark, folder, "orders")
    return o.select(
        F.col("o_custkey").alias("run"), F.struct("o_orderdate", "o_orderkey").alias("at"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice") / 100000 - 2.3).alias("cond_gap"),
        F.when(F.col("o_orderkey") % 3 != 0, (F.col("o_orderkey") % 11 - 5) / 10).alias("ref_gap"),
        F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_orderkey") % 101) / 19).alias("loss"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice") / 10000).alias("grad_norm"),
    )


_SNAPS = """s AS (SELECT o_custkey AS run, o_orderdate, o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice / 100000 - 2.3 END AS cond_gap, CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 11 - 5) / 10 END AS ref_gap,
  CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 101) / 19 END AS loss, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice / 10000 END AS grad_norm,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)"""


@query(f"""WITH {_SNAPS}, r AS (SELECT c_custkey AS run, CASE WHEN c_custkey % 19 = 0 THEN -3 WHEN c_custkey % 13 = 0 THEN 1 ELSE 0 END AS e FROM customer), t AS (SELECT * FROM s WHERE i - 1 >= 2 * n // 5),
g AS (SELECT run, count(*) FILTER (ref_gap > 0) > count(ref_gap) * 0.5 AS r, count(*) FILTER (cond_gap > 0) > count(cond_gap) * 0.5 AS c, coalesce(avg(ref_gap), 0) AS mr, coalesce(avg(cond_gap), 0) AS mc, coalesce(arg_max(loss, i) FILTER (loss IS NOT NULL), 9.9) AS fl, arg_max(coalesce(loss, 0), i) AS ll FROM t GROUP BY 1)
SELECT run, CASE WHEN e = -3 THEN 'TIMEOUT' WHEN e <> 0 THEN 'CRASH' WHEN g.run IS NULL THEN 'NO_DATA' WHEN ll > 5 THEN 'UNSTABLE' WHEN g.r AND g.c THEN 'PASS' ELSE 'WARN' END AS verdict, CASE WHEN e <> 0 OR mr IS NULL THEN '-Infinity'::DOUBLE ELSE round(100 * mr + 200 * mc - 3 * fl, 4) END AS score FROM r LEFT JOIN g USING (run)""")
def run_verdicts(spark, folder):
    code = F.when(F.col("c_custkey") % 19 == 0, -3).when(F.col("c_custkey") % 13 == 0, 1).otherwise(0)
    runs = table(spark, folder, "customer").select(F.col("c_custkey").alias("run"), code.alias("exit_code"))
    return V.run_verdicts(runs, _snapshots(spark, folder), "run", "at", loss="loss").withColumn("score", F.round("score", 4))


@query(f"""WITH {_SNAPS}, c AS (SELECT *, sum((grad_norm IS NOT NULL)::INT) OVER w AS c1, sum((i > 3 AND cond_gap IS NOT NULL)::INT) OVER w AS c2, sum((i > 3 AND ref_gap IS NOT NULL)::INT) OVER w AS c3 FROM s WINDOW w AS (PARTITION BY run ORDER BY i ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, max(CASE WHEN grad_norm <= 15 THEN c1 END) OVER w AS g1, max(CASE WHEN i > 3 AND cond_gap >= -1 THEN c2 END) OVER w AS g2, max(CASE WHEN i > 3 AND ref_gap >= 0 THEN c3 END) OVER w AS g3 FROM c WINDOW w AS (PARTITION BY run ORDER BY i ROWS UNBOUNDED PRECEDING)),
f AS (SELECT run, i, CASE WHEN loss > 5.2 THEN 'loss' WHEN grad_norm > 15 AND c1 - coalesce(g1, 0) >= 3 THEN 'grad_norm' WHEN i > 3 AND cond_gap < -1 AND c2 - coalesce(g2, 0) >= 3 THEN 'cond_gap' WHEN i > 3 AND ref_gap < 0 AND c3 - coalesce(g3, 0) >= 4 THEN 'ref_gap' END AS f FROM g)
SELECT run, min(i) FILTER (f IS NOT NULL)::INT AS stop_at, arg_min(f, i) FILTER (f IS NOT NULL) AS reason FROM f GROUP BY 1""")
def early_stop_signals(spark, folder):
    """The snapshot at which one of four signals stops a run."""
    return V.early_stops(_snapshots(spark, folder), ["run"], ["at"], -1.0, 3, 3, loss_limit=5.2, grad_limit=15.0, ref_gap_min=0.0, ref_patience=4)


@query(f"""WITH r AS (SELECT o_custkey, list(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END ORDER BY o_orderdate, o_orderkey) AS l FROM orders GROUP BY 1)
SELECT o_custkey, list_reduce(l, lambda s, x: {{'best': CASE WHEN x IS NOT NULL AND (s.best IS NULL OR x > s.best + 2000) THEN x ELSE s.best END, 'stale': CASE WHEN x IS NULL THEN s.stale WHEN s.best IS NULL OR x > s.best + 2000 THEN 0 ELSE s.stale + 1 END, 'n': s.n + 1,
  'at': CASE WHEN s.at IS NOT NULL THEN s.at WHEN x IS NOT NULL AND s.n + 1 >= 5 AND NOT (s.best IS NULL OR x > s.best + 2000) AND s.stale + 1 >= 3 THEN s.n + 1 END}}, {{'best': NULL::DOUBLE, 'stale': 0, 'n': 0, 'at': NULL::INT}}).at AS plateau_at FROM r""")
def campaign_plateau(spark, folder):
    o = table(spark, folder, "orders").withColumn("v", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")))
    return V.campaign_plateau(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "v", 3, 2000.0)


@query("""WITH s AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS step, l_extendedprice / 20000 AS loss, l_quantity * 1.3 AS gn, 100 - l_linenumber * 3 AS cov, l_extendedprice / 20000 AS lc, l_extendedprice / 20000 * (1 + l_discount / 5) AS ln, CASE WHEN l_tax > 0 THEN l_tax * 2 END AS sc, l_discount AS sr, l_tax AS cr, l_quantity AS lw FROM lineitem),
a AS (SELECT unnest([CASE WHEN loss > 2 THEN 'loss_high/WARNING' END, CASE WHEN gn > 50 THEN 'gradient_pause/WARNING' WHEN gn > 10 THEN 'gradient_high/INFO' END, CASE WHEN cov < 90 THEN 'coverage_low/WARNING' END, CASE WHEN step > 1000 AND ln > 0 AND 100 * (ln - lc) / ln < 1 THEN 'not_learning/WARNING' END,
  CASE WHEN step > 500 AND sc < 0.05 THEN 'scale_collapsed/WARNING' END, CASE WHEN step > 1000 AND cr < sr - 0.01 THEN 'references_inverted/WARNING' END, CASE WHEN lw > 40 THEN 'loader_slow/WARNING' WHEN lw > 20 THEN 'loader_slow/INFO' END]) AS a FROM s)
SELECT split_part(a, '/', 1) AS alarm, split_part(a, '/', 2) AS severity, count(*) AS n FROM a WHERE a IS NOT NULL GROUP BY 1, 2""")
def trainer_alarms(spark, folder):
    """How often each alarm on a trainer's state goes off."""
    loss = F.col("l_extendedprice") / 20000
    s = table(spark, folder, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("step"), loss.alias("loss"), (F.col("l_quantity") * 1.3).alias("grad_norm_smooth"), (100 - F.col("l_linenumber") * 3).cast("double").alias("siglip_coverage_pct"),
        loss.alias("loss_cond"), (loss * (1 + F.col("l_discount") / 5)).alias("loss_null"), F.when(F.col("l_tax") > 0, F.col("l_tax") * 2).alias("ip_scale_mean"), F.col("l_discount").alias("loss_self_ref"), F.col("l_tax").alias("loss_cross_ref"), F.col("l_quantity").alias("loader_wait_pct"),
    )
    return V.trainer_alarms(s, "id").groupBy("alarm", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT c_mktsegment AS k, max(o_totalprice) AS a, avg(o_totalprice) AS b, count(*)::DOUBLE AS c FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1), l AS (SELECT k, unnest(['a', 'b', 'c']) AS metric, unnest([a, b, c]) AS v FROM s),
w AS (SELECT metric, max(v) FILTER (k = 'BUILDING') AS x, max(v) FILTER (k = 'MACHINERY') AS y FROM l GROUP BY 1) SELECT metric, round(x, 4) AS a, round(y, 4) AS b FROM w WHERE y < x""")
def campaign_regressions(spark, folder):
    """On what one segment's runs fall below another's."""
    o = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    s = o.groupBy("c_mktsegment").agg(F.max("o_totalprice").alias("a"), F.avg("o_totalprice").alias("b"), F.count(F.lit(1)).cast("double").alias("c"))
    return V.worse_than(s, "c_mktsegment", "BUILDING", "MACHINERY", ["a", "b", "c"]).select("metric", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))


@query("""WITH p AS (SELECT l_orderkey, max(l_linenumber) AS iteration, sum(l_quantity) AS eta, count(*) FILTER (l_returnflag <> 'R') AS remaining FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN remaining > 0 AND 6 - iteration >= 0 THEN round(eta + eta / remaining * 8 * (6 - iteration), 4) END AS seconds FROM p""")
def campaign_eta(spark, folder):
    p = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("iteration"), F.sum("l_quantity").alias("eta"), F.count_if(F.col("l_returnflag") != "R").alias("remaining"))
    p = p.withColumn("most", F.lit(6)).withColumn("each", F.lit(8))
    return p.select("l_orderkey", F.round(V.time_left("eta", "remaining", "each", "iteration", "most"), 4).alias("seconds"))


@query("""SELECT DISTINCT event_type, event_id % 5 AS restarts, CASE WHEN event_type = 'error' THEN event_id % 5 < 3 ELSE event_id % 5 < 1 END AS retry, CASE WHEN event_type = 'error' THEN 120 ELSE 0 END AS delay FROM events""")
def retry_decisions(spark, folder):
    e = table(spark, folder, "events").select("event_type", (F.col("event_id") % 5).alias("restarts")).distinct()
    r = V.retry_policy(F.when(F.col("event_type") == "error", "jetsam_oom").otherwise("code"), F.col("restarts"))
    return e.select("event_type", "restarts", r["retry"].alias("retry"), r["delay"].alias("delay"))


_TRIED = "SELECT p_brand AS run, p_size AS params, max(p_retailprice) AS score, max(p_partkey % 7) AS g FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1, 2"


@query(f"""WITH t AS ({_TRIED}), now AS (SELECT DISTINCT p_size AS params FROM part WHERE p_brand = 'Brand#2' AND p_partkey % 5 = 0), own AS (SELECT * FROM t WHERE run = 'Brand#1'), pool AS (SELECT * FROM own UNION ALL SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM own))
SELECT params, max(score) AS score FROM pool WHERE params NOT IN (SELECT params FROM now) GROUP BY 1 ORDER BY score DESC, params LIMIT 5""")
def warm_start(spark, folder):
    """The five best parameters of an earlier run that the present one has not tried."""
    p = table(spark, folder, "part")
    prior = p.where("p_partkey % 3 <> 0").groupBy(F.col("p_brand").alias("run"), F.col("p_size").alias("params")).agg(F.max("p_retailprice").alias("score"))
    current = p.where("p_brand = 'Brand#2' AND p_partkey % 5 = 0").select(F.col("p_size").alias("params"))
    return SE.warm_start(prior, current, "Brand#1", n=5)


@query(f"""WITH t AS ({_TRIED}), own AS (SELECT * FROM t WHERE run = 'Brand#1'), f AS (SELECT * FROM own a WHERE NOT EXISTS (SELECT 1 FROM own b WHERE b.score >= a.score AND b.g >= a.g AND (b.score > a.score OR b.g > a.g)))
SELECT params, max(score) AS score FROM f GROUP BY 1 ORDER BY score DESC, params LIMIT 3""")
def warm_start_front(spark, folder):
    """Seeds from the Pareto front of an earlier run."""
    p = table(spark, folder, "part")
    prior = p.where("p_partkey % 3 <> 0").groupBy(F.col("p_brand").alias("run"), F.col("p_size").alias("params")).agg(F.max("p_retailprice").alias("score"), F.max(F.col("p_partkey") % 7).alias("g"))
    return SE.warm_start(prior, prior.limit(0), "Brand#1", goals=["score", "g"], n=3)


# small expressions

@query(f"""WITH {POOL_SQL} SELECT shard_id, CASE WHEN aesthetic_avg IS NOT NULL THEN round(greatest(0, least(1, (aesthetic_avg * 10 - 1) / 9)), 9) END AS aesthetic, CASE WHEN try_cast(shard_id AS BIGINT) < 400000 THEN 'journeydb' ELSE 'laion_coyo' END AS guess, substr(shard_id || '_checkpoint', 1, 12) AS checkpoint,
'v_' || substr(sha256('{{"keep":"' || coalesce(light_decision, 'none') || '","source":"' || regexp_replace(source, '[^a-z0-9]', '', 'g') || '"}}'), 1, 6) AS version, substr(sha256('{{"keep":"' || coalesce(light_decision, 'none') || '","source":"' || regexp_replace(source, '[^a-z0-9]', '', 'g') || '"}}'), 1, 16) AS params FROM pool""")
def shard_marks(spark, folder):
    """Small values of a shard: normalised aesthetics, a source by its number, and hashes of what it was made with."""
    config = F.create_map(F.lit("source"), F.regexp_replace("source", "[^a-z0-9]", ""), F.lit("keep"), F.coalesce("light_decision", F.lit("none")))
    return _pool(spark, folder).select(
        "shard_id", F.round(N.aesthetic_share(F.col("aesthetic_avg") * 10), 9).alias("aesthetic"), T.source_by_number(F.col("shard_id")).alias("guess"), T.checkpoint_mark(F.concat("shard_id", F.lit("_checkpoint.safetensors"))).alias("checkpoint"),
        T.config_hash(config, 6, "v_").alias("version"), T.config_hash(config).alias("params"),
    )


@query("SELECT id, min(height // 8) AS rows, min(width // 8) AS columns FROM images WHERE width > 0 AND height > 0 GROUP BY id")
def latent_grid(spark, folder):
    i = table(spark, folder, "images").where("width > 0 AND height > 0")
    return i.groupBy("id").agg(F.min(N.grid_side(F.col("height"))).alias("rows"), F.min(N.grid_side(F.col("width"))).alias("columns"))


@query("""WITH m AS (SELECT avg(l_quantity) AS a, stddev_pop(l_quantity) AS b, avg(l_tax) AS c, stddev_pop(l_tax) AS d FROM lineitem), z AS (SELECT l_orderkey, l_linenumber, (l_quantity - a) / (b + 1e-6) AS x, (l_tax - c) / (d + 1e-6) AS y FROM lineitem, m)
SELECT l_orderkey, l_linenumber, round(x / (sqrt(x * x + y * y) + 1e-8), 6) + 0.0 AS z_quantity, round(y / (sqrt(x * x + y * y) + 1e-8), 6) + 0.0 AS z_tax FROM z""")
def look_scores(spark, folder):
    """Statistics of every row as deviations from their means, scaled to length one."""
    z = N.standardised(table(spark, folder, "lineitem"), ["l_quantity", "l_tax"])
    return z.select("l_orderkey", "l_linenumber", (F.round("z_l_quantity", 6) + F.lit(0.0)).alias("z_quantity"), (F.round("z_l_tax", 6) + F.lit(0.0)).alias("z_tax"))


@query("SELECT id, ('0x' || substr(md5(url || ':0'), 1, 15))::BIGINT AS url_id FROM (SELECT id, min(url) AS url FROM images WHERE url IS NOT NULL GROUP BY id)")
def url_ids(spark, folder):
    """Numeric ids from addresses."""
    one = table(spark, folder, "images").where("url IS NOT NULL").groupBy("id").agg(F.min("url").alias("url"))
    return one.select("id", R.seeded_order("url", 0).alias("url_id"))
