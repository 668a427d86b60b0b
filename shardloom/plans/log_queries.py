"""Queries over observation logs (lineitem), histories (orders) and metric events (events)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..io import table
from ..operators import attribution as A
from ..operators import series as S

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return keep


def _log(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem as an observation log: shard, source, campaign, iteration, role and values; some values are null."""
    l = table(spark, folder, "lineitem")
    return l.select(
        F.col("l_suppkey").alias("shard"),
        (F.col("l_suppkey") % 7).cast("int").alias("source"),
        F.year("l_shipdate").alias("campaign"),
        F.trunc("l_shipdate", "month").alias("iteration"),
        F.when(F.col("l_returnflag") == "R", "excluded").otherwise("included").alias("role"),
        F.when(F.col("l_quantity") > 2, F.col("l_discount")).alias("cond_gap"),
        F.col("l_tax").alias("ref_gap"),
        (F.col("l_extendedprice") / 20000).alias("loss"),
        "l_orderkey",
        "l_linenumber",
    )


LOG = """log AS (
  SELECT l_suppkey AS shard, (l_suppkey % 7)::INT AS source, year(l_shipdate) AS campaign, date_trunc('month', l_shipdate) AS iteration,
         CASE WHEN l_returnflag = 'R' THEN 'excluded' ELSE 'included' END AS role, CASE WHEN l_quantity > 2 THEN l_discount END AS cond_gap,
         l_tax AS ref_gap, l_extendedprice / 20000 AS loss, l_orderkey, l_linenumber FROM lineitem
)"""


@query(f"""WITH {LOG} SELECT shard, round(avg(cond_gap) FILTER (role = 'included'), 4) AS included_mean, round(avg(cond_gap) FILTER (role = 'excluded'), 4) AS excluded_mean,
count(cond_gap) FILTER (role = 'included') AS included_n, count(cond_gap) FILTER (role = 'excluded') AS excluded_n FROM log GROUP BY shard""")
def role_means(spark, folder):
    out = A.role_means(_log(spark, folder), ["shard"], "cond_gap")
    return out.withColumn("included_mean", F.round("included_mean", 4)).withColumn("excluded_mean", F.round("excluded_mean", 4))


@query(f"""WITH {LOG}, o AS (SELECT shard, cond_gap AS v, row_number() OVER (PARTITION BY shard ORDER BY iteration, l_orderkey, l_linenumber) AS i, count(*) OVER (PARTITION BY shard) AS c FROM log)
SELECT o.shard, max(o.c) AS n, round(list_reduce(list_prepend(NULL::DOUBLE, list(v ORDER BY i)), lambda a, x, i: CASE WHEN x IS NULL THEN a WHEN a IS NULL THEN x ELSE a + (x - a) / (i - 1) END), 4) AS mean
FROM o GROUP BY o.shard""")
def running_mean(spark, folder):
    out = A.running_fold(_log(spark, folder), ["shard"], ["iteration", "l_orderkey", "l_linenumber"], "cond_gap")
    return out.withColumn("mean", F.round("mean", 4))


@query(f"""WITH {LOG}, o AS (SELECT shard, role, list(cond_gap ORDER BY iteration, l_orderkey, l_linenumber) AS l FROM log GROUP BY 1, 2)
SELECT shard, role, len(l) AS n, round(list_reduce(list_prepend(NULL::DOUBLE, l), lambda a, x: CASE WHEN x IS NULL THEN a WHEN a IS NULL THEN x ELSE a + (x - a) * 0.2 END), 4) AS mean FROM o""")
def ema_fold(spark, folder):
    out = A.running_fold(_log(spark, folder), ["shard", "role"], ["iteration", "l_orderkey", "l_linenumber"], "cond_gap", alpha=0.2)
    return out.withColumn("mean", F.round("mean", 4))


@query(f"""WITH {LOG}, p AS (SELECT campaign, source, shard, avg(cond_gap) FILTER (role = 'included') - avg(cond_gap) FILTER (role = 'excluded') AS a, count(cond_gap) FILTER (role = 'included') AS i, count(cond_gap) FILTER (role = 'excluded') AS e FROM log GROUP BY ALL)
SELECT source, count(*) AS shards, round(avg(a), 4) AS attribution, round(stddev_pop(a), 4) AS spread, round(count(DISTINCT campaign) / (SELECT count(DISTINCT campaign) FROM log), 4) AS ubiquity, CASE WHEN count(*) >= 5 THEN 1 ELSE 0 END AS trusted
FROM p WHERE i >= 2 AND e >= 2 GROUP BY source""")
def attribution_by_source(spark, folder):
    return A.attribution_by_source(_log(spark, folder), "cond_gap")


@query(f"""WITH {LOG}, g AS (SELECT iteration, source, count(*) AS n FROM log WHERE role = 'included' GROUP BY ALL)
SELECT strftime(iteration, '%Y-%m') AS iteration, source, n, round(n / sum(n) OVER (PARTITION BY iteration), 4) AS share FROM g""")
def source_iteration_mix(spark, folder):
    return A.iteration_mix(_log(spark, folder).where("role = 'included'"), "iteration", "source").withColumn("iteration", F.date_format("iteration", "yyyy-MM"))


@query(f"""WITH {LOG}, s AS (SELECT iteration, row_number() OVER (ORDER BY iteration) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT iteration FROM log)),
t AS (SELECT iteration, CASE WHEN i <= n // 3 THEN 'first' WHEN i > n - n // 3 THEN 'last' END AS part FROM s WHERE n >= 6),
c AS (SELECT source, count(*) FILTER (part = 'first') AS f, count(*) FILTER (part = 'last') AS l FROM log JOIN t USING (iteration) WHERE part IS NOT NULL GROUP BY source),
r AS (SELECT source, f / sum(f) OVER () AS a, l / sum(l) OVER () AS b FROM c)
SELECT source, round(a, 4) AS first_share, round(b, 4) AS last_share, round(b - a, 4) AS change, CASE WHEN abs(b - a) > 0.02 THEN 1 ELSE 0 END AS drifted FROM r""")
def share_drift(spark, folder):
    return A.share_drift(_log(spark, folder), "iteration", "source")


def _norm(gap: str) -> str:
    return f"greatest(0, least(1, {gap} + 0.5))"


def _composite(ref: str, cond: str, loss: str | None = None) -> str:
    """SQL of the composite of present signals."""
    parts = [(ref, _norm(ref), 0.2), (cond, _norm(cond), 0.65)] + ([(loss, f"(1 - greatest(0, least(1, ({loss} - 0.3) / 2.7)))", 0.15)] if loss else [])
    value = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE {w}::DOUBLE * {n} END" for c, n, w in parts)
    have = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE {w}::DOUBLE END" for c, _, w in parts)
    return f"CASE WHEN {have} > 0 THEN ({value}) / ({have}) END"


_EFFECTIVE = f"""WITH {LOG}, m AS (SELECT shard, avg(ref_gap) FILTER (role = 'included') AS ri, avg(cond_gap) FILTER (role = 'included') AS ci, avg(loss) FILTER (role = 'included') AS li, avg(ref_gap) FILTER (role = 'excluded') AS re, avg(cond_gap) FILTER (role = 'excluded') AS ce,
  count(*) FILTER (role = 'included') AS i, count(*) FILTER (role = 'excluded') AS e, quantile_cont(loss, 0.95) AS p95, count(*) FILTER (loss > 3) AS hard FROM log GROUP BY shard),
s AS (SELECT shard, hard, p95, {_composite("ri", "ci", "li")} AS raw, {_composite("ri", "ci")} - {_composite("re", "ce")} AS a, CASE WHEN i >= 3 AND e >= 3 THEN least(1, 2.0 * i * e / (i + e) / 3) ELSE 0 END AS conf FROM m),
f AS (SELECT shard, raw, conf, greatest(0, least(1, CASE WHEN a IS NOT NULL AND conf > 0 THEN greatest(0, least(1, raw + conf * a)) ELSE raw END + 0.05 * least(1, hard / 50.0) - 0.05 * greatest(0, least(1, (coalesce(p95, 0) - 1.5) / 3)))) AS eff FROM s WHERE raw IS NOT NULL
  UNION ALL SELECT shard, NULL, conf, NULL FROM s WHERE raw IS NULL)
"""


def _effective(spark, folder):
    log = _log(spark, folder)
    m = log.groupBy("shard").agg(F.percentile("loss", 0.95).alias("p95"), F.count_if(F.col("loss") > 3).alias("hard"))
    m = m.join(A.observation_fold(log, ["shard"], ["iteration", "l_orderkey", "l_linenumber"], ["ref_gap", "cond_gap", "loss"]), "shard")
    raw = A.composite(F.col("ref_gap_included"), F.col("cond_gap_included"), F.col("loss_included"))
    conf = A.confidence(F.col("n_included"), F.col("n_excluded"), 3)
    lift = A.composite(F.col("ref_gap_included"), F.col("cond_gap_included")) - A.composite(F.col("ref_gap_excluded"), F.col("cond_gap_excluded"))
    return m.withColumn("raw", raw).withColumn("conf", conf).withColumn("eff", A.effective(F.col("raw"), F.col("conf"), lift, F.col("hard"), F.col("p95")))


@query(_EFFECTIVE + "SELECT shard, round(raw, 4) AS raw, round(conf, 4) AS confidence, round(eff, 4) AS effective FROM f")
def effective_score(spark, folder):
    return _effective(spark, folder).select("shard", F.round("raw", 4).alias("raw"), F.round("conf", 4).alias("confidence"), F.round("eff", 4).alias("effective"))


@query(_EFFECTIVE + "SELECT shard, round(coalesce(nullif(eff, 0), raw) - raw, 4) + 0.0 AS moved, CASE WHEN (eff >= 0.5) <> (raw >= 0.5) THEN 1 ELSE 0 END AS flipped, row_number() OVER (ORDER BY round(abs(coalesce(eff, 0) - raw), 9) DESC NULLS LAST, shard) AS place FROM f")
def attribution_flips(spark, folder):
    """Shards by how far attribution moves their score; a score of 0 counts as none in what is reported."""
    from ..operators.ranking import global_rank

    e = _effective(spark, folder)
    far = F.coalesce(F.round(F.abs(F.coalesce("eff", F.lit(0.0)) - F.col("raw")), 9), F.lit(-1.0))
    moved = F.round(F.coalesce(F.nullif("eff", F.lit(0.0)), F.col("raw")) - F.col("raw"), 4) + F.lit(0.0)
    flipped = F.coalesce((F.col("eff") >= 0.5) != (F.col("raw") >= 0.5), F.lit(False)).cast("int")
    return global_rank(e, far, "shard", "place").select("shard", moved.alias("moved"), flipped.alias("flipped"), F.col("place").cast("bigint").alias("place"))


@query(f"""WITH {LOG}, m AS (SELECT shard, role, count(*) AS n, avg(cond_gap) AS mean, max_by(cond_gap, (iteration, l_orderkey, l_linenumber)) FILTER (cond_gap IS NOT NULL) AS last FROM log GROUP BY 1, 2)
SELECT shard, max(n) FILTER (role = 'included') AS n_included, round(max(mean) FILTER (role = 'included'), 4) AS mean_included, max(last) FILTER (role = 'included') AS last_included,
  max(n) FILTER (role = 'excluded') AS n_excluded, round(max(mean) FILTER (role = 'excluded'), 4) AS mean_excluded, max(last) FILTER (role = 'excluded') AS last_excluded FROM m GROUP BY 1""")
def observation_fold(spark, folder):
    out = A.observation_fold(_log(spark, folder), ["shard"], ["iteration", "l_orderkey", "l_linenumber"], ["cond_gap"])
    n = lambda r: F.nullif(f"n_{r}", F.lit(0)).alias(f"n_{r}")
    return out.select("shard", *[c for r in ("included", "excluded") for c in (n(r), F.round(f"cond_gap_{r}", 4).alias(f"mean_{r}"), F.col(f"last_cond_gap_{r}").alias(f"last_{r}"))])


@query(f"""WITH {LOG} SELECT shard, round(avg(cond_gap), 4) AS cond, round(avg(ref_gap), 4) AS ref, count(*) AS n, max_by(l_orderkey * 10 + l_linenumber, (iteration, l_orderkey, l_linenumber)) AS last_observation FROM log WHERE campaign = 1997 GROUP BY shard""")
def rescope_campaign(spark, folder):
    one = _log(spark, folder).where("campaign = 1997")
    last = A.latest_observation(one, ["shard"], ["iteration", "l_orderkey", "l_linenumber"]).select("shard", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("last_observation"))
    return one.groupBy("shard").agg(F.round(F.avg("cond_gap"), 4).alias("cond"), F.round(F.avg("ref_gap"), 4).alias("ref"), F.count(F.lit(1)).alias("n")).join(last, "shard")


@query(f"""WITH {LOG}, z AS (SELECT avg(loss) AS null_mean FROM log WHERE cond_gap IS NULL), c AS (SELECT shard, avg(loss) AS m, count(*) AS n FROM log WHERE cond_gap IS NOT NULL GROUP BY shard)
SELECT shard, n, round(null_mean - m, 4) AS benefit FROM c, z WHERE n >= 3""")
def cond_benefit(spark, folder):
    log = _log(spark, folder)
    base = log.where("cond_gap IS NULL").agg(F.avg("loss")).first()[0]
    per = log.where("cond_gap IS NOT NULL").groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.avg("loss").alias("m")).where("n >= 3")
    return per.select("shard", "n", F.round(F.lit(base) - F.col("m"), 4).alias("benefit"))


@query(f"WITH {LOG} SELECT shard, round(quantile_cont(loss, 0.5), 4) AS p50, round(quantile_cont(loss, 0.75), 4) AS p75, round(quantile_cont(loss, 0.95), 4) AS p95, round(quantile_cont(loss, 0.99), 4) AS p99 FROM log GROUP BY shard")
def loss_percentiles(spark, folder):
    p = _log(spark, folder).groupBy("shard").agg(F.percentile("loss", [0.5, 0.75, 0.95, 0.99]).alias("p"))
    return p.select("shard", *[F.round(F.col("p")[i], 4).alias(n) for i, n in enumerate(("p50", "p75", "p95", "p99"))])


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS loss FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50")
def hard_examples_topk(spark, folder):
    return table(spark, folder, "lineitem").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(50).select("l_orderkey", "l_linenumber", F.round("l_extendedprice", 2).alias("loss"))


@query(f"WITH {LOG}, s AS (SELECT campaign, shard, count(*) FILTER (role = 'included') AS k FROM log GROUP BY 1, 2) SELECT campaign, least(k, 3) AS scored, count(*) AS shards FROM s GROUP BY 1, 2")
def scored_histogram(spark, folder):
    s = _log(spark, folder).groupBy("campaign", "shard").agg(F.count_if(F.col("role") == "included").alias("k"))
    return s.groupBy("campaign", F.least("k", F.lit(3)).alias("scored")).agg(F.count(F.lit(1)).alias("shards"))


@query(f"WITH {LOG}, f AS (SELECT shard, min(iteration) AS i FROM log GROUP BY shard) SELECT strftime(i, '%Y-%m') AS iteration, count(*) AS first_contacts FROM f GROUP BY 1")
def first_contacts(spark, folder):
    f = _log(spark, folder).groupBy("shard").agg(F.min("iteration").alias("i"))
    return f.groupBy(F.date_format("i", "yyyy-MM").alias("iteration")).agg(F.count(F.lit(1)).alias("first_contacts"))


@query("""WITH o AS (SELECT l_orderkey, string_agg(DISTINCT (l_suppkey % 7)::VARCHAR, '+' ORDER BY (l_suppkey % 7)::VARCHAR) AS label, avg(l_discount) AS m FROM lineitem WHERE l_suppkey % 7 <> 0 GROUP BY l_orderkey)
SELECT label, count(*) AS orders, round(avg(m), 4) AS mean_score FROM o GROUP BY label""")
def provenance_rollup(spark, folder):
    from ..functions.text import joined_label

    l = table(spark, folder, "lineitem").withColumn("s", F.when(F.col("l_suppkey") % 7 == 0, "unknown").otherwise((F.col("l_suppkey") % 7).cast("string")))
    o = l.groupBy("l_orderkey").agg(joined_label(F.collect_set("s")).alias("label"), F.avg(F.when(F.col("s") != "unknown", F.col("l_discount"))).alias("m")).where("label IS NOT NULL")
    return o.groupBy("label").agg(F.count(F.lit(1)).alias("orders"), F.round(F.avg("m"), 4).alias("mean_score"))


# histories: orders by customer

ORD = "ORDER BY o_orderdate, o_orderkey"


def _runs(spark, folder) -> DataFrame:
    return table(spark, folder, "orders").withColumn("v", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")))


RUNS = "runs AS (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS v FROM orders)"
BY, ORDER = ["o_custkey"], ["o_orderdate", "o_orderkey"]


@query(f"""WITH {RUNS}, p AS (SELECT *, max(v) OVER (PARTITION BY o_custkey {ORD} ROWS UNBOUNDED PRECEDING) AS best FROM runs) SELECT o_orderkey, round(best, 4) AS best FROM p""")
def running_best(spark, folder):
    return S.running_best(_runs(spark, folder), BY, ORDER, "v").select("o_orderkey", F.round("best", 4).alias("best"))


@query(f"""WITH {RUNS}, p AS (SELECT o_orderkey, v, count(v) OVER w AS n, avg(v) OVER w AS m, stddev_pop(v) OVER w AS s FROM runs WINDOW w AS (PARTITION BY o_custkey {ORD} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT o_orderkey, round(CASE WHEN n >= 2 THEN m ELSE v END, 4) AS mean, round(CASE WHEN n >= 2 THEN s ELSE 0 END, 4) AS spread FROM p""")
def rolling_band(spark, folder):
    return S.rolling_band(_runs(spark, folder), BY, ORDER, "v").select("o_orderkey", F.round("mean", 4).alias("mean"), F.round("spread", 4).alias("spread"))


@query(f"""WITH {RUNS}, t AS (SELECT o_custkey, v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS b FROM runs WHERE v IS NOT NULL),
g AS (SELECT o_custkey, count(v) AS n, max_by(v, b) AS f, min_by(v, b) AS l, max(v) AS t FROM t WHERE b <= 4 GROUP BY o_custkey)
SELECT o_custkey, n, CASE WHEN n < 4 THEN 'short' WHEN l < f THEN 'regression' WHEN t - f < 100000 THEN 'plateau' ELSE 'moving' END AS state FROM g""")
def plateau(spark, folder):
    return S.plateau(_runs(spark, folder).where("v IS NOT NULL"), BY, ORDER, "v", threshold=100_000)


@query(f"""WITH {RUNS}, p AS (SELECT o_custkey, v, row_number() OVER (PARTITION BY o_custkey {ORD}) AS i FROM runs WHERE v IS NOT NULL), b AS (SELECT o_custkey, max(v) AS best, max(i) AS n FROM p GROUP BY 1)
SELECT o_custkey, round(best, 4) AS best, n - min(i) AS since FROM p JOIN b USING (o_custkey) WHERE v = best GROUP BY o_custkey, best, n""")
def evals_since_best(spark, folder):
    return S.since_best(_runs(spark, folder), BY, ORDER, "v").select("o_custkey", F.round("best", 4).alias("best"), "since")


@query(f"""WITH {RUNS}, o AS (SELECT o_custkey, list(v ORDER BY o_orderdate, o_orderkey) AS l FROM runs WHERE v IS NOT NULL GROUP BY 1)
SELECT o_custkey, list_reduce(l, lambda s, x: {{'high': CASE WHEN s.high IS NULL OR x > s.high + 5000 THEN x ELSE s.high END, 'wait': CASE WHEN s.high IS NULL OR x > s.high + 5000 THEN 0 ELSE s.wait + 1 END, 'i': s.i + 1,
  'stop': CASE WHEN s.stop IS NOT NULL THEN s.stop WHEN NOT (s.high IS NULL OR x > s.high + 5000) AND s.wait + 1 >= 4 THEN s.i + 1 END}}, {{'high': NULL::DOUBLE, 'wait': 0, 'i': 0, 'stop': NULL::INT}}).stop AS stop_at FROM o""")
def early_stop(spark, folder):
    return S.early_stop(_runs(spark, folder), BY, ORDER, "v", 4, 5000.0)


@query(f"""WITH {RUNS}, t AS (SELECT o_custkey, v, o_orderkey % 97 AS loss, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS b FROM runs WHERE v IS NOT NULL),
d AS (SELECT *, v - lag(v) OVER (PARTITION BY o_custkey ORDER BY b DESC) AS dg, loss - lag(loss) OVER (PARTITION BY o_custkey ORDER BY b DESC) AS dl FROM t WHERE b <= 3)
SELECT o_custkey, CASE WHEN count(*) = 3 AND coalesce(bool_and(dg < 0 AND dl <= 0), false) AND min_by(loss, b) < max_by(loss, b) THEN 1 ELSE 0 END AS overtrained FROM d GROUP BY 1""")
def overtrained(spark, folder):
    return S.overtrained(_runs(spark, folder).where("v IS NOT NULL").withColumn("loss", F.col("o_orderkey") % 97), BY, ORDER, "v", "loss")


@query(f"""WITH {RUNS}, p AS (SELECT o_orderkey, v - last_value(v IGNORE NULLS) OVER (PARTITION BY o_custkey {ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS d FROM runs) SELECT o_orderkey, round(d, 3) AS delta FROM p""")
def lag_delta(spark, folder):
    return S.delta_to_previous(_runs(spark, folder), BY, ORDER, "v").select("o_orderkey", F.round("delta", 3).alias("delta"))


@query(f"""WITH {RUNS}, t AS (SELECT o_custkey, v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS b FROM runs WHERE v IS NOT NULL), g AS (SELECT o_custkey, count(*) AS n, max_by(v, b) AS a, min_by(v, b) AS c FROM t WHERE b <= 3 GROUP BY 1)
SELECT o_custkey, CASE WHEN n < 3 THEN 'short' WHEN (c - a) / greatest(abs(a), 1e-9) > 0.02 THEN 'up' WHEN (c - a) / greatest(abs(a), 1e-9) < -0.02 THEN 'down' ELSE 'flat' END AS trend FROM g""")
def trend_label(spark, folder):
    return S.trend_label(_runs(spark, folder), BY, ORDER, "v")


@query(f"""WITH {RUNS}, p AS (SELECT o_custkey, o_totalprice AS x, row_number() OVER (PARTITION BY o_custkey {ORD}) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM runs)
SELECT o_custkey, count(*) AS n, round(avg(x), 4) AS mean, round(stddev_pop(x), 4) AS spread FROM p WHERE i > 2 * n // 5 GROUP BY 1""")
def settled_statistics(spark, folder):
    out = S.settled_statistics(_runs(spark, folder).withColumn("x", F.col("o_totalprice")), BY, ORDER, "x")
    return out.select("o_custkey", "n", F.round("mean", 4).alias("mean"), F.round("spread", 4).alias("spread"))


@query("""WITH t AS (SELECT o_custkey, o_orderstatus, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC ROWS UNBOUNDED PRECEDING) AS ok FROM orders WHERE o_orderstatus <> 'P')
SELECT o_custkey, count(*) FILTER (ok = 0 AND o_orderstatus = 'O') AS streak FROM t GROUP BY 1""")
def failure_streak(spark, folder):
    return S.trailing_streak(table(spark, folder, "orders"), BY, ORDER, "o_orderstatus", failed="O", success="F", skip="P")


@query("""WITH s AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS done, sum(o_totalprice) FILTER (o_orderstatus = 'F') AS total, max(o_totalprice) FILTER (o_orderstatus = 'F') AS top, date_diff('day', min(o_orderdate), max(o_orderdate)) AS days FROM orders GROUP BY 1),
b AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderdate, o_orderkey) AS r FROM orders WHERE o_orderstatus = 'F'), l AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders)
SELECT s.o_custkey, n, done, round(total, 2) AS total, days, b.o_orderkey AS best_run, l.o_orderkey AS last_run FROM s LEFT JOIN b ON b.o_custkey = s.o_custkey AND b.r = 1 LEFT JOIN l ON l.o_custkey = s.o_custkey AND l.r = 1""")
def campaign_summary(spark, folder):
    o = table(spark, folder, "orders")
    done = F.col("o_orderstatus") == "F"
    return o.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(done).alias("done"),
        F.round(F.sum(F.when(done, F.col("o_totalprice"))), 2).alias("total"),
        F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).alias("days"),
        F.max_by(F.when(done, F.col("o_orderkey")), F.when(done, F.struct("o_totalprice", -F.unix_micros(F.col("o_orderdate").cast("timestamp")), -F.col("o_orderkey")))).alias("best_run"),
        F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_run"),
    )


@query("""WITH c AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F')
SELECT c_mktsegment AS family, o_orderkey AS champion, round(o_totalprice, 2) AS score, CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN 'new' ELSE 'old' END AS era FROM c WHERE r = 1""")
def campaign_champions(spark, folder):
    from ..operators.ranking import top_per_group

    o = table(spark, folder, "orders").where("o_orderstatus = 'F'").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    best = top_per_group(o, ["c_mktsegment"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 1)
    return best.select(F.col("c_mktsegment").alias("family"), F.col("o_orderkey").alias("champion"), F.round("o_totalprice", 2).alias("score"), F.when(F.col("o_orderdate") >= F.to_timestamp(F.lit("1998-01-01")), "new").otherwise("old").alias("era"))


@query("SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'P') AS pending, count(*) FILTER (o_orderstatus = 'X') AS failed FROM orders GROUP BY 1")
def status_histogram(spark, folder):
    o = table(spark, folder, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P", "X"]).count().na.fill(0)
    return o.select("o_custkey", F.col("F").alias("done"), F.col("O").alias("open"), F.col("P").alias("pending"), F.col("X").alias("failed"))


@query("""WITH first AS (SELECT o_custkey, l_suppkey AS shard, min((o_orderdate, o_orderkey)) AS f FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT o_custkey, shard, row_number() OVER (PARTITION BY o_custkey ORDER BY f, shard) AS place FROM first""")
def consumed_in_order(spark, folder):
    """Shards each campaign consumed, in the order first seen."""
    l = table(spark, folder, "lineitem").join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    first = l.groupBy("o_custkey", F.col("l_suppkey").alias("shard")).agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("f"))
    return first.select("o_custkey", "shard", F.row_number().over(Window.partitionBy("o_custkey").orderBy("f", "shard")).cast("bigint").alias("place"))


# metric events

EBY, EORDER = ["event_type"], ["ts", "event_id"]


@query("""WITH c AS (SELECT max(ts) - INTERVAL 10 DAY AS cut FROM events), e AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i FROM events, c WHERE ts >= cut)
SELECT event_type AS metric, count(value) AS n, round(avg(value), 4) AS mean, min(value) AS low, max(value) AS high, min_by(value, i) AS first, max_by(value, i) AS last, round(coalesce(regr_slope(value, i), 0), 6) AS slope FROM e GROUP BY 1""")
def trend_summary(spark, folder):
    return _trends(spark, folder).select(F.col("event_type").alias("metric"), "n", F.round("mean", 4).alias("mean"), "low", "high", "first", "last", F.round("slope", 6).alias("slope"))


def _trends(spark, folder) -> DataFrame:
    e = table(spark, folder, "events")
    newest = e.agg(F.max("ts")).first()[0]
    return S.trend_summary(e.where(F.col("ts") >= F.lit(newest) - F.expr("INTERVAL 10 DAYS")), EBY, EORDER, "value")


@query("""WITH c AS (SELECT max(ts) - INTERVAL 10 DAY AS cut FROM events), e AS (SELECT event_type AS metric, count(value) AS n, avg(value) AS mean, max(value) AS high, max_by(value, (ts, event_id)) AS last FROM events, c WHERE ts >= cut GROUP BY 1),
r AS (SELECT * FROM (VALUES ('click', 'above', 20.0), ('click', 'spike', 1.5), ('view', 'below', 30.0), ('error', 'drop', 0.5), ('purchase', 'above', 1000.0)) t(metric, kind, threshold))
SELECT metric, kind, CASE WHEN coalesce(CASE kind WHEN 'above' THEN last > threshold WHEN 'below' THEN last < threshold WHEN 'spike' THEN n >= 3 AND last > threshold * mean WHEN 'drop' THEN n >= 3 AND last < threshold * high END, false) THEN 1 ELSE 0 END AS fired FROM e JOIN r USING (metric)""")
def alert_rules(spark, folder):
    rules = spark.createDataFrame([("click", "above", 20.0), ("click", "spike", 1.5), ("view", "below", 30.0), ("error", "drop", 0.5), ("purchase", "above", 1000.0)], "metric string, kind string, threshold double")
    return S.alerts(_trends(spark, folder).withColumnRenamed("event_type", "metric"), rules)


@query("""WITH w AS (SELECT * FROM (VALUES ('click', 1.0), ('view', 0.3), ('purchase', 2.0), ('error', 0.0)) t(event_type, weight)), m AS (SELECT user_id, event_type, avg(greatest(-1, least(1, value / 50 - 1))) AS m FROM events GROUP BY 1, 2)
SELECT user_id AS item, CASE WHEN sum(weight) > 0 THEN round(sum(weight * m) / sum(weight), 4) ELSE 0.0 END AS preference, round(greatest(0, least(1, round(0.5 + 0.2 * CASE WHEN sum(weight) > 0 THEN sum(weight * m) / sum(weight) ELSE 0 END, 6))), 4) AS blended FROM m JOIN w USING (event_type) GROUP BY 1""")
def preference_weighted(spark, folder):
    """Preferences: mean per source, then weighted over sources; blended into a base score of 0.5."""
    weights = spark.createDataFrame([("click", 1.0), ("view", 0.3), ("purchase", 2.0), ("error", 0.0)], "event_type string, weight double")
    per = table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.avg(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("value") / 50 - 1))).alias("m"))
    g = per.join(F.broadcast(weights), "event_type").groupBy("user_id").agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("m")).alias("s"))
    p = F.when(F.col("w") > 0, F.col("s") / F.col("w")).otherwise(F.lit(0.0))
    return g.select(F.col("user_id").alias("item"), F.round(p, 4).alias("preference"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(0.5 + 0.2 * p, 6))), 4).alias("blended"))


@query("""WITH s AS (SELECT user_id, ts AS t0 FROM events WHERE event_type = 'signup'), p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase')
SELECT p.event_id, round(date_diff('microsecond', s.t0, p.ts) / 3600000000.0, 2) AS hours FROM p ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.ts > s.t0""")
def asof_stage_duration(spark, folder):
    return _stages(spark, folder).select("event_id", F.round("hours", 2).alias("hours"))


def _stages(spark, folder) -> DataFrame:
    e = table(spark, folder, "events")
    ends = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    starts = e.where("event_type = 'signup'").select("user_id", F.col("ts").alias("t0"))
    joined = S.as_of(ends, starts, ["user_id"], "ts", "t0", "t0", "started")
    return joined.withColumn("hours", (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / 3600000000.0)


@query("""WITH s AS (SELECT user_id, ts AS t0 FROM events WHERE event_type = 'signup'), p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
d AS (SELECT p.user_id, p.event_id, date_diff('microsecond', s.t0, p.ts) / 3600000000.0 AS h FROM p ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.ts > s.t0)
SELECT user_id, count(*) AS stages, round(sum(h), 2) AS total, round(min(h), 2) AS shortest, round(max(h), 2) AS longest, round(avg(h), 2) AS mean, arg_max(event_id, (h, -event_id)) FILTER (h IS NOT NULL) AS slowest FROM d GROUP BY 1""")
def stage_summary(spark, folder):
    h = F.col("hours")
    return _stages(spark, folder).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("stages"), F.round(F.sum(h), 2).alias("total"), F.round(F.min(h), 2).alias("shortest"), F.round(F.max(h), 2).alias("longest"), F.round(F.avg(h), 2).alias("mean"),
        F.max_by(F.when(h.isNotNull(), F.col("event_id")), F.when(h.isNotNull(), F.struct(h, -F.col("event_id")))).alias("slowest"),
    )


@query("""WITH m AS (SELECT user_id, ts, event_id, coalesce(value > 30, false) AS state FROM events), l AS (SELECT *, CASE WHEN state IS NOT DISTINCT FROM lag(state) OVER w THEN 0 ELSE 1 END AS s FROM m WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT user_id, state, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM l), n AS (SELECT user_id, run, count(*) AS n FROM r WHERE state GROUP BY 1, 2)
SELECT user_id, sum(n // 2)::BIGINT AS fired FROM n GROUP BY 1""")
def sustained_threshold(spark, folder):
    return S.sustained(table(spark, folder, "events"), ["user_id"], EORDER, "value", 30, 2)


@query("""WITH m AS (SELECT user_id, ts, event_id, event_type AS state FROM events), l AS (SELECT *, CASE WHEN state IS NOT DISTINCT FROM lag(state) OVER w THEN 0 ELSE 1 END AS s FROM m WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM l), g AS (SELECT user_id, run, min(ts) AS a, max(ts) AS b FROM r GROUP BY 1, 2)
SELECT user_id, count(*) AS runs, count(*) FILTER (date_diff('microsecond', a, b) > 86400000000) AS stalls FROM g GROUP BY 1""")
def progress_stall(spark, folder):
    """Runs of an unchanged state, and those that lasted longer than a day."""
    runs = S.islands(table(spark, folder, "events"), ["user_id"], EORDER, F.col("event_type")).groupBy("user_id", "run").agg((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).alias("d"))
    return runs.groupBy("user_id").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("d") > 86400000000).alias("stalls"))


@query("""WITH b AS (SELECT least(19, floor((l_extendedprice - lo) / (hi - lo) * 20))::INT AS bin FROM lineitem, (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)) SELECT bin, count(*) AS n FROM b GROUP BY 1""")
def histogram_bins(spark, folder):
    """Twenty bins of equal width, the last one closed."""
    l = table(spark, folder, "lineitem")
    low, high = l.agg(F.min("l_extendedprice"), F.max("l_extendedprice")).first()
    return l.groupBy(F.least(F.lit(19), F.floor((F.col("l_extendedprice") - low) / (high - low) * 20)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
