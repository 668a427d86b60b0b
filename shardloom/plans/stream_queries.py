"""Queries that run a stream over a table to its end, and queries over logs kept as documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..io import table
from ..sources import documents as D
from ..streaming import streams as ST


def stream_follow(spark: SparkSession, folder: str) -> DataFrame:
    """Events taken once each by a stream, counted by kind."""
    like = table(spark, folder, "events")
    seen = ST.follow(spark, f"{folder}/events.parquet", like, key="event_id", at="ts")
    return seen.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


def stream_early_stop(spark: SparkSession, folder: str) -> DataFrame:
    """Per user the event at which three events had brought no new high."""
    like = table(spark, folder, "events")
    return ST.run_early_stops(spark, f"{folder}/events.parquet", like, "user_id", "event_id", "value", 3, 1.0)


def log_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """The last metrics of every document that is a trainer's log."""
    return D.latest_metrics(table(spark, folder, "documents"), "doc_id", "text").where("step IS NOT NULL")


def log_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    return D.snapshots(table(spark, folder, "documents"), "doc_id", "text").groupBy("doc_id").agg(F.count(F.lit(1)).alias("snapshots"), F.max("step").alias("last_step"), F.round(F.avg("loss_cond"), 6).alias("mean_loss"))


QUERIES = {"stream_follow": stream_follow, "stream_early_stop": stream_early_stop, "log_metrics": log_metrics, "log_snapshots": log_snapshots}

_LINES = r"""l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\r?\n')) AS line, generate_subscripts(regexp_split_to_array(text, '\r?\n'), 1) AS i FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, i, try_cast(replace(regexp_extract(line, 'step\s+([\d,]+)', 1), ',', '') AS BIGINT) AS step, try_cast(nullif(regexp_extract(line, 'loss_cond=([-+\d.eE]+)', 1), '') AS DOUBLE) AS loss_cond,
  try_cast(nullif(regexp_extract(line, 'loss_ref=([-+\d.eE]+)', 1), '') AS DOUBLE) AS loss_ref, try_cast(nullif(regexp_extract(line, 'ip_scale=([-+\d.eE]+)', 1), '') AS DOUBLE) AS ip_scale,
  try_cast(nullif(regexp_extract(line, 'VAL gap\s+([-+\d.eE]+)', 1), '') AS DOUBLE) AS val_gap, try_cast(nullif(regexp_extract(line, 'pairs=(\d+)', 1), '') AS DOUBLE) AS pairs FROM l)"""

SQL = {
    "stream_early_stop": """WITH o AS (SELECT user_id, list(value ORDER BY event_id) AS l FROM events WHERE value IS NOT NULL GROUP BY 1),
r AS (SELECT user_id, list_reduce(l, lambda s, x: {'high': CASE WHEN s.high IS NULL OR x > s.high + 1 THEN x ELSE s.high END, 'wait': CASE WHEN s.high IS NULL OR x > s.high + 1 THEN 0 ELSE s.wait + 1 END, 'n': s.n + 1,
  'stop': CASE WHEN s.stop IS NOT NULL THEN s.stop WHEN NOT (s.high IS NULL OR x > s.high + 1) AND s.wait + 1 >= 3 THEN s.n + 1 END}, {'high': NULL::DOUBLE, 'wait': 0, 'n': 0, 'stop': NULL::INT}) AS s FROM o)
SELECT user_id, s.n AS seen, s.high AS high, s.stop AS stop_at FROM r""",
    "stream_follow": "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1",
    "log_metrics": f"""WITH {_LINES}, g AS (SELECT doc_id, max_by(step, i) FILTER (step IS NOT NULL) AS step, max_by(loss_cond, i) FILTER (loss_cond IS NOT NULL) AS loss_cond, max_by(loss_ref, i) FILTER (loss_ref IS NOT NULL) AS loss_ref,
  max_by(ip_scale, i) FILTER (ip_scale IS NOT NULL) AS ip_scale, max_by(val_gap, i) FILTER (val_gap IS NOT NULL AND coalesce(pairs, 0) >= 16) AS val_gap FROM f GROUP BY 1)
SELECT doc_id, step, loss_cond, loss_ref, ip_scale, coalesce(val_gap, loss_ref - loss_cond) AS gap FROM g WHERE step IS NOT NULL""",
    "log_snapshots": f"""WITH {_LINES}, p AS (SELECT *, sum(CASE WHEN step IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS s FROM f),
g AS (SELECT doc_id, s, max(step) AS step, max_by(loss_cond, i) FILTER (loss_cond IS NOT NULL) AS loss_cond FROM p WHERE s > 0 GROUP BY 1, 2) SELECT doc_id, count(*) AS snapshots, max(step) AS last_step, round(avg(loss_cond), 6) AS mean_loss FROM g GROUP BY 1""",
}
