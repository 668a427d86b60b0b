"""What problems 2, 3 and 6 share: the current row of every shard and source names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..io import latest_rows


def source_key(name: Column) -> Column:
    """Letters, digits and ``+`` of a source name in lower case; null where it names no source."""
    key = F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}+]", "")
    return F.when((key != "") & (key != "unknown"), key)


def current_shards(shards: DataFrame) -> DataFrame:
    """One row per shard, the latest indexed; ``source_key`` added. A null shard_id is no shard."""
    return latest_rows(shards, "shard_id", "indexed_at").withColumn("source_key", source_key(F.col("source")))


def listed_sources(targets: DataFrame) -> DataFrame:
    """``source_targets`` with ``source_key``; of rows that name the same source the first in order of name counts."""
    keyed = targets.withColumn("source_key", source_key(F.col("source"))).where("source_key IS NOT NULL")
    others = [c for c in keyed.columns if c != "source_key"]
    first = keyed.groupBy("source_key").agg(F.min(F.struct("source", *[c for c in others if c != "source"])).alias("r"))
    return first.select("source_key", *[F.col(f"r.`{c}`").alias(c) for c in others])


def unit_score(value: Column) -> Column:
    """``value`` where it is a number from 0 to 1, else null."""
    return F.when(~F.isnan(value) & value.between(0.0, 1.0), value)


#: The same current rows for the SQL check.
CURRENT_SQL = r"""
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY shard_id ORDER BY indexed_at DESC NULLS LAST) AS rn
  FROM shards WHERE shard_id IS NOT NULL
),
cur AS (
  SELECT * EXCLUDE (rn), nullif(nullif(regexp_replace(lower(source), '[^\p{L}\p{N}+]', '', 'g'), ''), 'unknown') AS source_key
  FROM ranked WHERE rn = 1
),
listed AS (
  SELECT *, regexp_replace(lower(source), '[^\p{L}\p{N}+]', '', 'g') AS source_key FROM source_targets
)"""
