"""Score documents beside a shard: light scores, the unified score, provenance; and other small files read as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import joined_label

LIGHT = "source string, decision string, light_scores struct<combined_score: double, aesthetic_avg: double, caption_quality: double>"
UNIFIED = "source string, final_value_score double, light_score double, training_loss_normalized double, components struct<diversity: struct<value: double, source: string>>"
PROVENANCE = "shard_id string, sources array<struct<type: string, path: string>>"
SUFFIXES = {"light": ".light_scores.json", "unified": ".unified_score.json", "provenance": ".provenance.json"}


def sidecar_texts(spark: SparkSession, folder: str) -> DataFrame:
    """``shard_id, light, unified, provenance``: the raw documents of every shard that has one, by the names of the files."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(folder)
    named = files.select("value", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"))
    own = lambda kind: F.max(F.when(F.col("name").endswith(SUFFIXES[kind]), F.col("value")))
    known = F.lit(False)
    for suffix in SUFFIXES.values():
        known = known | F.col("name").endswith(suffix)
    return named.where(known).groupBy(F.regexp_extract("name", r"^([^.]*)", 1).alias("shard_id")).agg(*[own(k).alias(k) for k in SUFFIXES])


def _parsed(text: str, schema: str) -> Column:
    """The document, null if there is none or it is broken."""
    j = F.from_json(text, f"{schema}, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    return F.when(F.col(text).isNotNull() & j["__bad"].isNull(), j)


def provenance_label(sources: Column) -> Column:
    """The kinds of a shard's sources as one label; null if none is known."""
    return joined_label(F.transform(sources, lambda s: F.when(s["type"] == "jdb", F.lit("journeydb")).otherwise(s["type"])))


def index_rows(texts: DataFrame) -> DataFrame:
    """One index row per shard from its documents.

    The unified source goes before the light one, provenance before both. A
    shard without a unified score takes its light score as its value; without
    a light document its decision is unknown. Broken documents count as absent.
    """
    d = texts.withColumn("l", _parsed("light", LIGHT)).withColumn("u", _parsed("unified", UNIFIED)).withColumn("p", _parsed("provenance", PROVENANCE))
    has_l, has_u = F.col("l").isNotNull(), F.col("u").isNotNull()
    light = F.when(has_l, F.coalesce("l.light_scores.combined_score", F.lit(0.0)))
    return d.select(
        "shard_id",
        F.coalesce(provenance_label(F.col("p.sources")), F.when(has_u, F.col("u.source")), F.when(has_l, F.col("l.source")), F.lit("unknown")).alias("source"),
        has_l.cast("int").alias("has_light_score"),
        light.alias("light_score"),
        F.coalesce(F.when(has_l, F.col("l.decision")), F.lit("unknown")).alias("light_decision"),
        F.col("l.light_scores.aesthetic_avg").alias("aesthetic_avg"),
        F.col("l.light_scores.caption_quality").alias("caption_quality"),
        has_u.cast("int").alias("has_unified"),
        F.when(has_u, F.coalesce("u.final_value_score", F.lit(0.0))).otherwise(light).alias("final_value_score"),
        F.col("u.training_loss_normalized").alias("training_loss_normalized"),
        F.col("u.components.diversity.value").alias("diversity_score"),
        F.when(F.col("u.components.diversity.value").isNotNull(), F.coalesce("u.components.diversity.source", F.lit("source_rarity"))).alias("diversity_source"),
    )


def fallback_rows(texts: DataFrame) -> DataFrame:
    """The same where there is no index: scores are 0 instead of null, provenance is not looked at, and a shard with a unified score alone is kept."""
    d = texts.withColumn("l", _parsed("light", LIGHT)).withColumn("u", _parsed("unified", UNIFIED))
    has_u = F.col("u").isNotNull()
    light = F.coalesce("l.light_scores.combined_score", F.lit(0.0))
    decision = F.coalesce("l.decision", F.lit("unknown"))
    return d.select(
        "shard_id",
        F.coalesce(F.when(has_u, F.col("u.source")), F.col("l.source"), F.lit("unknown")).alias("source"),
        F.when(has_u, F.coalesce("u.light_score", light)).otherwise(light).alias("light_score"),
        F.when(has_u & (decision == "unknown"), "keep").otherwise(decision).alias("light_decision"),
        F.col("u").isNotNull().cast("int").alias("has_unified"),
        F.when(has_u, F.coalesce("u.final_value_score", F.lit(0.0))).otherwise(light).alias("final_value_score"),
    )


def evaluation_results(texts: DataFrame, run: str, text: str) -> DataFrame:
    """``run, clip_i``: ``clip_i_mean`` of a result document, else ``clip_i`` (0 counts as missing); broken documents are skipped."""
    j = F.from_json(text, "clip_i_mean double, clip_i double")
    value = F.coalesce(F.nullif(j["clip_i_mean"], F.lit(0.0)), j["clip_i"])
    return texts.select(run, value.alias("clip_i")).where("clip_i IS NOT NULL")


def scan_evaluations(spark: SparkSession, pattern: str) -> DataFrame:
    """The results of every evaluation folder that a path pattern names."""
    files = spark.read.option("wholetext", True).text(pattern).select(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("run"), "value")
    return evaluation_results(files, "run", "value")


def database_table(spark: SparkSession, url: str, name: str, key: str | None = None, parts: int = 1, bounds: tuple[int, int] = (0, 1), options: dict[str, str] | None = None) -> DataFrame:
    """A table of a database over JDBC, read only; with a numeric key in ``parts`` ranges at once. The driver class has to be on the class path."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
    for k, v in (options or {}).items():
        reader = reader.option(k, v)
    if key and parts > 1:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()
