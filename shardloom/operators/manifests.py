"""Selections as documents: entries of both decisions, a digest of the whole, provenance, and what two of them share."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import source_when_built
from ..session import discard


def selection_digest(entries: DataFrame, key: str = "shard_id", decision: str = "decision") -> DataFrame:
    """``checksum``: SHA-256 of the compact JSON list of the ordered (id, decision) pairs.

    The digest is of one text, so one task feeds it pair by pair from rows
    sorted outside memory; nothing is collected. Rows with a null key are left
    out, a null decision counts as empty.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest, first = hashlib.sha256(b"["), True
        for batch in batches:
            for pair in zip(batch["k"], batch["d"]):
                digest.update((b"" if first else b",") + json.dumps(pair, separators=(",", ":")).encode())
                first = False
        digest.update(b"]")
        yield pd.DataFrame({"checksum": [digest.hexdigest()]})

    pairs = entries.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("k"), F.coalesce(decision, F.lit("")).alias("d"))
    return pairs.repartition(1).sortWithinPartitions("k", "d").mapInPandas(run, "checksum string")


def write_manifest(entries: DataFrame, folder: str, name: str) -> str:
    """The entries of a selection as a JSON-lines table ``folder/name``, with its digest and counts beside it.

    It is written under another name and renamed, so that a reader sees the old
    one or the new one whole. Returns the path.
    """
    spark = entries.sparkSession
    fs, path = _files(spark, folder)
    target, part = f"{folder.rstrip('/')}/{name}", f"{folder.rstrip('/')}/.{name}.part"
    entries.write.mode("overwrite").json(f"{part}/entries")
    written = spark.read.schema(entries.schema).json(f"{part}/entries")
    counts = written.groupBy().agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("decision") == "include").alias("included"))
    counts.crossJoin(F.broadcast(selection_digest(written))).coalesce(1).write.mode("overwrite").json(f"{part}/header")  # one row each
    discard(spark, target)
    fs.rename(path(part), path(target))
    return target


def read_manifest(spark: SparkSession, path: str, schema) -> DataFrame:
    """The entries of a written selection; one whose digest does not fit is an error, one without a digest passes."""
    entries = spark.read.schema(schema).json(f"{path}/entries")
    header = spark.read.json(f"{path}/header").first()
    if header and "checksum" in header.asDict() and header.checksum != selection_digest(entries).first().checksum:
        raise ValueError(f"the entries of {path} do not fit their checksum")
    return entries


def _files(spark: SparkSession, folder: str):
    """The Hadoop file system of a folder, and how to name a path in it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def provenance(records: DataFrame, shard: str, path: str) -> DataFrame:
    """``shard, sources``: the distinct files a shard was built from, in order of path, each with its kind and number.

    The number is that of a numeric file name of kind ``jdb``. Null paths are
    left out; a shard without any has an empty list.
    """
    stem = F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"^(.*?)(\.[^.]*)?$", 1)
    kind = source_when_built(F.col(path))
    one = F.struct(F.col(path).alias("path"), kind.alias("type"), F.when(kind == "jdb", stem.try_cast("int")).alias("number"))
    return records.groupBy(shard).agg(F.array_sort(F.collect_set(F.when(F.col(path).isNotNull(), one))).alias("sources"))


def selection_overlap(sides: DataFrame, examples: int = 5) -> DataFrame:
    """``side, n, first_ids``: how many shards two selections share or not, and the first few of each (from ``compare_selections``)."""
    from .ranking import top_per_group

    counts = sides.groupBy("side").agg(F.count(F.lit(1)).alias("n"))
    first = top_per_group(sides, ["side"], [F.asc("shard_id")], examples).groupBy("side").agg(F.array_join(F.array_sort(F.collect_list("shard_id")), ",").alias("first_ids"))
    return counts.join(first, "side")
