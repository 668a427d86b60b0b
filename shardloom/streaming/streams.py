"""Structured Streaming: follow a growing table, stop early per key, aggregate late data."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import shared_dir, stage



def _stream_path(path: str) -> str:
    """The path as a pattern: a file stream takes a single file only through one."""
    return path if path.endswith("/") or any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def follow(spark: SparkSession, path: str, like: DataFrame, transform=None, key: str | None = None, at: str | None = None, late: str = "1 day", mode: str = "append", folder: str | None = None) -> DataFrame:
    """What a stream over the files at ``path`` writes once it has seen all of them.

    Rows of the same ``key`` are taken once within the watermark on ``at``. The
    stream's progress and output are in ``folder``: a call with the same one
    goes on where the last stopped and writes nothing twice. Without a folder
    the stream begins anew, in the shared folder.
    """
    base = folder or f"{shared_dir(spark).rstrip('/')}/stream/{uuid.uuid4().hex}"
    rows = spark.readStream.schema(like.schema).parquet(_stream_path(path))
    if at:
        rows = rows.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    if key:
        rows = rows.dropDuplicatesWithinWatermark([key]) if at else rows.dropDuplicates([key])
    out = transform(rows) if transform else rows
    query = out.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).format("parquet").option("path", f"{base}/out").start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


def windowed_counts(rows: DataFrame, at: str, by: str, value: str, width: str = "1 hour") -> DataFrame:
    """Counts and sums per time window and key; needs a watermark in a stream. An extension, not parity."""
    return rows.groupBy(F.window(at, width), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def early_stops(rows: DataFrame, key: str, order: str, value: str, patience: int, min_delta: float) -> DataFrame:
    """``key, seen, high, stop_at`` of a stream: per key the row at which ``patience`` rows had brought no new high.

    State per key is four numbers. Rows of one trigger are taken in order of
    ``order``; one row per key and trigger comes out (update mode).
    """

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, high, wait, stop = state.get if state.exists else (0, None, 0, None)
        rows = pd.concat([p[[order, value]] for p in parts]).sort_values(order, kind="stable")[value].to_numpy("f8", na_value=np.nan)
        rows = rows[~np.isnan(rows)]
        at = 0
        while at < len(rows):
            # from one new high that counts to the next
            better = np.flatnonzero(rows[at:] > high + min_delta) if high is not None else np.array([0])
            flat = int(better[0]) if len(better) else len(rows) - at
            if stop is None and wait + flat >= patience:
                stop = seen + max(0, patience - wait)
            wait, seen, at = wait + flat, seen + flat, at + flat
            if at < len(rows):
                high, wait, seen, at = float(rows[at]), 0, seen + 1, at + 1
        state.update((seen, high, wait, stop))
        yield pd.DataFrame({key: [k[0]], "seen": [seen], "high": [high], "stop_at": pd.array([stop], "Int64")})

    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, seen bigint, high double, stop_at bigint", "seen bigint, high double, wait bigint, stop bigint", "update", GroupStateTimeout.NoTimeout)


def run_early_stops(spark: SparkSession, path: str, like: DataFrame, key: str, order: str, value: str, patience: int, min_delta: float, folder: str | None = None) -> DataFrame:
    """The final state of ``early_stops`` over all files at ``path``: the row of each key with the most rows seen; ``folder`` as in ``follow``."""
    base = folder or f"{shared_dir(spark).rstrip('/')}/stream/{uuid.uuid4().hex}"
    out = early_stops(spark.readStream.schema(like.schema).parquet(_stream_path(path)), key, order, value, patience, min_delta)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")  # a repeated batch replaces itself

    query = out.writeStream.outputMode("update").option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    rows = spark.read.schema(out.schema).option("recursiveFileLookup", True).parquet(f"{base}/out")
    return stage(rows.groupBy(key).agg(F.max(F.struct("seen", "high", "stop_at")).alias("r")).select(key, "r.*"), "stops")
