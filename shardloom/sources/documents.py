"""Semi-structured sources: annotation lines, sidecars, trainer logs, metric files, vector bundles."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ANNOTATION = "img_path string, caption string, prompt string, Prompt2 string, Task2 struct<Caption: string>"


def annotations(lines: DataFrame, column: str = "value", priority: tuple[str, ...] = ("caption", "task", "prompt")) -> DataFrame:
    """``stem, caption``: the first non-blank field in order of priority; the last line of a stem counts.

    Blank and broken lines are skipped. ``lines`` may have ``position``; else
    the order of equal stems is that of the line's text.
    """
    parsed = lines.where(F.trim(F.coalesce(column, F.lit(""))) != "").withColumn("j", F.from_json(column, ANNOTATION, {"mode": "PERMISSIVE"}))
    field = {"caption": F.col("j.caption"), "task": F.col("j.Task2.Caption"), "prompt": F.col("j.prompt")}
    caption = F.coalesce(*[F.nullif(F.trim(field[p]), F.lit("")) for p in priority])
    stem = F.regexp_extract(F.element_at(F.split("j.img_path", "/"), -1), r"^(.*?)(\.[^.]*)?$", 1)
    order = F.col("position") if "position" in lines.columns else F.col(column)
    rows = parsed.where(F.col("j.img_path").isNotNull()).select(stem.alias("stem"), caption.alias("caption"), order.alias("o"))
    return rows.where(F.col("caption").isNotNull()).groupBy("stem").agg(F.max_by("caption", "o").alias("caption"))


def metric_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """``step, val_loss`` from lines of JSON, bad lines skipped, the last value of a step."""
    j = F.from_json(column, "step bigint, val_loss double")
    rows = lines.select(j.alias("j"), F.col(column).alias("o")).where("j.step IS NOT NULL AND j.val_loss IS NOT NULL")
    return rows.groupBy(F.col("j.step").alias("step")).agg(F.max_by(F.col("j.val_loss"), F.col("o")).alias("val_loss"))


#: What a trainer's log lines look like.
STEP = r"step\s+([\d,]+)"
FIELDS = {"loss_cond": r"loss_cond=([-+\d.eE]+)", "loss_ref": r"loss_ref=([-+\d.eE]+)", "ip_scale": r"ip_scale=([-+\d.eE]+)", "val_gap": r"VAL gap\s+([-+\d.eE]+)", "pairs": r"pairs=(\d+)"}
LEAST_PAIRS = 16


def log_fields(line: Column) -> dict[str, Column]:
    """Numbers of a log line by field, null where the line has none."""
    out = {"step": F.regexp_replace(F.regexp_extract(line, STEP, 1), ",", "").try_cast("bigint")}
    for name, pattern in FIELDS.items():
        out[name] = F.nullif(F.regexp_extract(line, pattern, 1), F.lit("")).try_cast("double")
    return out


def _explode_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, r"\r?\n")).alias("line_no", "line"))


def latest_metrics(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, step, loss_cond, loss_ref, ip_scale, gap``: the last value of each field of a log.

    The gap is that of the last validation line with enough pairs, else
    loss_ref minus loss_cond.
    """
    rows = _explode_lines(df, key, text)
    fields = log_fields(F.col("line"))
    rows = rows.select(key, "line_no", *[c.alias(n) for n, c in fields.items()])
    last = lambda c, on=None: F.max_by(c, F.when(F.col(c).isNotNull() if on is None else on, F.col("line_no")))
    g = rows.groupBy(key).agg(*[last(c).alias(c) for c in ("step", "loss_cond", "loss_ref", "ip_scale")], last("val_gap", F.col("val_gap").isNotNull() & (F.coalesce("pairs", F.lit(0)) >= LEAST_PAIRS)).alias("val_gap"))
    return g.select(key, "step", "loss_cond", "loss_ref", "ip_scale", F.coalesce("val_gap", F.col("loss_ref") - F.col("loss_cond")).alias("gap"))


def snapshots(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, snapshot, step, loss_cond, val_gap``: what follows a step line up to the next, as one row."""
    rows = _explode_lines(df, key, text)
    fields = log_fields(F.col("line"))
    rows = rows.select(key, "line_no", *[c.alias(n) for n, c in fields.items()])
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("snapshot", F.sum(F.col("step").isNotNull().cast("int")).over(w)).where("snapshot > 0")
    return placed.groupBy(key, "snapshot").agg(F.max("step").alias("step"), F.max_by("loss_cond", F.when(F.col("loss_cond").isNotNull(), F.col("line_no"))).alias("loss_cond"), F.max_by("val_gap", F.when(F.col("val_gap").isNotNull(), F.col("line_no"))).alias("val_gap"))


SIDECAR = "shard_id string, light struct<score: double, decision: string>, unified struct<final_value_score: double>, provenance struct<sources: array<struct<type: string>>>"


def sidecars(spark: SparkSession, path: str) -> DataFrame:
    """``shard_id, light_score, light_decision, final_value_score, sources`` from one JSON document per shard.

    A missing light score falls back to the unified one; broken documents are skipped.
    """
    docs = spark.read.schema(SIDECAR).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return docs.where("shard_id IS NOT NULL").select(
        "shard_id",
        F.coalesce("light.score", "unified.final_value_score").alias("light_score"),
        F.coalesce("light.decision", F.when(F.col("unified").isNotNull(), "keep").otherwise("unknown")).alias("light_decision"),
        F.col("unified.final_value_score").alias("final_value_score"),
        F.transform("provenance.sources", lambda s: s["type"]).alias("sources"),
    )


def vector_bundles(spark: SparkSession, path: str) -> DataFrame:
    """``bundle, rec_id, vec`` from .npz files of arrays by record id, scaled to unit length; half-written files are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"]):
                try:
                    with np.load(io.BytesIO(data), allow_pickle=False) as bundle:
                        ids = list(bundle.files)
                        vecs = [np.ravel(bundle[i]).astype("f4") for i in ids]
                except (ValueError, OSError, EOFError, KeyError):
                    continue
                vecs = [v / max(float(np.linalg.norm(v)), 1e-8) for v in vecs]
                yield pd.DataFrame({"bundle": name.rpartition("/")[2].partition(".")[0], "rec_id": ids, "vec": vecs})

    return files.mapInPandas(run, "bundle string, rec_id string, vec array<float>")
