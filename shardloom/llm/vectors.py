"""What problems 4 and 5 share: usable vectors and matrices from Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage

DIMENSIONS = 64


def usable_vectors(vectors: DataFrame, key: str = "rec_id", vec: str = "vec", at: str = "encoded_at", dimensions: int = DIMENSIONS) -> DataFrame:
    """``rec, vec``: one row per record with a usable vector, the latest one.

    A vector is usable if it has ``dimensions`` finite values that are not all
    zero. Null keys are left out. The result is a table in the shared folder.
    """
    v = F.col("vec")
    fine = (F.size(v) == dimensions) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > 1e30)) & F.exists(v, lambda x: x != 0)
    newest = vectors.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("rec")).agg(F.max(F.struct(F.col(at).alias("at"), F.col(vec).alias("vec"))).alias("r"))
    return stage(newest.select("rec", F.col("r.vec").cast("array<float>").alias("vec")).where(fine), "vectors")


def matrix(column: pa.Array, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The rows of a list column as float32, scaled to unit length in double precision."""
    if not len(column):
        return np.empty((0, dimensions), "f4")
    raw = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dimensions).astype("f8")
    raw /= np.abs(raw).max(axis=1, keepdims=True)
    return (raw / np.linalg.norm(raw, axis=1, keepdims=True)).astype("f4")
