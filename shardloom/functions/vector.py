"""Vector expressions on array columns, and packed vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; arrays of different length give null."""
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x))


def norm(a: Column, floor: float = 1e-8) -> Column:
    """Length of a vector, at least ``floor``."""
    return F.greatest(F.sqrt(dot(a, a)), F.lit(floor))


def unit(a: Column) -> Column:
    """The vector scaled to unit length."""
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def unpack_nibbles(packed: pd.Series, scale: pd.Series) -> pd.Series:
    """Two signed 4-bit values per byte, the low one first, times the scale; null for null."""

    def one(data: bytes | None, by: float | None) -> np.ndarray | None:
        if data is None or by is None or by != by:
            return None
        raw = np.frombuffer(data, "u1")
        out = np.empty(2 * len(raw), "i1")
        out[0::2], out[1::2] = raw & 15, raw >> 4
        return (np.where(out >= 8, out - 16, out) * by).astype("f4")

    return pd.Series([one(d, s) for d, s in zip(packed, scale)])


@F.pandas_udf(T.StructType([T.StructField("packed", T.BinaryType()), T.StructField("scale", T.FloatType())]))
def pack_nibbles(vectors: pd.Series) -> pd.DataFrame:
    """A vector of even length as signed 4-bit values: scale is the greatest magnitude by 7; null for null."""
    rows = []
    for v in vectors:
        if v is None:
            rows.append((None, None))
            continue
        x = np.asarray(v, "f4")
        scale = float(np.abs(x).max() / 7) if len(x) and np.abs(x).max() > 0 else 1.0
        q = np.clip(np.rint(x / scale), -8, 7).astype("i1") & 15
        rows.append(((q[0::2] | (q[1::2] << 4)).astype("u1").tobytes(), scale))
    return pd.DataFrame(rows, columns=["packed", "scale"])
