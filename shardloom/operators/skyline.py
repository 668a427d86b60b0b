"""Pareto fronts: rows no other row is at least as good as in all and better in one objective."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage


def front_mask(x: np.ndarray, block: int = 256) -> np.ndarray:
    """Rows of ``x`` (greater is better) that no row dominates."""
    order = np.lexsort(tuple(-x[:, i] for i in range(x.shape[1] - 1, -1, -1)))
    keep = np.zeros(len(x), bool)
    front = np.empty((0, x.shape[1]))
    for start in range(0, len(x), block):
        part = order[start : start + block]
        y = x[part]
        bad = ((front[:, None] >= y[None]).all(2) & (front[:, None] > y[None]).any(2)).any(0) if len(front) else np.zeros(len(y), bool)
        bad |= ((y[:, None] >= y[None]).all(2) & (y[:, None] > y[None]).any(2)).any(0)
        keep[part[~bad]] = True
        front = np.concatenate([front, np.unique(y[~bad], axis=0)])
    return keep


def pareto_front(df: DataFrame, key: str, best_high: list[str], best_low: list[str] = (), nulls_as_zero: bool = False) -> DataFrame:
    """Keys of the front. Rows with a null or NaN objective are out, or count as 0 if so asked.

    Equal rows are all kept. Partitions find their own fronts first; only those
    meet in one task, on distinct objective values.
    """
    goals = [*best_high, *best_low]
    sign = [1.0] * len(best_high) + [-1.0] * len(best_low)
    cols = []
    for i, (g, s) in enumerate(zip(goals, sign)):
        v = F.when(~F.isnan(F.col(g).cast("double")), F.col(g).cast("double"))
        cols.append(((F.coalesce(v, F.lit(0.0)) if nulls_as_zero else v) * s).alias(f"g{i}"))
    rows = stage(df.select(F.col(key).alias("k"), *cols).dropna(), "goals")
    names = [f"g{i}" for i in range(len(goals))]

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for b in batches:
            x = b[names].drop_duplicates() if kept is None else pd.concat([kept, b[names]]).drop_duplicates()
            kept = x[front_mask(x.to_numpy("f8"))] if len(x) else x
        if kept is not None:
            yield kept

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        x = part[names].drop_duplicates()
        return x[front_mask(x.to_numpy("f8"))]

    shape = ", ".join(f"{n} double" for n in names)
    front = rows.select(*names).mapInPandas(own, shape).groupBy(F.lit(0).alias("g")).applyInPandas(merge, shape)
    return rows.join(front, names).select(F.col("k").alias(key))
