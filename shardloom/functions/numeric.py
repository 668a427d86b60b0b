"""Numeric expressions: clamps, fallbacks and the four kinds of percentile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """``value`` within bounds; null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def finite(value: Column) -> Column:
    """``value`` as a double, null where it is null or NaN."""
    v = value.cast("double")
    return F.when(~F.isnan(v), v)


def nonzero(value: Column) -> Column:
    """Null where the value is 0, for rules that take 0 as missing."""
    return F.nullif(value, F.lit(0))


def index_percentile(ordered: Column, share: float) -> Column:
    """The element at floor(share * n), counted from 0, of an ordered array; null for an empty one."""
    n = F.size(ordered)
    return F.when(n > 0, F.element_at(ordered, F.least(n, F.floor(n * share).cast("int") + 1)))


def upper_median(ordered: Column) -> Column:
    """The element at n // 2."""
    return index_percentile(ordered, 0.5)


def redistribute(parts: list[tuple[Column, float]], total: float | None = None) -> Column:
    """Weighted sum of parts; the weights of null parts go to the others in proportion. Null if all are null."""
    whole = sum(w for _, w in parts) if total is None else total
    have = None
    value = None
    for c, w in parts:
        h = F.when(c.isNotNull(), F.lit(w)).otherwise(0.0)
        v = F.coalesce(c * F.lit(w), F.lit(0.0))
        have = h if have is None else have + h
        value = v if value is None else value + v
    return F.when(have > 0, value * F.lit(whole) / have)


def aesthetic_share(score: Column) -> Column:
    """A score from 1 to 10 as one from 0 to 1."""
    return clamp((score - 1.0) / 9.0)


def grid_side(pixels: Column, step: int = 8) -> Column:
    """Whole steps in a side."""
    return F.floor(pixels / step).cast("int")


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """``z_<column>`` for every column: deviations from the mean in standard deviations, each row scaled to length one. Null where one is null."""
    row = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    joined = df.crossJoin(F.broadcast(row))  # one row
    z = [(F.col(c) - F.col(f"m{i}")) / (F.col(f"s{i}") + 1e-6) for i, c in enumerate(columns)]
    length = F.sqrt(sum((v * v for v in z[1:]), z[0] * z[0])) + 1e-8
    return joined.withColumns({f"z_{c}": v / length for c, v in zip(columns, z)}).drop(*row.columns)
