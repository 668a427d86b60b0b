"""Operators for preparing language-model training data.

Nothing outside this package imports it. ``queries`` and ``oracle_sql`` are
added to the driver's registry when the package is present.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _modules() -> list:
    from . import p01_quality, p02_diverse, p03_mixture, p04_clusters, p05_neighbours, p06_cutoff, p07_incremental, p08_encode, p09_packing, p10_level

    return [p01_quality, p02_diverse, p03_mixture, p04_clusters, p05_neighbours, p06_cutoff, p07_incremental, p08_encode, p09_packing, p10_level]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for m in _modules() for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in getattr(m, "SQL", {}).items()}
