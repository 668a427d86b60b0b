"""The queries of the core library by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import comparison_queries, curation_queries, data_queries, log_queries, pool_queries, report_queries, rule_queries, stream_queries


def _modules() -> list:
    return [pool_queries, log_queries, data_queries, stream_queries, curation_queries, comparison_queries, rule_queries, report_queries]


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """The shards an expression of the boolean language selects."""
    return pool_queries.QUERIES["dsl_top_pct_not_source"](spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for m in _modules() for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.SQL.items()}
