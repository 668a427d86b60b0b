"""Table access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def latest_rows(df: DataFrame, key: str, at: str) -> DataFrame:
    """One row per non-null ``key``: the one with the greatest ``at``.

    A null ``at`` counts as the earliest. Among rows of the same ``at`` the one
    whose values sort last wins, so the result does not depend on row order.
    The aggregate combines before the shuffle, so a key of many rows is no hot
    spot. Map columns are not supported.
    """
    others = [c for c in df.columns if c not in (key, at)]
    picked = df.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("__k")).agg(
        F.max(F.struct(F.col(f"`{at}`").alias("__at"), *[F.col(f"`{c}`") for c in others])).alias("__r")
    )
    back: dict[str, Column] = {key: F.col("__k"), at: F.col("__r.__at")}
    return picked.select(*[back.get(c, F.col(f"__r.`{c}`")).alias(c) for c in df.columns])
