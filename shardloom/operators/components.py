"""Connected components of an edge table, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``; root is the component's smallest node.

    Alternating large-star and small-star: every round replaces the edges of a
    node by edges to its smallest neighbour, which takes a number of rounds
    logarithmic in the longest chain. Round results are tables in the shared
    folder. Self-loops count as nodes of their own; null ends are dropped.
    """
    pairs = edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = stage(pairs, "edges")
    seen = None
    for _ in range(rounds):
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v >= u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        own = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(own, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(own.select("u", F.col("m").alias("v")))
        pairs = stage(small.where("u >= v").distinct(), "edges")
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return pairs.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
