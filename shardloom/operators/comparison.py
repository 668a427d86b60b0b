"""Comparisons of arms and versions, rule tables, priorities, grids, and subset picks over vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .similarity import _unit, usable


def compare_pair(results: DataFrame, a: str, b: str, metrics: list[str], arm: str = "arm", lower_better: tuple[str, ...] = (), tie: float = 1e-9) -> DataFrame:
    """``metric, a, b, delta, winner`` of two arms that have one row each; a missing value loses to none and ties with nothing."""
    long = results.where(F.col(arm).isin(a, b)).unpivot([arm], metrics, "metric", "value")
    wide = long.groupBy("metric").agg(F.max(F.when(F.col(arm) == a, F.col("value"))).alias("a"), F.max(F.when(F.col(arm) == b, F.col("value"))).alias("b"))
    sign = F.when(F.col("metric").isin(*lower_better), -1.0).otherwise(1.0) if lower_better else F.lit(1.0)
    delta = F.col("b") - F.col("a")
    winner = F.when(delta.isNull(), F.lit(None)).when(F.abs(delta) <= tie, "tie").when(delta * sign > 0, b).otherwise(a)
    return wide.select("metric", "a", "b", delta.alias("delta"), winner.alias("winner"))


def fired_rules(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """``key, rule`` for every rule (a boolean column) that holds; null does not hold."""
    hits = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]), lambda x: x.isNotNull())
    return df.select(key, F.explode(hits).alias("rule"))


def resolve_version(versions: DataFrame, group: str, version: str, current: str, complete: str, n: str, made: str) -> DataFrame:
    """``group, version``: the current one if it has records, else the newest complete one, else ``flat``."""
    usable_ = versions.withColumn("p", F.when(F.col(current) & (F.col(n) > 0), 2).when(F.col(complete), 1).otherwise(0))
    best = usable_.groupBy(group).agg(F.max(F.struct("p", F.col(made).alias("m"), F.col(version).alias("v"))).alias("b"))
    return best.select(group, F.when(F.col("b.p") > 0, F.col("b.v").cast("string")).otherwise(F.lit("flat")).alias("version"))


def first_source_wins(parts: list[DataFrame], key: str) -> DataFrame:
    """The union of tables of the same columns, each key from the first table that has it."""
    both = None
    for i, p in enumerate(parts):
        p = p.withColumn("__i", F.lit(i))
        both = p if both is None else both.unionByName(p, allowMissingColumns=True)
    others = [c for c in both.columns if c not in (key, "__i")]
    return both.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct("__i", *others)).alias("r")).select(key, F.col("r.__i").alias("part"), *[F.col(f"r.{c}").alias(c) for c in others])


def parameter_grid(df: DataFrame, grid: dict[str, list]) -> DataFrame:
    """Every row once for every combination of values (the lists are written by hand)."""
    for name, values in grid.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def rated_neighbours(df: DataFrame, queries: DataFrame, key: str, look: str, content: str, least: float, k: int, block: int = 2048) -> DataFrame:
    """``key, other, look_cos, content_cos, place``: of the rows that look alike (``least`` or more) the ``k`` least alike in content.

    Query rows are taken in blocks against all rows; what comes back is ``k`` rows per query and partition.
    """
    spark = df.sparkSession
    rows = stage(usable(usable(df, look), content).select(key, F.col(look).alias("l"), F.col(content).alias("c")), "rows")
    asked = stage(rows.join(queries.select(key).distinct(), key, "left_semi"), "asked")
    kind = df.schema[key].dataType.simpleString()
    shape = f"{key} {kind}, other {kind}, look_cos double, content_cos double"
    blocks = max(1, -(-asked.count() // block))
    out = spark.createDataFrame([], shape)
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b).toPandas()  # about ``block`` rows
        if not len(part):
            continue
        shared = spark.sparkContext.broadcast((part[key].to_numpy(), _unit(part["l"]), _unit(part["c"])))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, ql, qc = shared.value
            for batch in batches:
                if not len(batch):
                    continue
                batch = batch.sort_values(key)  # with a stable sort, ties come in order of key
                others = batch[key].to_numpy()
                look_cos = (ql @ _unit(batch["l"]).T).round(9)
                content_cos = (qc @ _unit(batch["c"]).T).round(9)
                rank = np.where((look_cos >= least) & (ids[:, None] != others[None, :]), content_cos, np.inf)
                top = np.argsort(rank, axis=1, kind="stable")[:, :k]
                r = np.repeat(np.arange(len(ids)), top.shape[1])
                c = top.ravel()
                ok = np.isfinite(rank[r, c])
                r, c = r[ok], c[ok]
                yield pd.DataFrame({key: ids[r], "other": others[c], "look_cos": look_cos[r, c], "content_cos": content_cos[r, c]})

        out = out.union(rows.mapInPandas(run, shape))
    w = Window.partitionBy(key).orderBy("content_cos", "other")
    return out.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def densest_subset(df: DataFrame, seeds: DataFrame, key: str, vec: str, n: int) -> DataFrame:
    """``key, place, cos`` of the ``n`` rows nearest to the seed whose ``n`` nearest are nearest on average; ties by key."""
    from .similarity import search

    near = stage(search(seeds, df, key, vec, n), "near")
    best = near.groupBy(key).agg(F.avg("cos").alias("m")).orderBy(F.desc("m"), key).limit(1).select(F.col(key).alias("__s"))
    return near.join(F.broadcast(best), F.col(key) == F.col("__s")).select(F.col("other").alias(key), "place", "cos")


def separated_groups(centres: list[tuple[str, float, np.ndarray]], apart: float, n: int) -> list[str]:
    """Names of up to ``n`` groups, tightest first, whose centres have cosines below ``apart`` with all picked before.

    ``centres`` has one entry per group: name, mean cosine, unit centre.
    """
    picked: list[tuple[str, np.ndarray]] = []
    for name, _, c in sorted(centres, key=lambda x: (-x[1], x[0])):
        if len(picked) < n and all(float(c @ p) < apart for _, p in picked):
            picked.append((name, c))
    return [name for name, _ in picked]


def retrieval_weights(cosines: DataFrame, key: str, name: str, cos: str, k: int, temperature: float, single: float) -> DataFrame:
    """``key, name, weight``: softmax weights of a key's ``k`` best cosines; the best alone, with 1, where it has ``single`` of the weight or more."""
    by = Window.partitionBy(key)
    best = cosines.withColumn("__p", F.row_number().over(by.orderBy(F.desc(cos), F.asc(name)))).where(F.col("__p") <= k)
    u = best.withColumn("__u", F.exp((F.col(cos) - F.max(cos).over(by)) / temperature))
    w = u.withColumn("__w", F.col("__u") / F.sum("__u").over(by)).withColumn("__t", F.max("__w").over(by))
    return w.where((F.col("__t") < single) | (F.col("__p") == 1)).select(key, name, F.when(F.col("__t") >= single, 1.0).otherwise(F.col("__w")).alias("weight"))
