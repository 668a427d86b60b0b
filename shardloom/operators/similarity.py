"""Exact cosine search and joins over vectors, in blocks of bounded size.

Vectors are cut into blocks by hash; a task holds two blocks at most. What a
task hands on grows with its rows, not with the pairs it finds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .components import components

BLOCK = 8192


def _unit(vectors) -> np.ndarray:
    x = np.stack(list(vectors)).astype("f8")
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)


def usable(df: DataFrame, vec: str) -> DataFrame:
    """Rows whose vector is neither null, empty, all zero nor holds NaN."""
    v = F.col(vec)
    return df.where(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0))


def search(queries: DataFrame, base: DataFrame, key: str, vec: str, k: int, below: float | None = None, block: int = 4096) -> DataFrame:
    """``key, other, cos, place``: the ``k`` nearest base rows of every query row, exactly.

    A row is no neighbour of itself; ``below`` leaves out what is nearer than
    that (copies). Ties go to the smaller key. Query rows are taken in blocks of
    ``block``; each block is sent to all base partitions, which send back ``k``
    rows per query, so neither grows with the base.
    """
    spark = base.sparkSession
    base, queries = usable(base, vec), usable(queries, vec)
    kind = base.schema[key].dataType.simpleString()
    blocks = max(1, -(-queries.count() // block))
    asked = stage(queries.select(key, vec).withColumn("__b", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")), "queries")
    out = None
    for b in range(blocks):
        part = asked.where(F.col("__b") == b).select(key, vec).toPandas()  # about ``block`` rows
        if not len(part):
            continue
        shared = spark.sparkContext.broadcast((part[key].to_numpy(), _unit(part[vec])))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            for batch in batches:
                if not len(batch):
                    continue
                batch = batch.sort_values(key)  # with a stable sort, ties come in order of key
                others = batch[key].to_numpy()
                s = q @ _unit(batch[vec]).T
                s[ids[:, None] == others[None, :]] = -2
                if below is not None:
                    s[s > below] = -2
                top = np.argsort(-s.round(9), axis=1, kind="stable")[:, :k]
                rows = np.repeat(np.arange(len(ids)), top.shape[1])
                cos = s[rows, top.ravel()].round(9)
                keep = cos > -1.5
                yield pd.DataFrame({key: ids[rows][keep], "other": others[top.ravel()][keep], "cos": cos[keep]})

        found = base.select(key, vec).mapInPandas(run, f"{key} {kind}, other {kind}, cos double")
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], f"{key} {kind}, other {kind}, cos double, place int")
    w = Window.partitionBy(key).orderBy(F.desc("cos"), "other")
    return out.dropDuplicates([key, "other"]).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def threshold_classes(df: DataFrame, key: str, vec: str, least: float, block: int = BLOCK) -> DataFrame:
    """``key, class, links``: rows linked by a cosine of at least ``least``, also by way of others.

    The class is its smallest key, links the number of other rows at ``least``
    or more. Every row with a usable vector comes out once, a row without links
    as its own class. Every pair of rows is compared in exactly one task, which
    hands on one root and one count per row. Keys are unique and cast to strings.
    """
    rows = stage(usable(df, vec).select(F.col(key).cast("string").alias("k"), F.col(vec).alias("v")), "vectors")
    n = rows.count()
    blocks = max(1, -(-n // block))
    placed = rows.withColumn("b", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    tasks = placed.select("k", "v", F.least("b", "o").alias("b1"), F.greatest("b", "o").alias("b2"), "b")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        ids, x = part["k"].to_numpy(), _unit(part["v"])
        one = part["b1"].iloc[0] == part["b2"].iloc[0]
        left = np.flatnonzero((part["b"] == part["b1"]).to_numpy())
        right = left if one else np.flatnonzero((part["b"] != part["b1"]).to_numpy())
        links = np.zeros(len(ids), "i8")
        label = np.arange(len(ids))

        for start in range(0, len(left), 1024):
            rows_ = left[start : start + 1024]
            hit = (x[rows_] @ x[right].T).round(9) >= least
            hit &= rows_[:, None] != right[None, :]
            links[rows_] += hit.sum(axis=1)
            if not one:
                links[right] += hit.sum(axis=0)
            for r, row in enumerate(rows_):
                met = label[right[hit[r]]]
                if len(met) and (met != label[row]).any():  # among copies only the first row gets here
                    joined = np.append(np.unique(met), label[row])
                    label[np.isin(label, joined)] = joined.min()
        # the class's first key in the task
        first = np.full(len(ids), len(ids))
        order = np.argsort(ids, kind="stable")
        np.minimum.at(first, label[order], np.arange(len(ids)))
        roots = order[first[label]]
        return pd.DataFrame({"k": ids, "root": ids[roots], "links": links})

    local = stage(tasks.groupBy("b1", "b2").applyInPandas(run, "k string, root string, links bigint"), "local")
    joined = components(local.where("k != root").select(F.col("k").alias("a"), F.col("root").alias("b")))
    counts = local.groupBy("k").agg(F.sum("links").alias("links"))
    return counts.join(joined, F.col("k") == F.col("node"), "left").select(F.col("k").alias(key), F.coalesce("root", "k").alias("class"), "links")


def group_spread(df: DataFrame, group: str, vec: str) -> DataFrame:
    """``group, n, mean_cosine``: the mean cosine of a group's pairs from vector sums alone.

    For unit vectors it is (|sum|^2 - n) / (n (n - 1)); null for a single row.
    """
    x = usable(df, vec)
    scaled = x.select(group, F.posexplode(vec).alias("i", "v"), F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, y: s + y.cast("double") * y.cast("double"))).alias("l"))
    sums = scaled.groupBy(group, "i").agg(F.sum(F.col("v").cast("double") / F.col("l")).alias("s"))
    whole = sums.groupBy(group).agg(F.sum(F.col("s") * F.col("s")).alias("q"))
    counts = x.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(whole, group).select(group, "n", F.when(F.col("n") > 1, (F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("mean_cosine"))


def centroids(df: DataFrame, group: str, vec: str) -> DataFrame:
    """``group, centroid``: the direction of the mean of a group's unit vectors, as an array."""
    x = usable(df, vec)
    scaled = x.select(group, F.posexplode(vec).alias("i", "v"), F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, y: s + y.cast("double") * y.cast("double"))).alias("l"))
    sums = scaled.groupBy(group, "i").agg(F.sum(F.col("v").cast("double") / F.col("l")).alias("s"))
    rows = sums.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("p"))
    arr = F.transform("p", lambda e: e["s"])
    length = F.sqrt(F.aggregate("c", F.lit(0.0), lambda s, y: s + y * y))
    return rows.select(group, arr.alias("c")).select(group, F.transform("c", lambda y: y / F.greatest(length, F.lit(1e-8))).alias("centroid"))


def farthest_points(df: DataFrame, key: str, vec: str, n: int, start: str | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """``key, place, nearest``: rows picked one after another, each the least similar to those picked before.

    Every round is one pass over staged rows that keeps, per row, its greatest
    cosine to the picked ones, and hands back one row per partition. Ties go to
    the smaller key; the first is ``start`` or the smallest key. With ``seeds``
    (rows picked already, as many as fit on the driver) ``n`` more are picked
    and only those come out.
    """
    spark = df.sparkSession
    rows = stage(usable(df, vec).select(F.col(key).cast("string").alias("k"), F.col(vec).alias("v")), "points")
    given = usable(seeds, vec).select(F.col(key).cast("string").alias("k"), F.col(vec).alias("v")).orderBy("k").collect() if seeds is not None else []
    if given:
        picked, near, chosen = [r.k for r in given], [float("nan")] * len(given), list(_unit([r.v for r in given]))
    else:
        first = rows.where(F.col("k") == start).first() if start else rows.orderBy("k").limit(1).first()
        if first is None:
            return spark.createDataFrame([], f"{key} string, place int, nearest double")
        picked, near, chosen = [first.k], [float("nan")], [_unit([first.v])[0]]
    while len(picked) < n + len(given):
        done, marks = set(picked), np.stack(chosen)

        def run(batches: Iterator[pd.DataFrame], done=done, marks=marks) -> Iterator[pd.DataFrame]:
            best = None
            for batch in batches:
                batch = batch[~batch["k"].isin(done)]
                if len(batch):
                    s = (_unit(batch["v"]) @ marks.T).max(axis=1).round(9)
                    order = np.lexsort((batch["k"].to_numpy(), s))[0]
                    row = (float(s[order]), batch["k"].iloc[order], batch["v"].iloc[order])
                    if best is None or row[:2] < best[:2]:
                        best = row
            if best:
                yield pd.DataFrame({"s": [best[0]], "k": [best[1]], "v": [best[2]]})

        nxt = rows.mapInPandas(run, "s double, k string, v array<float>").orderBy("s", "k").limit(1).first()
        if nxt is None:
            break
        picked.append(nxt.k)
        near.append(nxt.s)
        chosen.append(_unit([nxt.v])[0])
    return spark.createDataFrame([(k, i, None if s != s else s) for i, (k, s) in enumerate(zip(picked[len(given) :], near[len(given) :]))], f"{key} string, place int, nearest double")
