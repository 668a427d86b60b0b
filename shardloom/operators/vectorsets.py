"""Reports and picks over grouped vectors: diversity within and between groups, neighbour quality, subsets around a seed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clamp
from ..functions.vector import dot, norm
from ..session import stage
from .ranking import seeded_order, stride_sample
from .similarity import centroids, group_spread, search, usable


def group_means(df: DataFrame, group: str, key: str, vec: str, n: int) -> DataFrame:
    """``group, mean``: the direction of the mean of at most ``n`` of a group's vectors, every (size // n)-th in order of key."""
    picked = stride_sample(usable(df, vec).select(group, key, vec), group, key, n)
    return centroids(picked, group, vec).withColumnRenamed("centroid", "mean")


def embedding_diversity(df: DataFrame, group: str, vec: str, k: int = 10, intra_weight: float = 0.5) -> DataFrame:
    """``group, intra, inter, diversity``: how unlike a group's vectors are, how unlike its centre is to the nearest others, and their blend.

    ``intra`` is 1 less the mean cosine of the group's pairs (0.5 for a single
    vector), from vector sums alone. ``inter`` is 1 less the mean cosine with
    the ``k`` nearest centres, within 0 and 1, then scaled to the range over
    all groups; 0.5 if there is but one group. Groups without vectors are left out.
    """
    spread = group_spread(df, group, vec)
    centres = stage(centroids(df, group, vec), "centres")
    near = search(centres, centres, group, "centroid", k).groupBy(group).agg(clamp(1.0 - F.avg("cos")).alias("inter"))
    both = stage(spread.join(near, group, "left").withColumn("inter", F.coalesce("inter", F.lit(0.5))), "diversity")
    low, high = both.agg(F.min("inter"), F.max("inter")).first()
    inter = (F.col("inter") - F.lit(low)) / F.lit(high - low) if low is not None and high > low else F.col("inter")
    intra = F.coalesce(1.0 - F.col("mean_cosine"), F.lit(0.5))
    # an inner diversity of 0 counts as unknown in the blend
    blend = clamp(intra_weight * F.coalesce(F.nullif(intra, F.lit(0.0)), F.lit(0.5)) + (1.0 - intra_weight) * inter)
    return both.select(group, intra.alias("intra"), inter.alias("inter"), blend.alias("diversity"))


def neighbour_quality(neighbours: DataFrame, df: DataFrame, key: str, vec: str, pairs: int = 8000, first: int = 5, seed: int = 42) -> DataFrame:
    """``nearest, random, ratio``: mean distance to the first neighbours, that of random pairs, and the first by the second.

    ``neighbours`` has key, cos and place. Random pairs are each row with the
    next in a seeded order, the first ``pairs`` of them.
    """
    near = neighbours.where(F.col("place") <= first).agg(F.avg(F.sqrt(F.greatest(2.0 - 2.0 * F.col("cos"), F.lit(0.0)))).alias("nearest"))
    some = usable(df, vec).select(key, F.col(vec).alias("v")).orderBy(seeded_order(key, seed), key).limit(pairs + 1)
    w = Window.partitionBy(F.lit(0)).orderBy(seeded_order(key, seed), key)  # ``pairs`` rows
    cos = dot(F.col("v"), F.col("o")) / (norm(F.col("v")) * norm(F.col("o")))
    random = some.withColumn("o", F.lead("v").over(w)).where("o IS NOT NULL").agg(F.avg(F.sqrt(F.greatest(2.0 - 2.0 * cos, F.lit(0.0)))).alias("random"))
    return near.crossJoin(F.broadcast(random)).withColumn("ratio", F.try_divide("nearest", "random"))  # one row each


def style_report(df: DataFrame, key: str, group: str, vec: str, tau: float, copies: float = 0.95, least: int = 3, block: int = 4096) -> DataFrame:
    """``group, n, diversity, pair_rich, connectivity`` of every group of vectors.

    A strong neighbour has a cosine of ``tau`` or more and no more than
    ``copies``. ``diversity`` is the root mean square distance of the group's
    pairs (0 for one vector), ``pair_rich`` the share of vectors with ``least``
    strong neighbours, ``connectivity`` the number of other groups that any
    vector has a strong pair with (above ``copies`` counts as no pair). Every
    pair of blocks is one task, which hands on a count per row and a row per
    pair of groups.
    """
    rows = stage(usable(df, vec).select(F.col(key).alias("k"), F.col(group).alias("g"), F.col(vec).alias("v")), "rows")
    blocks = max(1, -(-rows.count() // block))
    placed = rows.withColumn("b", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    kind, own = (rows.schema[c].dataType.simpleString() for c in ("k", "g"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        ids, groups = part["k"].to_numpy(), part["g"].to_numpy()
        x = np.stack(list(part["v"])).astype("f8")
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)
        one = part["b1"].iloc[0] == part["b2"].iloc[0]
        left = np.flatnonzero((part["b"] == part["b1"]).to_numpy())
        right = left if one else np.flatnonzero((part["b"] != part["b1"]).to_numpy())
        counts = np.zeros(len(ids), "i8")
        met: set = set()
        for start in range(0, len(left), 1024):
            at = left[start : start + 1024]
            s = (x[at] @ x[right].T).round(9)
            strong = (s >= tau) & (s <= copies) & (at[:, None] != right[None, :])
            counts[at] += strong.sum(axis=1)
            if not one:
                np.add.at(counts, right, strong.sum(axis=0))
            r, c = np.nonzero(strong)
            met.update(p for p in set(zip(groups[at[r]], groups[right[c]])) if p[0] != p[1])
        pairs = sorted({(min(p), max(p)) for p in met})
        n = len(ids)
        return pd.DataFrame({"k": [*ids, *[None] * len(pairs)], "a": [*[None] * n, *[p[0] for p in pairs]], "b": [*[None] * n, *[p[1] for p in pairs]], "n": [*counts, *[0] * len(pairs)]})

    tasks = placed.select("k", "g", "v", F.least("b", "o").alias("b1"), F.greatest("b", "o").alias("b2"), "b")
    found = stage(tasks.groupBy("b1", "b2").applyInPandas(run, f"k {kind}, a {own}, b {own}, n bigint"), "met")
    strong = found.where("k IS NOT NULL").groupBy("k").agg(F.sum("n").alias("strong"))
    rich = rows.select("k", "g").join(strong, "k", "left").groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.avg((F.coalesce("strong", F.lit(0)) >= least).cast("double")).alias("pair_rich"))
    linked = found.where("k IS NULL").select("a", "b").distinct()
    degree = linked.select(F.col("a").alias("g")).union(linked.select(F.col("b").alias("g"))).groupBy("g").agg(F.count(F.lit(1)).alias("connectivity"))
    spread = group_spread(rows, "g", "v").select("g", F.coalesce(F.sqrt(F.greatest(2.0 - 2.0 * F.col("mean_cosine"), F.lit(0.0))), F.lit(0.0)).alias("diversity"))
    return rich.join(spread, "g").join(degree, "g", "left").select(F.col("g").alias(group), "n", "diversity", "pair_rich", F.coalesce("connectivity", F.lit(0)).alias("connectivity"))


def _around(seeds: DataFrame, df: DataFrame, key: str, vec: str, n: int, other: DataFrame, score, floor: float) -> DataFrame:
    near = search(seeds, df, key, vec, n).join(other, "other")
    scored = near.groupBy(key).agg(F.avg("cos").alias("coherence"), score).where(F.col("coherence") >= floor)
    best = scored.orderBy(F.desc("score"), key).limit(1)
    return near.join(F.broadcast(best.select(key, "score")), key)


def far_subset(df: DataFrame, seeds: DataFrame, key: str, vec: str, prior: Column, n: int, floor: float = 0.60, weight: float = 2.0) -> DataFrame:
    """``key, place, cos, score``: the ``n`` nearest of the seed with the best coherence less ``weight`` times the mean cosine with a prior.

    ``prior`` is a vector; seeds whose ``n`` nearest have a mean cosine below
    ``floor`` are out. Ties go to the smaller key; empty if no seed qualifies.
    """
    v = F.col(vec)
    with_prior = usable(df, vec).select(F.col(key).alias("other"), (dot(v, prior) / F.greatest(norm(v) * norm(prior), F.lit(1e-8))).alias("p"))
    score = F.round(F.avg("cos") - weight * F.avg("p"), 9).alias("score")
    return _around(seeds, df, key, vec, n, with_prior, score, floor).select(F.col("other").alias(key), "place", "cos", "score")


def look_subset(df: DataFrame, seeds: DataFrame, key: str, look: str, content: str, n: int, floor: float = 0.80, weight: float = 1.0) -> DataFrame:
    """``key, place, cos, score``: the ``n`` rows nearest in look to the seed whose neighbours look most alike and differ most in content.

    The score is the mean cosine of looks less ``weight`` times that of contents.
    """
    rows = usable(usable(df, look), content)
    near = search(seeds, rows, key, look, n)
    unit = lambda c: F.transform(c, lambda x: x / F.greatest(norm(F.col(c)), F.lit(1e-8)))
    body = rows.select(F.col(key).alias("__k"), unit(content).alias("__c"))
    pairs = near.join(body.withColumnRenamed("__k", key).withColumnRenamed("__c", "__a"), key).join(body.withColumnRenamed("__k", "other").withColumnRenamed("__c", "__b"), "other")
    g = pairs.groupBy(key).agg(F.avg("cos").alias("l"), F.avg(dot(F.col("__a"), F.col("__b"))).alias("c")).where(F.col("l") >= floor)
    best = g.select(key, F.round(F.col("l") - weight * F.col("c"), 9).alias("score")).orderBy(F.desc("score"), key).limit(1)
    return near.join(F.broadcast(best), key).select(F.col("other").alias(key), "place", "cos", "score")


def exemplars(df: DataFrame, group: str, key: str, vec: str, apart: float = 0.55, n: int = 5, least: int = 3) -> DataFrame:
    """``group, place, key, cos``: of the groups that are tightest and apart from each other, the row nearest the centre.

    Groups of fewer than ``least`` rows are out; tightness is the mean cosine
    with the group's centre. One row per group comes to the driver.
    """
    x = usable(df, vec).select(group, F.col(key).alias("k"), F.col(vec).alias("v"))
    centres = centroids(x, group, "v")
    cos = dot(F.col("v"), F.col("centroid")) / F.greatest(norm(F.col("v")), F.lit(1e-8))
    placed = x.join(centres, group).withColumn("cos", F.round(cos, 9))
    per = placed.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg("cos").alias("tight"), F.max(F.struct("cos", (-F.col("k")).alias("m"))).alias("best")).where(F.col("n") >= least)
    picked: list[tuple] = []
    marks: list[np.ndarray] = []
    for r in per.join(centres, group).orderBy(F.desc("tight"), group).collect():
        c = np.array(r.centroid)
        if len(picked) < n and all(float(c @ m) < apart for m in marks):
            picked.append((r[group], len(picked) + 1, -r.best.m, r.best.cos))
            marks.append(c)
    kinds = [x.schema[c].dataType.simpleString() for c in (group, "k")]
    return df.sparkSession.createDataFrame(picked, f"{group} {kinds[0]}, place int, {key} {kinds[1]}, cos double")


def silhouettes(assigned: DataFrame, group: str, vec: str) -> DataFrame:
    """``group, n, silhouette``: how much nearer a group's rows are to their own centre than to the next, on average.

    The simplified silhouette by squared distance of unit vectors to centres;
    0 for a group of one row or where there is one group. Centres are
    broadcast: their number is that of the clusters asked for.
    """
    x = usable(assigned, vec).select(group, F.col(vec).alias("v"))
    centres = centroids(x, group, "v")
    packed = centres.agg(F.collect_list(F.struct(F.col(group).alias("g"), F.col("centroid").alias("c"))).alias("cs"))
    far = lambda c: 1.0 - dot(F.col("v"), c) / F.greatest(norm(F.col("v")), F.lit(1e-8))
    each = x.crossJoin(F.broadcast(packed)).select(  # one row
        group,
        F.array_min(F.transform(F.filter("cs", lambda e: e["g"] == F.col(group)), lambda e: far(e["c"]))).alias("own"),
        F.array_min(F.transform(F.filter("cs", lambda e: e["g"] != F.col(group)), lambda e: far(e["c"]))).alias("next"),
    )
    s = F.coalesce(F.try_divide(F.col("next") - F.col("own"), F.greatest("next", "own")), F.lit(0.0))
    return each.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(s).alias("silhouette")).withColumn("silhouette", F.when(F.col("n") > 1, F.col("silhouette")).otherwise(0.0))
