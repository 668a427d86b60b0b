"""Problem 2: a subset of given size that covers the variety of the data.

Method: determinantal greedy selection. Records that agree within a tolerance
have (almost) the same kernel row, so a determinant with two of them is
(almost) zero: they form a like group and only its smallest member stands for
selection. Partitions of bounded size each pick a core-set by greedy
selection with incremental Cholesky updates; core-sets are merged, again in
partitions of bounded size, until one final pass picks the subset.

Like groups are found on a grid. Its cells are as wide as the tolerance; a
cell is cut into 8 sub-cells a side, of which each is represented once. Two
sub-cells at most 7 steps apart hold only like records, two at 10 or more
none; between, the records themselves are compared. A hot group of jittered
copies therefore costs as many rows as it covers sub-cells, not pairs of its
members.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..io import table
from ..session import stage
from ..operators.components import components
from .shardtable import CURRENT_SQL, current_shards

SCORES = ["diversity_score", "light_score", "aesthetic_avg", "caption_quality"]
TOLERANCE = 1e-4
#: Room for the rounding of decimal scores held as doubles.
ROUNDING = 1e-9
FINE = 8
SIZE = 200
#: Records a selection task holds at most; with a subset of 200, 6.4 MB of Cholesky rows.
PER_TASK = 4000


def like_groups(records: DataFrame, key: str, group: str, scores: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """``key, root``: every record with the smallest key of its like group.

    Two records are alike if they have the same group and all scores are
    present and differ by at most the tolerance; also by way of others. A
    record with a null group, or a score that is null, NaN or infinite, is
    alone. Keys are unique.
    """
    width = tolerance + ROUNDING
    cols = [f"x{i}" for i in range(len(scores))]
    rows = records.select(F.col(key).alias("k"), F.col(group).alias("g"), *[F.col(s).cast("double").alias(c) for s, c in zip(scores, cols)])
    for c in cols:
        rows = rows.withColumn(c, F.when(~F.isnan(c) & (F.abs(c) < 1e12), F.col(c)))
    whole = rows.dropna()
    for i, c in enumerate(cols):
        whole = whole.withColumn(f"s{i}", F.floor(F.col(c) / (width / FINE)).cast("bigint"))
    subs = [f"s{i}" for i in range(len(cols))]
    points = whole.withColumn("cell", F.struct(*[F.floor(F.col(s) / FINE).cast("bigint").alias(s) for s in subs]))
    # one node per sub-cell: members are alike with each other
    fine = stage(points.groupBy("g", "cell", *subs).agg(F.min("k").alias("node"), F.count(F.lit(1)).alias("n")), "cells")
    steps = [d for d in product((-1, 0, 1), repeat=len(subs)) if d >= tuple([0] * len(subs))]
    moves = F.array(*[F.struct(*[F.lit(v).cast("bigint").alias(s) for v, s in zip(d, subs)]) for d in steps])
    left = fine.select("g", F.col("node").alias("a"), *[F.col(s).alias(f"a{s}") for s in subs], "cell", F.explode(moves).alias("m"))
    left = left.withColumn("cell", F.struct(*[(F.col(f"cell.{s}") + F.col(f"m.{s}")).alias(s) for s in subs])).drop("m")
    pairs = left.join(fine.select("g", "cell", F.col("node").alias("b"), *subs), ["g", "cell"]).where("a != b")
    apart = F.greatest(*[F.abs(F.col(f"a{s}") - F.col(s)) for s in subs])
    pairs = pairs.withColumn("apart", apart).where(F.col("apart") <= FINE + 1)
    pairs = stage(pairs.select("g", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "apart").distinct(), "pairs")
    sure = pairs.where(F.col("apart") <= FINE - 1).select("a", "b")
    members = whole.join(fine.select("g", *subs, "node"), ["g", *subs]).select("node", "k", *cols)
    spots = members.select("node", *cols).distinct()
    one = pairs.where(F.col("apart") > FINE - 1).join(spots.select(F.col("node").alias("a"), *[F.col(c).alias(f"a{c}") for c in cols]), "a")
    two = one.join(spots.withColumnRenamed("node", "b"), "b")
    near = F.lit(True)
    for c in cols:
        near = near & (F.abs(F.col(f"a{c}") - F.col(c)) <= width)
    edges = sure.union(two.where(near).select("a", "b").distinct())
    roots = components(edges).withColumnRenamed("node", "n0")
    grouped = members.select("k", "node").join(roots, F.col("node") == F.col("n0"), "left").select("k", F.coalesce("root", "node").alias("root"))
    return rows.select("k").join(grouped, "k", "left").select(F.col("k").alias(key), F.coalesce("root", "k").alias("root"))


def greedy_determinant(kernel_row, diagonal: np.ndarray, size: int, floor: float = 1e-10) -> tuple[list[int], list[float]]:
    """Indices in the order picked and the residual each had, by incremental Cholesky.

    ``kernel_row(j)`` is row j of the kernel. A pick j adds the column
    (K[j] - C C_j) / sqrt(d_j); d is what the picks leave unexplained of each
    record. Stops when all that is left is explained.
    """
    d = diagonal.astype("f8").copy()
    size = min(size, len(d))
    c = np.zeros((size, len(d)))
    picked: list[int] = []
    gains: list[float] = []
    while len(picked) < size:
        j = int(np.argmax(d))
        if d[j] <= floor:
            break
        k = len(picked)
        row = (kernel_row(j) - c[:k, j] @ c[:k]) / np.sqrt(d[j])
        c[k] = row
        picked.append(j)
        gains.append(float(d[j]))
        d -= row * row
        d[j] = -np.inf
    return picked, gains


def _select(part: pd.DataFrame, size: int, scale: float, same: float) -> pd.DataFrame:
    """The greedy subset of a frame ``k, g, x``, filled up in order of key where nothing new is left."""
    part = part.sort_values("k").reset_index(drop=True)
    g = part["g"].fillna("\0").to_numpy()
    x = part["x"].to_numpy("f8")
    none = np.isnan(x)
    x = np.where(none, 0.0, x)

    def row(j: int) -> np.ndarray:
        by_value = np.where(none | none[j], (none & none[j]).astype("f8"), np.exp(-np.abs(x - x[j]) / scale))
        return by_value * np.where(g == g[j], 1.0, 1.0 - same)

    picked, gains = greedy_determinant(row, np.ones(len(part)), size)
    rest = np.setdiff1d(np.arange(len(part)), picked)[: max(0, min(size, len(part)) - len(picked))]
    out = part.iloc[[*picked, *rest]].copy()
    out["rank"] = np.arange(len(out), dtype="i8")
    out["gain"] = [*gains, *([0.0] * len(rest))]
    return out


def select_diverse(
    records: DataFrame,
    key: str = "shard_id",
    group: str = "source_key",
    value: str = "diversity_score",
    size: int = SIZE,
    scale: float = 0.05,
    same: float = 0.6,
    like: list[str] | None = None,
    tolerance: float = TOLERANCE,
) -> tuple[DataFrame, DataFrame]:
    """The subset ``key, group, value, rank, gain`` and all records' like groups ``key, root``.

    The kernel of two records is exp(-|difference of value| / scale), times
    1 - same if their groups differ. A null or NaN value is a value of its own,
    unlike every number; a null group is a group of its own. With no more like
    groups than ``size`` all representatives are selected. Ties go to the
    smaller key. Rows with a null key are left out; of repeated keys the
    smallest row counts. Other columns are ignored.
    """
    scores = like if like is not None else SCORES
    needed = list(dict.fromkeys([group, value, *scores]))
    rows = records.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*needed)).alias("r"))
    rows = stage(rows.select(key, *[F.col(f"r.{c}").alias(c) for c in needed]), "records")
    groups = stage(like_groups(rows, key, group, scores, tolerance), "groups")
    stand = rows.join(groups.where(F.col(key) == F.col("root")).select(key), key)
    pool = stand.select(F.col(key).alias("k"), F.col(group).alias("g"), F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")).alias("x"))
    kind = rows.schema[key].dataType.simpleString()
    shape = f"k {kind}, g string, x double, rank bigint, gain double"

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return _select(part[["k", "g", "x"]], size, scale, same)[["k", "g", "x", "rank", "gain"]]

    n, turn = pool.count(), 0
    while n > max(PER_TASK, 2 * size):
        tasks = -(-n // max(PER_TASK, 2 * size))
        pool = stage(pool.groupBy(F.pmod(F.xxhash64(F.lit(turn), "k"), F.lit(tasks)).alias("task")).applyInPandas(run, shape).select("k", "g", "x"), "coreset")
        n, turn = pool.count(), turn + 1
    chosen = pool.groupBy(F.lit(0).alias("task")).applyInPandas(run, shape)
    chosen = chosen.select(F.col("k").alias(key), F.col("g").alias(group), F.col("x").alias(value), "rank", "gain")
    return chosen, groups


def _selected(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return select_diverse(current_shards(table(spark, folder, "shards")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Members of like groups with the smallest shard_id of the group."""
    groups = _selected(spark, folder)[1]
    return groups.where("root != shard_id").select(F.col("root").alias("shard_id_a"), F.col("shard_id").alias("shard_id_b"))


def p2_subset(spark: SparkSession, folder: str) -> DataFrame:
    """The selected shards, in the order picked, each with the size of its like group."""
    chosen, groups = _selected(spark, folder)
    sizes = groups.groupBy(F.col("root").alias("shard_id")).agg(F.count(F.lit(1)).alias("like_shards"))
    return chosen.join(sizes, "shard_id")


QUERIES = {"p2_found": p2_found, "p2_subset": p2_subset}

SQL = {
    "p2_found": f"""WITH RECURSIVE {CURRENT_SQL},
pts AS (
  SELECT shard_id, source_key, diversity_score d, light_score l, aesthetic_avg a, caption_quality c FROM cur
  WHERE source_key IS NOT NULL AND NOT isnan(diversity_score) AND NOT isnan(light_score) AND NOT isnan(aesthetic_avg) AND NOT isnan(caption_quality)
),
edges AS (
  SELECT x.shard_id AS u, y.shard_id AS v FROM pts x JOIN pts y ON x.source_key = y.source_key AND x.shard_id != y.shard_id
    AND abs(x.d - y.d) <= 0.000100001 AND abs(x.l - y.l) <= 0.000100001 AND abs(x.a - y.a) <= 0.000100001 AND abs(x.c - y.c) <= 0.000100001
),
reach AS (
  SELECT DISTINCT u AS root, u AS node FROM edges
  UNION
  SELECT r.root, e.v FROM reach r JOIN edges e ON e.u = r.node
)
SELECT min(root) AS shard_id_a, node AS shard_id_b FROM reach GROUP BY node HAVING min(root) != node"""
}
