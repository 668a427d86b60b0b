"""Problem 4: clusters of mutually similar records, with sizes and typical members.

Method: mergeable cluster-feature trees. Every partition folds its vectors into
cluster features (count, linear sum); a vector joins the nearest feature whose
mean direction is near enough, else it starts its own. Features are additive:
rounds of reduction bring features of like direction together (by random
hyperplanes, other ones every round, in tasks of bounded size) and merge them.
Ward agglomeration of the remaining leaves gives the centres; full passes over
all vectors then assign members and take the means anew. Vectors that fit
nowhere are held against each other, all pairs, before they belong to none:
small or wide clusters, whose members are no feature together, are found there.

Nothing but features and centres leaves its partition: a cluster with a third
of all records is one feature per partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..io import latest_rows, table
from ..session import stage
from .vectors import DIMENSIONS, matrix, usable_vectors

#: Cosine with the mean direction from which a record is a member.
MEMBER = 0.75
#: Cosine with another cluster's mean direction from which it is none.
APART = 0.7
LEAST = 10
#: Cosine of a vector with a feature's direction from which the feature takes it up.
ABSORB = 0.7
#: Cosine of the directions of two features from which they are merged.
MERGE = 0.78
#: Features a reduction task holds at most, on average, and features Ward agglomerates at most.
PER_TASK = 4000
#: Leaves that may become centres: as many clusters can be found.
LEAVES = 50_000
#: Features of fewer records are no leaves for Ward: they lie apart after all rounds.
LEAF = 3
ROUNDS = 4
#: Cosine from which two vectors that fit nowhere are neighbours: members of one cluster have 0.56 with each other on average, or more.
LOOSE = 0.5
#: Length of the mean of a vector's neighbours from which it may be a centre; of a cluster's members it is MEMBER or more.
TIGHT = 0.65
#: Vectors that fit nowhere that are broadcast at once (under 13 MB).
CHUNK = 50_000
REFINE = 12
#: Features a task holds at most before it hands them on, so that its work is in proportion to its vectors, whatever the noise.
HELD = 5000
#: Numbers in a block of vectors by centres.
TILE = 8_000_000


def absorb(counts: np.ndarray, sums: np.ndarray, x: np.ndarray, w: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Features after taking up the rows of ``x``, sums of ``w`` records each.

    Rows near enough to a feature are added to the nearest; the others become
    features one after another, so that like rows share one.
    """
    length = np.linalg.norm(x, axis=1)
    unit = x / np.maximum(length, 1e-12)[:, None]
    rest = np.arange(len(x))
    if len(counts):
        s = unit @ (sums / np.maximum(np.linalg.norm(sums, axis=1), 1e-12)[:, None]).T
        best = s.argmax(axis=1)
        near = s[np.arange(len(x)), best] >= limit
        order = best[near]
        np.add.at(sums, order, x[near])
        np.add.at(counts, order, w[near])
        rest = rest[~near]
    added_c: list[float] = []
    added_s: list[np.ndarray] = []
    while len(rest):
        first = rest[0]
        seed = x[first].copy()
        own = unit[rest] @ (seed / max(np.linalg.norm(seed), 1e-12)) >= limit
        own[0] = True
        added_s.append(x[rest[own]].sum(axis=0))
        added_c.append(float(w[rest[own]].sum()))
        rest = rest[~own]
    if added_c:
        counts = np.concatenate([counts, added_c])
        sums = np.concatenate([sums, np.stack(added_s)]) if len(sums) else np.stack(added_s)
    return counts, sums


def settle(counts: np.ndarray, sums: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Features merged, largest first, until no two are near."""
    while len(counts):
        order = np.argsort(-counts, kind="stable")
        before = len(counts)
        counts, sums = absorb(np.empty(0), np.empty((0, sums.shape[1])), sums[order], counts[order], limit)
        if len(counts) == before:
            break
    return counts, sums


def ward(counts: np.ndarray, sums: np.ndarray, limit: float, most: int = PER_TASK) -> list[list[int]]:
    """Groups of features by Ward agglomeration; two groups of directions below ``limit`` are not joined.

    Joins the pair of the least increase of squared distance to the mean
    directions first. Memory is quadratic in the number of features, so the
    ``most`` largest are agglomerated and any others stay groups of their own.
    """
    order = np.argsort(-counts, kind="stable")
    keep, rest = order[:most], order[most:]
    groups = [[int(i)] for i in keep]
    n, ls = counts[keep].astype("f8"), sums[keep].astype("f8")

    def unit(v: np.ndarray) -> np.ndarray:
        return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)

    d = unit(ls)
    cos = d @ d.T
    cost = np.where(cos >= limit, (n[:, None] * n / (n[:, None] + n)) * (2 - 2 * cos), np.inf)
    np.fill_diagonal(cost, np.inf)
    while len(n) and np.isfinite(cost.min()):
        i, j = sorted(np.unravel_index(int(cost.argmin()), cost.shape))
        groups[i] += groups[j]
        n[i] += n[j]
        ls[i] += ls[j]
        n[j] = 0
        groups[j] = []
        cost[j, :] = cost[:, j] = np.inf
        c = unit(ls) @ unit(ls[i])
        fresh = np.where((n > 0) & (c >= limit), (n * n[i] / np.maximum(n + n[i], 1)) * (2 - 2 * c), np.inf)
        fresh[i] = np.inf
        cost[i, :] = cost[:, i] = fresh
    return [g for g in groups if g] + [[int(i)] for i in rest]


def _features(vectors: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.empty(0), np.empty((0, DIMENSIONS))
        for batch in batches:
            x = matrix(batch.column(0)).astype("f8")
            for start in range(0, len(x), 1000):
                part = x[start : start + 1000]
                counts, sums = absorb(counts, sums, part, np.ones(len(part)), ABSORB)
                if len(counts) > HELD:
                    counts, sums = settle(counts, sums, ABSORB)
                    if len(counts) > HELD // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(counts), pa.array(sums.tolist(), pa.list_(pa.float64()))], names=["n", "ls"])
                        counts, sums = np.empty(0), np.empty((0, DIMENSIONS))
        if len(counts):
            yield pa.RecordBatch.from_arrays([pa.array(counts), pa.array(sums.tolist(), pa.list_(pa.float64()))], names=["n", "ls"])

    return vectors.select("vec").mapInArrow(run, "n double, ls array<double>")


def _reduced(features: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Features after rounds of merging, each in tasks by random hyperplanes."""

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        counts, sums = settle(part["n"].to_numpy("f8"), np.stack(part["ls"].to_numpy()), MERGE)
        return pd.DataFrame({"n": counts, "ls": list(sums)})

    features = stage(features, "features")
    for turn in range(rounds):
        total = features.count()
        planes = max(0, int(np.ceil(np.log2(max(1, total) / PER_TASK))))
        normals = np.random.default_rng(turn).standard_normal((max(1, planes), DIMENSIONS))

        def side(batches: Iterator[pa.RecordBatch], normals: np.ndarray = normals, planes: int = planes) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ls = batch.column("ls").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, DIMENSIONS)
                bits = (ls @ normals.T > 0) @ (1 << np.arange(len(normals))) if planes else np.zeros(batch.num_rows, "i8")
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bits.astype("i8"))], names=["n", "ls", "task"])

        keyed = features.mapInArrow(side, "n double, ls array<double>, task bigint")
        features = stage(keyed.groupBy("task").applyInPandas(merge, "n double, ls array<double>"), "features")
        if not planes:
            break
    return features


def _tiles(batches: Iterator[pa.RecordBatch], centres: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces whose product with the centres is of bounded size."""
    step = max(1, TILE // max(1, centres))
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def _assign(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """``rec, cluster, cos``: records near one centre and apart from all others."""
    directions = (centres / np.linalg.norm(centres, axis=1, keepdims=True)).astype("f4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _tiles(batches, len(directions)):
            s = matrix(batch.column(1)) @ directions.T
            best = s.argmax(axis=1)
            top = s[np.arange(len(s)), best]
            s[np.arange(len(s)), best] = -1
            own = (top >= MEMBER) & (s.max(axis=1) < APART)
            picked = pa.array(np.flatnonzero(own))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(picked), pa.array(best[own].astype("i4")), pa.array(top[own].astype("f8"))], names=["rec", "cluster", "cos"])

    return vectors.select("rec", "vec").mapInArrow(run, "rec string, cluster int, cos double")


def _means(vectors: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sums of the members of every centre, from one pass."""
    directions = (centres / np.linalg.norm(centres, axis=1, keepdims=True)).astype("f4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(directions), DIMENSIONS + 1))
        for batch in _tiles(batches, len(directions)):
            x = matrix(batch.column(0))
            s = x @ directions.T
            best = s.argmax(axis=1)
            own = s[np.arange(len(s)), best] >= MEMBER
            np.add.at(total, best[own], np.column_stack([np.ones(own.sum()), x[own]]))
        used = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(used.astype("i4")), pa.array(total[used].tolist(), pa.list_(pa.float64()))], names=["cluster", "sums"])

    parts = vectors.select("vec").mapInArrow(run, "cluster int, sums array<double>")
    added = parts.groupBy("cluster").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(DIMENSIONS + 1)])
    counts, sums = np.zeros(len(centres)), centres.copy()
    for r in added.collect():  # one row per centre
        counts[r[0]], sums[r[0]] = r[1], r[2:]
    return counts, sums


def _merged(counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    return np.stack([sums[g].sum(axis=0) for g in ward(counts, sums, MERGE)])


def _overlooked(vectors: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Centres of what is dense among the vectors that are near no centre, from all pairs of them."""
    directions = (centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)).astype("f4")

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _tiles(batches, len(directions)):
            if len(directions):
                near = (matrix(batch.column(1)) @ directions.T).max(axis=1, initial=-1) >= MEMBER
                batch = batch.take(pa.array(np.flatnonzero(~near)))
            yield batch

    select = vectors.select("rec", "vec")
    unfit = stage(select.mapInArrow(rest, select.schema), "unfit")
    chunks = -(-unfit.count() // CHUNK)
    parts = None
    for i in range(chunks):
        held = unfit.where(F.pmod(F.xxhash64("rec"), F.lit(chunks)) == i).select("vec").toArrow().combine_chunks()
        if not held.num_rows:
            continue
        shared = vectors.sparkSession.sparkContext.broadcast(matrix(held.column(0).combine_chunks()).astype("f4"))

        def near(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            y = shared.value
            for batch in batches:
                for start in range(0, batch.num_rows, 500):
                    piece = batch.slice(start, 500)
                    hit = (matrix(piece.column(1)) @ y.T >= LOOSE).astype("f4")
                    n = hit.sum(axis=1)
                    some = np.flatnonzero(n > 0)
                    sums = (hit[some] @ y).astype("f8")
                    yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(some)), pa.array(n[some].astype("f8")), pa.array(sums.tolist(), pa.list_(pa.float64()))], names=["rec", "n", "ls"])

        part = stage(unfit.mapInArrow(near, "rec string, n double, ls array<double>"), "dense")
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        return np.empty((0, DIMENSIONS))
    added = parts.groupBy("rec").agg(F.sum("n").alias("n"), *[F.sum(F.col("ls")[i]).alias(f"s{i}") for i in range(DIMENSIONS)])
    sums = F.array(*[F.col(f"s{i}") for i in range(DIMENSIONS)])
    dense = added.select("n", sums.alias("ls")).where(F.col("n") >= LEAST // 2)
    dense = dense.where(F.expr("sqrt(aggregate(ls, 0D, (a, x) -> a + x * x))") >= TIGHT * F.col("n"))
    rows = _reduced(dense).orderBy(F.desc("n")).limit(LEAVES).toArrow()
    if not rows.num_rows:
        return np.empty((0, DIMENSIONS))
    found = rows.column("ls").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, DIMENSIONS).astype("f8")
    unit = found / np.linalg.norm(found, axis=1, keepdims=True)
    return unit[(unit @ directions.T).max(axis=1, initial=-1) < MERGE]


def find_clusters(vectors: DataFrame) -> DataFrame:
    """``rec, cluster, cos`` of all members; ``vectors`` is what ``usable_vectors`` gives.

    A record is a member of a cluster if its cosine with the cluster's mean
    direction is at least MEMBER and that with any other below APART; records
    that fit nowhere have no row. Clusters of fewer than LEAST records are
    dropped. Cluster numbers are by size, the largest 0. Without vectors the
    result is empty.
    """
    spark = vectors.sparkSession
    leaves = _reduced(_features(vectors)).where(F.col("n") >= LEAF).orderBy(F.desc("n")).limit(LEAVES)
    rows = leaves.toArrow()  # at most LEAVES features, 26 MB
    centres = np.empty((0, DIMENSIONS))
    if rows.num_rows:
        counts = rows.column("n").to_numpy().astype("f8")
        sums = rows.column("ls").combine_chunks().flatten().to_numpy().reshape(len(counts), DIMENSIONS).astype("f8")
        centres = _merged(counts, sums)
    for _ in range(2):
        if len(centres):
            counts, sums = _means(vectors, centres)
            centres = sums[counts >= LEAST]
            centres = _merged(counts[counts >= LEAST], centres) if len(centres) else centres
    more = _overlooked(vectors, centres)
    if len(more):
        centres, last = np.concatenate([centres, more]), np.empty(0)
        for _ in range(REFINE):
            counts, sums = _means(vectors, centres)
            held = counts >= LEAST // 2
            if not held.any():
                centres = centres[:0]
                break
            before, centres = len(centres), _merged(counts[held], sums[held])
            # stable once no centre gains or loses members
            if len(centres) == before and np.array_equal(np.sort(counts), last):
                break
            last = np.sort(counts)
        if len(centres):
            counts, sums = _means(vectors, centres)
            centres = sums[counts >= LEAST]
    if not len(centres):
        return spark.createDataFrame([], "rec string, cluster int, cos double")
    found = stage(_assign(vectors, centres), "members")
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "cluster")  # one row per cluster
    sizes = found.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST)
    numbers = sizes.withColumn("number", (F.row_number().over(order) - 1).cast("int")).select("cluster", "number")
    return found.join(F.broadcast(numbers), "cluster").select("rec", F.col("number").alias("cluster"), "cos")


def _numbered(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Members with the stored number each holds, and the number of every cluster."""
    members = find_clusters(usable_vectors(table(spark, folder, "style_vectors")))
    stored = latest_rows(table(spark, folder, "assignments"), "rec_id", "assigned_at").select(F.col("rec_id").alias("rec"), F.col("cluster").alias("stored"))
    held = stage(members.join(stored, "rec", "left"), "held")
    votes = held.where("stored IS NOT NULL").groupBy("cluster", "stored").agg(F.count(F.lit(1)).alias("votes"))
    first = Window.partitionBy("cluster").orderBy(F.desc("votes"), "stored")
    numbers = votes.withColumn("r", F.row_number().over(first)).where("r = 1").select("cluster", F.col("stored").alias("number"))
    return held, numbers


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Members whose stored number is missing, null or not their cluster's."""
    held, numbers = _numbered(spark, folder)
    wrong = held.join(F.broadcast(numbers), "cluster").where(F.col("stored").isNull() | (F.col("stored") != F.col("number")))
    return wrong.select(F.col("rec").alias("rec_id"), F.col("number").alias("cluster"))


def p4_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Every cluster with its stored number, size, mean cosine and five most typical members."""
    held, numbers = _numbered(spark, folder)
    near = Window.partitionBy("cluster").orderBy(F.desc("cos"), "rec")
    # the nearest of 64 slices of a cluster first, so that no cluster is ranked in one task
    sliced = Window.partitionBy("cluster", "slice").orderBy(F.desc("cos"), "rec")
    best = held.withColumn("slice", F.pmod(F.xxhash64("rec"), F.lit(64))).withColumn("r", F.row_number().over(sliced)).where("r <= 5")
    typical = best.withColumn("r", F.row_number().over(near)).where("r <= 5").groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("r", "rec"))).alias("t"))
    sizes = held.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.round(F.avg("cos"), 4).alias("mean_cos"))
    return sizes.join(typical, "cluster").join(numbers, "cluster", "left").select("number", "size", "mean_cos", F.col("t.rec").alias("typical"))


QUERIES = {"p4_found": p4_found, "p4_clusters": p4_clusters}
