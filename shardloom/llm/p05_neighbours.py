"""Problem 5: the k most similar vectors for every vector.

Method: shifted space-filling curves. Vectors are projected by replacing them
with the nearest of a set of anchors (mean directions from a bounded sample);
several Hilbert orderings of the anchors, each of another rotation and shift,
lay all vectors out along curves. A curve is cut into windows at anchor
boundaries, neighbouring anchors merging until a window has a least number of
vectors. Inside a window every vector meets every other, exactly; the results
of all curves merge and the nearest are ranked by the exact cosine.

Why anchors: around a centre these vectors spread alike in all directions, so
an ordering of the vectors themselves keeps few near ones together; an ordering
of the anchors keeps a whole neighbourhood in one window. A window is never
capped: a large one is cut into blocks, and every pair of its blocks is a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..io import table
from ..session import stage
from .vectors import DIMENSIONS, matrix, usable_vectors
from .p04_clusters import absorb, settle

K = 5
#: Records from which the anchors are taken, at most about so many.
SAMPLE = 20_000
#: Vectors a window has at least, and a block at most.
WINDOW = 2000
BLOCK = 12_000
CURVES = 3
#: A vector also enters the window of the next anchors whose cosine is this near to the best.
MARGIN = 0.1
PROBES = 3
HILBERT_DIMENSIONS, HILBERT_BITS = 6, 8
#: From so many candidates of a row on they are ranked one row at a time.
CROWD = 512


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Place of integer points (n x d, below 2**bits) along the Hilbert curve; d * bits is at most 62.

    Gray-code transform of the coordinates from the top bit down, then their bits interleaved.
    """
    x = points.astype("i8").copy()
    n, d = x.shape
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            upper = (x[:, i] & q) > 0
            x[:, 0] = np.where(upper, x[:, 0] ^ p, x[:, 0])
            swap = np.where(upper, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= swap
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(n, "i8")
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[:, d - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t[:, None]
    out = np.zeros(n, "i8")
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = out << 1 | ((x[:, i] >> b) & 1)
    return out


def curve_windows(anchors: np.ndarray, counts: np.ndarray, curve: int, least: int) -> np.ndarray:
    """Window of every anchor on one curve: neighbours along it until ``least`` vectors are together."""
    rng = np.random.default_rng(curve)
    turn = np.linalg.qr(rng.standard_normal((DIMENSIONS, HILBERT_DIMENSIONS)))[0]
    flat = anchors @ turn
    low, high = flat.min(axis=0), flat.max(axis=0)
    cells = (flat - low) / np.maximum(high - low, 1e-9) * 0.5 + rng.random(HILBERT_DIMENSIONS) * 0.5
    order = np.argsort(hilbert_index((cells * ((1 << HILBERT_BITS) - 1)).astype("i8"), HILBERT_BITS), kind="stable")
    window = np.zeros(len(anchors), "i8")
    now, filled = 0, 0
    for a in order:
        if filled >= least:
            now, filled = now + 1, 0
        window[a] = now
        filled += counts[a]
    if now and filled < least:
        window[window == now] = now - 1
    return window


def anchor_homes(anchors: np.ndarray, counts: np.ndarray, curves: int, least: int) -> list[set[int]]:
    """The places where the vectors of every anchor are compared, however many they are.

    All anchors of a window on any curve meet at the one with the most vectors,
    so that a large anchor's vectors go to one place and its neighbours come there.
    """
    homes: list[set[int]] = [set() for _ in anchors]
    largest = np.argsort(-counts, kind="stable")
    for curve in range(curves):
        windows = curve_windows(anchors, counts, curve, least)
        host: dict[int, int] = {}
        for a in largest:
            host.setdefault(int(windows[a]), int(a))
        for a, w in enumerate(windows):
            homes[a].add(host[int(w)])
    return homes


def nearest(x: np.ndarray, y: np.ndarray, k: int, same: bool, tile: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of at least the ``k`` best columns of every row of ``x @ y.T``.

    The k-th best of the maxima of column chunks bounds the k-th best from
    below, so only what reaches it is looked at. Where very many do, as among
    copies, the row is ranked on its own, ties in order of the columns. ``same``:
    a row is no partner of itself.
    """
    rows, cols = [], []
    x, y, x8, y8 = x.astype("f4"), y.astype("f4"), x, y
    width = len(y)
    chunk = max(1, min(64, width // (4 * k)))
    whole = width // chunk * chunk
    for start in range(0, len(x), tile):
        s = x[start : start + tile] @ y.T
        if same:
            s[np.arange(len(s)), np.arange(start, start + len(s))] = -2
        top = s[:, :whole].reshape(len(s), -1, chunk).max(axis=2)
        if top.shape[1] > k:
            bound = np.partition(top, top.shape[1] - k, axis=1)[:, top.shape[1] - k]
        else:
            bound = np.full(len(s), -1.5, "f4")
        hit = s >= np.maximum(bound - 1e-6, -1.5)[:, None]
        crowded = np.flatnonzero(hit.sum(axis=1) > CROWD)
        for i in crowded:
            exact = (y8 @ x8[start + i]).round(9)
            if same:
                exact[start + i] = -2
            least = np.partition(exact, width - k)[width - k]
            above = np.flatnonzero(exact > least)
            hit[i] = False
            hit[i, above] = True
            hit[i, np.flatnonzero(exact == least)[: k - len(above)]] = True
        r, c = np.nonzero(hit)
        rows.append(r + start)
        cols.append(c)
    return (np.concatenate(rows), np.concatenate(cols)) if rows else (np.empty(0, "i8"), np.empty(0, "i8"))


def _doubles(vecs: pd.Series) -> np.ndarray:
    raw = np.stack(vecs.to_numpy()).astype("f8")
    raw /= np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def _best(ids: np.ndarray, other: np.ndarray, x: np.ndarray, y: np.ndarray, k: int, same: bool) -> pd.DataFrame:
    r, c = nearest(x, y, k, same)
    keep = ids[r] != other[c]
    r, c = r[keep], c[keep]
    cos = np.empty(len(r))
    for start in range(0, len(r), 100_000):
        part = slice(start, start + 100_000)
        cos[part] = np.einsum("ij,ij->i", x[r[part]], y[c[part]])
    out = pd.DataFrame({"rec": ids[r], "other": other[c], "cos": cos.round(9)})
    out = out.sort_values(["rec", "cos", "other"], ascending=[True, False, True]).drop_duplicates(["rec", "other"])
    return out.groupby("rec", sort=False).head(k)


def _without_crowds(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame | None]:
    """The vectors, of more than ``k + 1`` equal ones only those of the smallest ids, and ``rec, head`` of the others.

    No record needs more than ``k + 1`` of them among its nearest; the head is
    the first of a record's copies. None if there are no such copies.
    """
    hashed = vectors.withColumn("h1", F.xxhash64("vec")).withColumn("h2", F.hash("vec"))
    crowds = stage(hashed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("rec").alias("head")).where(F.col("n") > k + 1), "crowds")
    if crowds.isEmpty():
        return vectors, None
    inside = hashed.select("rec", "h1", "h2").join(crowds, ["h1", "h2"])
    place = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("rec"))
    first = inside.withColumn("place", place).where(F.col("place") <= k + 1).select("rec")
    spare = stage(inside.join(first, "rec", "left_anti").select("rec", "head"), "spare")
    return stage(vectors.join(spare.select("rec"), "rec", "left_anti"), "kept"), spare


def top_neighbours(vectors: DataFrame, k: int = K, sample: int = SAMPLE, window: int = WINDOW, block: int = BLOCK, curves: int = CURVES) -> DataFrame:
    """``rec, other, cos, place``: the ``k`` most similar other records of every record.

    ``vectors`` is what ``usable_vectors`` gives. Cosines equal to nine
    decimals are ties, the smaller id first. The lists are exact inside a
    window and its curves; against brute force they reach a recall of 0.9 or
    more (tests). A table of one record gives none.
    """
    spark = vectors.sparkSession
    kept, spare = _without_crowds(vectors, k)
    if spare is not None:
        near = stage(top_neighbours(kept, k, sample, window, block, curves), "near")
        # a spare copy has what the first of its copies has, and that one
        heads = spare.select("head").distinct()
        own = near.join(heads, F.col("rec") == F.col("head")).select("head", "other", "cos").union(heads.select("head", F.col("head").alias("other"), F.lit(1.0).alias("cos")))
        order = Window.partitionBy("head").orderBy(F.desc("cos"), "other")
        lists = own.withColumn("place", F.row_number().over(order).cast("int")).where(F.col("place") <= k)
        return near.unionByName(spare.join(lists, "head").select("rec", "other", "cos", "place"))
    n = vectors.count()
    if n < 2:
        return spark.createDataFrame([], "rec string, other string, cos double, place int")
    share = max(1, -(-n // sample))
    picked = vectors.where(F.pmod(F.xxhash64("rec"), F.lit(share)) == 0).select("vec").limit(2 * sample).toArrow()
    seen = matrix(picked.column("vec").combine_chunks()).astype("f8") if picked.num_rows else np.eye(1, DIMENSIONS)
    counts, sums = np.empty(0), np.empty((0, DIMENSIONS))
    for start in range(0, len(seen), 1000):
        counts, sums = absorb(counts, sums, seen[start : start + 1000], np.ones(len(seen[start : start + 1000])), 0.7)
    counts, sums = settle(counts, sums, 0.8)
    anchors = (sums / np.linalg.norm(sums, axis=1, keepdims=True)).astype("f4")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = matrix(batch.column(1)) @ anchors.T
            many = min(PROBES, len(anchors))
            near = np.argpartition(-s, many - 1, axis=1)[:, :many]
            top = np.take_along_axis(s, near, 1)
            order = np.argsort(-top, axis=1, kind="stable")
            near, top = np.take_along_axis(near, order, 1), np.take_along_axis(top, order, 1)
            near = np.where(top >= top[:, :1] - MARGIN, near, -1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, many, dtype="i4")), pa.array(near.ravel().astype("i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["rec", "vec", "near"])

    placed = vectors.mapInArrow(place, "rec string, vec array<float>, near array<int>")
    own = np.zeros(len(anchors), "i8")
    for r in placed.groupBy(F.col("near")[0].alias("a")).agg(F.count(F.lit(1)).alias("n")).collect():  # one row per anchor
        own[r.a] = r.n
    homes = anchor_homes(anchors.astype("f8"), own, curves, window)
    members: dict[int, int] = {}
    for a, hs in enumerate(homes):
        for h in hs:
            members[h] = members.get(h, 0) + int(own[a])
    table_ = [(a, h, max(1, -(-members[h] // block))) for a, hs in enumerate(homes) for h in sorted(hs)]
    lookup = F.broadcast(spark.createDataFrame(table_, "anchor int, window bigint, blocks int"))  # anchors x curves rows
    entered = (
        placed.withColumn("anchor", F.explode(F.filter("near", lambda a: a >= 0)))
        .join(lookup, "anchor")
        .withColumn("b", F.pmod(F.xxhash64("rec"), F.col("blocks")).cast("int"))
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("rec", "vec", "window", F.least("b", "o").alias("b1"), F.greatest("b", "o").alias("b2"), "b")
    )

    def pairs(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates("rec")
        part = part.sort_values("rec", kind="stable")
        ids, x = part["rec"].to_numpy(), _doubles(part["vec"])
        if part["b1"].iloc[0] == part["b2"].iloc[0]:
            return _best(ids, ids, x, x, k, True)
        left = (part["b"] == part["b1"]).to_numpy()
        a, b = np.flatnonzero(left), np.flatnonzero(~left)
        if not len(a) or not len(b):
            return pd.DataFrame({"rec": [], "other": [], "cos": []})
        return pd.concat([_best(ids[a], ids[b], x[a], x[b], k, False), _best(ids[b], ids[a], x[b], x[a], k, False)])

    met = entered.groupBy("window", "b1", "b2").applyInPandas(pairs, "rec string, other string, cos double")
    # the best k of a record's lists: structs sort by cosine, then by the smaller id
    listed = met.groupBy("rec").agg(F.array_sort(F.collect_set(F.struct((-F.col("cos")).alias("far"), "other"))).alias("l"))
    ranked = listed.select("rec", F.posexplode(F.slice("l", 1, k)).alias("place", "x"))
    return ranked.select("rec", F.col("x.other").alias("other"), (-F.col("x.far")).alias("cos"), F.col("place").cast("int").alias("place"))


def _lists(spark: SparkSession, folder: str) -> DataFrame:
    return top_neighbours(usable_vectors(table(spark, folder, "style_vectors")))


def p5_found(spark: SparkSession, folder: str, least: float = 0.7) -> DataFrame:
    """Pairs that are among each other's five nearest, with a cosine of 0.7 or more."""
    near = _lists(spark, folder).where(F.col("cos") >= least)
    pair = near.select(F.least("rec", "other").alias("rec_id_a"), F.greatest("rec", "other").alias("rec_id_b"))
    return pair.groupBy("rec_id_a", "rec_id_b").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("rec_id_a", "rec_id_b")


def p5_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The lists as ``neighbors`` should hold them: JSON arrays of ids and of cosines of four decimals."""
    ordered = F.array_sort(F.collect_list(F.struct("place", "other", "cos")))
    lists = _lists(spark, folder).groupBy("rec").agg(ordered.alias("l"))
    return lists.select(
        F.col("rec").alias("rec_id"),
        F.to_json(F.transform("l", lambda x: x["other"])).alias("neighbor_ids"),
        F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: F.format_string("%.4f", x["cos"])), ", "), F.lit("]")).alias("neighbor_cos"),
    )


QUERIES = {"p5_found": p5_found, "p5_neighbours": p5_neighbours}
