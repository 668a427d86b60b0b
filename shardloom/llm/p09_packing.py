"""Problem 9: items packed into containers of fixed capacity.

Method: swap-based local search. Tasks of bounded size first place their items
best-fit in order of decreasing size, then exchange one-for-one, two-for-one
or move items between underfull containers; every step makes a fuller container
fuller and a less full one emptier (the sum of squared fills grows), until
containers come out empty or nothing improves. Containers that stay underfull
are pooled and packed again in fewer tasks, so that what many tasks leave over
ends up together.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..io import table
from ..session import stage
from .p08_encode import VOCABULARY, count_tokens

CAPACITY = 1024
#: Items a packing task holds at most.
PER_TASK = 20_000
#: Containers filled to this share are not packed again.
FULL = 0.995


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers of item numbers: largest items first, each into the fullest container it fits."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    bins: list[list[int]] = []
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps = 0  # bit g: some container has gap g
    for i in order:
        s = sizes[i]
        fitting = gaps >> s
        if fitting:
            gap = s + (fitting & -fitting).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                gaps &= ~(1 << gap)
            bins[b].append(i)
            left = gap - s
        else:
            b = len(bins)
            bins.append([i])
            left = capacity - s
        by_gap[left].append(b)
        gaps |= 1 << left
    return bins


def improve(bins: list[list[int]], sizes: list[int], capacity: int, sweeps: int = 20) -> list[list[int]]:
    """Local search between the underfull containers; sweeps end earlier when nothing improves."""
    done = [b for b in bins if sum(sizes[i] for i in b) == capacity]
    open_ = [list(b) for b in bins if sum(sizes[i] for i in b) < capacity]
    for _ in range(sweeps):
        open_.sort(key=lambda b: -sum(sizes[i] for i in b))
        fills = [sum(sizes[i] for i in b) for b in open_]
        where: dict[int, set[tuple[int, int]]] = {}  # size -> (container, item)
        for n, b in enumerate(open_):
            for i in b:
                where.setdefault(sizes[i], set()).add((n, i))
        present = sorted(where)
        changed = False

        def take(size: int, to: int, but: tuple[tuple[int, int], ...] = ()) -> tuple[int, int] | None:
            """An item of that size in a container after ``to``, from the least full."""
            found = [x for x in where.get(size, ()) if x[0] > to and x not in but]
            return max(found) if found else None

        def shift(item: int, source: int, to: int) -> None:
            open_[source].remove(item)
            open_[to].append(item)
            fills[source] -= sizes[item]
            fills[to] += sizes[item]
            where[sizes[item]].discard((source, item))
            where[sizes[item]].add((to, item))

        for n in range(len(open_)):
            while fills[n] < capacity and open_[n]:
                gap = capacity - fills[n]
                best: tuple[int, int, list[tuple[int, int]]] | None = None  # gain, item given away or -1, items taken
                for give in [-1, *sorted(set(open_[n]), key=lambda i: sizes[i])]:
                    have = 0 if give < 0 else sizes[give]
                    limit = have + gap
                    k = bisect_right(present, limit) - 1
                    while k >= 0 and present[k] > have + (best[0] if best else 0):
                        one = take(present[k], n)
                        if one:
                            best = (present[k] - have, give, [one])
                            break
                        k -= 1
                    if best and best[0] == gap:
                        break
                    low, high = 0, bisect_right(present, limit) - 1
                    while low <= high:
                        both = present[low] + present[high]
                        if both > limit:
                            high -= 1
                            continue
                        if both > have + (best[0] if best else 0):
                            one = take(present[high], n)
                            two = take(present[low], n, (one,)) if one else None
                            # what is given away goes to the first item's container and must fit there
                            if two and fills[one[0]] - sizes[one[1]] - (sizes[two[1]] if two[0] == one[0] else 0) + have <= capacity:
                                best = (both - have, give, [one, two])
                        low += 1
                    if best and best[0] == gap:
                        break
                if not best:
                    break
                _, give, taken = best
                for source, item in taken:
                    shift(item, source, n)
                if give >= 0:
                    shift(give, n, taken[0][0])
                changed = True
        open_ = [b for b in open_ if b]
        if not changed:
            break
    return [*done, *open_]


def _pack(part: pd.DataFrame, capacity: int) -> pd.DataFrame:
    part = part.sort_values(["size", "k", "piece"], ascending=[False, True, True]).reset_index(drop=True)
    sizes = part["size"].tolist()
    bins = improve(best_fit(sizes, capacity), sizes, capacity)
    number = np.zeros(len(part), "i8")
    fill = np.zeros(len(part), "i8")
    for b, items in enumerate(bins):
        number[items] = b
        fill[items] = sum(sizes[i] for i in items)
    return part.assign(bin=number, fill=fill)


def pack(items: DataFrame, key: str = "doc_id", size: str = "tokens", capacity: int = CAPACITY, per_task: int = PER_TASK) -> DataFrame:
    """``key, piece, pieces, size, container, fill``, one row per piece.

    An item above the capacity is split into full pieces and a rest; no other
    item is split. ``fill`` is the sum of sizes in the container. An item of
    size 0, or null, takes no room: one piece with a null container. Rows with
    a null key are left out; repeated rows are items of their own. An empty
    table gives an empty result.
    """
    kind = items.schema[key].dataType.simpleString()
    rows = items.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint").alias("n"))
    pieces = F.greatest(F.ceil(F.col("n") / capacity), F.lit(1)).cast("int")
    cut = stage(
        rows.withColumn("pieces", pieces)
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        .withColumn("size", F.least(F.col("n") - F.col("piece") * F.lit(capacity), F.lit(capacity)).cast("bigint"))
        .withColumn("row", F.monotonically_increasing_id())
        .select("k", "piece", "pieces", "size", "row"),
        "pieces",
    )
    alone = cut.where((F.col("size") == 0) | (F.col("size") == capacity))
    alone = alone.withColumn("container", F.when(F.col("size") > 0, F.concat(F.lit("f-"), F.col("row").cast("string")))).withColumn("fill", F.col("size"))
    out = [alone.drop("row")]
    shape = f"k {kind}, piece int, pieces int, size bigint, row bigint, bin bigint, fill bigint, task int"
    open_, turn = cut.where((F.col("size") > 0) & (F.col("size") < capacity)), 0
    n = open_.count()
    while n:
        tasks = -(-n // per_task)

        def run(task: tuple, part: pd.DataFrame) -> pd.DataFrame:
            return _pack(part[["k", "piece", "pieces", "size", "row"]], capacity).assign(task=int(task[0]))

        spread = F.pmod(F.xxhash64(F.lit(turn), "row"), F.lit(tasks)).cast("int")
        packed = stage(open_.groupBy(spread.alias("task")).applyInPandas(run, shape), "packed")
        packed = packed.withColumn("container", F.concat_ws("-", F.lit(str(turn)), "task", "bin"))
        last = tasks == 1
        full = packed if last else packed.where(F.col("fill") >= capacity * FULL)
        out.append(full.select("k", "piece", "pieces", "size", "container", "fill"))
        if last:
            break
        open_ = packed.where(F.col("fill") < capacity * FULL).select("k", "piece", "pieces", "size", "row")
        m, turn = open_.count(), turn + 1
        if m > 0.9 * n:  # hardly anything fits together: what is left stays as packed
            out.append(packed.where(F.col("fill") < capacity * FULL).select("k", "piece", "pieces", "size", "container", "fill"))
            break
        n = m
    result = out[0].select("k", "piece", "pieces", "size", "container", "fill")
    for part in out[1:]:
        result = result.union(part)
    return result.withColumnRenamed("k", key).withColumnRenamed("size", size)


def _packed(spark: SparkSession, folder: str, vocabulary: str = VOCABULARY) -> DataFrame:
    sized = stage(count_tokens(table(spark, folder, "documents"), vocabulary=vocabulary), "sized")
    return pack(sized)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose pieces the packing put into more than one container."""
    held = _packed(spark, folder).groupBy("doc_id").agg(F.min("container").alias("first"), F.max("container").alias("last"))
    return held.where(F.col("first") != F.col("last")).select("doc_id")


def p9_containers(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder)


def p9_report(spark: SparkSession, folder: str) -> DataFrame:
    """Containers used, the least number possible, and the share of space filled."""
    packed = _packed(spark, folder)
    bins = packed.where("container IS NOT NULL").agg(F.countDistinct("container").alias("containers"), F.sum("tokens").alias("tokens"))
    return bins.select(
        "containers",
        "tokens",
        F.ceil(F.col("tokens") / CAPACITY).alias("least_containers"),
        F.round(F.try_divide(F.col("tokens"), F.col("containers") * CAPACITY), 6).alias("filled"),
    )


QUERIES = {"p9_found": p9_found, "p9_containers": p9_containers, "p9_report": p9_report}
