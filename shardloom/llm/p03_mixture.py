"""Problem 3: a mix of sources with target shares of the total size.

Method: multivariate-hypergeometric splitting tree. A shard is cut into blocks
of images. Exact image quotas per source give the number of blocks each source
contributes. The block counts of all sources are split at random between the
left and the right half of the output shards, then each half again, down to the
single output shard; every node's draw is seeded by its place in the tree, so
any task can compute the part of the tree it needs. A leaf owns a run of
positions in every source's permutation of its blocks; runs are disjoint, so
blocks are drawn without replacement. Slots are shuffled inside the output
shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..io import table
from ..session import parallelism
from .shardtable import CURRENT_SQL, current_shards, listed_sources

BLOCK = 500
OUT_SHARD = 5000
SEED = 20240611
#: Ranges of the permuting hash; the position of a block is the count before its range plus its rank within.
HASH_RANGES = 1024


def image_quotas(images: dict[str, int], percent: dict[str, int], repeats: dict[str, int], total: int) -> dict[str, int]:
    """Images each source gives to a mix of ``total``, in exact arithmetic.

    Shares are proportional to ``percent``, none above images x repeats; what a
    short source cannot give is shared out among the others in proportion. The
    parts below one image go to the largest remainders, then by name.
    """
    most = {s: images[s] * max(0, repeats[s]) for s in images}
    quota: dict[str, Fraction] = {}
    open_, left = {s for s in images if percent[s] > 0 and most[s] > 0}, Fraction(total)
    while open_:
        weight = sum(percent[s] for s in open_)
        full = {s for s in open_ if left * percent[s] / weight >= most[s]}
        if not full:
            quota |= {s: left * percent[s] / weight for s in open_}
            break
        quota |= {s: Fraction(most[s]) for s in full}
        left -= sum(most[s] for s in full)
        open_ -= full
    whole = {s: int(quota.get(s, 0)) for s in images}
    rest = round(sum(quota.values(), Fraction(0))) - sum(whole.values())
    order = sorted(images, key=lambda s: (-(quota.get(s, Fraction(0)) - whole[s]), s))
    return {s: whole[s] + (s in order[:rest]) for s in images}


#: The generator draws from fewer blocks than this at once.
DRAWN_AT_ONCE = 1_000_000_000


def draw(rng: np.random.Generator, counts: list[int], take: int, most: int = DRAWN_AT_ONCE) -> list[int]:
    """How many of ``take`` blocks drawn without replacement come from each source.

    From ``most`` blocks on, bundles of blocks are drawn, as few to a bundle as
    possible, and what is left of ``take`` comes from the blocks outside
    bundles, the largest rest first. The sum is always ``take``.
    """
    unit = sum(counts) // most + 1
    if not take:
        return [0] * len(counts)
    left = [int(x) * unit for x in rng.multivariate_hypergeometric([c // unit for c in counts], min(take // unit, sum(c // unit for c in counts)), method="marginals")]
    rest = take - sum(left)
    for i in sorted(range(len(counts)), key=lambda i: (-((counts[i] - left[i]) % unit), left[i] - counts[i], i)):
        more = min(rest, counts[i] - left[i])
        left[i] += more
        rest -= more
    return left


def split_tree(blocks: list[int], leaves: int, first: int, last: int, seed: int) -> Iterator[tuple[int, list[int], list[int]]]:
    """``leaf, starts, counts`` for the leaves from ``first`` up to ``last`` (exclusive).

    Only the nodes above those leaves are drawn.
    """
    stack = [(0, leaves, [0] * len(blocks), list(blocks))]
    while stack:
        low, high, starts, counts = stack.pop()
        if high <= first or low >= last:
            continue
        if high - low == 1:
            yield low, starts, counts
            continue
        middle = (low + high) // 2
        n = sum(counts)
        take = n * (middle - low) // (high - low)
        rng = np.random.Generator(np.random.PCG64([seed, low, high]))
        left = draw(rng, counts, take)
        stack.append((middle, high, [s + x for s, x in zip(starts, left)], [c - x for c, x in zip(counts, left)]))
        stack.append((low, middle, starts, left))


def mix_sources(
    shards: DataFrame,
    targets: DataFrame,
    total: int | None = None,
    block: int = BLOCK,
    out_shard: int = OUT_SHARD,
    seed: int = SEED,
) -> tuple[DataFrame, DataFrame]:
    """The mix and its report.

    ``shards`` has shard_id (unique), source_key and n_images; null, zero and
    negative n_images count 0 and unlisted or null sources take no part.
    ``targets`` has one row per listed source (a table whose size does not grow
    with the data; it is read to the driver). ``total`` images are mixed, by
    default as many as all listed sources have.

    Mix: ``out_shard, slot, source_key, shard_id, repeat_no, first_image,
    n_images``: a run of images of one use of a shard. No shard is used more
    than max_repeats times. Report: ``source, target_pct, max_repeats, images,
    wanted, short, actual, actual_pct``, of which ``actual`` is summed over the
    drawn mix; ``short`` is a source that is used up (every shard max_repeats
    times) and still stays below its share of ``total``. Without images the mix
    is empty and actual_pct null.
    """
    spark = shards.sparkSession
    size = F.greatest(F.coalesce("n_images", F.lit(0)), F.lit(0))
    owned = shards.select("source_key", "shard_id", size.alias("n")).join(targets.select("source_key"), "source_key")
    supply = {r.source_key: int(r.n) for r in owned.groupBy("source_key").agg(F.sum("n").alias("n")).collect()}
    rows = targets.select("source_key", "source", "target_pct", "max_repeats").collect()
    names = sorted(r.source_key for r in rows)
    images = {s: supply.get(s, 0) for s in names}
    percent = {r.source_key: r.target_pct or 0 for r in rows}
    repeats = {r.source_key: r.max_repeats or 0 for r in rows}
    everything = sum(images.values())
    total = everything if total is None else total
    quota = image_quotas(images, percent, repeats, total)
    passes = {s: -(-quota[s] // images[s]) if images[s] else 0 for s in names}

    plan = spark.createDataFrame([(s, names.index(s), quota[s], passes[s]) for s in names], "source_key string, number int, quota bigint, passes int")
    pieces = (
        owned.where("n > 0")
        .join(F.broadcast(plan.where("quota > 0")), "source_key")
        .withColumn("repeat_no", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
        .withColumn("first_image", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(block).cast("bigint"))))
        .withColumn("n_images", F.least(F.col("n") - F.col("first_image"), F.lit(block)))
        .withColumn("h", F.xxhash64(F.lit(seed), "shard_id", "repeat_no", "first_image"))
        .withColumn("range", F.pmod("h", F.lit(HASH_RANGES)))
        .drop("n", "passes")
    )
    in_range = Window.partitionBy("source_key", "repeat_no", "range").orderBy("h", "shard_id", "first_image")
    before = Window.partitionBy("source_key").orderBy("repeat_no", "range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        pieces.groupBy("source_key", "repeat_no", "range").agg(F.count(F.lit(1)).alias("c"), F.sum("n_images").alias("i"))
        .select("source_key", "repeat_no", "range", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"), F.coalesce(F.sum("i").over(before), F.lit(0)).alias("i0"))
    )
    placed = (
        pieces.withColumn("rank", F.row_number().over(in_range) - 1)
        .withColumn("run", F.sum("n_images").over(in_range.rowsBetween(Window.unboundedPreceding, -1)))
        .join(offsets, ["source_key", "repeat_no", "range"])
        .withColumn("position", F.col("c0") + F.col("rank"))
        .withColumn("left", F.col("quota") - F.col("i0") - F.coalesce("run", F.lit(0)))
        .where("left > 0")
        .withColumn("n_images", F.least("n_images", "left"))
        .select("source_key", "number", "position", "shard_id", "repeat_no", "first_image", "n_images", "h")
    )
    # blocks per source, for the root of the tree: one row per listed source
    drawn = {r.number: r.b for r in placed.groupBy("number").agg(F.count(F.lit(1)).alias("b")).collect()}
    blocks = [int(drawn.get(i, 0)) for i in range(len(names))]
    leaves = max(1, -(-sum(quota.values()) // out_shard))

    def descend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                ids = batch["id"].to_numpy()
                found = [
                    (leaf, k, starts[k], counts[k])
                    for leaf, starts, counts in split_tree(blocks, leaves, int(ids.min()), int(ids.max()) + 1, seed)
                    for k in range(len(counts))
                    if counts[k]
                ]
                yield pd.DataFrame(found, columns=["out_shard", "number", "start", "count"])

    runs = spark.range(0, leaves, 1, min(leaves, 4 * parallelism(spark))).mapInPandas(descend, "out_shard bigint, number int, start bigint, count bigint")
    slots = runs.select("out_shard", "number", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("count") - 1)).alias("position"))
    local = Window.partitionBy("out_shard").orderBy(F.xxhash64(F.lit(seed + 1), "h"), "number", "position")
    # both sides grow with the mix; the planner takes the tree's leaves for a small table
    mix = slots.hint("merge").join(placed, ["number", "position"]).select(
        "out_shard", (F.row_number().over(local) - 1).alias("slot"), "source_key", "shard_id", "repeat_no", "first_image", "n_images"
    )

    head = spark.createDataFrame(
        [(r.source_key, r.source, r.target_pct, r.max_repeats, images[r.source_key], quota[r.source_key], images[r.source_key] * max(0, repeats[r.source_key]), percent[r.source_key]) for r in rows],
        "source_key string, source string, target_pct int, max_repeats int, images bigint, wanted bigint, most bigint, percent int",
    )
    given = mix.groupBy("source_key").agg(F.sum("n_images").alias("actual"))
    sum_all = Window.partitionBy(F.lit(0))  # one row per listed source
    report = (
        head.join(given, "source_key", "left")
        .withColumn("actual", F.coalesce("actual", F.lit(0)))
        .withColumn("short", (F.col("actual") >= F.col("most")) & (F.col("actual") * 100 < F.col("percent") * F.lit(total).cast("bigint")))
        .withColumn("actual_pct", F.round(F.try_divide(F.col("actual") * 100.0, F.sum("actual").over(sum_all)), 4))
        .select("source", "target_pct", "max_repeats", "images", "wanted", "short", "actual", "actual_pct")
    )
    return mix, report


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    shards = current_shards(table(spark, folder, "shards")).where("source_key IS NOT NULL")
    return mix_sources(shards, listed_sources(table(spark, folder, "source_targets")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Listed sources that the drawn mix uses up without reaching their share."""
    return _mixed(spark, folder)[1].where("short").select("source")


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[1]


def p3_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[0]


QUERIES = {"p3_found": p3_found, "p3_report": p3_report, "p3_mix": p3_mix}

SQL = {
    "p3_found": f"""WITH {CURRENT_SQL},
per AS (
  SELECT l.source, l.target_pct, l.max_repeats, coalesce(sum(greatest(coalesce(c.n_images, 0), 0)), 0) AS images
  FROM listed l LEFT JOIN cur c USING (source_key) GROUP BY 1, 2, 3
)
SELECT source FROM per WHERE images * max_repeats * 100 < target_pct * (SELECT sum(images) FROM per)"""
}
