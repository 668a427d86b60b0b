"""Choice of the shards of an iteration: best, diverse, unexplored, quotas, and a weighted draw for the rest."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .ranking import seeded_order, weighted_sample
from .similarity import farthest_points

#: Share of unscored shards from which exploration is raised, and to what at least.
EXPLORE_FROM, EXPLORE_RAISED = 0.30, 0.30
#: Fixed value: the score of a shard without one.
UNSCORED = 0.3


@dataclass(frozen=True)
class Policy:
    """What a selection weighs. ``schedule`` entries are (through or after, iteration, rate); the first that fits counts."""

    performance: float = 0.60
    diversity: float = 0.20
    exploration: float = 0.15
    recency_penalty: float = 0.30
    recency_window: int = 3
    schedule: tuple[tuple[str, int, float], ...] = ()
    per_source: dict[str, int] = field(default_factory=dict)
    seed: int = 42


def exploration_rate(policy: Policy, iteration: int, unscored: float) -> float:
    """The rate of this iteration: of the schedule (not at iteration 0), raised while many shards are unscored."""
    rate = policy.exploration
    if iteration > 0:
        for kind, at, value in policy.schedule:
            if kind == "through" and iteration <= at or kind == "after" and iteration > at:
                rate = value
                break
    return max(rate, EXPLORE_RAISED) if unscored > EXPLORE_FROM else rate


def shard_score(effective: Column, composite: Column) -> Column:
    """Effective, else composite score; 0 counts as missing, as null does."""
    return F.coalesce(F.nullif(effective, F.lit(0.0)), F.nullif(composite, F.lit(0.0)), F.lit(UNSCORED))


def recency_weight(score: Column, selected: Column, iteration: int, window: int, penalty: float) -> Column:
    """A score less up to ``penalty`` of it, the more often the shard was selected for the iterations there were."""
    base = F.when(score > 0, score).otherwise(F.lit(UNSCORED))
    often = F.least(F.lit(1.0), selected / max(1.0, iteration / max(1, window)))
    return F.when((selected > 0) & F.lit(window > 0), base * (1.0 - penalty * often)).otherwise(base)


def select_shards(pool: DataFrame, n: int, policy: Policy = Policy(), iteration: int = 0, key: str = "shard_id", held_out: tuple[str, ...] = (), embedding: str | None = None) -> DataFrame:
    """``key, phase``: up to ``n`` shards of a pool, chosen in phases that never displace one another.

    The pool has source, effective, composite, n_selected and n_scored, one
    row per key; a null n_selected or n_scored counts 0, a null source as
    ``unknown``. ``held_out`` sources take no part. Phases: ``all`` if the pool
    has at most ``n`` shards; else ``performance`` (best scores after the
    recency penalty), ``diversity`` (farthest embeddings from those chosen if
    ``embedding`` names a column and enough have one, else sources chosen least
    so far), ``exploration`` (never selected ones in seeded order, else the
    least selected), ``source`` (quotas, while places are left), ``fill`` (a
    seeded draw by weight). Ties go to the smaller key. Every phase keeps at
    most ``n`` rows per task, so only chosen shards are ever brought together.
    """
    rows = pool.select(
        key,
        F.coalesce("source", F.lit("unknown")).alias("source"),
        F.col("effective").cast("double").alias("effective"),
        F.col("composite").cast("double").alias("composite"),
        F.coalesce("n_selected", F.lit(0)).alias("n_selected"),
        F.coalesce("n_scored", F.lit(0)).alias("n_scored"),
        *([F.col(embedding).alias("vec")] if embedding else []),
    ).where(~F.col("source").isin(*held_out) if held_out else F.lit(True))
    score = shard_score(F.col("effective"), F.col("composite"))
    # the first phase knows no penalty at iteration 0
    early = recency_weight(score, F.col("n_selected"), iteration, policy.recency_window if iteration > 0 else 0, policy.recency_penalty)
    late = recency_weight(score, F.col("n_selected"), iteration, policy.recency_window, policy.recency_penalty)
    rows = stage(rows.withColumns({"early": early, "weight": F.greatest(F.lit(0.001), late), "scored": F.col("effective").isNotNull() | F.col("composite").isNotNull()}), "pool")
    total, unscored = rows.agg(F.count(F.lit(1)), F.count_if(F.col("n_scored") == 0)).first()
    if total <= n:
        return rows.select(key, F.lit("all").alias("phase"))
    parts: list[DataFrame] = []

    def left() -> DataFrame:
        out = rows
        for p in parts:
            out = out.join(F.broadcast(p.select(key)), key, "left_anti")  # at most ``n`` rows
        return out

    def chosen() -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def take(picked: DataFrame, phase: str) -> None:
        parts.append(stage(picked.select(key, "source", F.lit(phase).alias("phase")), phase))

    take(rows.where("scored").orderBy(F.desc("early"), key).limit(max(1, int(n * policy.performance))), "performance")
    count = int(n * policy.diversity)
    if count > 0:
        rest = left()
        known = rows.where("vec IS NOT NULL") if embedding else None
        seeds = known.join(F.broadcast(parts[0].select(key)), key, "left_semi") if embedding else None
        if embedding and not seeds.isEmpty() and rest.where("vec IS NOT NULL").count() >= count:
            picks = farthest_points(known, key, "vec", count, seeds=seeds).select(F.col(key).cast(rows.schema[key].dataType).alias(key))
            take(rows.join(F.broadcast(picks), key, "left_semi"), "diversity")
        else:
            held = parts[0].groupBy("source").agg(F.count(F.lit(1)).alias("held"))
            take(rest.join(F.broadcast(held), "source", "left").orderBy(F.coalesce("held", F.lit(0)), key).limit(count), "diversity")
    count = int(n * exploration_rate(policy, iteration, unscored / total))
    if count > 0:
        rest = left()
        new = rest.where("n_selected = 0")
        take((rest.orderBy("n_selected", key) if new.isEmpty() else new.orderBy(seeded_order(key, policy.seed), key)).limit(count), "exploration")
    for source, least in policy.per_source.items():  # written by hand
        so_far = chosen()
        free = n - so_far.count()
        missing = min(least - so_far.where(F.col("source") == source).count(), free)
        if missing > 0:
            take(left().where(F.col("source") == source).orderBy(F.desc("early"), key).limit(missing), "source")
    needed = n - chosen().count()
    if needed > 0:
        take(weighted_sample(left(), key, F.col("weight"), needed, policy.seed + 1), "fill")
    return chosen().select(key, "phase")
