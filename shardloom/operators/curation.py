"""Curation steps over scored records: incremental near-duplicates, selections under quotas, gates and comparisons."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .similarity import _unit, usable


def near_duplicates(new: DataFrame, kept: DataFrame, key: str, vec: str, order: str, least: float = 0.95, block: int = 4096) -> DataFrame:
    """``key, of, cos``: new rows near an earlier kept one, with the most similar such row.

    ``kept`` is what earlier batches kept; new rows follow in ``order`` (a
    number, unique). A new row is refused if a kept row, or a new row before it
    that is not refused itself, has a cosine of ``least`` or more. Copies inside
    the batch count too. Vectors meet in blocks; what is decided one after
    another is only the table of near pairs, in rounds.
    """
    spark = new.sparkSession
    n = usable(new, vec).select(F.col(key).cast("string").alias("k"), F.col(vec).alias("v"), F.col(order).cast("double").alias("o"))
    old = usable(kept, vec).select(F.col(key).cast("string").alias("k"), F.col(vec).alias("v"), F.lit(float("-inf")).alias("o"))
    every = stage(old.union(n).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.hash("v")), "every")
    heads = stage(every.groupBy("h1", "h2").agg(F.min(F.struct("o", "k")).alias("m")).select("h1", "h2", F.col("m.k").alias("head")), "heads")
    placed = every.join(heads, ["h1", "h2"])
    base = stage(placed.where("k = head").select("k", "v", "o"), "base")
    asked = stage(base.where("o > double('-Infinity')"), "asked")
    copies = stage(placed.where("k != head AND o > double('-Infinity')").select("k", "head"), "copies")
    blocks = max(1, -(-asked.count() // block))
    edges = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == b).toPandas()  # about ``block`` rows
        if not len(part):
            continue
        shared = spark.sparkContext.broadcast((part["k"].to_numpy(), part["o"].to_numpy(), _unit(part["v"])))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, at, q = shared.value
            for batch in batches:
                if len(batch):
                    s = (q @ _unit(batch["v"]).T).round(9)
                    r, c = np.nonzero((s >= least) & (at[:, None] > batch["o"].to_numpy()[None, :]))
                    yield pd.DataFrame({"a": ids[r], "b": batch["k"].to_numpy()[c], "fixed": np.isneginf(batch["o"].to_numpy()[c]), "cos": s[r, c]})

        found = base.mapInPandas(run, "a string, b string, fixed boolean, cos double")
        edges = found if edges is None else edges.union(found)
    if edges is None:
        edges = spark.createDataFrame([], "a string, b string, fixed boolean, cos double")
    edges = stage(edges, "near")
    state = stage(edges.select("a").union(edges.where("NOT fixed").select("b")).distinct().select(F.col("a").alias("k"), F.lit("open").alias("state")), "state")
    while not state.where("state = 'open'").isEmpty():
        seen = edges.join(state.select(F.col("k").alias("b"), F.col("state").alias("s")), "b", "left").withColumn("s", F.when(F.col("fixed"), "kept").otherwise(F.col("s")))
        by = seen.groupBy(F.col("a").alias("k")).agg(F.max((F.col("s") == "kept").cast("int")).alias("hit"), F.max((F.col("s") == "open").cast("int")).alias("wait"))
        now = F.when(F.col("state") != "open", F.col("state")).when(F.col("hit") == 1, "refused").when(F.coalesce("wait", F.lit(0)) == 0, "kept").otherwise("open")
        state = stage(state.join(by, "k", "left").select("k", now.alias("state")), "state")
    good = state.where("state = 'kept'").select(F.col("k").alias("b"), F.lit(True).alias("ok"))
    hits = edges.join(state.where("state = 'refused'").select(F.col("k").alias("a")), "a").join(good, "b", "left").where("fixed OR ok")
    out = stage(hits.groupBy(F.col("a").alias("k")).agg(F.max(F.struct("cos", "b")).alias("m")).select("k", F.col("m.b").alias("of"), F.col("m.cos").alias("cos")), "hits")
    rest = copies.join(out.select(F.col("k").alias("head"), "of", "cos"), "head", "left").select("k", F.coalesce("of", "head").alias("of"), F.coalesce("cos", F.lit(1.0)).alias("cos"))
    return out.union(rest).withColumnRenamed("k", key)


def weighted_decisions(scores: DataFrame, weights: DataFrame, group: str, signals: list[str]) -> DataFrame:
    """Scores combined by a weight table per group; the weight of a missing signal is shared out; kept from the group's threshold on.

    ``weights`` has group, w_<signal> and threshold, one row per group (a
    table written by hand); groups it does not list take its row ``default``.
    """
    default = weights.where(F.col(group) == "default").first()
    joined = scores.join(F.broadcast(weights), group, "left")
    total = have = None
    for s in signals:
        w = F.coalesce(F.col(f"w_{s}"), F.lit(float(default[f"w_{s}"])))
        v, h = F.coalesce(F.col(s) * w, F.lit(0.0)), F.when(F.col(s).isNotNull(), w).otherwise(0.0)
        total, have = (v, h) if total is None else (total + v, have + h)
    value = F.try_divide(total, have)
    kept = F.coalesce(value >= F.coalesce("threshold", F.lit(float(default["threshold"]))), F.lit(False))
    return joined.withColumn("combined", value).withColumn("decision", F.when(kept, "keep").otherwise("discard")).drop("threshold", *[f"w_{s}" for s in signals])


def rotating_holdout(df: DataFrame, group: str, turn: int) -> DataFrame:
    """Rows but those of the group whose turn it is, groups taken in order of name; a single group is never held out."""
    names = [r[0] for r in df.where(F.col(group).isNotNull()).select(group).distinct().orderBy(group).collect()]  # one row per source
    return df if len(names) < 2 else df.where(~F.col(group).eqNullSafe(F.lit(names[turn % len(names)])))


def relative_regressions(results: DataFrame, reference: str, arm: str = "arm", metric: str = "metric", value: str = "value", lower_better: tuple[str, ...] = ("lpips", "fid", "loss"), limit: float = 0.03) -> DataFrame:
    """``arm, metric, change, failed``: how much worse than the reference arm, by its size (1 where it is 0); failed above the limit."""
    ref = results.where(F.col(arm) == reference).select(metric, F.col(value).alias("__r"))
    sign = F.when(F.lower(metric).isin(*lower_better), 1.0).otherwise(-1.0)
    worse = sign * (F.col(value) - F.col("__r")) / F.when(F.col("__r") == 0, 1.0).otherwise(F.abs("__r"))
    return results.where(F.col(arm) != reference).join(ref, metric).select(arm, metric, (F.round(worse, 6) + F.lit(0.0)).alias("change"), (worse > limit).cast("int").alias("failed"))


def champion(scores: DataFrame, family: str, key: str, score: str, incumbents: DataFrame, margin: float) -> DataFrame:
    """``family, champion, changed``: the best, unless the incumbent is within the margin of it."""
    best = scores.groupBy(family).agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(key)).alias("k"))).alias("b")).select(family, F.col("b.s").alias("s"), (-F.col("b.k")).alias("k"))
    held = incumbents.join(scores.select(family, key, score), [family, key]).select(family, F.col(key).alias("ik"), F.col(score).alias("is"))
    stays = F.col("ik").isNotNull() & (F.col("s") - F.col("is") < margin)
    return best.join(held, family, "left").select(family, F.when(stays, F.col("ik")).otherwise(F.col("k")).alias("champion"), (~F.coalesce(F.col("ik") == F.when(stays, F.col("ik")).otherwise(F.col("k")), F.lit(False))).cast("int").alias("changed"))


def superseded(runs: DataFrame, group: str, key: str, order: list[str], main: str, side: str, next_side: str | None = None) -> DataFrame:
    """Keys of runs that the next run of their group beats on both values; a null side value of the next passes.

    ``next_side`` names the column the next run's side value is taken from, if that is another one.
    """
    w = Window.partitionBy(group).orderBy(*order)
    nxt = runs.withColumn("__m", F.lead(main).over(w)).withColumn("__s", F.lead(next_side or side).over(w)).withColumn("__k", F.lead(key).over(w))
    return nxt.where(F.col("__k").isNotNull() & (F.col("__m") > F.col(main)) & (F.col("__s").isNull() | (F.col("__s") > F.col(side)))).select(key)


def snapshot_changes(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """``key, change``: added, removed, advanced or fallen back between two snapshots; equal ones are left out."""
    o, n = old.select(key, F.col(value).alias("o")), new.select(key, F.col(value).alias("n"))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("n") > F.col("o"), "advanced").when(F.col("n") < F.col("o"), "back")
    return o.join(n, key, "full_outer").select(key, change.alias("change")).where("change IS NOT NULL")


def rotate_issues(issues: DataFrame, key: str, resolved: str, at: str, keep: int = 500) -> DataFrame:
    """All unresolved issues and the ``keep`` newest resolved ones."""
    done = issues.where(F.col(resolved))
    return issues.where(~F.coalesce(F.col(resolved), F.lit(False))).unionByName(done.orderBy(F.desc(at), F.asc(key)).limit(keep))


SEVERITIES = ("critical", "error", "warning", "info")


def at_least_severe(df: DataFrame, severity: str, least: str) -> DataFrame:
    """Rows of a severity at or above ``least``; unknown severities rank last."""
    rank = lambda c: F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.lower(c)), F.lit(0)), F.lit(9))
    return df.where(rank(F.col(severity)) <= rank(F.lit(least)))


def send_alerts(alerts: DataFrame, poster: Callable[[list[dict]], bool], severity: str = "severity", least: str = "warning", most: int = 1000) -> dict:
    """Hands the alerts severe enough to ``poster``; ``sent, n_sent, n_total, skipped``.

    ``poster`` is called on the driver with one list of rows; more than
    ``most`` alerts at once are an error of the rules and raise one. Without
    alerts it is not called. What it returns says whether they were sent.
    """
    total = alerts.count()
    rows = [r.asDict() for r in at_least_severe(alerts, severity, least).limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} alerts at once")
    sent = bool(rows) and bool(poster(rows))
    return {"sent": sent, "n_sent": len(rows) if sent else 0, "n_total": total, "skipped": total - len(rows)}


def reordered(queue: DataFrame, key: str, place: str, wanted: list[str]) -> DataFrame:
    """The queue with the wanted keys first, in that order, the others in the old one (the list is written by hand)."""
    at = F.array_position(F.array(*[F.lit(w) for w in wanted]), F.col(key)) if wanted else F.lit(0)
    front = F.when(at > 0, at)
    w = Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last(front), place, key)  # a queue of requests
    return queue.withColumn("new_place", F.row_number().over(w))


def conditions_hold(df: DataFrame, conditions: list[tuple[str, str, float]]) -> DataFrame:
    """Rows for which all (column, operator, number) conditions hold; unknown columns and nulls pass, as the rules fail open."""
    ops = {"<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__, "==": Column.__eq__, "!=": Column.__ne__}
    for name, op, number in conditions:
        if name in df.columns and op in ops:
            df = df.where(F.coalesce(ops[op](F.col(name).try_cast("double"), F.lit(number)), F.lit(True)))
    return df


def mean_correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """``pairs, mean_corr`` of all pairs of columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    values = F.array(*[F.col(f"c{i}") for i in range(len(pairs))])
    return row.select(F.lit(len(pairs)).alias("pairs"), F.aggregate(values, F.lit(0.0), lambda s, x: s + x / len(pairs)).alias("mean_corr"))
