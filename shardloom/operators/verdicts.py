"""Rules that judge runs: quality gates, verdicts, stops and alarms, as expressions and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quality_gate(current: DataFrame, previous: DataFrame, by: list[str], metric: str = "metric", value: str = "value", lower_better: tuple[str, ...] = ("lpips", "fid"), neutral: float = 0.01) -> DataFrame:
    """``by..., metric, change, status``: every current metric against the previous run's.

    The change is relative to the previous value (1 where that is 0). Up to
    ``neutral`` it is neutral, else improved or regressed by the metric's
    direction; no_baseline where either value is missing.
    """
    old = previous.select(*by, metric, F.col(value).alias("__p"))
    delta = F.col(value) - F.col("__p")
    size = F.abs(delta) / F.when(F.col("__p") == 0, 1.0).otherwise(F.abs("__p"))
    better = F.when(F.col(metric).isin(*lower_better), delta < 0).otherwise(delta > 0)
    status = F.when(delta.isNull(), "no_baseline").when(size <= neutral, "neutral").when(better, "improved").otherwise("regressed")
    return current.join(old, [*by, metric], "left").select(*by, metric, size.alias("change"), status.alias("status"))


def gate_verdict(gated: DataFrame, by: list[str]) -> DataFrame:
    """``by..., verdict``: REGRESSION before IMPROVED before NEUTRAL; NO_BASELINE if nothing could be compared."""
    some = lambda s: F.bool_or(F.col("status") == s)
    verdict = F.when(F.every(F.col("status") == "no_baseline"), "NO_BASELINE").when(some("regressed"), "REGRESSION").when(some("improved"), "IMPROVED").otherwise("NEUTRAL")
    return gated.groupBy(*by).agg(verdict.alias("verdict"))


#: Means above which a validation passes, or at least warns.
PASS_CLIP, PASS_DELTA, WARN_CLIP, WARN_DELTA = 0.20, 0.05, 0.15, 0.0


def validation_verdict(pairs: DataFrame, by: list[str], clip: str = "clip_i", delta: str = "adapter_delta", text: str = "clip_t", broken: str | None = None) -> DataFrame:
    """``by..., verdict, mean_clip_i, mean_adapter_delta, mean_clip_t, n_pairs`` over image pairs.

    Without any image score it is WARN and only the text score counts; a
    missing delta passes; a true ``broken`` in any row fails.
    """
    g = pairs.groupBy(*by).agg(
        F.avg(clip).alias("c"), F.avg(delta).alias("d"), F.avg(text).alias("t"), F.count(F.lit(1)).alias("n_pairs"), (F.bool_or(broken) if broken else F.lit(False)).alias("b")
    )
    over = lambda c, d: (F.col("c") > c) & (F.col("d").isNull() | (F.col("d") > d))
    verdict = F.when(F.coalesce("b", F.lit(False)), "FAIL").when(F.col("c").isNull(), "WARN").when(over(PASS_CLIP, PASS_DELTA), "PASS").when(over(WARN_CLIP, WARN_DELTA), "WARN").otherwise("FAIL")
    known = F.col("c").isNotNull()
    return g.select(*by, verdict.alias("verdict"), F.round("c", 4).alias("mean_clip_i"), F.when(known, F.round("d", 4)).alias("mean_adapter_delta"), F.when(~known, F.round("t", 4)).alias("mean_clip_t"), "n_pairs")


#: Exit code of a run that was stopped for time, and the last loss from which a run is unstable.
TIMED_OUT, UNSTABLE_LOSS = -3, 5.0


def run_verdicts(runs: DataFrame, snapshots: DataFrame, key: str, order: str, exit_code: str = "exit_code", ref: str = "ref_gap", cond: str = "cond_gap", loss: str = "loss_smooth") -> DataFrame:
    """``key, verdict, score`` of every run from its exit code and the last three fifths of its snapshots.

    TIMEOUT, CRASH (another exit code), NO_DATA, UNSTABLE (last loss above 5),
    PASS if more than half of the reference gaps and of the conditioning gaps
    are above 0, else WARN. The score is 100 ref + 200 cond - 3 last loss, with
    0 for missing gaps and 9.9 for a missing loss; -infinity for a run that
    failed or has no snapshot.
    """
    w = Window.partitionBy(key)
    placed = snapshots.withColumn("__i", F.row_number().over(w.orderBy(order)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    tail = placed.where(F.col("__i") >= F.floor(F.col("__n") * 2 / 5))
    above = lambda c: F.count_if(F.col(c) > 0) > F.count(c) * 0.5
    g = tail.groupBy(key).agg(
        above(ref).alias("r"),
        above(cond).alias("c"),
        F.coalesce(F.avg(ref), F.lit(0.0)).alias("mr"),
        F.coalesce(F.avg(cond), F.lit(0.0)).alias("mc"),
        F.coalesce(F.max_by(loss, F.when(F.col(loss).isNotNull(), F.col("__i"))), F.lit(9.9)).alias("fl"),
        F.max_by(F.coalesce(loss, F.lit(0.0)), "__i").alias("ll"),
        F.lit(True).alias("some"),
    )
    j = runs.select(key, F.col(exit_code).alias("__e")).join(g, key, "left")
    verdict = (
        F.when(F.col("__e") == TIMED_OUT, "TIMEOUT").when(F.col("__e") != 0, "CRASH").when(F.col("some").isNull(), "NO_DATA")
        .when(F.col("ll") > UNSTABLE_LOSS, "UNSTABLE").when(F.col("r") & F.col("c"), "PASS").otherwise("WARN")
    )
    score = F.when((F.col("__e") != 0) | F.col("some").isNull(), F.lit(float("-inf"))).otherwise(100.0 * F.col("mr") + 200.0 * F.col("mc") - 3.0 * F.col("fl"))
    return j.select(key, verdict.alias("verdict"), score.alias("score"))


def early_stops(
    snapshots: DataFrame,
    by: list[str],
    order: list[str],
    min_cond_gap: float,
    patience: int,
    warmup: int,
    loss_limit: float = 5.0,
    grad_limit: float | None = None,
    ref_gap_min: float | None = None,
    ref_patience: int | None = None,
    grad_patience: int = 3,
) -> DataFrame:
    """``by..., stop_at, reason``: the first snapshot (from 1) at which one of four signals stops the run; null if none does.

    ``loss``: above its limit, at once. ``grad_norm``: above its limit in
    ``grad_patience`` snapshots running. After ``warmup`` snapshots:
    ``cond_gap`` and ``ref_gap`` below their floors for as long as their
    patience. A snapshot without a value neither adds to a signal's streak nor
    ends it. Of signals of one snapshot the first in this order counts. Columns
    are loss, grad_norm, cond_gap and ref_gap.
    """
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = snapshots.withColumn("__i", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    late = F.col("__i") > warmup
    signals: list[tuple[str, Column, Column, int]] = []
    if grad_limit is not None:
        signals.append(("grad_norm", F.col("grad_norm").isNotNull(), F.col("grad_norm") > grad_limit, grad_patience))
    signals.append(("cond_gap", late & F.col("cond_gap").isNotNull(), F.col("cond_gap") < min_cond_gap, patience))
    if ref_gap_min is not None:
        signals.append(("ref_gap", late & F.col("ref_gap").isNotNull(), F.col("ref_gap") < ref_gap_min, ref_patience if ref_patience is not None else patience))
    fired = F.when(F.col("loss") > loss_limit, "loss")
    for name, counts, bad, needed in signals:
        # how many snapshots counted so far, and how many had when the last good one came
        rows = rows.withColumn(f"__c_{name}", F.sum(counts.cast("int")).over(w))
        rows = rows.withColumn(f"__g_{name}", F.max(F.when(counts & ~bad, F.col(f"__c_{name}"))).over(w))
        fired = fired.when(counts & bad & (F.col(f"__c_{name}") - F.coalesce(f"__g_{name}", F.lit(0)) >= needed), name)
    hit = rows.withColumn("__f", fired)
    first = F.min(F.when(F.col("__f").isNotNull(), F.struct("__i", "__f")))
    return hit.groupBy(*by).agg(first.alias("h")).select(*by, F.col("h.__i").alias("stop_at"), F.col("h.__f").alias("reason"))


def campaign_plateau(runs: DataFrame, by: list[str], order: list[str], score: str, patience: int, min_delta: float = 0.01, min_runs: int = 5) -> DataFrame:
    """``by..., plateau_at``: the run (from 1) at which ``patience`` runs with a score had brought no gain above ``min_delta``; null if never.

    Runs without a score count towards ``min_runs`` only and raise no alarm
    themselves. The best moves with counted gains only, so this is a fold over
    a group's scores, eight bytes a run.
    """
    start = F.struct(F.lit(None).cast("double").alias("best"), F.lit(0).alias("stale"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("at"))

    def step(s: Column, x: Column) -> Column:
        v, n = x["v"], s["n"] + 1
        better = v.isNotNull() & (s["best"].isNull() | (v > s["best"] + min_delta))
        stale = F.when(v.isNull(), s["stale"]).when(better, F.lit(0)).otherwise(s["stale"] + 1)
        at = F.when(s["at"].isNotNull(), s["at"]).when(v.isNotNull() & (n >= min_runs) & (stale >= patience), n)
        return F.struct(F.when(better, v).otherwise(s["best"]).alias("best"), stale.alias("stale"), n.alias("n"), at.alias("at"))

    folded = runs.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(score).cast("double").alias("v")))).alias("o"))
    return folded.select(*by, F.aggregate("o", start, step)["at"].alias("plateau_at"))


#: Limits of the alarms on a trainer's state.
LIMITS = {"loss": 2.0, "grad_pause": 50.0, "grad_warn": 10.0, "coverage": 90.0, "gap_pct": 1.0, "scale": 0.05, "inversion": 0.01, "wait": 20.0, "wait_warn": 40.0, "learning_step": 1000, "scale_step": 500}


def trainer_alarms(states: DataFrame, key: str, with_coverage: bool = True, limits: dict[str, float] | None = None) -> DataFrame:
    """``key, alarm, severity`` for every rule a trainer's state breaks.

    Columns: step, loss, grad_norm_smooth, siglip_coverage_pct, loss_cond,
    loss_null, ip_scale_mean, loss_self_ref, loss_cross_ref, loader_wait_pct; a
    missing column or value breaks no rule. The stronger of the two gradient
    rules counts; some rules wait for a step.
    """
    m = LIMITS | (limits or {})
    c = lambda name: F.col(name) if name in states.columns else F.lit(None).cast("double")
    step = F.coalesce(c("step"), F.lit(0))
    learned = 100 * (c("loss_null") - c("loss_cond")) / F.nullif(c("loss_null"), F.lit(0.0))
    rules: list[tuple[str, Column, Column]] = [
        ("loss_high", c("loss") > m["loss"], F.lit("WARNING")),
        ("gradient_pause", c("grad_norm_smooth") > m["grad_pause"], F.lit("WARNING")),
        ("gradient_high", (c("grad_norm_smooth") > m["grad_warn"]) & (c("grad_norm_smooth") <= m["grad_pause"]), F.lit("INFO")),
        ("coverage_low", F.lit(with_coverage) & (c("siglip_coverage_pct") < m["coverage"]), F.lit("WARNING")),
        ("not_learning", (step > m["learning_step"]) & (c("loss_null") > 0) & (learned < m["gap_pct"]), F.lit("WARNING")),
        ("scale_collapsed", (step > m["scale_step"]) & (c("ip_scale_mean") < m["scale"]), F.lit("WARNING")),
        ("references_inverted", (step > m["learning_step"]) & (c("loss_cross_ref") < c("loss_self_ref") - m["inversion"]), F.lit("WARNING")),
        ("loader_slow", c("loader_wait_pct") > m["wait"], F.when(c("loader_wait_pct") > m["wait_warn"], "WARNING").otherwise("INFO")),
    ]
    hits = F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(name).alias("alarm"), severity.alias("severity"))) for name, broken, severity in rules])
    return states.select(key, F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("x")).select(key, "x.alarm", "x.severity")


def worse_than(summaries: DataFrame, key: str, a: str, b: str, metrics: list[str]) -> DataFrame:
    """``metric, a, b`` for the metrics (greater is better) on which row ``b`` falls below row ``a``; missing values are left out."""
    long = summaries.where(F.col(key).isin(a, b)).unpivot([key], metrics, "metric", "value")
    wide = long.groupBy("metric").agg(F.max(F.when(F.col(key) == a, F.col("value"))).alias("a"), F.max(F.when(F.col(key) == b, F.col("value"))).alias("b"))
    return wide.where("b < a")


def time_left(eta: str, remaining: str, per_iteration: str, iteration: str, iterations: str) -> Column:
    """Seconds until a campaign ends: what this iteration still takes, and the same pace for all that follow; null where nothing can be said."""
    pace = F.try_divide(F.col(eta), F.col(remaining))
    later = F.col(iterations) - F.col(iteration)
    return F.when((F.col(remaining) > 0) & (later >= 0), F.col(eta) + pace * F.col(per_iteration) * later)


def retry_policy(reason: Column, restarts: Column, memory_retries: int = 3, memory_delay: int = 120) -> Column:
    """``retry, most, delay``: what ended for want of memory is tried again several times after a pause, anything else once."""
    memory = F.coalesce(reason == "jetsam_oom", F.lit(False))
    most = F.when(memory, F.lit(memory_retries)).otherwise(F.lit(1))
    return F.struct((restarts < most).alias("retry"), most.alias("most"), F.when(memory, F.lit(memory_delay)).otherwise(F.lit(0)).alias("delay"))

