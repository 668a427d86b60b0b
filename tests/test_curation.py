"""Curation operators: order-dependent ones against a plain loop, random ones by what must hold."""

import numpy as np
from pyspark.sql import functions as F

from shardloom.operators import curation as C


def test_near_duplicates_against_a_loop(spark):
    rng = np.random.default_rng(11)
    base = rng.standard_normal((30, 6))
    x = np.concatenate([base, base[rng.integers(0, 30, 90)] + 0.12 * rng.standard_normal((90, 6))]).astype("f4")
    u = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1, keepdims=True)
    s = (u @ u.T).round(9)
    kept = list(range(15))
    want = {}
    for i in range(15, 120):
        near = [j for j in kept if s[i, j] >= 0.97]
        if near:
            want[str(i)] = max(near, key=lambda j: (s[i, j], str(j)))
        else:
            kept.append(i)
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(120)] + [(500, None)], "id bigint, v array<float>").withColumn("o", F.col("id"))
    got = {r.id: r.of for r in C.near_duplicates(df.where("id >= 15"), df.where("id < 15"), "id", "v", "o", 0.97, block=40).collect()}
    assert got == {k: str(v) for k, v in want.items()}
    many = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(300)] + [(900, [2.0, -1.0])], "id bigint, v array<float>").withColumn("o", F.col("id"))
    got = C.near_duplicates(many, many.limit(0), "id", "v", "o").collect()
    assert len(got) == 299 and {r.of for r in got} == {"0"}
    assert C.near_duplicates(df.limit(0), df, "id", "v", "o").count() == 0


def test_weighted_decisions(spark):
    w = spark.createDataFrame([("default", 0.5, 0.5, 0.5), ("a", 1.0, 0.0, 0.9)], "g string, w_x double, w_y double, threshold double")
    s = spark.createDataFrame([("a", 0.8, 1.0), ("b", 0.8, None), ("b", None, None), (None, 0.2, 0.2)], "g string, x double, y double")
    got = sorted((str(r.g), r.combined is None or round(r.combined, 3), r.decision) for r in C.weighted_decisions(s, w, "g", ["x", "y"]).collect())
    assert got == [("None", 0.2, "discard"), ("a", 0.8, "discard"), ("b", 0.8, "keep"), ("b", True, "discard")]


def test_holdout_conditions_and_severity(spark):
    df = spark.createDataFrame([("a", "1"), ("b", "x"), (None, "9")], "g string, v string")
    assert {r.g for r in C.rotating_holdout(df, "g", 1).collect()} == {"a", None}
    assert C.rotating_holdout(df.where("g = 'a'"), "g", 0).count() == 1
    assert {r.v for r in C.conditions_hold(df, [("v", ">", 5.0), ("none", "<", 0.0)]).collect()} == {"x", "9"}
    sev = spark.createDataFrame([("ERROR",), ("info",), ("odd",), (None,)], "s string")
    assert [r.s for r in C.at_least_severe(sev, "s", "warning").collect()] == ["ERROR"]


def test_alerts_are_handed_over(spark):
    a = spark.createDataFrame([("x", "critical"), ("y", "info"), ("z", "warning")], "name string, severity string")
    got: list = []
    assert C.send_alerts(a, lambda rows: got.extend(rows) or True) == {"sent": True, "n_sent": 2, "n_total": 3, "skipped": 1}
    assert sorted(r["name"] for r in got) == ["x", "z"]
    assert C.send_alerts(a.limit(0), lambda rows: 1 / 0)["sent"] is False
    assert C.send_alerts(a, lambda rows: False)["n_sent"] == 0
