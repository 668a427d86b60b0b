"""Comparisons, rules, versions and picks on small tables."""

import numpy as np
from pyspark.sql import functions as F

from shardloom.operators import comparison as C
from shardloom.operators import similarity as SI


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_compare_pair(spark):
    r = spark.createDataFrame([("a", 1.0, 2.0, None), ("b", 2.0, 2.0, 1.0), ("c", 9.0, 9.0, 9.0)], "arm string, x double, loss double, z double")
    got = {x.metric: (x.delta, x.winner) for x in C.compare_pair(r, "a", "b", ["x", "loss", "z"], lower_better=("loss",)).collect()}
    assert got == {"x": (1.0, "b"), "loss": (0.0, "tie"), "z": (None, None)}


def test_rules_versions_and_unions(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 50)], "id int, v int")
    assert rows(C.fired_rules(df, "id", {"big": F.col("v") > 10, "set": F.col("v").isNotNull()})) == [(1, "set"), (3, "big"), (3, "set")]
    v = spark.createDataFrame([("g", "v1", True, True, 0, 9), ("g", "v2", False, True, 5, 2), ("g", "v3", False, True, 5, 1), ("h", "v9", False, False, 5, 1)], "g string, v string, cur boolean, done boolean, n int, made int")
    assert rows(C.resolve_version(v, "g", "v", "cur", "done", "n", "made")) == [("g", "v1"), ("h", "flat")]
    one, two = spark.createDataFrame([("a", 1)], "k string, x int"), spark.createDataFrame([("a", 2), ("b", 3), (None, 4)], "k string, x int")
    assert rows(C.first_source_wins([one, two], "k")) == [("a", 0, 1), ("b", 1, 3)]
    assert C.parameter_grid(one, {"p": [1, 2], "q": ["x", "y", "z"]}).count() == 6


def test_ties_of_copies_come_by_key(spark):
    data = [(i, [1.0, 0.0]) for i in range(40)] + [(99, [0.0, 1.0])]
    df = spark.createDataFrame(data, "id bigint, v array<float>").repartition(3)
    got = SI.search(df.where("id = 5"), df, "id", "v", 4).orderBy("place").collect()
    assert [r.other for r in got] == [0, 1, 2, 3]


def test_separated_groups():
    c = [("a", 0.9, np.array([1.0, 0.0])), ("b", 0.8, np.array([0.9, 0.43])), ("c", 0.7, np.array([0.0, 1.0]))]
    assert C.separated_groups(c, 0.5, 5) == ["a", "c"] and C.separated_groups(c, 0.99, 2) == ["a", "b"]
