"""Core operators on small hand-made tables: nulls, ties, repeats, empties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardloom.functions import numeric as N
from shardloom.functions import text as T
from shardloom.functions.vector import pack_nibbles, unpack_nibbles
from shardloom.io import latest_rows
from shardloom.operators import attribution as A
from shardloom.operators import filters as FI
from shardloom.operators import ranking as R
from shardloom.operators import series as S
from shardloom.operators import similarity as SI
from shardloom.operators.components import components
from shardloom.operators.skyline import front_mask, pareto_front


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_latest_rows(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("a", 2, 7), ("b", None, 1), (None, 3, 3)], "k string, at int, v int")
    assert rows(latest_rows(df, "k", "at")) == [("a", 2, 7), ("b", None, 1)]
    assert rows(latest_rows(df.limit(0), "k", "at")) == []


def test_global_rank_matches_a_sort(spark):
    rng = np.random.default_rng(3)
    vals = [float(v) for v in rng.integers(0, 40, 500)]
    df = spark.createDataFrame([(f"{i:04d}", v) for i, v in enumerate(vals)] + [("none", None)], "id string, v double")
    got = {r.id: r["rank"] for r in R.global_rank(df, F.col("v"), "id").collect()}
    order = sorted(range(500), key=lambda i: (-vals[i], i))
    assert [got[f"{i:04d}"] for i in order] == list(range(1, 501)) and got["none"] is None


def test_slices_are_a_partition(spark):
    df = spark.range(300).select(F.col("id").cast("string").alias("id"), (F.col("id") % 2).alias("g"))
    parts = [{r.id for r in R.seeded_slice(df, "g", "id", i, 4).collect()} for i in (1, 2, 3, 4)]
    assert sum(map(len, parts)) == 300 and len(set().union(*parts)) == 300


def test_weighted_sample(spark):
    df = spark.range(100).select("id", F.when(F.col("id") < 50, 0.0).otherwise(1.0).alias("w"))
    got = [r.id for r in R.weighted_sample(df, "id", F.col("w"), 20).collect()]
    assert len(got) == 20 and min(got) >= 50


def test_captions(spark):
    cases = [("a b c d e", True), ("a b c d", False), (None, False), ("  ", False), ("http a b c d", False), ("one two three four x.JPG", True), ("one two three four x.jpg  ", False)]
    df = spark.createDataFrame(cases, "t string, want boolean")
    assert all(r.got == r.want for r in df.select("want", T.caption_valid(F.col("t")).alias("got")).collect())
    q = df.select("t", T.caption_quality(F.col("t")).alias("q")).collect()
    assert {r.t: round(r.q, 3) for r in q}["a b c d"] == 0.1 and {r.t: r.q for r in q}[None] == 0.0


def test_drop_reason_order(spark):
    df = spark.createDataFrame([("x", 10, 10), ("a b c d e", 10, 900), ("a b c d e", None, 900), ("a b c d e", 900, 900)], "c string, w int, h int")
    assert [r[0] for r in df.select(FI.drop_reason(F.col("c"), F.col("w"), F.col("h"))).collect()] == ["caption", "size", "size", None]


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, o int, v string")
    new = spark.createDataFrame([("b", 5, "z"), ("b", 4, "w"), ("c", 1, "q"), (None, 1, "n")], "k string, o int, v string")
    assert rows(FI.insert_or_ignore(new, "k", "o", old)) == [("c", 1, "q")]
    assert rows(FI.insert_or_replace(old, new, "k", "o")) == [("a", 1, "x"), ("b", 5, "z"), ("c", 1, "q")]
    o = spark.createDataFrame([("a", "maps", 5), ("b", "art", 7)], "k string, source string, n_images int")
    n = spark.createDataFrame([("a", "unknown", 9), ("b", "new", 0), ("c", "unknown", -1)], "k string, source string, n_images int")
    assert rows(FI.conditional_upsert(o, n, "k")) == [("a", "maps", 9), ("b", "new", 7), ("c", "unknown", -1)]


def test_pack_is_whole(spark):
    got = FI.pack(spark.range(1234), "id", 100).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("slot").alias("s")).collect()
    assert sorted(r.n for r in got) == [34] + [100] * 12 and all(r.n == r.s for r in got)


def test_running_fold_keeps_nulls(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 4.0), ("a", 3, None), ("a", 4, 8.0), ("b", 1, None)], "k string, i int, v double")
    assert rows(A.running_fold(df, ["k"], ["i"], "v")) == [("a", 4, 5.0), ("b", 1, None)]


def test_attribution_needs_both_roles(spark):
    log = [("c1", "s", "x", r, v) for r, v in (("included", 0.5), ("included", 0.7), ("excluded", 0.1), ("excluded", 0.3))] + [("c1", "s", "y", "included", 0.9)]
    df = spark.createDataFrame(log, "campaign string, source string, shard string, role string, v double")
    r = A.attribution_by_source(df, "v").first()
    assert (r.shards, r.attribution, r.trusted) == (1, 0.4, 0)


def test_series(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 3.0, 2.0, None, 3.0, 2.5])] + [("b", 0, None)], "k string, i int, v double")
    assert rows(S.since_best(df, ["k"], ["i"], "v")) == [("a", 3.0, 3)]
    assert rows(S.early_stop(df, ["k"], ["i"], "v", 2)) == [("a", 4)]
    assert [r.delta for r in S.delta_to_previous(df, ["k"], ["i"], "v").orderBy("k", "i").collect()] == [None, 2.0, -1.0, None, 1.0, -0.5, None]
    t = {r.k: r.slope for r in S.trend_summary(df.where("k = 'b' OR i < 3"), ["k"], ["i"], "v").collect()}
    assert t == {"a": 0.5, "b": 0.0}


def test_as_of_is_strict(spark):
    left = spark.createDataFrame([("u", 5), ("u", 7), ("u", 1), ("w", 5)], "u string, at int")
    right = spark.createDataFrame([("u", 5, 50), ("u", 2, 20)], "u string, at int, v int")
    assert rows(S.as_of(left, right, ["u"], "at", "at", "v", "got")) == [("u", 1, None), ("u", 5, 20), ("u", 7, 50), ("w", 5, None)]


def test_percentiles(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],), ([],)], "v array<double>")
    assert [r[0] for r in df.select(N.index_percentile(F.col("v"), 0.25)).collect()] == [2.0, None]


def test_components_against_union_find(spark):
    rng = np.random.default_rng(1)
    e = [(f"{a:03d}", f"{b:03d}") for a, b in rng.integers(0, 200, (150, 2))] + [(f"{i:03d}", f"{i + 1:03d}") for i in range(300, 340)] + [(None, "001")]
    root: dict = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in e:
        if a is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(e, "a string, b string")).collect()}
    assert got == {n: find(n) for n in root}


def test_threshold_classes_and_search(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((120, 8)).astype("f4")
    x[50:55] = x[49]
    data = [(i, x[i].tolist()) for i in range(120)] + [(500, None), (501, [0.0] * 8), (502, [float("nan")] * 8)]
    df = spark.createDataFrame(data, "id bigint, v array<float>")
    u = x.astype("f8") / np.linalg.norm(x, axis=1, keepdims=True)
    s = (u @ u.T).round(9)
    np.fill_diagonal(s, -2)
    got = {r.id: (r["class"], r.links) for r in SI.threshold_classes(df, "id", "v", 0.8, block=50).collect()}
    assert set(got) == {str(i) for i in range(120)} and all(got[str(i)][1] == (s[i] >= 0.8).sum() for i in range(120))
    near = SI.search(df.where("id % 10 = 0"), df, "id", "v", 4).collect()
    for i in range(0, 120, 10):
        want = sorted(range(120), key=lambda j: (-s[i, j], j))[:4]
        assert [r.other for r in sorted((r for r in near if r.id == i), key=lambda r: r.place)] == want


def test_pareto_against_brute_force(spark):
    rng = np.random.default_rng(4)
    p = rng.integers(0, 12, (200, 3))
    dominated = ((p[:, None] >= p[None]).all(2) & (p[:, None] > p[None]).any(2)).any(0)
    assert (front_mask(p.astype("f8")) == ~dominated).all()
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)] + [(900, None, 99.0, 99.0)], "id int, a double, b double, c double").repartition(3)
    assert {r.id for r in pareto_front(df, "id", ["a", "b", "c"]).collect()} == set(np.flatnonzero(~dominated).tolist())


def test_nibbles_round_trip(spark):
    v = [[1.0, -7.0, 3.5, 0.0], [0.0, 0.0], None]
    df = spark.createDataFrame([(x,) for x in v], "v array<float>").select("v", pack_nibbles("v").alias("p"))
    got = [r.u for r in df.select(unpack_nibbles("p.packed", "p.scale").alias("u")).collect()]
    assert got[2] is None and np.allclose(got[0], v[0], atol=0.5) and list(got[1]) == [0.0, 0.0]


@pytest.mark.parametrize("k", [1, 3])
def test_farthest_points(spark, k):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [-1.0, 0.0])], "id string, v array<float>")
    got = [r.id for r in SI.farthest_points(df, "id", "v", k).orderBy("place").collect()]
    assert got == ["a", "c", "b"][:k]


def test_composite_and_effective_by_hand(spark):
    df = spark.createDataFrame([(0.1, 0.2, 1.2), (None, 0.2, None), (None, None, None), (0.9, -0.9, 9.0)], "r double, c double, l double")
    got = [x and round(x, 6) for (x,) in df.select(A.composite(F.col("r"), F.col("c"), F.col("l"))).collect()]
    # 0.6 * 0.20 + 0.7 * 0.65 + (1 - 0.9 / 2.7) * 0.15; 0.7 alone; nothing; 1 * 0.20 + 0 + 0
    assert got == [0.675, 0.7, None, 0.2]
    e = spark.createDataFrame([(0.5, 0.5, 0.4, 25, 3.0), (0.5, 0.0, 0.4, 0, None), (0.5, 1.0, None, None, 9.0), (0.9, 1.0, 0.5, 100, 1.0), (None, 1.0, 0.5, 1, 1.0)], "raw double, conf double, attr double, hard int, p95 double")
    got = [x and round(x, 6) for (x,) in e.select(A.effective(F.col("raw"), F.col("conf"), F.col("attr"), F.col("hard"), F.col("p95"))).collect()]
    # 0.7 + 0.025 - 0.025; no confidence; no attribution and the whole malus; the bonus goes no further than 1
    assert got == [0.7, 0.5, 0.45, 1.0, None]


def test_caption_quality_by_hand(spark):
    words = "one two three four five six seven eight nine ten"
    cases = {words: 0.6, words + " photo.TIFF": 0.4 * 11 / 20 + 0.4 - 0.3, words + " photo.bmp,": 0.4 * 11 / 20 + 0.4, "http " + words: 0.4 * 11 / 20 + 0.4 - 0.4, " http " + words: 0.4 * 11 / 20 + 0.4, "a b c d": 0.1, "": 0.0}
    df = spark.createDataFrame(list(cases.items()), "t string, want double")
    assert all(abs(r.q - max(0, r.want)) < 1e-9 for r in df.select("want", T.caption_quality(F.col("t")).alias("q")).collect())


def test_global_rank_may_name_its_columns_as_it_likes(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 7.0), (3, None)], "id long, v double")
    assert rows(R.global_rank(df, F.col("v"), "id", "__p", "__t").select("id", "__p", "__t")) == [(1, 2, 2), (2, 1, 2), (3, None, None)]
    assert rows(R.global_rank(df, F.col("v"), "id", "__k", "__b").select("id", "__k", "__b")) == [(1, 2, 2), (2, 1, 2), (3, None, None)]


def test_pack_in_order_counts_a_null_key_last(spark):
    low = -(1 << 63)
    df = spark.createDataFrame([(k,) for k in [5, None, low, 9, -2, 7, 0]], "id long")
    got = {r.id: (r.bin, r.slot) for r in FI.pack_in_order(df, "id", 3).collect()}
    assert got == {low: (0, 0), -2: (0, 1), 0: (0, 2), 5: (1, 0), 7: (1, 1), 9: (1, 2), None: (2, 0)}
    assert FI.pack_in_order(df.limit(0), "id", 3).count() == 0


def test_global_rank_splits_ties(spark):
    df = spark.range(20_000).select(F.format_string("%06d", F.col("id")).alias("id"), F.when(F.col("id") % 3 > 0, 1.0).otherwise(F.col("id") * 1e6).alias("v"))
    got = R.global_rank(df, F.col("v"), "id").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 20_001)) and [(-r.v, r.id) for r in got] == sorted((-r.v, r.id) for r in got)
    assert R.global_rank(df.limit(0), F.col("v"), "id").count() == 0


def test_with_replacement(spark):
    main, few = spark.range(70), spark.range(1000, 1003)
    got = [tuple(r) for r in R.with_replacement(main, {"few": (few, 0.3), "none": (few.limit(0), 0.1)}, "id").collect()]
    assert sum(p == "main" for _, p in got) == 70 and sum(p == "few" for _, p in got) == 35 and not any(p == "none" for _, p in got)
    with pytest.raises(ValueError):
        R.with_replacement(main, {"few": (few, 1.0)}, "id")


def test_group_rank_with_a_hot_group(spark):
    df = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"), (F.col("id") % 11).alias("v"))
    got = R.group_rank(df, ["g"], [F.desc("v"), F.asc("id")]).collect()
    want: dict = {}
    for r in sorted(got, key=lambda r: (-r.v, r.id)):
        want.setdefault(r.g, []).append(r.id)
    assert len(got) == 9000 and all(want[r.g][r["rank"] - 1] == r.id and r.total == len(want[r.g]) for r in got)
    per = {r.g: (r.n, r.mid) for r in R.group_index_values(df, "g", "v", {"mid": 0.5}).collect()}
    vals = {g: sorted(i % 11 for i in ids) for g, ids in want.items()}
    assert per == {g: (len(v), v[len(v) // 2]) for g, v in vals.items()}
