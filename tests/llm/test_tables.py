"""Algorithms over shards, vectors and images against brute force."""

import collections
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardloom.llm import captions as C
from shardloom.llm import p02_diverse as D
from shardloom.llm import p03_mixture as M
from shardloom.llm import p04_clusters as CL
from shardloom.llm import p05_neighbours as NB
from shardloom.llm import p06_cutoff as CU
from shardloom.llm import p07_incremental as I
from shardloom.llm.vectors import usable_vectors


def test_greedy_determinant_equals_exhaustive_gain():
    rng = np.random.default_rng(1)
    x = rng.random((30, 2))
    k = np.exp(-np.abs(x[:, None] - x[None]).sum(2) / 0.3)
    picked, gains = D.greedy_determinant(lambda j: k[j], np.ones(30), 6)
    chosen: list[int] = []
    for _ in range(6):
        best = max((i for i in range(30) if i not in chosen), key=lambda i: np.linalg.slogdet(k[np.ix_(chosen + [i], chosen + [i])])[1])
        chosen.append(best)
    assert picked == chosen
    assert math.isclose(np.prod(gains), np.linalg.det(k[np.ix_(chosen, chosen)]), rel_tol=1e-9)


def test_like_groups_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.random((40, 4)).round(6)
    rows = [(f"{i:04d}", "s" if i % 3 else None, *[float(v) for v in base[i]]) for i in range(40)]
    for i in range(40, 160):
        j = int(rng.integers(0, 40))
        rows.append((f"{i:04d}", "s", *[float(round(v, 6)) for v in base[j] + rng.integers(-2, 3, 4) * 0.00005]))
    rows += [("9000", "s", None, 0.1, 0.1, 0.1), ("9001", "s", float("nan"), 0.1, 0.1, 0.1)]
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame(rows, "k string, g string, a double, b double, c double, d double")
    got = {r.k: r.root for r in D.like_groups(df, "k", "g", names).collect()}
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in itertools.combinations(rows[:160], 2):
        if x[1] and x[1] == y[1] and all(abs(p - q) <= 1e-4 + 1e-9 for p, q in zip(x[2:], y[2:])):
            a, b = find(x[0]), find(y[0])
            root[max(a, b)] = min(a, b)
    assert got == {r[0]: find(r[0]) for r in rows}


def test_selection_covers(spark):
    rows = [(f"{i:05d}", "big", 0.5, 0.5, 0.5, 0.5) for i in range(900)] + [(f"x{i}", f"s{i % 5}", i / 50, 0.1, 0.1, i / 50) for i in range(50)] + [("none", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "shard_id string, source_key string, diversity_score double, light_score double, aesthetic_avg double, caption_quality double")
    chosen, groups = D.select_diverse(df, size=20)
    got = chosen.collect()
    assert len(got) == 20 and {f"s{i}" for i in range(5)} | {"big"} <= {r.source_key for r in got} and sum(r.source_key == "big" for r in got) == 1
    assert groups.where("root != shard_id").count() == 899
    assert D.select_diverse(df.limit(0), size=5)[0].count() == 0


def test_quotas():
    q = M.image_quotas({"a": 100, "b": 10, "c": 0}, {"a": 50, "b": 30, "c": 20}, {"a": 1, "b": 2, "c": 5}, 100)
    assert q == {"a": 80, "b": 20, "c": 0}
    assert M.image_quotas({}, {}, {}, 10) == {}


def test_split_tree_is_a_partition():
    whole = list(M.split_tree([50, 7, 300], 9, 0, 9, 3))
    assert [sum(c[k] for _, _, c in whole) for k in range(3)] == [50, 7, 300]
    for k in range(3):
        at = 0
        for _, starts, counts in whole:
            assert starts[k] == at
            at += counts[k]
    assert [x for a in range(0, 9, 2) for x in M.split_tree([50, 7, 300], 9, a, min(9, a + 2), 3)] == whole


def test_mixture(spark):
    shards = spark.createDataFrame([(f"s{i}", "big" if i < 8 else "small", 100) for i in range(9)] + [("n", "big", None), ("m", "big", -5), ("o", "other", 100), ("u", None, 100)], "shard_id string, source_key string, n_images bigint")
    targets = spark.createDataFrame([("big", "Big", 60, 1), ("small", "Small", 30, 2), ("none", "None", 10, 9)], "source_key string, source string, target_pct int, max_repeats int")
    mix, report = M.mix_sources(shards, targets, block=30, out_shard=200)
    rep = {r.source: r for r in report.collect()}
    assert (rep["Big"].short, rep["Small"].short, rep["None"].short) == (False, True, True)
    rows = mix.collect()
    assert sum(r.n_images for r in rows) == 900 == sum(r.actual for r in rep.values())
    assert rep["Small"].actual == 200 and rep["Big"].actual == 700
    used = collections.Counter((r.shard_id, r.repeat_no, i) for r in rows for i in range(r.first_image, r.first_image + r.n_images))
    assert max(used.values()) == 1 and all(r.repeat_no < (1 if r.source_key == "big" else 2) for r in rows)
    assert all(sorted(x.slot for x in g) == list(range(len(list(g)))) for g in [[r for r in rows if r.out_shard == o] for o in {r.out_shard for r in rows}])
    assert M.mix_sources(shards.limit(0), targets)[0].count() == 0


def test_mix_of_more_images_than_an_int_holds_in_percent(spark):
    shards = spark.createDataFrame([("a", "big", 300_000_000), ("b", "small", 100_000_000)], "shard_id string, source_key string, n_images bigint")
    targets = spark.createDataFrame([("Big", "big", 60, 1), ("Small", "small", 40, 1)], "source string, source_key string, target_pct int, max_repeats int")
    for times in (1, 10):  # percent of a total that is an int, and of one that is not
        grown = shards.withColumn("n_images", F.col("n_images") * times)
        report = M.mix_sources(grown, targets, block=1_000_000 * times, out_shard=10_000_000 * times)[1]
        assert {(r.source, r.actual, r.short) for r in report.collect()} == {("Big", 300_000_000 * times, False), ("Small", 100_000_000 * times, True)}


def test_cutoffs(spark):
    rng = np.random.default_rng(5)
    rows = [("a", float(v) / 20) for v in rng.integers(0, 21, 300)] + [("b", 0.5)] * 7 + [("c", None), (None, 0.3)]
    df = spark.createDataFrame(rows, "source_key string, score double")
    targets = spark.createDataFrame([("a", 37), ("b", 10), ("c", 50), ("z", 20)], "source_key string, keep_pct int")
    got = {r.source_key: r for r in CU.score_cutoffs(df, targets).collect()}
    vals = [v for k, v in rows if k == "a"]
    want = max(t for t in set(vals) if sum(v >= t for v in vals) * 100 >= 37 * len(vals))
    assert got["a"].cutoff == want and got["a"].n_kept == sum(v >= want for v in vals)
    assert (got["b"].cutoff, got["b"].n_kept) == (0.5, 7) and got["c"].cutoff is None and got["z"].n_scored == 0


def _vectors(n_clusters, per, noise, seed, dim=64):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n_clusters, dim))
    x = np.concatenate([c + 0.45 * rng.standard_normal((per, dim)) for c in centres] + [rng.standard_normal((noise, dim))])
    return x * rng.uniform(0.5, 2, (len(x), 1))


@pytest.fixture(scope="module")
def table_of_vectors(spark):
    x = _vectors(6, 60, 15, 1).astype("f4")
    rows = [(f"r{i:04d}", x[i].tolist(), 1) for i in range(len(x))] + [("r0000", x[0].tolist(), 1), ("bad1", None, 1), ("bad2", [1.0] * 3, 1), ("bad3", [0.0] * 64, 1), ("bad4", [float("nan")] * 64, 1), (None, x[0].tolist(), 1)]
    return spark.createDataFrame(rows, "rec_id string, vec array<float>, encoded_at int"), x


def test_usable_vectors(table_of_vectors):
    df, x = table_of_vectors
    assert usable_vectors(df).count() == len(x)


def test_clusters(table_of_vectors):
    df, x = table_of_vectors
    got = {r.rec: r.cluster for r in CL.find_clusters(usable_vectors(df)).collect()}
    truth = [i // 60 for i in range(360)]
    groups = collections.defaultdict(set)
    for r, c in got.items():
        groups[c].add(truth[int(r[1:])] if int(r[1:]) < 360 else None)
    assert len(groups) == 6 and all(len(g) == 1 and None not in g for g in groups.values()) and len(got) >= 340
    assert CL.find_clusters(usable_vectors(df.limit(0))).count() == 0


def test_hilbert_index_is_a_walk():
    pts = np.array(list(itertools.product(range(8), repeat=2)))
    order = pts[np.argsort(NB.hilbert_index(pts, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all() and len(set(NB.hilbert_index(pts, 3))) == 64


@pytest.mark.parametrize("block", [12_000, 40])
def test_neighbours_against_brute_force(table_of_vectors, block):
    df, x = table_of_vectors
    u = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1, keepdims=True)
    s = (u @ u.T).round(9)
    np.fill_diagonal(s, -2)
    want = {f"r{i:04d}": {f"r{j:04d}" for j in sorted(range(len(x)), key=lambda j: (-s[i, j], j))[:5]} for i in range(len(x))}
    got = collections.defaultdict(set)
    for r in NB.top_neighbours(usable_vectors(df), window=50, block=block).collect():
        got[r.rec].add(r.other)
    assert sum(len(want[k] & got[k]) for k in want) / (5 * len(want)) >= 0.9


def test_neighbours_of_a_large_anchor_do_not_depend_on_its_size(spark):
    # three records whose other neighbours are 60 around another direction, fewer or more than a window has
    rng = np.random.default_rng(4)
    big, small = np.eye(64)[0], 0.6 * np.eye(64)[0] + 0.8 * np.eye(64)[1]
    x = np.concatenate([big + 0.02 * rng.standard_normal((60, 64)), small + 0.02 * rng.standard_normal((3, 64))]).astype("f4")
    u = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1, keepdims=True)
    s = (u @ u.T).round(9)
    np.fill_diagonal(s, -2)
    want = {(f"r{i:02d}", f"r{j:02d}") for i in range(63) for j in np.argsort(-s[i], kind="stable")[:5]}
    df = usable_vectors(spark.createDataFrame([(f"r{i:02d}", v.tolist(), 1) for i, v in enumerate(x)], "rec_id string, vec array<float>, encoded_at int"))
    for window in (100, 50):
        assert {(r.rec, r.other) for r in NB.top_neighbours(df, window=window).collect()} == want


@pytest.mark.parametrize("block", [12_000, 700])
def test_neighbours_of_copies(spark, block):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((5, 64))
    rows = [(f"c{i:05d}", (x[0] * (1 + i % 3)).astype("f4").tolist()) for i in range(2000)] + [(f"d{i}", (x[1 + i % 4] + 0.1 * rng.standard_normal(64)).astype("f4").tolist()) for i in range(40)]
    df = spark.createDataFrame([(k, v, 1) for k, v in rows], "rec_id string, vec array<float>, encoded_at int")
    got = collections.defaultdict(list)
    for r in NB.top_neighbours(usable_vectors(df), block=block, window=100).orderBy("rec", "place").collect():
        got[r.rec].append(r.other)
    first = [f"c{i:05d}" for i in range(6)]
    for k in ("c00000", "c00003", "c01999"):
        assert got[k] == [f for f in first if f != k][:5]


def test_addresses():
    same = ["https://www.A.example:443/x/../p/./q.JPG?b=2&a=1&utm_source=z#top", "http://a.example/p/%71.JPG?a=1&b=2", "//A.EXAMPLE/p//q.JPG?a=1&b=2&gclid=5"]
    assert len({C.resource(s) for s in same}) == 1
    assert len({C.resource(s) for s in ("http://a/p?page=1", "http://a/p?page=2", "http://a/P?page=1", "http://a:8080/p?page=1")}) == 4
    assert C.resource(None) is None and C.resource("  ") is None


BASE = "A striped loom painted grey stands in a glass-roofed hall at Nosendale, its handle bent to one side, in thick morning mist"


@pytest.mark.parametrize(
    "other, same",
    [
        (BASE.upper() + ".", True),
        ("[HD] " + BASE.replace("painted", "paintd") + " - stock photo", True),
        ("its handle bent to one side, in thick morning mist, A striped loom painted grey stands in a glass-roofed hall at Nosendale", True),
        (BASE[:80] + "...", True),
        ("<p>" + BASE.replace(" at ", " ").replace("ee", "éé") + "</p>", True),
        (BASE.replace("grey", "green"), False),
        (BASE.replace("loom", "kettle"), False),
        (BASE.replace("Nosendale", "Fagarby"), False),
    ],
)
def test_descriptions(other, same):
    frequent = set("grey green loom kettle striped painted hall handle side morning mist".split()).__contains__
    assert C.same_description(C.words(BASE), C.words(other), frequent) is same


def test_batches_against_a_sequential_run(spark):
    rng = np.random.default_rng(9)
    colours, things, towns = "red blue green grey white".split(), "lantern kettle ladder globe drum bicycle".split(), ["Naseldale", "Rivoden", "Tamelby", "Corustow", "Pelinwick", "Dagorham", "Fisenmere"]
    text = lambda: f"A {rng.choice(colours)} {rng.choice(things)} stands near the old {rng.choice(things)} in {rng.choice(towns)} under heavy clouds at the end of winter"
    rows, pool = [], []
    for i in range(400):
        cap = text() if i < 150 or rng.random() < 0.5 else pool[int(rng.integers(len(pool)))][1]
        url = f"http://h.example/{int(rng.integers(0, 10**9))}.jpg" if i < 150 or rng.random() < 0.8 else pool[int(rng.integers(len(pool)))][0].replace("http://", "https://www.")
        if rng.random() < 0.3:
            cap = cap.replace("winter", "wintr").upper()
        pool.append((url, cap))
        rows.append((i * 7 % 1009, url, cap, 0 if i < 150 else 1 + i % 4))
    rows += [(5000, None, None, 2), (5001, "", "  ", 3), rows[200]]
    df = spark.createDataFrame(rows, "id bigint, url string, caption string, batch int").withColumn("words", F.lit(1))
    words, urls = {r[0]: C.words(r[2]) for r in rows}, {r[0]: C.resource(r[1]) for r in rows}
    classes = {" ".join(words[r[0]]) for r in rows if C.running(words[r[0]])}
    df_count = collections.Counter(t for c in classes for t in set(c.split()))
    frequent = lambda t: df_count[t] >= 50
    accepted, refused = [], set()
    for b, i in sorted({(r[3], r[0]) for r in rows}):
        hit = b > 0 and any((urls[i] and urls[i] == urls[j]) or (C.running(words[i]) and C.running(words[j]) and C.same_description(words[i], words[j], frequent)) for j in accepted)
        refused.add(i) if hit else accepted.append(i)
    got = I.refused_records(df).collect()
    assert {r.id for r in got} == refused
    assert all((r.refused_by_address or r.refused_by_caption) in set(accepted) for r in got)
    assert I.refused_records(df.limit(0)).count() == 0


def test_draws_of_any_size():
    rng = np.random.default_rng(5)
    for counts, take, most in (([7, 0, 5], 6, 10**9), ([70, 1, 55], 61, 20), ([3, 3, 3], 9, 2), ([10**12, 5, 10**11], 10**11 + 7, 10**9), ([0, 0], 0, 5)):
        left = M.draw(rng, counts, take, most)
        assert sum(left) == take and all(0 <= x <= c for x, c in zip(left, counts))
    # in proportion on average
    shares = np.mean([M.draw(rng, [600, 300, 100], 500, 64) for _ in range(300)], axis=0)
    assert np.allclose(shares, [300, 150, 50], atol=8)
