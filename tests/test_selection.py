"""Selection phases, manifests, stops, search strategies, sidecars and the stored index, by what must hold."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardloom.operators import manifests as MA
from shardloom.operators import search as SE
from shardloom.operators import selection as SL
from shardloom.operators import verdicts as V
from shardloom.operators import vectorsets as VS
from shardloom.operators.dedup_index import VectorIndex
from shardloom.sources import sidecars as SC


def pool(spark, n=200, vec=False):
    rng = np.random.default_rng(1)
    rows = [(f"{i:04d}", f"s{i % 5}", float(rng.random()) if i % 2 else None, None, int(i % 3), int(i % 2)) + ((rng.standard_normal(4).tolist(),) if vec else ()) for i in range(n)]
    return spark.createDataFrame(rows, "shard_id string, source string, effective double, composite double, n_selected int, n_scored int" + (", vec array<double>" if vec else ""))


def test_phases(spark):
    p = pool(spark)
    policy = SL.Policy(performance=0.5, diversity=0.1, exploration=0.1, per_source={"s4": 12}, schedule=(("through", 9, 0.1),))
    got = {r.shard_id: r.phase for r in SL.select_shards(p, 40, policy, 5).collect()}
    count = lambda ph: sum(v == ph for v in got.values())
    # half of the pool is unscored, so exploration is raised to 0.3
    assert (count("performance"), count("diversity"), count("exploration")) == (20, 4, 12) and len(got) == 40
    rows = {r.shard_id: r for r in p.collect()}
    assert all(rows[k].n_selected == 0 for k, v in got.items() if v == "exploration") and all(rows[k].source == "s4" for k, v in got.items() if v == "source")
    assert got == {r.shard_id: r.phase for r in SL.select_shards(p, 40, policy, 5).collect()}
    assert {r.phase for r in SL.select_shards(p, 500, policy, 5).collect()} == {"all"}
    held = SL.select_shards(p, 40, policy, 5, held_out=("s4",)).join(p, "shard_id")
    assert held.where("source = 's4'").isEmpty()
    assert SL.select_shards(p.limit(0), 5).count() == 0
    far = SL.select_shards(pool(spark, vec=True), 40, policy, 5, embedding="vec")
    assert far.where("phase = 'diversity'").count() == 4


def test_recency_and_exploration_by_hand(spark):
    df = spark.createDataFrame([(0.8, 0), (0.8, 3), (0.8, 9), (-1.0, 0)], "s double, n int")
    got = [round(r[0], 6) for r in df.select(SL.recency_weight(F.col("s"), F.col("n"), 12, 3, 0.3)).collect()]
    # 3 selections of 12 / 3 expected: three quarters of the penalty
    assert got == [0.8, round(0.8 * (1 - 0.3 * 0.75), 6), 0.56, 0.3]
    policy = SL.Policy(exploration=0.15, schedule=(("through", 3, 0.4), ("after", 5, 0.05)))
    assert [SL.exploration_rate(policy, i, 0.0) for i in (0, 1, 3, 4, 6)] == [0.15, 0.4, 0.4, 0.15, 0.05] and SL.exploration_rate(policy, 6, 0.31) == 0.3


def test_manifest_round_trip(spark, tmp_path):
    e = spark.createDataFrame([("b", "include"), ("a", "exclude"), (None, "include")], "shard_id string, decision string")
    import hashlib

    want = hashlib.sha256(json.dumps([["a", "exclude"], ["b", "include"]], separators=(",", ":")).encode()).hexdigest()
    assert MA.selection_digest(e).first().checksum == want
    path = MA.write_manifest(e, f"file://{tmp_path}", "m")
    path = MA.write_manifest(e.where("shard_id IS NOT NULL"), f"file://{tmp_path}", "m")
    assert MA.read_manifest(spark, path, e.schema).count() == 2
    spark.createDataFrame([("c", "include")], e.schema).write.mode("append").json(f"{path}/entries")
    with pytest.raises(ValueError):
        MA.read_manifest(spark, path, e.schema)


def test_stops(spark):
    rows = [("a", i, 0.1, None, -1.0, None) for i in range(1, 9)] + [("b", 1, 9.0, None, 1.0, None)] + [("c", i, 0.1, 20.0 if i != 3 else None, 1.0, None) for i in range(1, 6)] + [("d", 1, 0.1, 20.0, 1.0, 1.0)]
    s = spark.createDataFrame(rows, "k string, i int, loss double, grad_norm double, cond_gap double, ref_gap double")
    got = {r.k: (r.stop_at, r.reason) for r in V.early_stops(s, ["k"], ["i"], 0.0, 3, 2, grad_limit=10.0, ref_gap_min=0.0).collect()}
    # two snapshots of warmup and three below the floor; a missing value neither adds to a streak nor ends it
    assert got == {"a": (5, "cond_gap"), "b": (1, "loss"), "c": (4, "grad_norm"), "d": (None, None)}
    r = spark.createDataFrame([("x", i, v) for i, v in enumerate([1.0, None, 1.005, 1.0, 0.9, 2.0, 1.0])], "k string, i int, v double")
    assert V.campaign_plateau(r, ["k"], ["i"], "v", 3, 0.01, 2).first().plateau_at == 5


def test_strategies_try_everything_once():
    space = {"a": [1, 2, 3], "b": ["x", "y"]}
    for name, kind in SE.STRATEGIES.items():
        s, tried = kind(space, seed=3), []
        while (p := s.propose(tried)) is not None:
            score = float(p["a"]) + (p["b"] == "y")
            tried.append((p, (score, -score) if name == "nsga" else score))
        assert len(tried) == 6 and len({tuple(p.values()) for p, _ in tried}) == 6
    # a model that has learnt goes to the better half first
    gp = SE.GaussianUcb({"a": list(range(10))}, kappa=0.1)
    assert gp.propose([({"a": i}, float(i)) for i in (0, 3, 6)])["a"] > 6


def test_sidecar_files(spark, tmp_path):
    (tmp_path / "000001.light_scores.json").write_text(json.dumps({"source": "laion", "decision": "discard", "light_scores": {"combined_score": 0.4, "aesthetic_avg": 0.5}}))
    (tmp_path / "000001.provenance.json").write_text(json.dumps({"shard_id": "shard-000001", "sources": [{"type": "jdb"}, {"type": "wikiart"}, {"type": "jdb"}]}))
    (tmp_path / "000002.unified_score.json").write_text(json.dumps({"source": "coyo", "final_value_score": 0.7, "light_score": 0.6}))
    (tmp_path / "000003.unified_score.json").write_text("{broken")
    (tmp_path / "000004.other.json").write_text("{}")
    texts = SC.sidecar_texts(spark, f"file://{tmp_path}")
    a = {r.shard_id: r for r in SC.index_rows(texts).collect()}
    assert set(a) == {"000001", "000002", "000003"}
    assert (a["000001"].source, a["000001"].final_value_score, a["000001"].light_decision, a["000001"].has_unified) == ("journeydb+wikiart", 0.4, "discard", 0)
    assert (a["000002"].source, a["000002"].final_value_score, a["000002"].light_score, a["000002"].light_decision) == ("coyo", 0.7, None, "unknown")
    assert (a["000003"].source, a["000003"].has_unified, a["000003"].final_value_score) == ("unknown", 0, None)
    b = {r.shard_id: r for r in SC.fallback_rows(texts).collect()}
    # without an index a unified score alone means keep, and provenance is not looked at
    assert (b["000002"].light_decision, b["000002"].light_score, b["000001"].source, b["000003"].light_score) == ("keep", 0.6, "laion", 0.0)
    (tmp_path / "run1").mkdir()
    (tmp_path / "run1" / "eval.json").write_text('{"clip_i_mean": 0, "clip_i": 0.3}')
    assert [tuple(r) for r in SC.scan_evaluations(spark, f"file://{tmp_path}/*/eval.json").collect()] == [("run1", 0.3)]


def test_vector_index(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame([*r], "id int, vec array<double>")
    index = VectorIndex(spark, f"file://{tmp_path}/index")
    assert index.batches() == [] and index.add(rows((1, [1.0, 0.0]), (2, [0.0, 1.0])), 0).count() == 0
    # duplicates of one batch survive, those of an earlier one are found; known ids are left out
    found = index.add(rows((3, [1.0, 0.01]), (4, [1.0, 0.01]), (2, [1.0, 0.0]), (5, [-1.0, 0.0]), (6, None)), 1)
    assert sorted((r.id, r["of"]) for r in found.collect()) == [(3, 1), (4, 1)]
    again = VectorIndex(spark, f"file://{tmp_path}/index")
    assert again.batches() == [0, 1] and again.stored().count() == 5
    again.add(rows((3, [1.0, 0.01])), 1)
    assert again.stored().count() == 3
    again.rollback(0)
    assert again.batches() == [0] and again.stored().count() == 2


def test_exemplars_and_silhouettes(spark):
    x = [(1, 10, [1.0, 0.0]), (1, 11, [1.0, 0.1]), (1, 12, [1.0, -0.1]), (2, 20, [0.0, 1.0]), (2, 21, [0.1, 1.0]), (2, 22, [-0.2, 1.0]), (3, 30, [1.0, 0.0]), (4, 40, None)]
    df = spark.createDataFrame(x, "g int, id int, v array<double>")
    got = [(r.g, r.place, r.id) for r in VS.exemplars(df, "g", "id", "v").orderBy("place").collect()]
    assert got == [(1, 1, 10), (2, 2, 20)]
    s = {r.g: r.silhouette for r in VS.silhouettes(df.where("g < 3"), "g", "v").collect()}
    assert min(s.values()) > 0.9
    assert VS.silhouettes(df.where("g = 1"), "g", "v").first().silhouette == 0.0
