"""Archives, annotation lines, logs, bundles and streams."""

import io
import tarfile

import numpy as np
from pyspark.sql import functions as F

from shardloom.sources import archives as AR
from shardloom.sources import documents as D
from shardloom.streaming import streams as ST


def _tar(path, members, cut=None):
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w") as t:
        for name, body in members:
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    path.write_bytes(buffer.getvalue()[:cut])


def test_archives(spark, tmp_path):
    _tar(tmp_path / "000001.tar", [("a.jpg", b"1"), ("a.txt", b"one"), ("b.jpg", b"2"), ("c.png", b"3"), ("c.caption", b"three"), ("d.txt", b"")])
    _tar(tmp_path / "000002.tar", [("x.jpg", b"9" * 600), ("x.txt", b"nine"), ("y.jpg", b"8" * 600)], cut=2800)
    got = sorted((r.shard, r.stem, r.caption) for r in AR.records(spark, str(tmp_path)).collect())
    assert got == [("000001", "a", "one"), ("000001", "c", "three"), ("000002", "x", "nine")]
    assert AR.records(spark, str(tmp_path), per_shard=1).count() == 2
    checks = {r.shard: (r.members, r.records, r.unpaired, r.empty_members) for r in AR.structural_checks(spark, str(tmp_path)).collect()}
    assert checks["000001"] == (6, 2, 2, 1)
    assert {r.shard: r.truncated for r in AR.structural_checks(spark, str(tmp_path)).collect()} == {"000001": False, "000002": True}
    bare = AR.records(spark, str(tmp_path), bodies=False).collect()
    assert {(r.shard, r.stem) for r in bare} >= {("000001", "a"), ("000001", "c")} and all(r.image is None for r in bare)
    assert AR.scan_members(spark, str(tmp_path / "000001.tar"), pairs=1).count() == 2
    rows = spark.createDataFrame([(0, 0, bytearray(b"p"), "cap"), (0, 1, bytearray(b"q"), "tion")], "bin bigint, slot bigint, image binary, caption string")
    out = tmp_path / "out"
    AR.write_archives(rows, str(out)).collect()
    assert sorted(r.caption for r in AR.records(spark, str(out)).collect()) == ["cap", "tion"]


def test_annotations(spark):
    lines = ['{"img_path": "x/a.jpg", "prompt": "p", "Task2": {"Caption": "t"}}', '{"img_path": "b.png", "caption": " ", "prompt": "pb"}', "broken{", "", '{"img_path": "b.png", "prompt": "later"}', '{"img_path": "n.png"}']
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lines)] + [(9, None)], "position int, value string")
    assert {r.stem: r.caption for r in D.annotations(df).collect()} == {"a": "t", "b": "later"}


def test_logs(spark):
    text = "step 1,000  loss_cond=0.5 loss_ref=0.9\nVAL gap +0.3 pairs=17\nstep 1,050 loss_cond=0.4\nVAL gap +0.8 pairs=3"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")
    r = {x.id: x for x in D.latest_metrics(df, "id", "text").collect()}
    assert (r[1].step, r[1].loss_cond, r[1].gap) == (1050, 0.4, 0.3) and r[3].step is None
    assert [(x.step, x.val_gap) for x in D.snapshots(df, "id", "text").orderBy("snapshot").collect()] == [(1000, 0.3), (1050, 0.8)]


def test_bundles(spark, tmp_path):
    np.savez(tmp_path / "s1.npz", r1=np.array([3.0, 4.0]), r2=np.zeros(2))
    (tmp_path / "s2.npz").write_bytes(b"half")
    got = {r.rec_id: [round(v, 3) for v in r.vec] for r in D.vector_bundles(spark, str(tmp_path)).collect()}
    assert got == {"r1": [0.6, 0.8], "r2": [0.0, 0.0]}


def test_streams(spark, tmp_path):
    rows = [(i, "u" if i % 2 else "w", float(v)) for i, v in enumerate([1, 5, 2, 4, 3, 4, 2, 4])]
    df = spark.createDataFrame(rows, "id bigint, u string, v double")
    for part in (0, 1):
        df.where(F.col("id") % 2 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    df.where("id < 3").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert ST.follow(spark, str(tmp_path / "in") + "/", df, key="id").count() == 8
    got = {r.u: r.stop_at for r in ST.run_early_stops(spark, str(tmp_path / "in") + "/", df, "u", "id", "v", 3, 0.0).collect()}
    assert got["u"] is not None
    # a second call goes on where the first stopped, and finds nothing new
    out = f"file://{tmp_path}/kept"
    first = ST.follow(spark, str(tmp_path / "in") + "/", df, key="id", folder=out).count()
    df.limit(1).withColumn("id", F.lit(99).cast("bigint")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert ST.follow(spark, str(tmp_path / "in") + "/", df, key="id", folder=out).count() == first + 1


def test_early_stop_equals_a_loop(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, f"k{i % 7}", float(v) if v else None) for i, v in enumerate(rng.integers(0, 30, 400))]
    df = spark.createDataFrame(rows, "id bigint, u string, v double")
    df.coalesce(2).write.parquet(str(tmp_path / "in"))
    got = {r.u: (r.seen, r.stop_at) for r in ST.run_early_stops(spark, str(tmp_path / "in") + "/", df, "u", "id", "v", 6, 2.0).collect()}
    for u in got:
        seen, high, wait, stop = 0, None, 0, None
        for _, k, v in rows:
            if k == u and v is not None:
                seen += 1
                high, wait = (v, 0) if high is None or v > high + 2.0 else (high, wait + 1)
                stop = seen if stop is None and wait >= 6 else stop
        assert got[u] == (seen, stop)
