"""The stored index gives, batch after batch, what the replay of all batches gives, and reads no more than it has to."""

import hashlib

from pyspark.sql import functions as F

from shardloom.llm import history
from shardloom.llm.history import HistoryIndex
from shardloom.llm.p07_incremental import refused_records


def test_batches_one_by_one(spark, data, tmp_path):
    images = spark.read.parquet(f"{data}/images.parquet")
    index = HistoryIndex(spark, f"file://{tmp_path}/index", parts=4, most_shards=3)
    got: set = set()
    for b in range(9):
        refused = index.add(images.where(F.col("batch") == b))
        got |= {(r.id, r.refused_by_address, r.refused_by_caption) for r in refused.collect()}
        if b in (2, 5):  # another driver goes on
            index = HistoryIndex.open(spark, f"file://{tmp_path}/index", most_shards=3)
            assert index.batches == b + 1
    want = {(r.id, r.refused_by_address, r.refused_by_caption) for r in refused_records(images).collect()}
    assert len(index.shards) <= 3
    assert {g[0] for g in got} == {w[0] for w in want}
    assert len(want) > 20


def test_words_that_come_up_later_are_learnt(spark, tmp_path):
    images = lambda rows: spark.createDataFrame(rows, "id bigint, url string, caption string")
    text = "a striped loom painted grey stands in the vaulted hall at nosendale with the handle bent to one side"
    index = HistoryIndex(spark, f"file://{tmp_path}/later", parts=4, most_shards=2)
    index.add(images([(0, "http://h.example/0", "nothing but one first caption of the index and it is quite short")]))
    index.add(images([(i, f"http://h.example/{i}", f"{text} near the {n} lantern of a {m}") for i, n, m in ((1, "red", "weaver"), (2, "blue", "sailor"))]))
    assert len(index.shards) == 1 and index.known["loom"] == 2 and "nosendale" in index.known
    assert spark.read.parquet(f"{index.shards[0]}/keys").select("key").distinct().count() > 3
    got = index.add(images([(3, "http://h.example/3", f"{text} near the red lantern of a weavr")])).collect()
    assert [(r.id, r.refused_by_caption) for r in got] == [(3, 1)]
    again = index.add(images([(3, "http://h.example/3", "x"), (1, None, None), (4, "HTTP://WWW.h.example/2#top", None), (None, None, None)])).collect()
    assert [(r.id, r.refused_by_address) for r in again] == [(4, 2)]
    assert index.add(images([])).count() == 0


def test_a_batch_reads_the_parts_it_touches_only(spark, tmp_path, monkeypatch):
    images = lambda rows: spark.createDataFrame(rows, "id bigint, url string, caption string")
    place = lambda i: "".join("bcdfghjklmnprstv"[int(d, 16)] + "aeiou"[int(d, 16) % 5] for d in hashlib.md5(str(i).encode()).hexdigest()[:5])
    text = lambda i: f"the old windmill of {place(i)} stands in a snowy orchard by the river and nobody has painted it since"
    index = HistoryIndex(spark, f"file://{tmp_path}/index", parts=64, most_shards=9)
    index.add(images([(i * 10 + j, f"http://h.example/{i}/{j}", f"{text(i)} {w}") for i in range(600) for j, w in enumerate(("spring", "autumn"))]))
    read: dict[str, set] = {}
    plain = HistoryIndex._stored

    def watched(self, kind, parts=None):
        out = plain(self, kind, parts)
        if parts is not None:
            read.setdefault(kind, set()).update(parts)
            # the filter reaches the file listing: nothing but those parts is opened
            files = {f.rpartition("part=")[2].partition("/")[0] for f in out.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
            assert {int(f) for f in files if f} <= set(parts)
        return out

    monkeypatch.setattr(history.HistoryIndex, "_stored", watched)
    got = index.add(images([(9000, "http://other.example/", f"{text(7)} sprng")])).collect()
    assert [(r.id, r.refused_by_caption) for r in got] == [(9000, 70)]
    sizes = {k: len(p) for k, p in read.items()}
    assert max(sizes.values()) < 40, sizes
    assert set(read) == {"ids", "keys", "texts", "classes", "addresses"} and all(len(p) < (40 if k == "keys" else 16) for k, p in read.items())
