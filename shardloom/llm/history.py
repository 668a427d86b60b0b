"""A stored index of accepted records, to which batches come one after another.

The index is a folder of Parquet tables, so it outlives the driver: ``open`` it
and go on. Captions lie in parts by key, with their signatures; their words in
parts by class; addresses and ids in parts by theirs. A batch reads the parts
its own keys, classes and addresses fall into and nothing else; what was
accepted before is not parsed, routed or compared again. Every batch writes one
shard of each table; when there are ``most_shards`` of them they are compacted
into one, for which words are counted and keys chosen anew.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, stage
from . import p07_incremental as P7

#: Parts a table is stored in. A batch of few records touches as many parts as it has keys at most.
PARTS = 256
KINDS = {
    "keys": P7.ROWS + ", part int",
    "texts": "class bigint, words string, part int",
    "classes": "class bigint, id bigint, part int",
    "addresses": "address bigint, id bigint, part int",
    "ids": "id bigint, part int",
}
BY = {"keys": "key", "texts": "class", "classes": "class", "addresses": "address", "ids": "id"}


class HistoryIndex:
    """``add`` takes a batch and returns what is refused of it; the rest is accepted and indexed."""

    def __init__(self, spark: SparkSession, folder: str, parts: int = PARTS, most_shards: int = 6) -> None:
        self.spark, self.folder, self.parts, self.most_shards = spark, folder.rstrip("/"), parts, most_shards
        self.batches = 0
        self.shards: list[str] = []
        self.known: dict[str, int] = {}
        self.classes = 0
        self.phrases: tuple[dict, dict] = ({}, {})

    @classmethod
    def open(cls, spark: SparkSession, folder: str, most_shards: int = 6) -> HistoryIndex:
        """The index as the last batch that was added to its end left it."""
        state = json.loads(spark.read.option("wholetext", True).text(f"{folder.rstrip('/')}/state").first()[0])
        index = cls(spark, folder, state["parts"], most_shards)
        index.batches, index.shards, index.classes = state["batches"], state["shards"], state["classes"]
        words = spark.read.parquet(f"{index.folder}/words-{state['words']}").toArrow() if state["words"] is not None else None
        if words is not None:
            index.known = dict(zip(words.column("w").to_pylist(), words.column("n").to_pylist()))
        index.phrases = (state["phrases"], {k: tuple(v) for k, v in state["homes"].items()})
        index._words = state["words"]
        return index

    _words: int | None = None

    def add(self, images: DataFrame) -> DataFrame:
        """``id, refused_by_address, refused_by_caption`` of the batch's refused records.

        The first batch is the history and is accepted whole. Ids that the
        index has already are the same records and left out. A batch counts
        from when its state is written; one that broke off before is added again.
        """
        number = self.batches
        rows = P7.parse(images.drop("batch").withColumn("batch", F.lit(number)))
        if number:
            rows = stage(rows, "rows")
            rows = rows.join(self._touched("ids", rows.select("id")).select("id"), "id", "left_anti")
        records = stage(rows, "batch")
        classes = records.where("class IS NOT NULL").groupBy("class").agg(F.min("words").alias("words"))
        if not number:
            self._learn(classes)
        new = stage(classes.select("class", "words", F.lit(number).alias("batch"), F.lit(None).cast("map<string,bigint>").alias("rarer")), "classes")
        keyed = stage(P7.key_rows(new, self._shared(), {}), "keyed")
        if number:
            like = stage(self._like(new, keyed), "like")
            touched = records.select("class").union(like.select("a")).union(like.select("b")).where("class IS NOT NULL").distinct()
            by_class = self._touched("classes", touched).join(touched, "class", "left_semi").select("id", F.lit(0).alias("batch"), F.lit(None).cast("bigint").alias("address"), "class")
            asked = records.select("address").where("address IS NOT NULL").distinct()
            by_address = self._touched("addresses", asked).join(asked, "address", "left_semi").select("id", F.lit(0).alias("batch"), "address", F.lit(None).cast("bigint").alias("class"))
            before = by_class.unionByName(by_address).groupBy("id").agg(F.min("batch").alias("batch"), F.max("address").alias("address"), F.max("class").alias("class"))
            refused = stage(P7.settle(before.unionByName(records.drop("words")), like), "refused")
        else:
            refused = self.spark.createDataFrame([], "id bigint, refused_by_address bigint, refused_by_caption bigint")
        accepted = stage(records.join(refused.select("id"), "id", "left_anti"), "accepted")
        kept = accepted.where("class IS NOT NULL").select("class").distinct()
        shard = f"{self.folder}/shards/{number:06d}"
        # all of them as of batch 0: a later batch asks after them
        old = keyed.join(kept, "class", "left_semi").withColumn("info", F.col("info").bitwiseAND(F.lit((1 << 17) - 1)))
        self._write(old, "keys", shard)
        self._write(new.join(kept, "class", "left_semi").select("class", "words"), "texts", shard)
        self._write(accepted.where("class IS NOT NULL").groupBy("class").agg(F.min("id").alias("id")), "classes", shard)
        self._write(accepted.where("address IS NOT NULL").groupBy("address").agg(F.min("id").alias("id")), "addresses", shard)
        self._write(accepted.select("id"), "ids", shard)
        self.shards.append(shard)
        self.batches += 1
        if len(self.shards) >= self.most_shards:
            self.compact()
        self._save()
        return refused

    def compact(self) -> None:
        """One shard of all, with words counted and keys chosen anew. The old shards go once the state names the new one."""
        target, before = f"{self.folder}/shards/to-{self.batches:06d}", self.shards
        texts = stage(self._stored("texts").groupBy("class").agg(F.min("words").alias("words")), "texts")
        self._learn(texts)
        rows = texts.select("class", "words", F.lit(0).alias("batch"), F.lit(None).cast("map<string,bigint>").alias("rarer"))
        self._write(P7.key_rows(rows, self._shared(), {}), "keys", target)
        self._write(texts, "texts", target)
        for kind, column in (("classes", "class"), ("addresses", "address")):
            self._write(self._stored(kind).groupBy(column).agg(F.min("id").alias("id")), kind, target)
        self._write(self._stored("ids").select("id"), "ids", target)
        self.shards = [target]
        self._save()
        for s in before:
            discard(self.spark, s)

    def read_parts(self, kind: str, asked: DataFrame) -> list[int]:
        """The parts of a table that keys, classes, addresses or ids fall into; ``PARTS`` numbers at most."""
        return sorted(r[0] for r in asked.select(self._part(asked.columns[0])).distinct().collect())

    def _part(self, column: str):
        return F.pmod(F.xxhash64(column), F.lit(self.parts)).cast("int").alias("part")

    def _write(self, rows: DataFrame, kind: str, shard: str) -> None:
        rows.withColumn("part", self._part(BY[kind])).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{shard}/{kind}")

    def _stored(self, kind: str, parts: list[int] | None = None) -> DataFrame:
        out = None
        for s in self.shards:
            rows = self.spark.read.schema(KINDS[kind]).parquet(f"{s}/{kind}")
            out = rows if out is None else out.unionByName(rows)
        # on the partition column, so that other parts are not even listed for reading
        return out if parts is None else out.where(F.col("part").isin(parts) if parts else F.lit(False))

    def _touched(self, kind: str, asked: DataFrame) -> DataFrame:
        return self._stored(kind, self.read_parts(kind, asked))

    def _learn(self, classes: DataFrame) -> None:
        self.known, self.classes, self.phrases = P7.learn(classes)
        self._words = self.batches
        rows = self.spark.createDataFrame(list(self.known.items()), "w string, n bigint")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/words-{self._words}")

    def _save(self) -> None:
        """The state, as one small file that takes the place of the last."""
        state = {"parts": self.parts, "batches": self.batches, "shards": self.shards, "classes": self.classes, "words": self._words, "phrases": self.phrases[0], "homes": self.phrases[1]}
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/state")

    def _shared(self):
        return P7.share(self.spark, self.known, max(1, self.classes), self.phrases)

    def _like(self, new: DataFrame, keyed: DataFrame) -> DataFrame:
        """``a, b``: classes of the batch and the like ones before or beside them."""
        held = self._touched("keys", keyed.select("key")).drop("part")
        # of the stored rows only those whose key the batch has, so that what is compared follows the batch
        held = held.join(keyed.select("key").distinct(), "key", "left_semi").select(*keyed.columns)
        pairs = stage(P7.offered_pairs(held.unionByName(keyed)), "offered")
        asked = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
        old = self._touched("texts", asked).join(asked, "class", "left_semi").select("class", "words", F.lit(0).alias("batch"))
        fresh = new.select("class", "words", "batch")
        texts = fresh.unionByName(old.join(fresh.select("class"), "class", "left_anti").dropDuplicates(["class"]))
        return P7.compared(pairs, texts, self._shared())
