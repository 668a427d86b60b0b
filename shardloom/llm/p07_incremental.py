"""Problem 7: new batches checked for repeats against everything accepted before.

Method: inverted index of keys. Captions that read the same are one class.
Every class is listed under keys, small groups of its most telling words
(``likeness``), with a signature of its words. All classes under a common key
are held against each other by their signatures, which leave out only pairs
that cannot pass; what remains is compared exactly, word by word. Addresses
repeat each other if they have the same spelling in ``captions.resource``.

Which record is accepted is then settled in rounds: a record is refused once an
accepted one before it has its address, its class or a like class, and accepted
once none before it can be. Copies meet as one minimum per address or class,
never as pairs. A key that too many classes share is split; its queries go to
every part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..io import table
from ..session import stage
from .captions import resource, running, same_description, words
from .likeness import AT_HOME, SEEN, TOGETHER, Collection, homes_of, linked_words, named, often_words, pairs_of, possible, tally

#: Words whose frequencies are broadcast at most (under 15 MB); those beyond are joined to the captions that have them.
VOCABULARY = 300_000
#: Codes that a task holds before it sums them up.
COUNTED = 4_000_000
#: Classes of a key, or of a part of one, on average at most; and the share of classes on which such keys are looked for.
PART = 20_000
LOOKED_AT = 64
#: Runs of up to so many classes are paired all at once, longer ones in blocks.
RUN = 64
BLOCK = 1024

_COLLECTIONS: dict[str, Collection] = {}


def parse(images: DataFrame) -> DataFrame:
    """``id, batch, address, class, words`` of every record; one row per id.

    ``address`` and ``class`` are 64-bit hashes, null where there is no address
    or no running language of eight words. Rows with a null id or batch are
    left out; of rows with the same id the smallest counts.
    """
    one = images.where(F.col("id").isNotNull() & F.col("batch").isNotNull()).groupBy("id").agg(F.min(F.struct("batch", "url", "caption")).alias("r"))
    rows = one.select("id", "r.batch", "r.url", "r.caption")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            urls = [resource(u) for u in b.column(2).to_pylist()]
            texts = []
            for c in b.column(3).to_pylist():
                w = words(c)
                texts.append(" ".join(w) if running(w) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(urls, pa.string()), pa.array(texts, pa.string())], names=["id", "batch", "url", "words"])

    parsed = rows.mapInArrow(run, "id bigint, batch int, url string, words string")
    return parsed.select(
        "id",
        "batch",
        F.when(F.col("url").isNotNull(), F.xxhash64("url")).alias("address"),
        F.when(F.col("words").isNotNull(), F.xxhash64("words")).alias("class"),
        "words",
    )


def _counts(classes: DataFrame) -> DataFrame:
    """``w, n``: words that occur in more than one class."""
    return classes.select(F.explode(F.array_distinct(F.split("words", " "))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def _frequencies(classes: DataFrame) -> dict[str, int]:
    """Classes per word, for the most frequent words that occur more than once."""
    rows = _counts(classes).orderBy(F.desc("n"), "w").limit(VOCABULARY).toArrow()
    return dict(zip(rows.column("w").to_pylist(), rows.column("n").to_pylist()))


def _with_rarer(classes: DataFrame, known: dict[str, int]) -> DataFrame:
    """The classes with ``rarer``, their recurring words that are not in the table, with frequencies; null if there are none."""
    kind = "map<string,bigint>"
    if len(known) < VOCABULARY:
        return classes.withColumn("rarer", F.lit(None).cast(kind))
    word, least = list(known.items())[-1]
    beyond = _counts(classes).where((F.col("n") < least) | ((F.col("n") == least) & (F.col("w") > F.lit(word))))
    own = classes.select("class", F.explode(F.array_distinct(F.split("words", " "))).alias("w")).join(beyond, "w")
    rarer = own.groupBy("class").agg(F.map_from_entries(F.collect_list(F.struct("w", "n"))).cast(kind).alias("rarer"))
    return stage(classes.join(rarer, "class", "left"), "rarer")


def _collection(shared) -> Collection:
    """The broadcast frequencies, unpacked once per Python worker."""
    value = shared.value
    if value["id"] not in _COLLECTIONS:
        _COLLECTIONS.clear()
        _COLLECTIONS[value["id"]] = Collection(dict(zip(value["words"], value["n"])), value["classes"], *value["phrases"])
    return _COLLECTIONS[value["id"]]


def share(spark: SparkSession, known: dict[str, int], total: int, phrase: tuple[dict[str, str], dict[str, tuple[str, int]]]):
    """What a collection knows of its words, for every Python worker."""
    return spark.sparkContext.broadcast({"id": f"{id(known)}-{total}", "words": list(known), "n": list(known.values()), "classes": total, "phrases": phrase})


ROWS = "key bigint, class bigint, lo bigint, hi bigint, info bigint"


def key_rows(classes: DataFrame, shared, hot: dict[int, int]) -> DataFrame:
    """ROWS: every class once per key, with its signature; ``info`` packs its other words, the batch and what the row is.

    A class of batch 0 is only ever asked after. A key of ``hot`` is split into
    parts: a class belongs to one of them and, if it arrived later, asks in all.
    """
    split = classes.sparkSession.sparkContext.broadcast(hot)
    low = (1 << 64) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        about, hot = _collection(shared), split.value
        for b in batches:
            names, texts, batch, rarer = (b.column(c).to_pylist() for c in range(4))
            at, keys, base, sig = [], [], [], []
            for i, (name, text, when, more) in enumerate(zip(names, texts, batch, rarer)):
                tokens = text.split(" ")
                sig.append(about.signature(tokens))
                own = about.keys(tokens, dict(more) if more else None)
                if hot and not hot.keys().isdisjoint(own):
                    for k in own:
                        parts = hot.get(k, 1)
                        mine = name % parts
                        for p in range(parts) if when > 0 else (mine,):
                            keys.append((k + p * 0x9E3779B97F4A7C15) & low)
                            at.append(i)
                            base.append(p == mine)
                else:
                    keys += own
                    at += [i] * len(own)
                    base += [True] * len(own)
            at_ = np.array(at, "i8")
            lo = np.array([s[0] & low for s in sig], "u8").view("i8")
            hi = np.array([s[0] >> 64 for s in sig], "u8").view("i8")
            info = np.array([s[1] for s in sig], "i8") | np.minimum(np.array(batch, "i8"), 1 << 30) << 17
            columns = [np.array(keys, "u8").view("i8"), np.array(names, "i8")[at_], lo[at_], hi[at_], info[at_] | np.array(base, "i8") << 16]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "class", "lo", "hi", "info"])

    return classes.select("class", "words", "batch", "rarer").mapInArrow(run, ROWS)


def _offers(key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of equal keys, in pieces of bounded size; the rows are in order of key."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    lengths = np.diff(np.append(starts, len(key)))
    rows = np.repeat(lengths, lengths) <= RUN
    at = np.flatnonzero(rows)
    for d in range(1, RUN):
        at = at[at + d < len(key)]
        at = at[key[at + d] == key[at]]
        if not len(at):
            break
        yield at, at + d
    for s, n in zip(starts[lengths > RUN].tolist(), lengths[lengths > RUN].tolist()):
        for x in range(s, s + n, BLOCK):
            own = np.arange(x, min(x + BLOCK, s + n))
            for y in range(x, s + n, BLOCK):
                other = np.arange(y, min(y + BLOCK, s + n))
                i, j = np.repeat(own, len(other)), np.tile(other, len(own))
                keep = i < j
                yield i[keep], j[keep]


def offered_pairs(rows: DataFrame) -> DataFrame:
    """``a, b``, the smaller first: classes that share a key and whose signatures let them be alike. One of them arrived later than batch 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if held is None or not held.num_rows:
            return
        key, name, lo, hi, info = (held.column(c).to_numpy() for c in range(5))
        order = np.argsort(key, kind="stable")
        key, name, info = key[order], name[order], info[order]
        bits = lo[order].view("u8"), hi[order].view("u8")
        free, base, later = (info & 255).astype("i4"), (info >> 16 & 1).astype("?"), info >> 17 > 0
        found = np.empty((0, 2), "i8")
        for i, j in _offers(key):
            ok = (later[i] | later[j]) & (base[i] | base[j]) & (name[i] != name[j])
            i, j = i[ok], j[ok]
            ok = possible(bits, free, i, j)
            a, b = name[i[ok]], name[j[ok]]
            found = np.concatenate([found, np.column_stack([np.minimum(a, b), np.maximum(a, b)])])
            if len(found) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], names=["a", "b"])
                found = found[:0]
        found = np.unique(found, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], names=["a", "b"])

    # all rows of a key come to one task; keys too large for one are split before
    return rows.repartition("key").mapInArrow(run, "a bigint, b bigint").distinct()


def compared(pairs: DataFrame, texts: DataFrame, shared) -> DataFrame:
    """``a, b``: pairs of classes that give the same description, from ``texts`` (class, words, batch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = _collection(shared).frequent
        for batch in batches:
            keep = []
            for i, (wa, ba, wb, bb) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(2, 6)))):
                a, b = wa.split(" "), wb.split(" ")
                # the one that came later is held against the one before; in one batch either may be the first
                if (ba >= bb and same_description(a, b, frequent)) or (bb >= ba and same_description(b, a, frequent)):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    side = lambda k: texts.select(F.col("class").alias(k), F.col("words").alias(f"w{k}"), F.col("batch").alias(f"b{k}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "wa", "ba", "wb", "bb")
    return joined.mapInArrow(run, "a bigint, b bigint")


def _tallied(classes: DataFrame, codes, words: int, least: float) -> dict[int, int]:
    """How many classes have every code that ``codes`` finds in a list of texts, of those that at least ``least`` have.

    Counted over all classes. A class has few codes, so those that a fixed share
    of all classes has do not become more with the data.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed() -> pa.RecordBatch:
            code, n = tally(np.concatenate(held), words)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"])

        held: list[np.ndarray] = []
        for batch in batches:
            held.append(codes(pc.split_pattern(batch.column(0), " ")))
            if sum(map(len, held)) > COUNTED:
                yield summed()
        if held:
            yield summed()

    found = classes.select("words").mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toArrow()
    return dict(zip(found.column("code").to_pylist(), found.column("n").to_pylist()))


def learn(classes: DataFrame) -> tuple[dict[str, int], int, tuple[dict[str, str], dict[str, tuple[str, int]]]]:
    """Frequencies of words, the number of classes, and phrases, all from every class."""
    known, total = _frequencies(classes), classes.count()
    number = often_words(known, total)
    if not number:
        return known, total, ({}, {})
    # a task gets the counts of the frequent words only
    known_often = {w: known[w] for w in number}
    least = min(known_often.values())
    phrase = linked_words(number, known, _tallied(classes, lambda texts: pairs_of(texts, number, known_often), len(number), max(SEEN, TOGETHER * least)))
    if (phrase < 0).all():
        return known, total, ({}, {})
    return known, total, named(number, known, phrase, _tallied(classes, lambda texts: homes_of(texts, number, phrase), len(number), AT_HOME * max(SEEN, least)))


def hot_keys(classes: DataFrame, shared, part: int = PART, looked_at: int = LOOKED_AT) -> dict[int, int]:
    """Parts of every key that more than ``part`` classes are expected to share, from one class in ``looked_at``."""
    some = classes.where(F.pmod("class", F.lit(looked_at)) == 0)
    counts = key_rows(some, shared, {}).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part / looked_at)
    return {r.key & ((1 << 64) - 1): -(-r.n * looked_at // part) for r in counts.collect()}  # at most keys / part rows


def like_classes(classes: DataFrame, part: int = PART) -> DataFrame:
    """``a, b``: classes that give the same description, from ``class, words, batch`` (the class's first batch)."""
    known, total, phrase = learn(classes)
    shared = share(classes.sparkSession, known, total, phrase)
    classes = _with_rarer(classes, known)
    pairs = stage(offered_pairs(key_rows(classes, shared, hot_keys(classes, shared, part))), "offered")
    return compared(pairs, classes, shared)


def settle(records: DataFrame, like: DataFrame, rounds: int = 1000) -> DataFrame:
    """``id, refused_by_address, refused_by_caption`` of every refused record: the first accepted one that it repeats.

    ``records`` has id, batch, address and class. Batch 0 is accepted as it is.
    The rounds needed are the length of the longest chain of records that
    depend on each other; each settles at least the first of every chain.
    """
    both = stage(like.select("a", "b").union(like.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "like")
    linked = both.select(F.col("a").alias("class")).distinct()
    many_a = records.where("address IS NOT NULL").groupBy("address").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("address")
    many_c = records.where("class IS NOT NULL").groupBy("class").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("class").union(linked).distinct()
    # only records that share something with another need settling
    tied = (
        records.join(many_a.withColumn("ta", F.lit(True)), "address", "left")
        .join(many_c.withColumn("tc", F.lit(True)), "class", "left")
        .where("ta OR tc")
        .select("id", "batch", F.when(F.col("ta"), F.col("address")).alias("address"), F.when(F.col("tc"), F.col("class")).alias("class"), F.struct("batch", "id").alias("ord"))
    )
    state = stage(tied.withColumn("state", F.when(F.col("batch") == 0, F.lit("accepted")).otherwise(F.lit("open"))), "state")
    first = lambda of: F.min(F.when(F.col("state") == of, F.col("ord")))
    for _ in range(rounds):
        if state.where("state = 'open'").isEmpty():
            break
        by_a = state.where("address IS NOT NULL").groupBy("address").agg(first("accepted").alias("aa"), first("open").alias("ao"))
        by_c = state.where("class IS NOT NULL").groupBy("class").agg(first("accepted").alias("ca"), first("open").alias("co"))
        by_l = by_c.join(both, F.col("class") == F.col("b")).groupBy(F.col("a").alias("class")).agg(F.min("ca").alias("la"), F.min("co").alias("lo"))
        seen = state.join(by_a, "address", "left").join(by_c, "class", "left").join(by_l, "class", "left")
        before = lambda c: F.coalesce(F.col(c) < F.col("ord"), F.lit(False))
        refused = before("aa") | before("ca") | before("la")
        waits = before("ao") | before("co") | before("lo")
        now = F.when(F.col("state") != "open", F.col("state")).when(refused, F.lit("refused")).when(~waits, F.lit("accepted")).otherwise(F.lit("open"))
        state = stage(seen.withColumn("state", now).select(*state.columns), "state")
    accepted = state.where("state = 'accepted'")
    by_a = accepted.where("address IS NOT NULL").groupBy("address").agg(F.min("ord").alias("aa"))
    by_c = accepted.where("class IS NOT NULL").groupBy("class").agg(F.min("ord").alias("ca"))
    by_l = by_c.join(both, F.col("class") == F.col("b")).groupBy(F.col("a").alias("class")).agg(F.min("ca").alias("la"))
    out = state.where("state = 'refused'").join(by_a, "address", "left").join(by_c, "class", "left").join(by_l, "class", "left")
    earlier = lambda c: F.when(F.col(c) < F.col("ord"), F.col(c))
    return out.select("id", earlier("aa")["id"].alias("refused_by_address"), F.coalesce(earlier("ca"), earlier("la"))["id"].alias("refused_by_caption"))


def refused_records(images: DataFrame) -> DataFrame:
    """Refused records of all batches, each with the accepted record it repeats.

    Batches arrive in order, within a batch records by id. A record with
    neither address nor a comparable caption repeats nothing. Other columns are
    ignored; an empty table gives an empty result.
    """
    records = stage(parse(images), "parsed")
    classes = records.where("class IS NOT NULL").groupBy("class").agg(F.min("batch").alias("batch"), F.min("words").alias("words"))
    like = stage(like_classes(stage(classes, "classes")), "pairs")
    return settle(records.drop("words"), like)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Refused records with the accepted ones they repeat, the smaller id first."""
    out = refused_records(table(spark, folder, "images"))
    pairs = out.select("id", F.explode(F.array("refused_by_address", "refused_by_caption")).alias("other")).where("other IS NOT NULL")
    return pairs.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def p7_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Per batch the records, and those refused by address and by caption."""
    images = table(spark, folder, "images")
    out = refused_records(images)
    batches = images.where("id IS NOT NULL AND batch IS NOT NULL").groupBy("id").agg(F.min("batch").alias("batch"))
    return (
        batches.join(out, "id", "left").groupBy("batch")
        .agg(
            F.count(F.lit(1)).alias("records"),
            F.count("refused_by_address").alias("by_address"),
            F.count("refused_by_caption").alias("by_caption"),
            F.count_if(F.col("refused_by_address").isNull() & F.col("refused_by_caption").isNull()).alias("accepted"),
        )
    )


QUERIES = {"p7_found": p7_found, "p7_batches": p7_batches}
