"""Problem 10: the reading level of each document.

Method: words are ranked by their frequency in all documents. A document's
coverage rank is the size of the smallest frequency-ranked vocabulary that
covers a fixed share of its words, which is that quantile of its words' ranks.
Coverage rank and sentence complexity (letters per word, share of long words,
words per sentence) are calibrated on the graded samples: one logistic cut
between every two neighbouring levels, so that the distance between classes
and not their means places the cut. The score is a column expression.

Texts are read twice, in Arrow batches, and never shuffled: once for the word
counts, which are added up inside a task first, and once for the measures. The
most frequent words, whose number is fixed, are broadcast. Only where a
document's covering word lies beyond them are its rarer words joined to their
ranks.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..io import table
from ..session import stage
from .languages import FUNCTION_WORDS

#: Share of a document's words its vocabulary has to cover.
COVERED = 0.9
#: Words whose ranks are broadcast at most (under 2 MB).
BROADCAST_WORDS = 50_000
#: Different words a task counts before it hands its counts on.
COUNTED_AT_ONCE = 200_000
LONG = 9
LEAST_WORDS = 25
#: Graded samples that are fitted at most; of more, those with the smallest hashes of their texts.
MOST_SAMPLES = 20_000

WORD = re.compile(r"[a-z]+(?:['-][a-z]+)*")
SENTENCE_END = re.compile(r"[.!?…]+[\"')\]]*(?=\s|$)")
TOKEN = re.compile(r"(?:[^\W\d_]|['-])+")
LETTERS = re.compile(r"[^\W\d_]+")
#: Whole words with at most a mark at either end, as running text has them.
CLEAN = re.compile(r"(?<!\S)[(\[\"'«„“]*[^\W\d_](?:[^\W\d_]|['-])*[)\]\"'»”.,;:!?…]*(?!\S)")
DASHES = str.maketrans("’‘ʼ‐‑–", "'''---")

MEASURES = "n int, ends int, letters_per_word double, long_share double, clean_share double, ascii_share double, english_hits int, other_hits int"


def plain(text: str) -> str:
    """Lower case, ligatures and marks resolved, every kind of space a plain one."""
    out = text.lower()
    if not out.isascii():
        out = out.replace("ﬃ", "ffi").replace("ﬁ", "fi").replace("ﬂ", "fl").translate(DASHES)
        out = "".join([c if c.isalnum() or (k := unicodedata.category(c)) not in ("Mn", "Cf", "Zs") else " " if k == "Zs" else "" for c in out])
    return out


def measures(t: str, words: list[str]) -> list:
    """The values of MEASURES for a plain text and its words."""
    n = len(words)
    hits = Counter(lang for token in TOKEN.findall(t) for lang in FUNCTION_WORDS.get(token, ()))
    raw = len(t.split())
    letters = ascii_letters = 0
    if not t.isascii():
        found = LETTERS.findall(t)
        letters = sum(map(len, found))
        ascii_letters = sum(sum(c <= "z" for c in w) if not w.isascii() else len(w) for w in found)
    return [
        n,
        len(SENTENCE_END.findall(t)),
        sum(map(len, words)) / max(n, 1),
        sum(len(w) >= LONG for w in words) / max(n, 1),
        len(CLEAN.findall(t)) / raw if raw else None,
        ascii_letters / letters if letters else 1.0,
        hits.pop("en", 0),
        max(hits.values(), default=0),
    ]


def word_ranks(docs: DataFrame, text: str) -> DataFrame:
    """``word, rank`` over all documents: the number of words that are at least as frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(counts: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        counts: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    counts.update(WORD.findall(plain(t)))
                if len(counts) > COUNTED_AT_ONCE:
                    yield rows(counts)
                    counts = Counter()
        yield rows(counts)

    counts = stage(docs.select(text).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "words")
    # one row per frequency: of N words in running text at most about sqrt(2 N)
    steps = counts.groupBy("n").agg(F.count(F.lit(1)).alias("c"))
    upward = Window.partitionBy(F.lit(0)).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    return counts.join(steps.select("n", F.sum("c").over(upward).alias("rank")), "n").select("word", "rank")


class Ranks:
    """The ranks of the broadcast words, those of the others as a table, and the size of the vocabulary."""

    def __init__(self, ranked: DataFrame, broadcast: int) -> None:
        rows = ranked.where(F.col("rank") <= broadcast).toArrow()  # at most as many rows
        frequent = dict(zip(rows.column("word").to_pylist(), rows.column("rank").to_pylist()))
        self.shared = ranked.sparkSession.sparkContext.broadcast(frequent)
        self.rare = ranked.where(F.col("rank") > broadcast)
        self.size = ranked.count()


def measured_texts(docs: DataFrame, key: str, text: str, ranks: Ranks, covered: float = COVERED) -> DataFrame:
    """``k``, MEASURES and ``coverage_rank`` of every row with a key; words the ranking does not have rank behind all.

    A null text counts as empty and has a null coverage rank, as any text without words.
    """
    shared, kind = ranks.shared, docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            out: list[list] = []
            for t in batch.column(1).to_pylist():
                t = plain(t or "")
                words = WORD.findall(t)
                own = sorted([known[w] for w in words if w in known])
                need = ceil(len(words) * covered)
                # beyond the broadcast words: which of the rarer ones covers is found by a join
                beyond = need > len(own)
                out.append([*measures(t, words), own[need - 1] if need and not beyond else None, need - len(own) if beyond else None, [w for w in words if w not in known] if beyond else None])
            columns = list(zip(*out)) if out else [()] * len(shape)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, f.type) for c, f in zip(columns, shape)]], names=["k", *[f.name for f in shape]])

    schema = f"{MEASURES}, rank bigint, need int, rarer array<string>"
    shape = to_arrow_schema(StructType.fromDDL(schema))
    first = stage(docs.where(F.col(key).isNotNull()).select(key, text).mapInArrow(run, f"k {kind}, {schema}"), "measured")
    words = first.where("need IS NOT NULL").select("k", "need", F.explode("rarer").alias("word")).join(ranks.rare, "word", "left")
    places = F.array_sort(F.collect_list(F.coalesce("rank", F.lit(ranks.size + 1))))
    late = words.groupBy("k", "need").agg(places.alias("places")).select("k", F.element_at("places", F.col("need")).alias("late"))
    return first.drop("need", "rarer").join(late, "k", "left").withColumn("coverage_rank", F.coalesce("rank", "late")).drop("rank", "late")


FEATURES = ["letters", "long", "log_sentence", "log_rank"]
#: Ridge of each feature's weight, in units of the samples' spread. The rank depends on what else is in the collection and is shrunk most.
RIDGE = [0.05, 0.05, 0.05, 1.0]


def _features(measured: DataFrame) -> DataFrame:
    return measured.withColumns(
        {
            "words_per_sentence": F.col("n") / F.greatest("ends", F.lit(1)),
            "letters": F.col("letters_per_word"),
            "long": F.col("long_share"),
            "log_rank": F.ln("coverage_rank"),
        }
    ).withColumn("log_sentence", F.ln("words_per_sentence"))


def logistic(x: np.ndarray, y: np.ndarray, ridge: list[float], steps: int = 80) -> np.ndarray:
    """Intercept and weights by Newton steps; the ridge keeps them finite where the classes are apart."""
    x1 = np.column_stack([np.ones(len(x)), x])
    w, shrink = np.zeros(x1.shape[1]), np.diag([1e-9, *ridge])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        move = np.linalg.solve((x1 * (p * (1 - p) + 1e-9)[:, None]).T @ x1 + shrink, x1.T @ (y - p) - shrink @ w)
        w += move
        if np.abs(move).max() < 1e-8:
            break
    return w


def calibrate(x: np.ndarray, levels: np.ndarray) -> dict[int, list[float]]:
    """For every level but the lowest, intercept and weights of the cut below it, on FEATURES as they are."""
    middle, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    cuts = {}
    for level in sorted(set(levels.tolist()))[1:]:
        w = logistic((x - middle) / spread, (levels >= level).astype("f8"), RIDGE)
        cuts[int(level)] = [float(w[0] - (w[1:] * middle / spread).sum()), *(w[1:] / spread).tolist()]
    return cuts


def reading_levels(
    docs: DataFrame, samples: DataFrame, key: str = "doc_id", text: str = "text", sample_text: str = "text", level: str = "level", broadcast: int = BROADCAST_WORDS
) -> DataFrame:
    """``key, words, coverage_rank, letters_per_word, long_share, words_per_sentence, english_prose, score, level``.

    One row per document with a key; keys are unique. The level is the highest
    of the samples' levels whose cut the document passes; the score is the
    lowest level plus the probabilities of passing each cut, weighted by the
    step to the next level. Documents without a word (null, empty, blank, other
    scripts) have null measures and level and are no English prose. English
    prose has at least 25 words, sentences, clean words and no other language's
    function words in the majority, whatever ``lang`` says. Repeated texts get
    the same level. Samples with a null text or level, or without a word, are
    ignored; of samples of one level all texts have it, without samples the
    level is null.
    """
    ranks = Ranks(stage(word_ranks(docs, text), "ranks"), broadcast)
    measured = _features(measured_texts(docs, key, text, ranks))
    graded = samples.where(F.col(sample_text).isNotNull() & F.col(level).isNotNull())
    graded = graded.select(F.xxhash64(sample_text, level).alias("__s"), F.col(sample_text).alias("__t"), F.col(level).cast("int").alias("level"))
    graded = graded.groupBy("__s").agg(F.first("__t").alias("__t"), F.first("level").alias("level")).orderBy("__s").limit(MOST_SAMPLES)
    known = _features(measured_texts(graded, "__s", "__t", ranks)).where("n > 0")
    rows = known.join(graded.select(F.col("__s").alias("k"), "level"), "k").select("level", *FEATURES).orderBy("level", *FEATURES).toArrow()
    levels = rows.column("level").to_numpy()
    cuts = calibrate(np.column_stack([rows.column(c).to_numpy() for c in FEATURES]), levels) if len(levels) else {}
    steps = sorted(set(levels.tolist()))
    score, reached = F.lit(float(steps[0]) if steps else None), F.lit(steps[0] if steps else None).cast("int")
    for below, (at, weights) in zip(steps, cuts.items()):
        z = reduce(lambda a, b: a + b, [F.lit(w) * F.col(c) for w, c in zip(weights[1:], FEATURES)], F.lit(weights[0]))
        score = score + (at - below) / (1.0 + F.exp(-z))
        reached = F.when(z > 0, F.lit(at)).otherwise(reached)
    prose = (
        (F.col("n") >= LEAST_WORDS)
        & (F.col("ends") >= 1)
        & (F.col("words_per_sentence") <= 120)
        & (F.col("clean_share") >= 0.85)
        & (F.col("ascii_share") >= 0.97)
        & ((F.col("other_hits") <= F.col("english_hits")) | (F.col("other_hits") < 0.04 * F.col("n")))
    )
    any_word = F.col("n") > 0
    return measured.select(
        F.col("k").alias(key),
        F.col("n").alias("words"),
        "coverage_rank",
        *[F.when(any_word, F.round(c, 6)).alias(c) for c in ("letters_per_word", "long_share", "words_per_sentence")],
        F.coalesce(prose, F.lit(False)).alias("english_prose"),
        F.when(any_word, F.round(score, 6)).alias("score"),
        F.when(any_word, reached).alias("level"),
    )


def _levels(spark: SparkSession, folder: str) -> DataFrame:
    return reading_levels(table(spark, folder, "documents"), table(spark, folder, "level_samples"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """English prose of level 3."""
    return _levels(spark, folder).where("english_prose AND level = 3").select("doc_id")


def p10_levels(spark: SparkSession, folder: str) -> DataFrame:
    return _levels(spark, folder)


def p10_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share of each level in the collection; documents without a level have a null one."""
    counted = _levels(spark, folder).groupBy("level").agg(F.count(F.lit(1)).alias("documents"), F.count_if("english_prose").alias("english_prose"))
    return counted.withColumn("share", F.round(F.col("documents") / F.sum("documents").over(Window.partitionBy(F.lit(0))), 6))


QUERIES = {"p10_found": p10_found, "p10_levels": p10_levels, "p10_shares": p10_shares}
