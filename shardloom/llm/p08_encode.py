"""Problem 8: every text as token ids of a public byte-level vocabulary.

Method: rank queue over a hierarchical bitmap (``bpe``). The vocabulary is
broadcast as bytes (its size is fixed, under 2 MB); each Python worker builds
its tables once. Texts stay in their input partitions, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..io import table
from .bpe import Encoder, load_ranks

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

_ENCODERS: dict[str, Encoder] = {}


def _encoder(vocabulary: str, ranks) -> Encoder:
    """The Python worker's encoder, built once from the broadcast vocabulary."""
    if vocabulary not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[vocabulary] = Encoder(ranks.value)
    return _ENCODERS[vocabulary]


def encode_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``key, ids``: one row per input row, ids without special tokens.

    Null and empty texts give an empty list; a text's special-token strings
    are ordinary text. Repeated rows give repeated rows; other columns are
    ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(load_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, ranks)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            # pieces of bounded size, so that a batch of long texts needs no large list
            for start in range(0, batch.num_rows, 500):
                part = [encoder.encode(t) for t in texts.slice(start, 500).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(p) for p in part])]).astype("i4")
                flat = np.concatenate([np.frombuffer(p, "i4") for p in part if len(p)] or [np.empty(0, "i4")])
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                yield pa.RecordBatch.from_arrays([keys.slice(start, 500), ids], names=[key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(f"`{key}`", f"`{text}`").mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``key, tokens``: number of ids of every text, 0 for null and empty ones."""
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(load_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, ranks)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                counts = pa.array([encoder.count(t) for t in part.column(1).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), counts], names=[key, "tokens"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(f"`{key}`", f"`{text}`").mapInArrow(run, f"`{key}` {kind}, tokens bigint")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_documents(table(spark, folder, "documents"))


QUERIES = {"p8_ids": p8_ids}
