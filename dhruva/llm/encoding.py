"""Problem 7: the corpus as token ids of a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dhruva.llm.bpe import load
from dhruva.session import spread

#: Rank file; its place is a parameter of every operator and never part of the repository.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Characters encoded at a time, so that a batch of long texts does not fill a worker.
BATCH_CHARS = 3_000_000


def encoded_batches(batch: pa.RecordBatch, column: str, ranks: str) -> Iterator[tuple[int, list[str | None], list[bytes]]]:
    """(first row, texts, ids of each) of slices of a batch of at most BATCH_CHARS, one text at least."""
    bpe, texts = load(ranks), batch.column(column).to_pylist()
    start, held = 0, 0
    for i, text in enumerate(texts):
        size = len(text) if text else 0
        if held and held + size > BATCH_CHARS:
            yield start, texts[start:i], bpe.encode(texts[start:i])
            start, held = i, 0
        held += size
    if start < len(texts):
        yield start, texts[start:], bpe.encode(texts[start:])


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS) -> DataFrame:
    """One row ``(id, ids)`` for each row of ``docs``: the token ids of its whole text, no special tokens.

    Null and empty texts have an empty list; strings that look like special tokens are ordinary text; repeated
    rows come out as often as they go in; other columns are ignored, whatever their names. The job is one scan
    and one Arrow map, without a shuffle; no text is cut.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts, ids in encoded_batches(batch, "text", ranks):
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
                values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(start, len(texts)), lists], names=["id", "ids"])

    return spread(rows).mapInArrow(run, schema).select(F.col("id").alias(id_col), "ids")


def token_counts(docs: DataFrame, keep: list[str], text_col: str = "text", ranks: str = RANKS, name: str = "tokens") -> DataFrame:
    """``keep`` columns and the token count of each row's whole text; 0 for null and empty texts."""
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [len(x) // 4 for _, _, ids in encoded_batches(batch, "__text", ranks) for x in ids]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(counts, pa.int64())], names=[*keep, name])

    return spread(rows).mapInArrow(run, schema)
