"""Problem 9: oversized texts cut into pieces under a token limit by content-defined chunking.

A rolling hash over the last tokens marks landmarks. From where a piece begins, the first landmark between the
minimum and the maximum size is taken (the position of the least hash if there is none) and snapped to the nearest
natural boundary around it: the end of a paragraph, else of a line, a sentence, a word. Where a stretch has
none at all the cut stays at the landmark, on a whole character if possible. Landmarks depend on nearby
tokens only, so an edit changes pieces around it and later cuts fall back into step.

The next piece begins `overlap` tokens before the cut, so consecutive pieces share exactly that many tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dhruva.llm.bpe import load
from dhruva.llm.encoding import RANKS, encoded_batches
from dhruva.session import spread

LIMIT, OVERLAP = 1_000, 50
WINDOW = 16  # tokens under the rolling hash
MARK = 7  # one position in 2^MARK is a landmark
SLACK = 16  # tokens left free in a piece that begins within a word, as its text may need a few more when encoded alone
SNAP = 220  # tokens around a landmark within which a boundary of a higher kind wins over a nearer lower one

# Blanks, line ends, sentence ends and what may close a sentence after them (fixed values).
WIDE_BLANKS = "\x85\xa0                　"
LINE_ENDS, WIDE_LINE_ENDS = b"\n\r\x0b\x0c", "\x85  "
ENDERS, WIDE_ENDERS = b".!?", "…।॥。！？"
CLOSERS, WIDE_CLOSERS = b"\"')]", "”’"
KINDS = ("paragraph", "line", "sentence", "word", "character", "none", "end")


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling_hash(ids: np.ndarray) -> np.ndarray:
    """Hash of the WINDOW tokens before each token boundary 0..n (fewer at the start)."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(ids.astype(np.uint64)), dtype=np.uint64)))
    back = np.maximum(np.arange(len(sums)) - WINDOW, 0)
    return _mix(sums - sums[back])


def _of(members: bytes) -> np.ndarray:
    """Which byte values are among ``members``."""
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


_BLANK, _LINE, _ENDER, _CLOSER = _of(b" \t\n\r\x0b\x0c"), _of(LINE_ENDS), _of(ENDERS), _of(CLOSERS)


def _wide(raw: np.ndarray, text: str, chars: str) -> list[tuple[np.ndarray, int]]:
    """(start, bytes) of each of the non-ASCII ``chars`` that occur in the text."""
    out = []
    for c in chars if not text.isascii() else "":
        if c in text:
            code = c.encode()
            hit = raw[: len(raw) - len(code) + 1] == code[0]
            for k in range(1, len(code)):
                hit = hit & (raw[k : len(raw) - len(code) + 1 + k] == code[k])
            out.append((np.flatnonzero(hit), len(code)))
    return out


def boundaries(text: str, ends: np.ndarray) -> np.ndarray:
    """Kind of each token boundary 0..n, an index of KINDS; ``ends`` are the UTF-8 offsets of the boundaries.

    A word ends before and after a blank, a sentence after its mark and closing quotes if a blank follows, a line after
    its line end, a paragraph after an empty line.
    """
    raw = np.frombuffer(text.encode(), np.uint8)
    n = len(raw)
    kind = np.full(n + 1, 4, np.int8)
    kind[:n][(raw & 0xC0) == 0x80] = 5
    blank = _BLANK[raw]
    for at, size in _wide(raw, text, WIDE_BLANKS):
        for k in range(size):
            blank[at + k] = True
    edge = np.flatnonzero(np.diff(blank, prepend=False, append=False))
    kind[edge] = 3

    open_ = np.append(blank, True)
    marks = [np.flatnonzero(_ENDER[raw]) + 1, *(at + size for at, size in _wide(raw, text, WIDE_ENDERS))]
    at = np.concatenate(marks)
    wide = [(set(a.tolist()), size) for a, size in _wide(raw, text, WIDE_CLOSERS)]
    while len(at):
        kind[at[open_[at]]] = 2
        at = at[(at < n) & ~open_[at]]
        closed = at[_CLOSER[raw[at]]] + 1
        more = [np.array([x + size for x in at.tolist() if x in starts], np.int64) for starts, size in wide]
        at = np.concatenate([closed, *more])

    line = np.flatnonzero(_LINE[raw])
    line = line[~((raw[line] == 13) & (np.append(raw, 0)[line + 1] == 10))] + 1
    line = np.sort(np.concatenate([line, *(a + size for a, size in _wide(raw, text, WIDE_LINE_ENDS))]))
    if len(line):
        kind[line] = 1
        filled = np.concatenate(([0], np.cumsum(~blank)))
        kind[line[1:][filled[line[1:]] == filled[line[:-1]]]] = 0
        for a, size in _wide(raw, text, "\u2029"):
            kind[a + size] = 0
    return kind[ends]


def cut(ids: np.ndarray, kind: np.ndarray, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(first token, end, kind of the end) of each piece; one piece if the text is within the limit."""
    n = len(ids)
    marks_hash = rolling_hash(ids)
    landmark = np.flatnonzero((marks_hash >> np.uint64(64 - MARK)) == 0)
    natural = [np.flatnonzero(kind == k) for k in range(5)]
    least, slack = limit // 2, min(SLACK, limit // 10)
    out, start = [], 0
    while n - start > (room := limit - (slack if start else 0)):
        low, high = start + least, start + room
        i = np.searchsorted(landmark, low)
        at = int(landmark[i]) if i < len(landmark) and landmark[i] <= high else low + int(np.argmin(marks_hash[low : high + 1]))
        end, k_end = at, 5
        for reach in (SNAP, limit):
            a, b = max(low, at - reach), min(high, at + reach)
            for k in range(4 if reach == SNAP else 5):
                w = natural[k]
                j = np.searchsorted(w, at)
                near = [int(x) for x in w[max(j - 1, 0) : j + 1] if a <= x <= b]
                if near:
                    end, k_end = min(near, key=lambda x: (abs(x - at), x)), k
                    break
            if k_end < 5:
                break
        out.append((start, end, k_end))
        start = end - overlap
    out.append((start, n, 6))
    return out


def split_oversized(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True, ranks: str = RANKS
) -> DataFrame:
    """Pieces ``(id, piece, first_token, n_tokens, cut, tokens, text)`` of every text of more than ``limit`` tokens.

    ``piece`` counts from 0; ``tokens`` are the piece's ids, at most ``limit``; the last ``overlap`` of one piece are
    the first of the next. ``text`` is the piece's text: whole characters that begin in it, so a character that an
    overlap starts within belongs to the piece before. ``cut`` says at what the piece ends. Null, empty
    and smaller texts give no row; repeated rows are cut each for itself; other columns are ignored.
    """
    if limit < 8 or not 0 <= overlap < limit // 3:
        raise ValueError("overlap must be less than a third of limit")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    fields = [rows.schema["id"], T.StructField("piece", T.IntegerType()), T.StructField("first_token", T.LongType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("cut", T.StringType())]
    if with_text:
        fields += [T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("text", T.StringType())]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = load(ranks).token_bytes
        for batch in batches:
            for start, texts, encoded in encoded_batches(batch, "text", ranks):
                rows_, piece, first, size, kinds, tokens, parts = [], [], [], [], [], [], []
                for i, (text, data) in enumerate(zip(texts, encoded)):
                    if len(data) // 4 <= limit:
                        continue
                    ids, raw = np.frombuffer(data, "<i4"), text.encode()
                    ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(lengths[ids])))
                    for k, (a, b, kind) in enumerate(cut(ids, boundaries(text, ends), limit, overlap)):
                        rows_.append(start + i), piece.append(k), first.append(a), size.append(b - a), kinds.append(KINDS[kind])
                        if with_text:
                            x, y = int(ends[a]), int(ends[b])
                            while x < y and raw[x] & 0xC0 == 0x80:
                                x += 1
                            while y < len(raw) and raw[y] & 0xC0 == 0x80:
                                y += 1
                            tokens.append(ids[a:b]), parts.append(raw[x:y].decode())
                cols = [batch.column("id").take(pa.array(rows_, pa.int64())), pa.array(piece, pa.int32()), pa.array(first, pa.int64()), pa.array(size, pa.int32()), pa.array(kinds, pa.string())]
                if with_text:
                    flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int32)
                    offsets = np.cumsum([0, *map(len, tokens)]).astype(np.int32)
                    cols += [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32())), pa.array(parts, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return spread(rows).mapInArrow(run, T.StructType(fields)).withColumnRenamed("id", id_col)
