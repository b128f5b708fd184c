"""Problem 5: same or near-same records across splits by a weighted cosine join.

A text is the vector of its distinct words, each with weight 1 ("unit") or its inverse document frequency ("idf"),
scaled to norm 1. Words are ordered from rare to frequent. Inverted lists hold only the leading words of a vector:
as soon as what follows cannot reach the threshold any more - its norm is below it, or the sum of its weights times
the largest weight of each word in any vector is - the rest is left out. Two vectors with a dot product of at least
the threshold share one of those leading words. A list entry also carries its position and the norm that is left,
which bound the product of a pair met there; survivors get their exact product from the whole vectors.

Word frequencies and largest weights are kept for 2^BITS hash buckets, so what is broadcast has a fixed size; words
that share a bucket only make the order and the bounds a little looser, never wrong.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dhruva.llm.confusables import with_shapes, words
from dhruva.session import materialise

BITS = 18
EPS = 1e-9


@lru_cache(maxsize=1 << 16)
def _word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def word_sets(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``text`` replaced by ``terms``: the sorted hashes of its distinct words."""
    keep = [c for c in rows.columns if c != text]
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("terms", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted(map(_word_hash, set(words(t)))) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(terms, pa.list_(pa.int64()))], names=[*keep, "terms"])

    return rows.select(*keep, text).mapInArrow(with_shapes(rows.sparkSession, run), schema)


def _bucket(terms: np.ndarray) -> np.ndarray:
    return terms & ((1 << BITS) - 1)


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and row ends of a list column without nulls."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]


def cosine_pairs(left: DataFrame, right: DataFrame, threshold: float, weighting: str = "unit") -> DataFrame:
    """Pairs of word sets ``(l, r, common, n_l, n_r, cosine)`` with a cosine of at least ``threshold``.

    ``left`` and ``right`` have distinct ``(vid long, terms array<long>)``; vectors of equal terms have equal ids.
    Empty sets have no direction and pair with nothing.
    """
    if weighting not in ("unit", "idf"):
        raise ValueError("weighting is unit or idf")
    spark = left.sparkSession
    both = left.select("vid", "terms", F.lit(True).alias("l"), F.lit(False).alias("r"))
    both = both.union(right.select("vid", "terms", F.lit(False), F.lit(True))).where("size(terms) > 0")
    both = both.groupBy("vid", "terms").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    vectors = materialise(both, "vectors")
    size = 1 << BITS

    # Frequencies of all words by bucket: at most 2^BITS rows reach the driver.
    of_bucket = F.expr(f"cast(term & {size - 1} as int)")
    posts = vectors.select("vid", F.explode("terms").alias("term")).groupBy(of_bucket.alias("b")).count().toPandas()
    df = np.zeros(size, np.int64)
    df[posts["b"]] = posts["count"]
    total = vectors.count()
    idf = np.ones(size) if weighting == "unit" else np.log(1.0 + total / np.maximum(df, 1))

    # Largest scaled weight of each bucket, over all vectors.
    shared = spark.sparkContext.broadcast((df, idf))

    def maxima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = shared.value[1]
        top = np.zeros(size)
        for batch in batches:
            terms, ends = _flat(batch.column("terms"))
            w = idf[_bucket(terms)]
            norms = np.sqrt(np.add.reduceat(w * w, ends[:-1])) if len(terms) else np.zeros(0)
            np.maximum.at(top, _bucket(terms), w / np.repeat(norms, np.diff(ends)))
        at = np.flatnonzero(top)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(top[at])], names=["b", "w"])

    tops = vectors.select("terms").mapInArrow(maxima, "b int, w double").groupBy("b").agg(F.max("w").alias("w")).toPandas()
    most = np.zeros(size)
    most[tops["b"]] = tops["w"]
    shared_most = spark.sparkContext.broadcast(most)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (df, idf), most = shared.value, shared_most.value
        for batch in batches:
            terms, ends = _flat(batch.column("terms"))
            if not len(terms):
                continue
            counts = np.diff(ends)
            row = np.repeat(np.arange(len(counts)), counts)
            order = np.lexsort((terms, df[_bucket(terms)], row))
            terms = terms[order]
            w = idf[_bucket(terms)]
            w = w / np.sqrt(np.add.reduceat(w * w, ends[:-1]))[row]
            # What the words from here on can still add, by norm and by largest weights.
            squares, products = np.cumsum(w * w), np.cumsum(w * most[_bucket(terms)])
            last = ends[1:] - 1
            rest2 = squares[last][row] - squares + w * w
            rest = np.sqrt(np.maximum(rest2, 0))
            bound = np.minimum(rest, products[last][row] - products + w * most[_bucket(terms)])
            keep = np.flatnonzero(bound >= threshold - 1e-7)
            sign = np.zeros((len(counts), 2), np.uint64)
            bits = np.uint64(1) << (terms & 63).astype(np.uint64)
            high = (terms >> 6) & 1
            for half in (0, 1):
                part = np.where(high == half, bits, np.uint64(0))
                sign[:, half] = np.bitwise_or.reduceat(part, ends[:-1])
            r = row[keep]
            names = ["term", "vid", "n", "w", "rest", "s0", "s1", "l", "r"]
            cols = [terms[keep], batch.column("vid").to_numpy()[r], counts[r].astype(np.int32), w[keep], np.sqrt(np.maximum(rest2[keep] - w[keep] ** 2, 0)), sign[r, 0].view(np.int64), sign[r, 1].view(np.int64)]
            flags = [batch.column(c).to_numpy(zero_copy_only=False)[r] for c in ("l", "r")]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*cols, *flags)], names=names)

    schema = "term long, vid long, n int, w double, rest double, s0 long, s1 long, l boolean, r boolean"
    entries = vectors.mapInArrow(lists, schema)
    a = entries.where("l").select("term", *(F.col(c).alias(f"{c}_l") for c in ("vid", "n", "w", "rest", "s0", "s1")))
    b = entries.where("r").select("term", *(F.col(c).alias(f"{c}_r") for c in ("vid", "n", "w", "rest", "s0", "s1")))
    # At the first word that two vectors share, the bound holds; later ones need not pass.
    within = F.col("w_l") * F.col("w_r") + F.col("rest_l") * F.col("rest_r") >= threshold - 1e-7
    if weighting == "unit":
        differing = F.expr("bit_count(s0_l ^ s0_r) + bit_count(s1_l ^ s1_r)")
        within = within & (differing <= F.col("n_l") + F.col("n_r") - 2 * threshold * F.sqrt(F.col("n_l") * F.col("n_r")) + 1e-6)
    candidates = a.join(b, "term").where(within).select("vid_l", "vid_r").distinct()

    whole = vectors.select("vid", "terms")
    met = candidates.join(whole.select(F.col("vid").alias("vid_l"), F.col("terms").alias("t_l")), "vid_l")
    met = met.join(whole.select(F.col("vid").alias("vid_r"), F.col("terms").alias("t_r")), "vid_r")
    met = met.select("vid_l", "vid_r", F.array_intersect("t_l", "t_r").alias("both"), F.size("t_l").alias("n_l"), F.size("t_r").alias("n_r"), "t_l", "t_r")
    if weighting == "unit":
        cosine = F.size("both") / F.sqrt(F.col("n_l").cast("double") * F.col("n_r"))
    else:

        @F.pandas_udf(T.DoubleType())
        def square_sum(terms: pd.Series) -> pd.Series:
            idf = shared.value[1]
            return terms.map(lambda t: float((idf[_bucket(np.asarray(t, np.int64))] ** 2).sum()))

        cosine = square_sum("both") / F.sqrt(square_sum("t_l") * square_sum("t_r"))
    out = met.select(F.col("vid_l").alias("l"), F.col("vid_r").alias("r"), F.size("both").alias("common"), "n_l", "n_r", cosine.alias("cosine"))
    return out.where(F.col("cosine") >= threshold - EPS)


def split_name(column: str) -> F.Column:
    """train, validation or test; null for anything else."""
    s = F.lower(F.trim(F.regexp_replace(column, r"[\s\p{Z}\p{Cf}]+", " ")))
    return F.when(s.isin("train", "training"), "train").when(s.isin("validation", "val", "dev"), "validation").when(s == "test", "test")


def cross_split_overlaps(rows: DataFrame, id_col: str, text_col: str, split_col: str, jaccard: float = 0.8) -> DataFrame:
    """Pairs ``(train_id, eval_id, eval_split, shared)`` of records whose word sets have a Jaccard of ``jaccard`` or more.

    A Jaccard of j implies a cosine of at least 2j / (1 + j) between unit-weight vectors, so the cosine join at that
    threshold finds every pair and the exact share is tested on its few results. Equal word sets are one vector;
    its rows are looked up at the end. Null or wordless texts and unknown splits take no part.
    """
    items = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), split_name(split_col).alias("split"))
    items = items.where("id is not null and split is not null and text is not null")
    items = word_sets(items, "text").where("size(terms) > 0")
    items = materialise(items.select("id", "split", F.xxhash64("terms").alias("vid"), "terms").dropDuplicates(["id", "split", "vid"]), "items")
    sides = items.withColumn("train", F.col("split") == "train")
    pairs = cosine_pairs(sides.where("train").select("vid", "terms").dropDuplicates(["vid"]), sides.where("not train").select("vid", "terms").dropDuplicates(["vid"]), 2 * jaccard / (1 + jaccard))
    union = F.col("n_l") + F.col("n_r") - F.col("common")
    pairs = pairs.where(F.col("common") >= F.lit(jaccard) * union - EPS).select("l", "r", (F.col("common") / union).alias("shared"))
    train = sides.where("train").select(F.col("vid").alias("l"), F.col("id").alias("train_id"))
    evals = sides.where("not train").select(F.col("vid").alias("r"), F.col("id").alias("eval_id"), F.col("split").alias("eval_split"))
    return pairs.join(train, "l").join(evals, "r").where("train_id != eval_id").select("train_id", "eval_id", "eval_split", "shared").distinct()
