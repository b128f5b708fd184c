"""Bitmaps of hashes: rows that cannot have a partner go before they are shuffled; what is left is looked up exactly.

A bitmap has at most 2^MOST bits (4 MB) however many hashes it holds, so it may be sent to every executor. Hashes that
share a bit let a few more rows pass, never fewer.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST = 25


def _slot(h: np.ndarray, n: int | np.ndarray, size: int) -> np.ndarray:
    """The bit of hash ``h`` with the small number ``n``."""
    mixed = (h.view(np.uint64) + np.asarray(n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(64 - size)).astype(np.int64)


def flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and row ends of a list column without nulls."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]


class Bitmap:
    def __init__(self, hashes: DataFrame, count: int) -> None:
        """``hashes(h long, n int)``, about ``count`` of them."""
        self.size = size = min(MOST, max(10, math.ceil(math.log2(32 * max(1, count)))))
        slot = F.arrow_udf(lambda h, n: pa.array(_slot(h.to_numpy(), n.to_numpy(), size)), T.LongType())
        # At most 2^(MOST - 6) rows reach the driver.
        words = hashes.select(slot("h", "n").alias("s")).groupBy(F.expr("s >> 6").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("b")).toArrow()
        bits = np.zeros(1 << (size - 6), np.uint64)
        bits[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
        self.shared = hashes.sparkSession.sparkContext.broadcast(bits)

    def has(self, h: np.ndarray, n: int | np.ndarray = 0) -> np.ndarray:
        s = _slot(h, n, self.size)
        return (self.shared.value[s >> 6] >> (s & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

    def may_hold(self, h: Column) -> Column:
        """Can hash ``h`` (never null) with number 0 be among those of the bitmap?"""
        return F.arrow_udf(lambda h: pa.array(self.has(h.to_numpy())), T.BooleanType())(h)
