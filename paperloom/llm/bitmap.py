"""Bitmaps of hashes, merged on the executors and sized by the number of hashes.

A bitmap spares a scan most rows that a join would drop afterwards; the join
alone decides. It has about 16 bits a hash and MOST_BITS at most (16 MB), so
what is broadcast is bounded whatever the data; a full bitmap only spares less.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS = 16, 27


def bitmap(hashes: DataFrame, column: str) -> np.ndarray:
    """The bits of a column of 64-bit hashes, as 64-bit words; their number is a power of two."""
    n = hashes.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * n - 1).bit_length() if n else 0))
    slot = F.shiftrightunsigned(F.col(column), 64 - bits)
    words = hashes.select(F.shiftright(slot, 6).alias("word"), F.expr("1L").alias("one"), slot.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    words = words.select("word", F.expr("shiftleft(one, bit)").alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    found = words.toArrow()  # MOST_BITS / 64 rows at most
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes (unsigned) may be in the bitmap."""
    width = int(len(bits)).bit_length() - 1 + 6
    slot = (hashes >> np.uint64(64 - width)).astype(np.int64)
    return (bits[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
