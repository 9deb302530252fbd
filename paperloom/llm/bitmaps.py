"""Bitmaps of 64-bit hashes: small enough to be broadcast, they keep what can't join from leaving its task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each hash, and log2 of the most bits there are (16 MB). Beyond that more hashes are let through; none is ever kept back.
BITS_EACH, MAX_BITS = 64, 27


def bitmap(hashes: DataFrame) -> np.ndarray:
    """Two bits for each value of the long column `hash`. At most 2**MAX_BITS / 64 words reach the driver, combined by tasks."""
    bits = min(MAX_BITS, max(16, (BITS_EACH * hashes.count() - 1).bit_length()))
    slots = F.explode(F.array(F.col("hash").bitwiseAND((1 << bits) - 1), F.shiftrightunsigned("hash", 64 - bits)))
    words = hashes.select(slots.alias("s")).select(F.shiftright("s", 6).alias("w"), F.expr("shiftleft(1L, cast(s & 63 AS int))").alias("b"))
    out = np.zeros((1 << bits) // 64, np.int64)
    for w, b in words.groupBy("w").agg(F.bit_or("b").alias("b")).collect():
        out[w] = b
    return out.view(np.uint8)


def contains(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash (64 bits, of any sign) may be one of the bitmap's."""
    h, bits = hashes.view(np.uint64), np.uint64(len(table).bit_length() + 2)
    low, high = (h & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), (h >> (np.uint64(64) - bits)).astype(np.int64)
    return ((table[low >> 3] >> (low & 7).astype(np.uint8)) & (table[high >> 3] >> (high & 7).astype(np.uint8)) & 1).astype(bool)
