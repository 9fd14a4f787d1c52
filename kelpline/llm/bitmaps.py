"""Bit maps of bounded size that tell tasks which hashes may be in a table, however large it is."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
LEAST_BITS, MOST_BITS = 16, 27


class Bitmap:
    """Answers yes for every hash it was made of, and for a few others: two bits of 32 a hash or, beyond MOST_BITS, fewer."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.mask = U(len(words) * 64 - 1)

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        found = self._bit(hashes & self.mask)
        at = np.flatnonzero(found)
        found[at] = self._bit((hashes[at] >> U(32)) & self.mask)
        return found

    def _bit(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[(at >> U(6)).astype(np.int64)] >> (at & U(63))) & U(1)).astype(bool)


def bitmap(hashes: DataFrame, count: int, most_bits: int = MOST_BITS) -> Bitmap:
    """The map of a table of hashes (one long column `hash`), folded by Spark; 16 MB at most reach the driver."""
    bits = min(max(LEAST_BITS, int(32 * count).bit_length()), most_bits)
    mask = F.lit((1 << bits) - 1).cast("long")
    places = F.array(F.col("hash").bitwiseAND(mask), F.shiftrightunsigned("hash", 32).bitwiseAND(mask))
    spread = hashes.select(F.explode(places).alias("place"))
    spread = spread.select(F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, CAST(place & 63 AS INT))").alias("bits"))
    rows = spread.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros((1 << bits) // 64, np.int64)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return Bitmap(words.view(np.uint64))
