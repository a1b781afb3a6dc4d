"""A fixed-size bitmap of 64-bit hashes: a first sieve before an exact join.

It never grows with the data, so it can be broadcast at any scale. Where it fills up it lets more
rows through, and the join that follows stays exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# 8 MB.
BITS = 26


def bitmap(rows: DataFrame, hash_column: str):
    """Broadcast the leading bits of a long column, gathered in blocks of 32,768 bits."""
    place = F.shiftrightunsigned(hash_column, 64 - BITS)
    blocks = (
        rows.select(place.alias("place"))
        .groupBy((F.col("place") / F.lit(32768)).cast("long").alias("block"))
        .agg(F.bitmap_construct_agg(F.col("place") % 32768).alias("bits"))
    )
    out = np.zeros(1 << (BITS - 3), np.uint8)
    for block, bits in blocks.collect():
        out[block * 4096 : block * 4096 + len(bits)] = np.frombuffer(bits, np.uint8)
    return rows.sparkSession.sparkContext.broadcast(out)


def places_of(hashes: np.ndarray) -> np.ndarray:
    """The places of hashes in a bitmap: their leading bits, at half the size."""
    return (hashes >> np.uint64(64 - BITS)).astype(np.int32)


def marked(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 > 0


def holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return marked(bits, places_of(hashes))
