"""Texts as UTF-8 bytes in Arrow batches, their words and rolling hashes in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# An odd multiplier and its inverse modulo 2^64, for hashes of any slice from prefix sums.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)

# Bytes that belong to words: ASCII letters and digits, and every byte of a longer character.
WORD_BYTES = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column, and where each begins and ends (null: empty)."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most `limit` bytes of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield batch.slice(start)


def powers(n: int, base: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Slices:
    """Hashes of any slices of `data`, the same for equal bytes wherever they stand."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        terms = (data.astype(np.uint64) + np.uint64(1)) * powers(n, BASE)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        self.back = powers(n + 1, BASE_INVERSE)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])


def lower_ascii(data: np.ndarray) -> np.ndarray:
    upper = (data >= 65) & (data <= 90)
    return data + (upper.astype(np.uint8) << np.uint8(5))


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and how many words come before each text and the end."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = WORD_BYTES[data]
    edge = inside[1:] != inside[:-1]
    begins = edge & inside[1:]
    finishes = edge & inside[:-1]
    # Neighbouring texts touch in the buffer: end words where a text ends.
    cuts = ends[1:-1]
    cuts = cuts[inside[cuts] & inside[cuts + 1]] if len(cuts) else cuts
    begins[cuts] = True
    finishes[cuts] = True
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(finishes), np.searchsorted(start, ends)


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each lower-cased word, and how many words come before each text and the end."""
    data = lower_ascii(data)
    start, end, before = words(data, ends)
    return Slices(data).hash(start, end), before
