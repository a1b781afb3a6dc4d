"""Benchmark decontamination by spaced seeds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decisionlab.llm.bitmap import bitmap, holds
from decisionlab.llm.text import chunks, mix, utf8, word_hashes
from decisionlab.session import cut_lineage

CHUNK = 4 << 20
# A window of this many words, of which so many may differ: at least 84 % are the same.
WINDOW = 13
MISMATCHES = 2
# Word positions that a seed looks at; it ignores those between. Wherever the mismatches fall
# in a window, one of the masks has a place in it that avoids them (tested for all pairs).
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
# Stands for words before the beginning or after the end; never equal to another side's.
OUTSIDE_DOC, OUTSIDE_ITEM = 0, 1


def seeds(words: np.ndarray, before: np.ndarray, mask: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    """Seed hash and word position of every place where `mask` fits into one text."""
    span = mask[-1] + 1
    if len(words) < span:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(words) - span + 1
    total = np.zeros(n, np.uint64)
    for j, p in enumerate(mask):
        total = mix(total + words[p : p + n] + np.uint64(j + 1))
    text = np.searchsorted(before, np.arange(n), side="right")
    inside = np.arange(n) + span <= before[np.minimum(text, len(before) - 1)]
    return total[inside], np.flatnonzero(inside)


def surroundings(
    words: np.ndarray, before: np.ndarray, at: np.ndarray, span: int, window: int, outside: int
) -> np.ndarray:
    """The words that any window around a seed can hold: one row per seed."""
    text = np.searchsorted(before, at, side="right") - 1
    place = at[:, None] + np.arange(span - window, window)
    inside = (place >= before[text][:, None]) & (place < before[text + 1][:, None])
    rows = words[np.clip(place, 0, len(words) - 1)]
    rows = np.where(rows <= 1, rows + np.uint64(2), rows)
    return np.where(inside, rows, np.uint64(outside)).view(np.int64)


def found_seeds(
    rows: DataFrame, masks: tuple, window: int, outside: int, bits=None
) -> DataFrame:
    """Seeds of all texts (columns `key`, `text`) that pass the filter, with their words around."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                words, before = word_hashes(*utf8(part.column("text")))
                for number, mask in enumerate(masks):
                    seed, at = seeds(words, before, mask)
                    if bits is not None:
                        hit = holds(bits.value, seed)
                        seed, at = seed[hit], at[hit]
                    for s in range(0, len(at), 1 << 15):
                        some = at[s : s + (1 << 15)]
                        around = surroundings(words, before, some, mask[-1] + 1, window, outside)
                        text = np.searchsorted(before, some, side="right") - 1
                        yield pa.RecordBatch.from_arrays(
                            [part.column("key").take(pa.array(text)),
                             pa.array(some - before[text]),
                             pa.array(np.full(len(some), number, np.int32)),
                             pa.array(seed[s : s + (1 << 15)].view(np.int64)),
                             pa.ListArray.from_arrays(
                                 pa.array(np.arange(len(some) + 1, dtype=np.int32) * around.shape[1]),
                                 pa.array(around.ravel()))],
                            ["key", "at", "mask", "seed", "words"],
                        )

    kind = rows.schema["key"].dataType.simpleString()
    rows = rows.withColumn("text", F.col("text").cast("binary"))
    return rows.mapInArrow(run, f"key {kind}, at long, mask int, seed long, words array<long>")


def overlap(a: Column, b: Column, span: int, window: int) -> Column:
    """Most equal words in any window that holds the seed and lies inside both texts."""
    same = F.zip_with(a, b, lambda x, y: F.when(
        (x == OUTSIDE_DOC) | (y == OUTSIDE_ITEM), -window
    ).when(x == y, 1).otherwise(0))
    sums = [
        F.aggregate(F.slice(same, o + 1, window), F.lit(0), lambda s, x: s + x)
        for o in range(window - span + 1)
    ]
    return F.greatest(*sums) if len(sums) > 1 else sums[0]


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    *,
    window: int = WINDOW,
    mismatches: int = MISMATCHES,
    masks: tuple = MASKS,
) -> DataFrame:
    """Which documents share a passage with which benchmark items: `key`, `item`, `seeds`.

    A document and an item overlap if some `window` consecutive words of one equal those of
    the other but for at most `mismatches` substituted words. Words are runs of ASCII letters
    and digits and of any other characters beyond ASCII, lower-cased in ASCII, so case,
    punctuation and white space do not matter. `seeds` counts the verified seed places.

    Every seed of every document passes a bitmap of fixed size first; what is left is written,
    and equal surroundings are verified once, however many documents share them. Texts with
    fewer words than `window`, empty and null ones overlap with nothing. Repeated rows and keys
    are merged by key, null being a key like any other. Other columns are not read.
    """
    items = benchmark.select(F.col(item).alias("key"), F.col(item_text).alias("text"))
    known = cut_lineage(
        found_seeds(items, masks, window, OUTSIDE_ITEM)
        .select(F.col("key").alias("item"), "mask", "seed", F.col("words").alias("item_words"))
        .distinct()
    )
    bits = bitmap(known, "seed")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    hits = cut_lineage(found_seeds(rows, masks, window, OUTSIDE_DOC, bits))
    shared = hits.groupBy("mask", "seed", "words").agg(F.count("*").alias("n"))
    most = F.lit(0)
    for number, mask in enumerate(masks):
        value = overlap(F.col("words"), F.col("item_words"), mask[-1] + 1, window)
        most = F.when(F.col("mask") == number, value).otherwise(most)
    verified = (
        shared.join(known, ["mask", "seed"])
        .filter(most >= window - mismatches)
        .select("mask", "seed", "words", "item")
        .distinct()
    )
    return (
        hits.join(verified, ["mask", "seed", "words"])
        .groupBy("key", "item")
        .agg(F.count_distinct("mask", "at").alias("seeds"))
        .select(F.col("key").alias(key), F.col("item").alias(item), "seeds")
    )


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options
) -> DataFrame:
    """The rows of `docs` that overlap with no benchmark item, with all their columns.

    A row is known by its key and the hash of its text, so rows that share a key, or have
    none, are judged each by its own text. Null and empty texts stay.
    """
    named = docs.withColumn("_row", F.struct(F.col(key), F.xxhash64(text).alias("hash")))
    found = overlaps(named, benchmark, "_row", text, **options)
    bad = found.select(F.col("_row").alias("_bad")).distinct()
    return named.join(bad, F.col("_row").eqNullSafe(F.col("_bad")), "left_anti").drop("_row")
