"""Document quality by a factorisation machine over hashed words and structure."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decisionlab.llm.labelled import Adam, Sample, sample_of, sigmoid
from decisionlab.llm.text import Slices, chunks, lower_ascii, mix, utf8, words

CHUNK = 2 << 20
WORD_BITS = 16
FACTORS = 8
STATISTICS = 16
SIZE = (1 << WORD_BITS) + STATISTICS
# Bounds of the training sample: documents of each label, and their longest text.
PER_CLASS, LONGEST = 2_000, 20_000
STEPS = 60


@dataclass
class Model:
    """Bias, linear weights, factors, and the scale of the structure statistics."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    middle: np.ndarray
    spread: np.ndarray


def in_texts(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many of the flagged positions lie in each text."""
    sums = np.concatenate([[0], np.cumsum(flags)])
    return (sums[ends[1:]] - sums[ends[:-1]]).astype(np.float64)


def document_values(data: np.ndarray, ends: np.ndarray, n_chars: np.ndarray):
    """Words as (document, bucket, value), and the structure statistics of every document."""
    start, end, before = words(data, ends)
    lowered = lower_ascii(data)
    hashes = Slices(lowered).hash(start, end)
    doc = np.repeat(np.arange(len(ends) - 1), np.diff(before))
    bucket = (mix(hashes) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    cell, count = np.unique(doc << WORD_BITS | bucket, return_counts=True)
    rows, places = cell >> WORD_BITS, cell & ((1 << WORD_BITS) - 1)
    values = np.log1p(count)
    norm = np.sqrt(np.bincount(rows, values * values, minlength=len(ends) - 1))
    values = values / norm[rows]

    size = np.diff(ends).astype(np.float64)
    n_words = np.diff(before).astype(np.float64)
    some, some_words = np.maximum(size, 1), np.maximum(n_words, 1)
    upper = (data >= 65) & (data <= 90)
    letters = upper | ((data >= 97) & (data <= 122)) | (data >= 128)
    digits = (data >= 48) & (data <= 57)
    spaces = (data == 32) | ((data >= 9) & (data <= 13))
    marks = ~(letters | digits | spaces)
    again = np.zeros(len(hashes) + 1, bool)
    if len(hashes):
        again[1:-1] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    repeats = np.concatenate([[0], np.cumsum(again[: len(hashes)])])
    top = np.zeros(len(size))
    np.maximum.at(top, rows, count)
    distinct = np.bincount(rows, minlength=len(size))
    chars = np.where(np.isnan(n_chars), in_texts((data & 0xC0) != 0x80, ends), n_chars)
    statistics = np.stack([
        np.log1p(size),
        np.log1p(n_words),
        in_texts(upper, ends) / np.maximum(in_texts(letters, ends), 1),
        in_texts(digits, ends) / some,
        in_texts(marks, ends) / some,
        in_texts(spaces, ends) / some,
        in_texts(data == 10, ends) / some,
        in_texts(data >= 128, ends) / some,
        in_texts(data == 124, ends) / some_words,
        in_texts((data == 33) | (data == 63), ends) / some_words,
        in_texts((data == 46) | (data == 44), ends) / some_words,
        (size - in_texts(spaces, ends)) / some_words,
        (repeats[before[1:]] - repeats[before[:-1]]) / some_words,
        top / some_words,
        distinct / some_words,
        np.log1p(np.maximum(chars, 0)),
    ], 1)
    return rows, places, values, statistics


def design(rows, places, values, statistics, middle, spread):
    """One sparse matrix of words and scaled statistics, sorted by document."""
    scaled = np.clip((statistics - middle) / spread, -4, 4) / 4
    n, k = scaled.shape
    row = np.concatenate([rows, np.repeat(np.arange(n), k)])
    order = np.argsort(row, kind="stable")
    column = np.concatenate([places, np.tile(np.arange(SIZE - STATISTICS, SIZE), n)])
    value = np.concatenate([values, scaled.ravel()])
    return row[order], column[order], value[order]


def interactions(factors: np.ndarray, row: np.ndarray, column: np.ndarray, value: np.ndarray, n: int):
    """All pairwise terms of a document in linear time: half of (sum v x)^2 - sum (v x)^2."""
    terms = factors[column] * value[:, None]
    first = np.searchsorted(row, np.arange(n))
    sums = np.add.reduceat(terms, first, axis=0)
    squares = np.add.reduceat(terms * terms, first, axis=0)
    return sums, 0.5 * (sums * sums - squares).sum(axis=1)


def log_odds(model: Model, row: np.ndarray, column: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    _, pairs = interactions(model.factors, row, column, value, n)
    return model.bias + np.bincount(row, model.linear[column] * value, minlength=n) + pairs


def metadata(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64)


def fit(sample: Sample) -> Model:
    model = Model(0.0, np.zeros(SIZE), np.zeros((SIZE, FACTORS)), np.zeros(STATISTICS), np.ones(STATISTICS))
    if not sample.usable:
        return model
    texts = pa.array([r["text"] or "" for r in sample.rows])
    chars = pa.array([r["n_chars"] for r in sample.rows], pa.float64())
    rows, places, values, statistics = document_values(*utf8(texts), metadata(chars))
    model.middle, model.spread = statistics.mean(axis=0), statistics.std(axis=0) + 1e-6
    row, column, value = design(rows, places, values, statistics, model.middle, model.spread)
    n, y = len(sample.labels), sample.labels
    model.factors = np.random.default_rng(1).normal(0, 0.05, (SIZE, FACTORS))
    bias = np.zeros(1)
    held = {"bias": bias, "linear": model.linear, "factors": model.factors}
    adam = Adam(0.05)
    for _ in range(STEPS):
        sums, pairs = interactions(model.factors, row, column, value, n)
        odds = bias[0] + np.bincount(row, model.linear[column] * value, minlength=n) + pairs
        gap = (sigmoid(odds) - y) / n
        weight = gap[row] * value
        linear = np.bincount(column, weight, minlength=SIZE)
        slope = weight[:, None] * (sums[row] - model.factors[column] * value[:, None])
        factors = np.stack([np.bincount(column, slope[:, f], minlength=SIZE) for f in range(FACTORS)], 1)
        adam.step(held, {
            "bias": np.array([gap.sum()]),
            "linear": linear + 1e-5 * model.linear,
            "factors": factors + 1e-5 * model.factors,
        })
    model.bias = float(bias[0]) + sample.prior_shift()
    model.linear, model.factors = model.linear.astype(np.float32), model.factors.astype(np.float32)
    return model


def train(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    n_chars: str = "n_chars",
    *,
    per_class: int = PER_CLASS,
    longest: int = LONGEST,
) -> Model:
    """Fit on at most `per_class` documents of each label with up to `longest` characters."""
    named = docs.select(F.col(key), F.col(text).alias("text"), F.col(n_chars).cast("double").alias("n_chars"))
    return fit(sample_of(
        named, labels, label, ["text", "n_chars"], key=key, per_class=per_class, longest=longest
    ))


def score(
    docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", n_chars: str = "n_chars"
) -> DataFrame:
    """Score every whole text: one row per row of `docs`, with `key` and `score` (0 to 1).

    Inputs are hashed words, structure statistics (lengths, shares of character classes,
    repetition) and the metadata column `n_chars`, which counts as the text's length where it
    is null. Null and empty texts are scored by what is left. Where the sample had no labels of both
    kinds, every score is one half. Repeated rows and null keys are scored row by row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                n = part.num_rows
                values = document_values(*utf8(part.column("text")), metadata(part.column("n_chars")))
                cells = design(*values, model.middle, model.spread)
                found = sigmoid(log_odds(model, *cells, n).astype(np.float64))
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(found)], ["key", "score"])

    rows = docs.select(
        F.col(key).alias("key"), F.col(text).cast("binary").alias("text"), F.col(n_chars).cast("double").alias("n_chars")
    )
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)
