"""Bounded training samples of labelled documents, and the folds that they come from."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(key: Column) -> Column:
    """One third of all keys, by the CRC-32 of the key as text; a null key is not among them."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class Sample:
    """Rows of the sample with their labels, and how many labelled rows of each kind exist."""

    rows: list
    labels: np.ndarray
    counts: tuple[int, int]

    @property
    def usable(self) -> bool:
        return bool(len(self.labels)) and 0 < int(self.labels.sum()) < len(self.labels)

    def prior_shift(self) -> float:
        """What takes log-odds fitted on the sample to those of all labelled rows."""
        ones = int(self.labels.sum())
        return float(np.log(self.counts[1] / self.counts[0]) - np.log(ones / (len(self.labels) - ones)))


def known_labels(labels: DataFrame, label: str, key: str) -> DataFrame:
    """`_key`, `_label`: one row a key that is labelled 0 or 1, with its larger label."""
    return (
        labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_key"))
        .agg(F.max(label).alias("_label"))
    )


def sample_of(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    columns: list[str],
    *,
    key: str = "doc_id",
    text: str = "text",
    per_class: int,
    longest: int,
) -> Sample:
    """At most `per_class` documents of each label, picked by the hash of their key.

    Only the sample comes to the driver: its keys are chosen from the labels alone, and
    documents over `longest` characters are not taken. A key labelled twice counts with its larger
    label; labels other than 0 and 1 are ignored.
    """
    known = known_labels(labels, label, key)
    counts = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("_key"), F.col("_key")]
    picked = known.filter("_label = 0").orderBy(*order).limit(per_class).unionByName(
        known.filter("_label = 1").orderBy(*order).limit(per_class)
    )
    # At most 2 * per_class keys, so the broadcast has a fixed bound.
    rows = (
        docs.select(F.col(key).alias("_key"), *columns)
        .filter(F.length(text) <= longest)
        .join(F.broadcast(picked), "_key")
        .dropDuplicates(["_key"])
        .orderBy("_key")
        .collect()
    )
    return Sample(
        rows,
        np.array([r["_label"] for r in rows], np.float64),
        (counts.get(0, 0), counts.get(1, 0)),
    )


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Adam:
    """Gradient steps scaled by running moments."""

    def __init__(self, rate: float):
        self.rate, self.turn, self.state = rate, 0, {}

    def step(self, values: dict[str, np.ndarray], gradients: dict[str, np.ndarray]) -> None:
        self.turn += 1
        for name, g in gradients.items():
            m, v = self.state.get(name, (np.zeros_like(g), np.zeros_like(g)))
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            self.state[name] = m, v
            scale = np.sqrt(v / (1 - 0.99**self.turn)) + 1e-8
            values[name] -= (self.rate * (m / (1 - 0.9**self.turn)) / scale).astype(values[name].dtype)
