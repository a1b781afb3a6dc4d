"""Near-duplicate vectors by int8 tile products with proven error bounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decisionlab.llm.graph import components
from decisionlab.session import cut_lineage

# Vectors of a block; a task holds two blocks and works through them tile by tile.
BLOCK = 2048
TILE = 512
EXACT_ROWS = 8192
# Dimensions for which sums of products of int8 values are whole numbers in float32.
FLOAT32_DIMS = (1 << 24) // (127 * 127)


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, norms of the decoded rows and norms of what rounding took away."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    decoded = codes * scale[:, None]
    return codes, scale, np.linalg.norm(decoded, axis=1), np.linalg.norm(unit - decoded, axis=1)


class Tile:
    def __init__(self, raw: np.ndarray):
        # A power of two, so exact: squares can then neither overflow nor vanish.
        raw = np.ldexp(raw, -np.frexp(np.abs(raw).max(axis=1))[1][:, None])
        self.raw = raw
        self.norm = np.sqrt(np.einsum("ij,ij->i", raw, raw))
        self.unit = raw / self.norm[:, None]
        codes, self.scale, self.size, self.error = quantise(self.unit)
        kind = np.float32 if raw.shape[1] <= FLOAT32_DIMS else np.float64
        self.codes = codes.astype(kind)


def linked(a: Tile, b: Tile, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of `a` and `b` with a cosine of `threshold` or more.

    With x = x' + e and y = y' + f, where x', y' are the decoded unit vectors,
    |x.y - x'.y'| <= |e| |y'| + |x| |f| and |x| = 1. Only pairs whose int8 product plus this
    bound (and the rounding of doubles) reaches the threshold are computed in double precision.
    """
    product = (a.codes @ b.codes.T).astype(np.float64) * a.scale[:, None] * b.scale[None, :]
    bound = a.error[:, None] * b.size[None, :] + b.error[None, :] + 1e-9
    i, j = np.nonzero(product + bound >= threshold)
    keep = np.zeros(len(i), bool)
    for s in range(0, len(i), EXACT_ROWS):
        x, y = i[s : s + EXACT_ROWS], j[s : s + EXACT_ROWS]
        dot = np.einsum("ij,ij->i", a.raw[x], b.raw[y])
        keep[s : s + EXACT_ROWS] = dot / (a.norm[x] * b.norm[y]) >= threshold
    return i[keep], j[keep]


def find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def join_links(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Union the pairs and return every node's root. `parent` is flat before and after."""
    pairs = np.unique(np.stack([parent[i], parent[j]], 1), axis=0)
    for x, y in pairs[pairs[:, 0] != pairs[:, 1]].tolist():
        x, y = find(parent, x), find(parent, y)
        parent[max(x, y)] = min(x, y)
    while True:
        up = parent[parent]
        if (up == parent).all():
            return up
        parent = up


def compare_cell(cell: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links of one cell: per vector, how many rows it links to there and one linked root."""
    cell = cell.sort_values(["block", "key"], ignore_index=True)
    raw = np.stack(cell["vector"].to_numpy()).astype(np.float64)
    copies = cell["copies"].to_numpy(np.int64)
    own = (cell["block"] == cell["low"]).to_numpy()
    same = bool((cell["low"] == cell["high"]).iloc[0])
    split = int(own.sum())
    tiles = [(s, Tile(raw[s : min(s + TILE, split)])) for s in range(0, split, TILE)]
    others = tiles if same else [
        (s, Tile(raw[s : s + TILE])) for s in range(split, len(cell), TILE)
    ]
    links, parent = np.zeros(len(cell), np.int64), np.arange(len(cell))
    for s, a in tiles:
        for t, b in others:
            if same and t < s:
                continue
            i, j = linked(a, b, threshold)
            i, j = i + s, j + t
            if same and s == t:
                i, j = i[i < j], j[i < j]
            if len(i):
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                parent = join_links(parent, i, j)
    found = links > 0
    keys = cell["key"].to_numpy()
    return pd.DataFrame({"key": keys[found], "links": links[found], "root": keys[parent[found]]})


def usable(vector: Column) -> Column:
    """Not null, not zero, every component a finite number."""
    plain = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(plain & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_vectors(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    threshold: float = 0.93,
    block: int = BLOCK,
) -> DataFrame:
    """Links between vectors of the same label with a cosine of `threshold` or more.

    Returns one row per row of `vectors`: `key`, `n_links` (other rows linked directly),
    `component` (the smallest key reachable, its own included) and `kept` (`key` = `component`).
    Rows with a null label, and vectors that are null, empty, zero or hold null or non-finite
    components, link with nothing; so do vectors of different lengths. Equal vectors of a label
    are one node with a number of copies. A label of any size is dealt over cells of two blocks
    of about `block` different vectors, so no task grows with it, and every pair of blocks meets
    in one cell; a task returns counts and one root per vector, never its pairs. A null key
    counts as a link but names a group only if no other key is in it. Repeated keys are rows
    of their own. Other columns are not read.
    """
    rows = vectors.select(
        F.col(key).alias("id"),
        F.col(vector).cast("array<double>").alias("vector"),
        F.col(label).alias("label"),
    )
    rows = rows.withColumn("valid", usable(F.col("vector")) & F.col("label").isNotNull())
    content = F.concat(
        F.hex(F.xxhash64("label", "vector")), F.hex(F.xxhash64(F.lit(7), "vector", "label"))
    )
    rows = rows.withColumn("key", F.when(F.col("valid"), content))

    nodes = cut_lineage(
        rows.filter("valid")
        .groupBy("key", "label", "vector")
        .agg(F.count("*").alias("copies"), F.min("id").alias("first"))
        .withColumn("dims", F.size("vector"))
    )
    sizes = nodes.groupBy("label", "dims").agg(F.count("*").alias("n"))
    placed = (
        nodes.join(sizes, ["label", "dims"])
        .withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64(F.lit(11), "key"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .select(
            "label", "dims", "key", "vector", "copies", "block",
            F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        )
    )
    found = cut_lineage(
        placed.groupBy("label", "dims", "low", "high").applyInPandas(
            lambda cell: compare_cell(cell, threshold), "key string, links long, root string"
        )
    )
    roots = components(found, "key", "root").withColumnRenamed("node", "key")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    known = nodes.select("key", "copies", "first").join(roots, "key", "left").join(
        links, "key", "left"
    )
    known = known.withColumn("root", F.coalesce("root", "key"))
    names = known.groupBy("root").agg(F.min("first").alias("name"))
    known = known.join(names, "root").select(
        "key", "name", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")
    )
    out = rows.select("id", "key").join(known, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("name"))
    return out.select(
        F.col("id").alias(key),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component"),
        component.eqNullSafe(F.col("id")).alias("kept"),
    )
