"""SimHash fingerprints and near-duplicate groups by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decisionlab.llm.bitmap import bitmap, holds
from decisionlab.llm.graph import components
from decisionlab.llm.text import chunks
from decisionlab.session import cut_lineage, drop_folder, new_dir

CHUNK = 4 << 20


def shingle_hashes(text: bytes, width: int, seed: int) -> np.ndarray:
    """XXH64 of every run of `width` lower-cased words (of all words, where there are fewer)."""
    found = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(width, len(found))
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[: len(found) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.array([digest(joined[s:e], seed) for s, e in pairs], np.uint64)


def shingle_set(text: bytes, width: int, seed: int = 42) -> np.ndarray:
    return np.unique(shingle_hashes(text, width, seed))


def fingerprint(text: bytes, width: int, seed: int) -> int:
    """Bit i is set if it is set in over half of the shingle hashes. No words: zero."""
    hashes = shingle_hashes(text, width, seed)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, seed: int = 42
) -> DataFrame:
    """One row per row of `docs`: `key` and `fp` (long). A null text is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "_text", CHUNK):
                found = [fingerprint(t or b"", width, seed) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(found, pa.int64())], ["_key", "fp"]
                )

    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("binary").alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()
    return rows.mapInArrow(run, f"_key {kind}, fp long").withColumnRenamed("_key", key)


class Segments:
    """The cut of 64 bits into `bits // 3 + 1` segments, one of which differs by two bits at most."""

    def __init__(self, bits: int):
        self.bits, self.parts = bits, bits // 3 + 1
        self.edges = [round(64 * i / self.parts) for i in range(self.parts + 1)]

    def value(self, fp: Column, i: int) -> Column:
        width = self.edges[i + 1] - self.edges[i]
        value = F.shiftrightunsigned(fp, self.edges[i])
        return value.bitwiseAND(F.lit((1 << width) - 1)) if width < 64 else value

    def balls(self, prints: DataFrame) -> DataFrame:
        """Every row with `part` and `value`: its value in each segment, and those one bit away."""
        out = []
        for i in range(self.parts):
            width = self.edges[i + 1] - self.edges[i]
            flips = [0] + [1 << j if j < 63 else -(1 << 63) for j in range(width)]
            value = self.value(F.col("fp"), i)
            ball = F.array(*[value.bitwiseXOR(F.lit(x).cast("long")) for x in flips])
            out.append(prints.select("*", F.lit(i).alias("part"), F.explode(ball).alias("value")))
        table = out[0]
        for more in out[1:]:
            table = table.unionByName(more)
        return table

    def near(self, a: Column, b: Column) -> Column:
        return F.bit_count(a.bitwiseXOR(b)) <= self.bits

    def meeting(self, a: Column, b: Column, part: Column, value: Column) -> Column:
        """True at one of the places where a close pair meets: the first segment that is close
        enough, and there the value of `a` with the lowest differing bit turned."""
        here, earlier = F.lit(False), F.lit(True)
        for i in range(self.parts):
            mine = self.value(a, i)
            apart = mine.bitwiseXOR(self.value(b, i))
            lowest = F.when(apart == -(1 << 63), apart).otherwise(apart.bitwiseAND(-apart))
            here = here | ((part == i) & (value == mine.bitwiseXOR(lowest)) & earlier)
            earlier = earlier & (F.bit_count(apart) > 2)
        return here


def near_pairs(prints: DataFrame, bits: int = 4, node: str = "fp", other: Column | None = None) -> DataFrame:
    """Pairs `a` < `b` of nodes whose fingerprints (column `fp`) are at most `bits` apart.

    Two fingerprints that are close enough differ by at most two bits within one segment. Each
    enters, for each segment, its value there and every value one bit away: two values at
    most two bits apart share one. Table matches are then held against the complete
    distance within the join, where each pair counts at one place only. `node` is a unique
    column, the fingerprint itself by default; `other` is a condition on the sides `a` and `b`.
    The join is a merge: Spark's size estimate does not see that entries are exploded, and
    would send all of them to the driver to broadcast them.
    """
    segments = Segments(bits)
    table = segments.balls(prints)
    a, b = table.alias("a"), table.alias("b")
    left, right = F.col("a.fp"), F.col("b.fp")
    same = (F.col("a.part") == F.col("b.part")) & (F.col("a.value") == F.col("b.value"))
    fits = (F.col(f"a.{node}") < F.col(f"b.{node}")) & segments.near(left, right)
    if other is not None:
        fits = other & fits
    here = segments.meeting(left, right, F.col("a.part"), F.col("a.value"))
    found = a.join(b.hint("merge"), same & fits & here)
    return found.select(F.col(f"a.{node}").alias("a"), F.col(f"b.{node}").alias("b"))


def near_groups(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    *,
    width: int = 4,
    bits: int = 4,
    seed: int = 42,
) -> DataFrame:
    """Groups of documents whose fingerprints are linked at `bits` or fewer differing bits.

    Returns one row per row of `docs`: `key`, `fp` and `component`, the smallest key reachable
    by links, the row's own included. Rows with equal fingerprints are one node, so copies
    are never paired with each other. Empty and null texts have fingerprint zero and are linked
    like any other. Repeated rows stay repeated. A null key takes part in its group, and is
    the group's name only if no other key is in it. Other columns of `docs` are not read.
    """
    prints = cut_lineage(fingerprints(docs, key, text, width, seed))
    nodes = cut_lineage(prints.groupBy("fp").agg(F.min(key).alias("first")))
    roots = components(near_pairs(nodes.select("fp"), bits))
    nodes = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    names = nodes.groupBy("root").agg(F.min("first").alias("component"))
    named = nodes.join(names, "root").select("fp", "component")
    return prints.join(named, "fp").select(key, "fp", "component")


class Duplicates:
    """Rows of near-duplicate groups whose links are verified by their shingles; see `unique_rows`."""

    def __init__(self, docs: DataFrame, key: str, text: str, width: int, bits: int, similarity: float):
        self.width, self.bits, self.similarity = width, bits, similarity
        self.rows = docs.select(
            F.col(key).alias("key"),
            F.xxhash64(F.col(key), F.col(text)).alias("mark"),
            F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"),
        )

    def prints(self) -> DataFrame:
        """Per row its fingerprint and `node`, a hash of the fingerprint and the set of shingles."""
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunks(batch, "text", CHUNK):
                    texts = part.column("text").to_pylist()
                    prints = [fingerprint(t, width, 42) for t in texts]
                    nodes = [
                        xxhash.xxh64_intdigest(shingle_set(t, width).tobytes() + fp.to_bytes(8, "little", signed=True))
                        for t, fp in zip(texts, prints, strict=True)
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("key"), part.column("mark"), pa.array(prints, pa.int64()),
                         pa.array(np.array(nodes, np.uint64).view(np.int64))],
                        ["key", "mark", "fp", "node"],
                    )

        kind = self.rows.schema["key"].dataType.simpleString()
        return self.rows.mapInArrow(run, f"key {kind}, mark long, fp long, node long")

    def sets_of(self, nodes: DataFrame) -> DataFrame:
        """`node` and its shingle hashes, from the text of one of its rows (column `mark`)."""
        bits, width = bitmap(nodes, "mark"), self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kept = holds(bits.value, batch.column("mark").to_numpy().view(np.uint64))
                batch = batch.filter(pa.array(kept))
                for part in chunks(batch, "text", CHUNK):
                    sets = [shingle_set(t, width).view(np.int64) for t in part.column("text").to_pylist()]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("mark"), pa.array(sets, pa.list_(pa.int64()))], ["mark", "shingles"]
                    )

        found = self.rows.select("mark", "text").mapInArrow(run, "mark long, shingles array<long>")
        # Rows of one mark are copies of one node's row; they meet in the join, so this takes no further shuffle.
        return found.join(nodes, "mark").dropDuplicates(["mark"]).select("node", "shingles")

    def verified(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """Pairs whose sets of shingles have a Jaccard similarity of `similarity` or more."""
        path = new_dir(pairs.sparkSession, "sets")
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        sets = cut_lineage(self.sets_of(nodes.join(ends, "node").select("node", "mark")), path)
        a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
        b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        like = both >= self.similarity * (F.size("x") + F.size("y") - both)
        found = cut_lineage(pairs.join(a, "a").join(b, "b").filter(like).select("a", "b"))
        # The sets are large and not read again.
        drop_folder(pairs.sparkSession, path)
        return found

    def roots(self, nodes: DataFrame) -> DataFrame:
        """`node`, `root` of nodes that are not the smallest of their group.

        First every node is linked to one smaller node it shares a table entry with. The whole
        search then only has to look at pairs that this has not already brought together, so a
        dense group of near copies costs a few links for each, not all its pairs.
        """
        segments = Segments(self.bits)
        prints = nodes.select("node", "fp")
        led = leads(segments.balls(prints))
        close = (F.col("lead.node") < F.col("node")) & segments.near(F.col("lead.fp"), F.col("fp"))
        first = led.filter(close).groupBy(F.col("node").alias("b")).agg(F.min("lead.node").alias("a"))
        first = components(self.verified(cut_lineage(first.select("a", "b")), nodes))
        grouped = cut_lineage(
            prints.join(first, "node", "left").withColumn("root", F.coalesce("root", "node"))
        )
        apart = F.col("a.root") != F.col("b.root")
        pairs = cut_lineage(near_pairs(grouped, self.bits, "node", apart))
        more = self.verified(pairs, nodes)
        known = first.select(F.col("node").alias("a"), F.col("root").alias("b"))
        return components(known.unionByName(more))

    def keepers(self) -> DataFrame:
        """The mark of one row of each group: that of its smallest key, nulls last."""
        rows = cut_lineage(self.prints())
        nodes = cut_lineage(
            rows.groupBy("node").agg(F.min("fp").alias("fp"), F.min(place()).alias("place"))
            .select("node", "fp", F.col("place.mark").alias("mark"))
        )
        return self.firsts(rows, self.roots(nodes))

    def firsts(self, rows: DataFrame, roots: DataFrame) -> DataFrame:
        """The mark of the first row (columns `key`, `mark`, `node`) of each group."""
        nodes = rows.groupBy("node").agg(F.min(place()).alias("place"))
        groups = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node")).agg(
            F.min("place").alias("place")
        )
        return groups.select(F.col("place.mark").alias("mark"))


def leads(table: DataFrame) -> DataFrame:
    """Every table entry with `lead`, its smallest node; minima combine map-side."""
    least = table.groupBy("part", "value").agg(F.min(F.struct("node", "fp")).alias("lead"))
    return table.join(least, ["part", "value"])


def place() -> Column:
    """What rows of a group are ordered by."""
    return F.struct(F.col("key").isNull(), F.col("key"), F.col("mark"))


def one_row_each(docs: DataFrame, key: str, text: str, marks: DataFrame) -> DataFrame:
    """One row of `docs`, with all its columns, for each of `marks`."""
    keep = cut_lineage(marks).withColumnRenamed("mark", "_mark")
    marked = docs.withColumn("_mark", F.xxhash64(F.col(key), F.col(text)))
    one = Window.partitionBy("_mark").orderBy("_mark")
    kept = marked.join(keep, "_mark").withColumn("_turn", F.row_number().over(one))
    return kept.filter("_turn = 1").select(docs.columns)


def unique_rows(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    *,
    width: int = 5,
    bits: int = 8,
    similarity: float = 0.8,
) -> DataFrame:
    """One row of each group of near-duplicate documents, with all its columns.

    Documents are linked if their fingerprints over `width` words differ by at most `bits` and
    their sets of shingles have a Jaccard similarity of `similarity` or more; groups are
    connected by links. The row with the smallest key stays (a null key only where there is
    no other), and just one of rows that are equal in key and text. All texts without words, null
    ones included, are one group; fewer words than `width` are one shingle.
    """
    job = Duplicates(docs, key, text, width, bits, similarity)
    return one_row_each(docs, key, text, job.keepers())
