"""A stored tree hash of a ledger that is only appended to, with proofs.

The tree is that of `integrity.ledger_digest`: level 1 hashes blocks of lines, every further level
blocks of the hashes below. A complete block never changes again, so its hash is stored once, and an append hashes its own
lines and, on every level, the blocks they complete. What is not yet complete, less than a block a
level, is hashed when a digest or a proof is asked for.

The path of a line holds, level by level, the block it lies in. It shows that the line is part of a
digest. The path of the first new line also shows that an earlier digest covers a beginning of the
ledger: in each of its blocks, what stands before that line is what the earlier ledger had.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from decisionlab.functions import columns as C
from decisionlab.operators.integrity import DIGEST_BLOCK
from decisionlab.operators.ordered import number_rows
from decisionlab.session import numbered_folders

NODE = "place long, text string"


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _word(level: int) -> str:
    return "hashes" if level else "lines"


def digest_text(n: int | Column, top: str | Column) -> str | Column:
    """What the digest of `n` lines is the hash of, given the last hash left."""
    if isinstance(n, int):
        return f"ledger\n{n}\n{top}"
    return F.concat(F.lit("ledger\n"), n.cast("string"), F.lit("\n"), top)


class LedgerTree:
    """The levels of one ledger in a folder; `block` is fixed by the first append.

    Rows are (`place`, `text`): lines on level 0, hashes of complete blocks above. Each append writes a folder a
    level, named by the first place in it, and at last the ledger's new size, which makes it count. An
    append that was broken off leaves folders that the next one writes again.
    """

    def __init__(self, spark: SparkSession, path: str, block: int = DIGEST_BLOCK):
        self.spark, self.path, self.block = spark, path, block

    def sizes(self) -> list[int]:
        """The number of lines after every append."""
        return numbered_folders(self.spark, f"{self.path}/sizes", "size")

    def size(self) -> int:
        return max(self.sizes(), default=0)

    def nodes(self, level: int, first: int, end: int) -> DataFrame:
        """Places `first` to before `end` of a level; the range reaches the scan."""
        if first >= end:
            return self.spark.createDataFrame([], NODE)
        rows = self.spark.read.schema(f"{NODE}, first long").parquet(f"{self.path}/level={level}")
        place = F.col("place")
        return rows.filter((F.col("first") < end) & (place >= first) & (place < end)).select("place", "text")

    def _write(self, rows: DataFrame, level: int, first: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/level={level}/first={first}")

    def append(self, lines: DataFrame) -> int:
        """Add lines (`seq`, `line`) behind all that are stored, in `seq` order; the new size.

        It is for the caller to give every line once. No lines leave everything as it is.
        """
        start, n = self.size(), F.col("place")
        numbered = number_rows(lines.select("seq", "line"), ["seq"], "place")
        self._write(numbered.select((n - 1 + start).alias("place"), F.col("line").alias("text")), 0, start)
        added = self.spark.read.schema(NODE).parquet(f"{self.path}/level=0/first={start}").count()
        end = start + added
        level, old, new = 0, start // self.block, end // self.block
        while new > old:
            self._write(self._hashed(level, old, new), level + 1, old)
            level, old, new = level + 1, old // self.block, new // self.block
        if added:
            self.spark.range(1).write.mode("overwrite").parquet(f"{self.path}/sizes/size={end}")
        return end

    def _hashed(self, level: int, first: int, end: int) -> DataFrame:
        """Hashes of the complete blocks `first` to before `end` of a level."""
        rows = F.array_sort(F.collect_list(F.struct("place", "text")))
        text = F.array_join(F.transform(rows, lambda r: r["text"]), "\n")
        hashed = C.sha256(F.concat(F.lit(f"{_word(level)}\n"), text))
        below = self.nodes(level, first * self.block, end * self.block)
        number = F.floor(F.col("place") / self.block)
        return below.groupBy(number.alias("place")).agg(hashed.alias("text")).select("place", "text")

    def edge(self, n: int) -> tuple[list[list[str]], list[str | None], str]:
        """For the first `n` lines: on each level, what stands behind the complete blocks, the hash of the
        incomplete block below (null: none), and at last the one hash left.

        At most a block of rows a level comes to the driver.
        """
        counts = [n]
        while counts[-1] >= self.block:
            counts.append(counts[-1] // self.block)
        # One level more, in case what is incomplete makes a second hash on the last one.
        counts.append(0)
        rows = None
        for level, count in enumerate(counts):
            tail = self.nodes(level, count // self.block * self.block, count).withColumn("level", F.lit(level))
            rows = tail if rows is None else rows.unionByName(tail)
        tails: list[list[str]] = [[] for _ in counts]
        for r in rows.orderBy("level", "place").collect():
            tails[r["level"]].append(r["text"])
        opens, carry = [], None
        for level, (count, tail) in enumerate(zip(counts, tails)):
            opens.append(carry)
            rest = tail + ([carry] if carry else [])
            if not n or (level and count + bool(carry) <= 1):
                return tails, opens, rest[0] if n else ""
            carry = _sha("\n".join([_word(level), *rest])) if rest else None
        return tails, [*opens, carry], carry

    def digest(self, n: int | None = None) -> str:
        """The digest of the first `n` lines (all): that of `integrity.ledger_digest`."""
        n = self.size() if n is None else n
        return _sha(digest_text(n, self.edge(n)[2]))

    def paths(self, places: DataFrame) -> DataFrame:
        """The paths of lines (`place`) in the tree of all: `place`, `path`.

        A path is an array of (level, block, pos): the texts of a block, and where in it the path goes on.
        Every block is gathered once, however many lines want it.
        """
        n = self.size()
        _, opens, _ = self.edge(n)
        out = None
        for level, carry in enumerate(opens[:-1]):
            width, count = self.block ** (level + 1), n // self.block**level
            wanted = places.select("place", F.floor(F.col("place") / width).alias("number"))
            nodes = self.nodes(level, 0, count)
            if carry:
                nodes = nodes.unionByName(self.spark.createDataFrame([(count, carry)], NODE))
            nodes = nodes.withColumn("number", F.floor(F.col("place") / self.block))
            nodes = nodes.join(wanted.select("number").distinct(), "number", "left_semi")
            rows = F.array_sort(F.collect_list(F.struct("place", "text")))
            blocks = nodes.groupBy("number").agg(F.transform(rows, lambda r: r["text"]).alias("block"))
            pos = F.floor(F.col("place") / self.block**level) % self.block
            step = F.struct(F.lit(level).alias("level"), F.col("block"), pos.cast("int").alias("pos"))
            steps = wanted.join(blocks, "number").select("place", step.alias("step"))
            out = steps if out is None else out.unionByName(steps)
        if out is None:
            return self.spark.createDataFrame([], "place long, path array<struct<level:int,block:array<string>,pos:int>>")
        return out.groupBy("place").agg(F.array_sort(F.collect_list("step")).alias("path"))


def _step_hash(step: Column, texts: Column) -> Column:
    word = F.when(step["level"] == 0, "lines\n").otherwise("hashes\n")
    return C.sha256(F.concat(word, F.array_join(texts, "\n")))


def path_hashes(path: Column) -> Column:
    """The hash of each block of a path."""
    return F.transform(path, lambda step: _step_hash(step, step["block"]))


def holds_line(path: Column, line: Column, n: int, digest: str) -> Column:
    """Whether a path shows that a line is part of the ledger of `n` lines with that digest."""
    start = F.struct(line.alias("text"), F.lit(True).alias("right"))

    def climb(state: Column, step: Column) -> Column:
        here = F.coalesce(F.get(step["block"], step["pos"]) == state["text"], F.lit(False))
        return F.struct(_step_hash(step, step["block"]).alias("text"), (state["right"] & here).alias("right"))

    top = F.aggregate(path, start, climb)
    return top["right"] & (C.sha256(digest_text(F.lit(n), top["text"])) == digest)


def extends(path: Column, old: int, old_digest: str, n: int, digest: str, block: int) -> Column:
    """Whether the path of line number `old` shows that the ledger of `n` lines begins with the old one.

    Both digests are worked out from the same blocks, the old one from what stands before the path.
    """
    size = F.lit(block).cast("long")
    start = F.struct(
        F.lit(None).cast("string").alias("open"), F.lit(None).cast("string").alias("top"),
        F.lit(old).cast("long").alias("count"),
    )

    def climb(state: Column, step: Column) -> Column:
        rest = F.concat(
            F.slice(step["block"], F.lit(1), step["pos"]),
            F.array_compact(F.array(state["open"])),
        )
        left = state["count"] + F.when(state["open"].isNotNull(), 1).otherwise(0)
        top = F.coalesce(state["top"], F.when((step["level"] > 0) & (left == 1), F.get(rest, F.lit(0))))
        hashed = F.when(F.size(rest) > 0, _step_hash(step, rest))
        return F.struct(hashed.alias("open"), top.alias("top"), F.floor(state["count"] / size).alias("count"))

    state = F.aggregate(path, start, climb)
    was = C.sha256(digest_text(F.lit(old), F.coalesce(state["top"], state["open"], F.lit(""))))
    first = F.get(F.get(path, F.lit(0))["block"], F.get(path, F.lit(0))["pos"])
    return (was == old_digest) & holds_line(path, first, n, digest)


def only_appended(tree: LedgerTree, old: int, old_digest: str) -> bool:
    """Whether the stored ledger begins with the `old` lines that had that digest."""
    n = tree.size()
    if old >= n:
        return old == n and tree.digest() == old_digest
    place = tree.spark.range(old, old + 1).withColumnRenamed("id", "place")
    shown = extends(F.col("path"), old, old_digest, n, tree.digest(), tree.block)
    return bool(tree.paths(place).select(shown).first()[0])
