"""Harmonic packing of token ids into training sequences."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from decisionlab.llm.text import chunks
from decisionlab.llm.tokens import default_path, token_ids
from decisionlab.session import cut_lineage

CHUNK = 4 << 20
# Up to this many classes a piece is cut to the exact size of its class; shorter ones stay as
# they are, since a bin of so many pieces is nearly full anyway.
CLASSES = 64
# Share of its place in a bin that a piece may leave empty.
SLACK = 0.01
# Workers whose open bins one task of the next round merges.
FAN_IN = 32

LONGS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "worker")


def cut(n: int, capacity: int, classes: int, slack: float) -> list[tuple[int, int, int]]:
    """Cut `n` tokens into pieces (start, length, class).

    Class k holds lengths in (capacity / (k + 1), capacity / k], so k of its pieces fit in a
    bin. A remainder that would leave too much of its place empty is cut to the largest whole
    place it fills, and what is left goes on.
    """
    out, start = [], 0
    while n - start >= capacity:
        out.append((start, capacity, 1))
        start += capacity
    while start < n:
        rest = n - start
        k = capacity // rest
        place = capacity // k
        if k >= classes or place - rest <= slack * place:
            out.append((start, rest, k))
            break
        place = capacity // (k + 1)
        out.append((start, place, capacity // place))
        start += place
    return out


class Bins:
    """The open bin of each class in one task. Closed bins come out as rows with their place."""

    def __init__(self, first_id: int):
        self.open: dict[int, list[list]] = {}
        self.next_id = first_id

    def close(self, pieces: list[list]) -> list[list]:
        """Piece: key, start, length, crc, doc tokens, ids. Adds sequence and offset."""
        offset, out = 0, []
        for piece in pieces:
            out.append([*piece, self.next_id, offset])
            offset += piece[2]
        self.next_id += 1
        return out

    def add(self, k: int, piece: list) -> list[list]:
        pieces = self.open.setdefault(k, [])
        pieces.append(piece)
        if len(pieces) < k:
            return []
        del self.open[k]
        return self.close(pieces)

    def rest(self) -> list[list]:
        return [[*piece, None, None] for pieces in self.open.values() for piece in pieces]

    def best_fit(self, capacity: int) -> list[list]:
        """Close what is open: longest piece first, each into the fullest bin that takes it."""
        pieces = sorted((p for some in self.open.values() for p in some), key=lambda p: -p[2])
        bins: list[list[list]] = []
        room: list[tuple[int, int]] = []
        for piece in pieces:
            at = bisect_left(room, (piece[2], -1))
            if at < len(room):
                left, i = room.pop(at)
            else:
                left, i = capacity, len(bins)
                bins.append([])
            bins[i].append(piece)
            insort(room, (left - piece[2], i))
        return [row for some in bins for row in self.close(some)]


def pack(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    *,
    capacity: int = 2048,
    end_id: int = 1,
    tokenizer: str | None = None,
    classes: int = CLASSES,
    slack: float = SLACK,
    with_ids: bool = True,
) -> DataFrame:
    """Pack every document's token ids, closed by `end_id`, into sequences of `capacity`.

    Returns one row per piece: `key`, `start` (its document's ids before it), `length`,
    `ids_crc32` (of its ids as little-endian uint32), `doc_tokens`, `sequence_id`, `offset`
    in the sequence, and `ids` (those bytes) unless `with_ids` is off. Every id lies in
    exactly one piece, and the pieces of a sequence follow each other without gaps.

    Every worker fills its own bins, one open bin for each class of lengths, and holds no more
    than those. The bins still open at the end of a task go on to the next round, in which a
    task merges those of 32 workers, until one task is left with less than one bin per
    class; it packs these few pieces by best fit, whatever their class. A null or empty text is the
    end id alone. Null keys, repeated keys and repeated rows are documents of their own. Other
    columns are not read. No documents: no pieces.
    """
    path = tokenizer or default_path()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType
    schema = StructType(
        [StructField("key", kind)]
        + [StructField(n, LongType()) for n in LONGS]
        + [StructField("class", LongType()), StructField("ids", rows.select(
            F.lit(None).cast("binary").alias("x")).schema["x"].dataType)]
    )
    end = np.array([end_id], "<u4").tobytes()

    def batch_of(out: list[list], worker: int, key_type: pa.DataType) -> pa.RecordBatch:
        """out: key, start, length, crc, doc tokens, ids, sequence, offset."""
        cols = list(zip(*out, strict=True)) if out else [[] for _ in range(8)]
        longs = [*cols[1:5], cols[6], cols[7], [worker] * len(out)]
        k = [capacity // n for n in cols[2]]
        arrays = [pa.array(cols[0], key_type), *[pa.array(c, pa.int64()) for c in longs]]
        arrays += [pa.array(k, pa.int64()), pa.array(cols[5], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["key", *LONGS, "class", "ids"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_ids(path).encode
        worker = TaskContext.get().partitionId()
        bins, key_type = Bins(worker << 32), None
        for batch in batches:
            key_type = batch.schema.field(0).type
            for part in chunks(batch, "text", CHUNK):
                out = []
                for doc, words in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    ids = encode(words) + end
                    n = len(ids) // 4
                    for start, length, k in cut(n, capacity, classes, slack):
                        own = ids[4 * start : 4 * (start + length)]
                        piece = [doc, start, length, zlib.crc32(own), n, own if with_ids else None]
                        out += bins.add(k, piece)
                yield batch_of(out, worker, key_type)
        if key_type is not None:
            yield batch_of(bins.rest(), worker, key_type)

    def refill(turn: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            worker = TaskContext.get().partitionId()
            bins, key_type, out = Bins(turn << 56 | worker << 32), None, []
            for batch in batches:
                key_type = batch.schema.field(0).type
                for row in batch.to_pylist():
                    piece = [row[n] for n in ("key", "start", "length", "ids_crc32", "doc_tokens")]
                    out += bins.add(row["class"], [*piece, row["ids"]])
                yield batch_of(out, worker, key_type)
                out = []
            if key_type is not None:
                yield batch_of(bins.best_fit(capacity) if last else bins.rest(), worker, key_type)

        return run

    now = cut_lineage(rows.mapInArrow(fill, schema))
    closed = now.filter(F.col("sequence_id").isNotNull())
    turn, workers = 0, None
    while workers != 1:
        rest = now.filter(F.col("sequence_id").isNull())
        if workers is None:
            workers = (rest.agg(F.max("worker")).first()[0] or 0) + 1
        workers, turn = -(-workers // FAN_IN), turn + 1
        merged = rest.repartitionById(workers, (F.col("worker") / FAN_IN).cast("int"))
        merged = merged.sortWithinPartitions("worker", "class", "length", "key", "start")
        now = cut_lineage(merged.mapInArrow(refill(turn, workers == 1), schema))
        closed = closed.unionByName(now.filter(F.col("sequence_id").isNotNull()))
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return closed.select(F.col("key").alias(key), *names, *(["ids"] if with_ids else []))
