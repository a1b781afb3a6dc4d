"""Token sequences in a keyed global order, as binary shards of fixed-stride records."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decisionlab.llm.text import chunks, mix
from decisionlab.llm.tokens import default_path, token_ids
from decisionlab.session import new_dir

CHUNK = 4 << 20
ROUNDS = 6
# A record: number of ids, CRC-32 of their bytes, then the ids, padded with zeros.
HEADER = np.dtype([("length", "<u4"), ("crc", "<u4")])


class Permutation:
    """A keyed bijection of 0..n-1: a Feistel network over the next even power of two.

    Values that fall outside walk on through the network until they come back inside, at most
    four steps on average, so no table of the order is ever held.
    """

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = np.uint64(max(1, -(-(max(n, 1) - 1).bit_length() // 2)))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        seeds = np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        self.keys = mix(seeds ^ np.uint64(key & (1 << 64) - 1))

    def _pass(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & self.mask)
        return right << self.half | left

    def _walk(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        out = self._pass(x.astype(np.uint64), keys)
        while (outside := out >= np.uint64(self.n)).any():
            out[outside] = self._pass(out[outside], keys)
        return out.astype(np.int64)

    def slot(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, self.keys)

    def index(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, self.keys[::-1])


@cache
def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def shard_path(root: str, shard: int) -> str:
    return f"{root}/shard-{shard:06d}.bin"


class ShardWriter:
    """Fixed-stride records of consecutive slots, one shard file at a time.

    A shard is written under a name of its own and moved into place when it is complete, so a
    task that runs twice, or dies, leaves whole shards only, and the same bytes.
    """

    def __init__(self, root: str, ids_per_record: int, width: int, slots_per_shard: int):
        self.fs, self.folder = filesystem(root)
        self.width, self.slots_per_shard = width, slots_per_shard
        self.stride = HEADER.itemsize + width * ids_per_record
        self.slot, self.ids, self.shard, self.out, self.name = None, [], None, None, ""

    def add(self, slot: int, ids: bytes) -> None:
        """More ids for `slot`; slots come in order, and the pieces of one in their order."""
        if slot != self.slot:
            self.end_record()
            if slot // self.slots_per_shard != self.shard:
                self.end_shard()
                self.shard = slot // self.slots_per_shard
                self.name = f"{self.folder}/.{self.shard:06d}-{uuid.uuid4().hex}"
                self.out = self.fs.open_output_stream(self.name)
            self.slot = slot
        self.ids.append(ids)

    def end_record(self) -> None:
        if self.ids:
            ids = b"".join(self.ids)
            head = np.array([(len(ids) // self.width, zlib.crc32(ids))], HEADER).tobytes()
            self.out.write((head + ids).ljust(self.stride, b"\0"))
            self.ids = []

    def end_shard(self) -> None:
        self.end_record()
        if self.out is not None:
            self.out.close()
            self.fs.move(self.name, shard_path(self.folder, self.shard))
            self.out = None


def materialise(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    *,
    seed: int = 17,
    ids_per_record: int = 1024,
    slots_per_shard: int = 32_768,
    end_id: int = 1,
    tokenizer: str | None = None,
    path: str | None = None,
) -> DataFrame:
    """Write all sequences of `docs` in training order and return their index.

    Every document's ids are closed by `end_id`. The tasks of the scan lay theirs end to end
    and cut them into sequences of `ids_per_record`; only a task's last one may be shorter. All
    sequences are numbered in the order of the scan, and a keyed permutation gives each number
    its slot. Shard s holds the slots from s * `slots_per_shard` on, one fixed-stride record
    each, so slot t is found by arithmetic and a reader goes on from any slot by one seek
    (`read_slots`). Index rows, one per document and sequence: `key`, `start` (its document's
    ids before it), `length`, `slot`, `offset` (ids before it in the record), `shard`, `byte_offset`
    (of its first id in the shard), `ids_crc32`. Files: `path`, by default a new folder in the shared
    folder, holds the shards, `index` and `layout` (both Parquet).

    The texts are tokenised once; the table of ids is written, and each of its tasks then
    needs only how many sequences came before it, one number a task. The pieces are
    shuffled once, straight to the task that writes their shard. A null or empty text is the end id
    alone. Null keys, repeated keys and repeated rows are documents of their own. Other
    columns are not read. No documents: no shards, an empty index.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or default_path()
    path = (path or new_dir(spark, "training-order")).rstrip("/")
    vocabulary = token_ids(tokenizer).tokenizer.get_vocab_size()
    width = 2 if max(vocabulary, end_id + 1) <= 1 << 16 else 4
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_ids(tokenizer).encode
        worker, first = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                ids, firsts = [], []
                for words in part.column("text").to_pylist():
                    own = np.frombuffer(encode(words), "<u4")
                    ids.append(np.append(own, np.uint32(end_id)).astype(f"<u{width}").tobytes())
                    firsts.append(first)
                    first += len(own) + 1
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array([worker] * len(ids), pa.int64()),
                     pa.array(firsts, pa.int64()), pa.array(ids, pa.binary())],
                    ["key", "worker", "first", "ids"],
                )

    schema = f"key {kind}, worker long, first long, ids binary"
    ids_path = f"{path}/ids"
    rows.mapInArrow(tokenise, schema).write.option("compression", "zstd").parquet(ids_path)
    ids = spark.read.schema(schema).parquet(ids_path)
    end = F.max(F.col("first") + F.octet_length("ids") / F.lit(width))
    ends = ids.groupBy("worker").agg(F.ceil(end / ids_per_record).alias("n")).collect()
    before, total = {}, 0
    for worker, n in sorted(map(tuple, ends)):
        before[worker], total = total, total + n
    order = Permutation(total, seed)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1, write_content_size=True).compress
        for batch in batches:
            for part in chunks(batch, "ids", CHUNK):
                rows, starts, lengths, index, offsets, cuts = [], [], [], [], [], []
                columns = [part.column(n).to_pylist() for n in ("worker", "first", "ids")]
                for i, (worker, first, own) in enumerate(zip(*columns, strict=True)):
                    n, at = len(own) // width, 0
                    while at < n:
                        sequence, offset = divmod(first + at, ids_per_record)
                        length = min(n - at, ids_per_record - offset)
                        rows.append(i)
                        starts.append(at)
                        lengths.append(length)
                        index.append(before[worker] + sequence)
                        offsets.append(offset)
                        cuts.append(pack(own[width * at : width * (at + length)]))
                        at += length
                slots = order.slot(np.array(index, np.int64))
                longs = [starts, lengths, slots, offsets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("key").take(pa.array(rows, pa.int64())),
                     *[pa.array(x, pa.int64()) for x in longs], pa.array(cuts, pa.binary())],
                    ["key", "start", "length", "slot", "offset", "ids"],
                )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        shards = ShardWriter(path, ids_per_record, width, slots_per_shard)
        for batch in batches:
            slots, offsets = batch.column("slot").to_numpy(), batch.column("offset").to_numpy()
            crcs = []
            for slot, own in zip(slots.tolist(), batch.column("ids").to_pylist(), strict=True):
                own = unpack(own)
                shards.add(slot, own)
                crcs.append(zlib.crc32(own))
            places = slots % slots_per_shard * shards.stride + HEADER.itemsize + width * offsets
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(slots // slots_per_shard), pa.array(places),
                 pa.array(crcs, pa.int64())],
                [*batch.schema.names[:-1], "shard", "byte_offset", "ids_crc32"],
            )
        shards.end_shard()

    longs = "start long, length long, slot long, offset long"
    shards = max(1, -(-total // slots_per_shard))
    placed = ids.mapInArrow(place, f"key {kind}, {longs}, ids binary")
    dealt = placed.repartitionById(shards, F.floor(F.col("slot") / slots_per_shard).cast("int"))
    index = dealt.sortWithinPartitions("slot", "offset").mapInArrow(
        write, f"key {kind}, {longs}, shard long, byte_offset long, ids_crc32 long"
    )
    index = index.withColumnRenamed("key", key)
    index.write.parquet(f"{path}/index")
    layout = (total, ids_per_record, width, slots_per_shard, seed)
    spark.createDataFrame(
        [layout], "slots long, ids_per_record long, width long, slots_per_shard long, seed long"
    ).write.parquet(f"{path}/layout")
    return spark.read.schema(index.schema).parquet(f"{path}/index")


def read_slots(spark: SparkSession, path: str, start: int, n: int) -> Iterator[np.ndarray]:
    """The ids of up to `n` records from slot `start` on, in order; each is checked by its CRC."""
    slots, per_record, width, per_shard, _ = spark.read.parquet(f"{path}/layout").first()
    fs, folder = filesystem(path)
    stride = HEADER.itemsize + width * per_record
    slot, stop = start, min(start + n, slots)
    while slot < stop:
        shard, place = divmod(slot, per_shard)
        end = min(stop, (shard + 1) * per_shard)
        with fs.open_input_file(shard_path(folder, shard)) as f:
            f.seek(place * stride)
            for at in range(slot, end):
                record = f.read(stride)
                length, crc = np.frombuffer(record[: HEADER.itemsize], HEADER)[0]
                ids = record[HEADER.itemsize : HEADER.itemsize + width * int(length)]
                if zlib.crc32(ids) != crc:
                    raise ValueError(f"slot {at} is damaged")
                yield np.frombuffer(ids, f"<u{width}")
        slot = end
