"""Repeated byte strings across documents, by suffix arrays over shared surroundings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decisionlab.llm.bitmap import bitmap, holds
from decisionlab.llm.text import Slices, chunks, utf8
from decisionlab.session import cut_lineage

CHUNK = 4 << 20
# Bytes that are hashed at once; texts of any length go through in such parts.
PART = 1 << 20
# Bytes of the strings by whose least hash a longer string is dealt.
GRAM = 32
# Bytes of the stretches that one suffix array covers (more if one group has more).
BATCH = 1 << 20
# Different stretches of one group beyond which each of their strings is dealt by itself.
MOST = 20_000
# Ends every stretch; no UTF-8 text holds this byte.
END = 0xFF


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbouring values."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def stretches(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Neighbouring starts of strings of `length` bytes that are dealt to the same group.

    A string's group is the least hash of its GRAM-byte strings, so equal strings have the same
    wherever they stand. A stretch also ends where the first place of that hash falls out of
    the string, so no two starts of one stretch begin equal strings. Returns group, hash of
    the bytes that the stretch's strings cover, text number, first start within the text, and
    number of starts.
    """
    gram = min(GRAM, length)
    out: list[tuple[np.ndarray, ...]] = []
    for low in range(0, len(data) - length + 1, PART):
        part = data[low : low + PART + length - 1]
        slices, at = Slices(part), np.arange(len(part) - gram + 1)
        grams = slices.hash(at, at + gram)
        least = sliding_least(grams, length - gram + 1)
        n = len(least)
        # Strings must not run over the end of a text.
        cuts = ends[(ends > low) & (ends < low + len(part))] - low
        over = np.zeros(n + 1, np.int64)
        np.add.at(over, np.clip(cuts - length + 1, 0, n), 1)
        np.add.at(over, np.clip(cuts, 0, n), -1)
        inside = np.cumsum(over[:-1]) == 0
        change = np.ones(n + 1, bool)
        change[1:-1] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])
        change[1:-1] |= grams[: n - 1] == least[:-1]
        start = np.flatnonzero(inside & change[:-1])
        stop = np.flatnonzero(inside & change[1:])
        text = np.searchsorted(ends, start + low, side="right") - 1
        out.append((
            least[start], slices.hash(start, stop + length), text, start + low - ends[text], stop - start + 1
        ))
    if not out:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by at least their first `depth` bytes, by two-stage sorting.

    Only suffixes smaller than their successors are sorted directly. The others follow from one
    scan over the buckets of first bytes: whenever a suffix is passed whose predecessor is
    larger than it, that predecessor takes the next place at the front of its own bucket. The
    scan goes bucket by bucket, and within a bucket in waves of what is already placed.
    """
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int16)))
    told = np.append(np.where(step != 0, np.arange(n - 1), n - 1), n - 1)
    told = np.minimum.accumulate(told[::-1])[::-1]
    larger = np.append(step, -1)[told] < 0
    raw = text.tobytes()
    direct = sorted(np.flatnonzero(~larger).tolist(), key=lambda i: raw[i : i + depth])
    direct = np.array(direct, np.int64)

    sizes = np.bincount(text, minlength=256)
    starts = np.cumsum(sizes) - sizes
    induced = np.bincount(text[larger], minlength=256)
    order = np.empty(n, np.int64)
    bounds = np.cumsum(np.bincount(text[direct], minlength=256))
    for c in np.flatnonzero(sizes > induced).tolist():
        own = direct[bounds[c] - (sizes[c] - induced[c]) : bounds[c]]
        order[starts[c] + induced[c] : starts[c] + sizes[c]] = own
    front = starts.copy()
    order[front[text[-1]]] = n - 1
    front[text[-1]] += 1

    def pass_over(some: np.ndarray) -> None:
        before = some[some > 0] - 1
        before = before[larger[before]]
        byte = text[before]
        by_byte = np.argsort(byte, kind="stable")
        before, byte = before[by_byte], byte[by_byte]
        count = np.bincount(byte, minlength=256)
        place = front[byte] + np.arange(len(byte)) - (np.cumsum(count) - count)[byte]
        order[place] = before
        front[:] += count

    for c in np.flatnonzero(sizes).tolist():
        done = starts[c]
        while done < front[c]:
            done, begin = front[c], done
            pass_over(order[begin:done])
        pass_over(order[starts[c] + induced[c] : starts[c] + sizes[c]])
    return order


def repeated_starts(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """For each stretch, which of its starts begin a string that begins elsewhere, too."""
    text = np.frombuffer(b"".join(p + bytes([END]) for p in pieces) + bytes(8), np.uint8)
    n = len(text) - 8
    order = suffix_array(text[:n], length)
    ends = np.cumsum([len(p) + 1 for p in pieces])
    begins = ends - np.array([len(p) + 1 for p in pieces])
    whole = np.zeros(n, bool)
    for b, e in zip(begins.tolist(), ends.tolist(), strict=True):
        whole[b : e - length] = True
    # Adjacent common prefixes, eight bytes at a time, as long as they last.
    eight = np.zeros(n, np.uint64)
    for j in range(8):
        eight |= text[j : j + n].astype(np.uint64) << np.uint64(8 * j)
    a, b = order[:-1], order[1:]
    same = whole[a] & whole[b]
    a, b = a[same], b[same]
    for j in [*range(0, length - 8, 8), max(0, length - 8)]:
        same = eight[a + j] == eight[b + j]
        a, b = a[same], b[same]
    hit = np.zeros(n, bool)
    hit[a] = True
    hit[b] = True
    return [hit[s : e - length] for s, e in zip(begins.tolist(), ends.tolist(), strict=True)]


def flag_runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last position of every run of true flags."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge > 0), np.flatnonzero(edge < 0) - 1


def row_marks(key: str, text: str) -> list[Column]:
    """Two hashes that stand for a row: of key and text, and of the text. Never null."""
    return [F.xxhash64(F.col(key), F.col(text)).alias("mark"), F.xxhash64(F.col(text)).alias("hash")]


class Repeats:
    """The steps of one search; `repeats` below runs them."""

    row = ("mark", "hash")
    stretch = ("group", "content", "n")

    def __init__(self, docs: DataFrame, key: str, text: str, length: int, most: int):
        if length < 8:
            raise ValueError("strings must have at least 8 bytes")
        self.length, self.most = length, most
        words = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
        self.rows = docs.select(F.col(key).alias("key"), *row_marks(key, text), words.alias("text"))

    def all_stretches(self) -> DataFrame:
        length = self.length

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunks(batch, "text", CHUNK):
                    group, content, text, at, n = stretches(*utf8(part.column("text")), length)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(group.view(np.int64)), pa.array(content.view(np.int64)),
                         pa.array(n.astype(np.int32)), *[part.column(c).take(pa.array(text)) for c in ("mark", "hash")],
                         pa.array(at.astype(np.int32))],
                        ["group", "content", "n", "mark", "hash", "at"],
                    )

        return self.rows.select("mark", "hash", "text").mapInArrow(
            run, "group long, content long, n int, mark long, hash long, at int"
        )

    def with_text(self, wanted: DataFrame) -> DataFrame:
        """Join `wanted` (one row per document) with the texts, sieved before they are shuffled."""
        bits = bitmap(wanted, "mark")

        def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kept = holds(bits.value, batch.column("mark").to_numpy().view(np.uint64))
                yield batch.filter(pa.array(kept))

        return self.rows.mapInArrow(sieve, self.rows.schema).join(wanted, list(self.row))

    def texts_of(self, stretches_: DataFrame) -> DataFrame:
        """The bytes of one occurrence of each stretch (again for each copy of its whole row)."""
        length = self.length
        place = F.struct("at", "n", "group", "content", "alone", "crowded")
        wanted = stretches_.groupBy(*self.row).agg(F.collect_list(place).alias("places"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["group", "content", "n", "alone", "crowded"]
            for batch in batches:
                for part in chunks(batch, "text", CHUNK):
                    places = part.column("places")
                    flat = places.flatten()
                    text = np.repeat(np.arange(len(places)), places.value_lengths().to_numpy())
                    at, n = (flat.field(c).to_numpy() for c in ("at", "n"))
                    texts = part.column("text").to_pylist()
                    found = [
                        texts[t][a : a + m + length - 1]
                        for t, a, m in zip(text.tolist(), at.tolist(), n.tolist(), strict=True)
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [*[flat.field(c) for c in names], pa.array(found, pa.binary())], [*names, "bytes"]
                    )

        schema = "group long, content long, n int, alone boolean, crowded boolean, bytes binary"
        return self.with_text(wanted).select("text", "places").mapInArrow(run, schema)

    def by_suffix_array(self, texts: DataFrame) -> DataFrame:
        length = self.length

        def solve(rows: list[tuple]) -> pa.RecordBatch:
            out = []
            if len(rows) > 1:
                hits = repeated_starts([r[4] for r in rows], length)
                for (group, content, n, alone, _), hit in zip(rows, hits, strict=True):
                    if alone:
                        out += [(group, content, n, a, b) for a, b in zip(*map(np.ndarray.tolist, flag_runs(hit)), strict=True)]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["group", "content", "n", "first", "last"],
            )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in ("group", "content", "n", "alone", "bytes")]
                for row in zip(*columns, strict=True):
                    if held and row[:3] == held[-1][:3]:
                        continue
                    if size > BATCH and row[0] != held[-1][0]:
                        yield solve(held)
                        held, size = [], 0
                    held.append(row)
                    size += len(row[4])
            if held:
                yield solve(held)

        dealt = texts.repartition("group").sortWithinPartitions("group", "content", "n")
        return dealt.mapInArrow(run, "group long, content long, n int, first int, last int")

    def one_by_one(self, texts: DataFrame) -> DataFrame:
        """The same for crowded groups: every string is dealt by its own hash and counted."""
        length = self.length

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunks(batch, "bytes", 1 << 18):
                    data, ends = utf8(part.column("bytes"))
                    n = part.column("n").to_numpy().astype(np.int64)
                    row = np.repeat(np.arange(len(n)), n)
                    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                    start = ends[row] + place
                    marks = Slices(data).hash(start, start + length).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [*[part.column(c).take(pa.array(row)) for c in ("group", "content", "n", "alone")],
                         pa.array(place.astype(np.int32)), pa.array(marks)],
                        ["group", "content", "n", "alone", "first", "mark"],
                    )

        schema = "group long, content long, n int, alone boolean, first int, mark long"
        strings = texts.dropDuplicates(list(self.stretch)).mapInArrow(run, schema)
        counts = strings.groupBy("group", "mark").agg(F.count("*").alias("times")).filter("times > 1")
        return strings.filter("alone").join(counts, ["group", "mark"]).select(
            *self.stretch, "first", F.col("first").alias("last")
        )

    def spans(self) -> DataFrame:
        """Rows `mark`, `hash` with all ranges (start, end) of bytes that repeated strings cover."""
        everything = cut_lineage(self.all_stretches())
        groups = everything.groupBy("group").agg(F.count("*").alias("times")).filter("times > 1")
        shared = cut_lineage(everything.join(groups.select("group"), "group", "left_semi"))
        # Equal stretches are one from here on, with the place of one occurrence.
        place = F.struct("mark", "hash", "at")
        kinds = cut_lineage(
            shared.groupBy(*self.stretch).agg(F.count("*").alias("times"), F.min(place).alias("place"))
        )
        sizes = kinds.groupBy("group").agg(F.count("*").alias("kinds")).filter("kinds > 1")
        mixed = kinds.join(sizes, "group").select(
            *self.stretch, "place.*",
            (F.col("times") == 1).alias("alone"), (F.col("kinds") > self.most).alias("crowded"),
        )
        texts = cut_lineage(self.texts_of(mixed))
        copied = kinds.filter("times > 1").select(
            *self.stretch, F.lit(0).alias("first"), (F.col("n") - 1).alias("last")
        )
        found = copied.unionByName(self.by_suffix_array(texts.filter("NOT crowded")))
        found = found.unionByName(self.one_by_one(texts.filter("crowded")))
        ranges = shared.join(found, list(self.stretch)).select(
            *self.row,
            F.struct(
                (F.col("at") + F.col("first")).cast("long").alias("start"),
                (F.col("at") + F.col("last") + self.length).cast("long").alias("end"),
            ).alias("range"),
        )
        return cut_lineage(ranges.groupBy(*self.row).agg(F.collect_list("range").alias("ranges")))


def covered(ranges: list[dict]) -> list[tuple[int, int]]:
    """Overlapping or touching ranges as one."""
    out: list[list[int]] = []
    for start, end in sorted((r["start"], r["end"]) for r in ranges):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", *, length: int = 200, most: int = MOST
) -> DataFrame:
    """Documents with bytes that lie in a string of `length` bytes that starts anywhere else, too.

    Returns `key`, `mark` and `hash` (the row's hashes, see `row_marks`), `spans` (maximal removed runs as
    start and end, in bytes of the UTF-8 text) and `kept` (the other bytes): one row for each row of
    `docs` with at least one span. Matches never cross documents, may overlap, and are judged on the
    texts as given. Null and empty texts, and those shorter than `length`, have no spans. Repeated rows
    are occurrences of their own, so they repeat each other. Null keys are keys like any other. Other
    columns are not read.

    Strings are dealt by the least hash of their 32-byte strings. Neighbouring strings of one group
    form stretches; groups with a single stretch end there, equal stretches become one, and the
    different ones of a group are sorted as suffixes in one task. A group with more than `most`
    different ones is dealt anew, string by string, so no task holds an unbounded group.
    """
    job = Repeats(docs, key, text, length, most)
    spans = job.spans()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                runs, kept = [], []
                for own, ranges in zip(part.column("text").to_pylist(), part.column("ranges").to_pylist(), strict=True):
                    gone = covered(ranges)
                    runs.append([{"start": a, "end": b} for a, b in gone])
                    edges = [0, *[x for span in gone for x in span], len(own)]
                    kept.append(b"".join(own[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in ("key", "mark", "hash")], pa.array(runs, kind), pa.array(kept, pa.binary())],
                    ["key", "mark", "hash", "spans", "kept"],
                )

    kind = job.rows.schema["key"].dataType.simpleString()
    out = job.with_text(spans).mapInArrow(
        run, f"key {kind}, mark long, hash long, spans array<struct<start:bigint,end:bigint>>, kept binary"
    )
    return out.withColumnRenamed("key", key)
