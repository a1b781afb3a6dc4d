"""Runs of periodically repeated words, by a suffix automaton and link-cut access."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decisionlab.llm.text import Slices, chunks, mix, utf8

CHUNK = 2 << 20
# A run has at least this many words and repeats its period this many times.
LEAST, TIMES = 24, 3
# Every stretch of so many words inside a run occurs in it again: a run of n words with period q
# has n >= 2 * q + GRAM - 1, be it as n >= LEAST or as n >= TIMES * q.
GRAM = 8
SPACE = np.isin(np.arange(256), [32, *range(9, 14)])


def automaton(word: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix links, longest lengths and the state of every prefix; state 1 is the empty string."""
    link, length, moves, ends = [0, 0], [0, 0], [{}, {}], []
    last = 1
    for w in word:
        new = len(link)
        link.append(1)
        length.append(length[last] + 1)
        moves.append({})
        at = last
        while at and w not in moves[at]:
            moves[at][w] = new
            at = link[at]
        if at:
            to = moves[at][w]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                twin = len(link)
                link.append(link[to])
                length.append(length[at] + 1)
                moves.append(moves[to].copy())
                link[to] = link[new] = twin
                while at and moves[at].get(w) == to:
                    moves[at][w] = twin
                    at = link[at]
        ends.append(new)
        last = new
    return link, length, ends


def runs_of(word: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """All runs of a sequence as (start, length, period), by start and period; `times` is 3 or more.

    The tree of suffix links is cut into paths of states that have last occurred at the same
    end; each path is a splay tree by depth, whose root holds that end. Access to the state of a prefix
    walks over the paths above it and makes them one. A path left at a state of length m
    means that the m words that end here have last ended there: if the distance of both ends is d <= m,
    the last m + d words have the smallest period d and begin where that period does. The
    run's last word gives its whole length.
    """
    up, length, ends = automaton(word)
    size = len(up)
    shallow, deep, seen = [0] * size, [0] * size, [0] * size
    found: dict[tuple[int, int], int] = {}
    for now, x in enumerate(ends, 1):
        below = 0
        while x:
            # Splay x to the root of its path.
            top = 0
            while True:
                p = up[x]
                if shallow[p] == x:
                    left = True
                elif deep[p] == x:
                    left = False
                else:
                    break
                g = up[p]
                straight = None
                if shallow[g] == p:
                    straight = left
                    top, bigger = g, True
                elif deep[g] == p:
                    straight = not left
                    top, bigger = g, False
                if straight is None:
                    top = p
                elif straight:
                    # p above g first
                    if bigger:
                        c = deep[p]
                        shallow[g] = c
                        deep[p] = g
                    else:
                        c = shallow[p]
                        deep[g] = c
                        shallow[p] = g
                    if c:
                        up[c] = g
                    h = up[g]
                    up[g], up[p] = p, h
                    if shallow[h] == g:
                        shallow[h] = p
                    elif deep[h] == g:
                        deep[h] = p
                # x above p
                if left:
                    c = deep[x]
                    shallow[p] = c
                    deep[x] = p
                else:
                    c = shallow[x]
                    deep[p] = c
                    shallow[x] = p
                if c:
                    up[c] = p
                h = up[p]
                up[p], up[x] = x, h
                if shallow[h] == p:
                    shallow[h] = x
                elif deep[h] == p:
                    deep[h] = x
                if straight is False:
                    # x above g, on the other side
                    if bigger:
                        c = deep[x]
                        shallow[g] = c
                        deep[x] = g
                    else:
                        c = shallow[x]
                        deep[g] = c
                        shallow[x] = g
                    if c:
                        up[c] = g
                    h = up[g]
                    up[g], up[x] = x, h
                    if shallow[h] == g:
                        shallow[h] = x
                    elif deep[h] == g:
                        deep[h] = x
            before = seen[top] if top else seen[x]
            if before:
                d, m = now - before, length[x]
                if d <= m and m + d >= least and m + d >= times * d:
                    found[now - m - d, d] = now
            if deep[x]:
                seen[deep[x]] = before
            deep[x] = below
            below, x = x, up[x]
        seen[below] = now
    return sorted((start, end - start, d) for (start, d), end in found.items())


def whitespace_words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and how many words come before each text and the end."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~SPACE[data]
    begins = inside[1:] & ~inside[:-1]
    finishes = inside[:-1] & ~inside[1:]
    # Neighbouring texts touch in the buffer: words end where a text ends.
    cuts = ends[1:-1]
    cuts = cuts[inside[cuts] & inside[cuts + 1]]
    begins[cuts] = True
    finishes[cuts] = True
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(finishes), np.searchsorted(start, ends)


def stretches(flagged: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of every stretch of flagged neighbours of one document."""
    linked = flagged[1:] & flagged[:-1] & (doc[1:] == doc[:-1])
    first = np.flatnonzero(flagged & ~np.concatenate([[False], linked]))
    last = np.flatnonzero(flagged & ~np.concatenate([linked, [False]]))
    return first, last


def regions(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray, least: int, times: int):
    """Where runs can lie: (document, first word, words) of stretches whose words all recur nearby.

    Hashes only widen them. A run's stretches of `GRAM` words all recur within a distance of its
    period, at most its length / `times`, so every run lies in one region as a whole.
    """
    doc = np.repeat(np.arange(len(before) - 1), np.diff(before))
    n = len(start) - GRAM + 1
    if n < 1:
        return
    place = np.arange(n)
    grams = Slices(Slices(data).hash(start, end)).hash(place, place + GRAM)
    # Grams that cross from one document into the next get a hash of their own.
    crosses = doc[:n] != doc[GRAM - 1 :]
    grams = np.where(crosses, mix(place.astype(np.uint64)), mix(grams + doc[:n].astype(np.uint64)))
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    gap = np.where(same, order[1:] - order[:-1], n + 1)
    near = np.full(n, n + 1)
    near[order[1:]] = gap
    near[order[:-1]] = np.minimum(near[order[:-1]], gap)
    flagged = near <= n
    for _ in range(2):
        first, last = stretches(flagged, doc[:n])
        size = last - first + GRAM
        fits = np.zeros(n, bool)
        for a, b, s in zip(first[size >= least].tolist(), last[size >= least].tolist(), size[size >= least].tolist()):
            fits[a : b + 1] = near[a : b + 1] <= s // times
        flagged = fits
    first, last = stretches(flagged, doc[:n])
    for a, b in zip(first.tolist(), last.tolist()):
        if b - a + GRAM >= least:
            yield int(doc[a]), a, b - a + GRAM


def collapse(batch: pa.RecordBatch, least: int, times: int) -> tuple[np.ndarray, list, list]:
    """Number of words, runs and remaining words of every text of a batch."""
    data, ends = utf8(batch.column("text"))
    start, end, before = whitespace_words(data, ends)
    raw = data.tobytes()
    runs = [[] for _ in range(len(ends) - 1)]
    for doc, first, n in regions(data, start, end, before, least, times):
        ids: dict[bytes, int] = {}
        words = [
            ids.setdefault(raw[s:e], len(ids))
            for s, e in zip(start[first : first + n].tolist(), end[first : first + n].tolist())
        ]
        offset = first - int(before[doc])
        runs[doc] += [(offset + s, m, q) for s, m, q in runs_of(words, least, times)]
    left = []
    for i, found in enumerate(runs):
        words = raw[ends[i] : ends[i + 1]].split()
        if found:
            found.sort()
            keep = np.ones(len(words), bool)
            for s, m, q in found:
                keep[s + q : s + m] = False
            words = [words[k] for k in np.flatnonzero(keep)]
        left.append(b" ".join(words))
    return np.diff(before), runs, left


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(
    docs: DataFrame, key: str = "doc_id", text: str = "text", *, least: int = LEAST, times: int = TIMES
) -> DataFrame:
    """The runs of repeated words of every whole text: one row per row of `docs`.

    Words are separated by ASCII white space. A run is a longest stretch of at least `least` words, and
    at least `times` (3 or more) times its smallest period, in which words one period apart are
    equal. Returns `key`, `n_words`, `runs` (start, length, period; by start, then period) and
    `collapsed`: the text without the words after the first period of any run, joined by
    single spaces. Null, empty and blank texts have no words and no runs. Repeated rows and null keys
    are treated row by row; other columns are not read; an empty table gives an empty result. Each
    text is judged by itself, so nothing is shuffled and a lost task only reads its rows again.
    """
    if least < 2 * GRAM + 8 or times < 3:
        raise ValueError("runs have at least 24 words and three periods")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                n, runs, left = collapse(part, least, times)
                sizes = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
                flat = np.array([r for found in runs for r in found], np.int64).reshape(-1, 3)
                found = pa.ListArray.from_arrays(
                    pa.array(sizes, pa.int32()),
                    pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"]),
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array(n, pa.int64()), found.cast(RUNS), pa.array(left, pa.binary())],
                    ["key", "n_words", "runs", "collapsed"],
                )

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    spans = "array<struct<start:bigint,length:bigint,period:bigint>>"
    found = rows.mapInArrow(run, f"key {kind}, n_words long, runs {spans}, collapsed binary")
    return found.select(
        F.col("key").alias(key), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed")
    )
