"""Runs of repeated words against a comparison of all distances."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pyarrow as pa
import pytest

from decisionlab.llm import periodic_runs, queries

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w, least=24, times=3):
    """All runs, by holding the sequence against itself at every distance."""
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            smaller = (all(w[k] == w[k + r] for k in range(i, i + n - r)) for r in range(1, q))
            if j > i and n >= max(least, times * q) and not any(smaller):
                out.append((i, n, q))
            i = j + 1 if j == i else j
    return sorted(out)


def planted(rng, n, kinds):
    w = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randrange(3)):
        if n > 5:
            a = rng.randrange(n)
            p = rng.randrange(1, max(2, (n - a) // 3 + 1))
            for i in range(a, min(n, a + p * rng.randrange(3, 9) + rng.randrange(p))):
                w[i] = w[a + (i - a) % p]
    return w


def test_automaton_against_all_distances():
    rng = random.Random(1)
    for _ in range(600):
        w = planted(rng, rng.randrange(130), rng.choice([1, 2, 3, 30]))
        assert periodic_runs.runs_of(w) == plain_runs(w)
        assert periodic_runs.runs_of(w, 3, 3) == plain_runs(w, 3, 3)
        text = " ".join(map(str, w))
        batch = pa.RecordBatch.from_arrays([pa.array(["x y", text, None, f"\n{text}\t "])], ["text"])
        n, runs, left = periodic_runs.collapse(batch, 24, 3)
        assert n.tolist() == [2, len(w), 0, len(w)]
        assert runs == [[], plain_runs(w), [], plain_runs(w)] and left[1] == left[3]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_row(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, digest(listed), digest(left))


def test_op13_against_all_distances(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    # Holding against every distance is quadratic: hash-free, but for the longest texts too slow.
    some = {r.doc_id: plain_row(r.doc_id, r.text) for r in docs if len(r.text or "") < 6000}
    got = {r.doc_id: tuple(r) for r in queries.QUERIES["op13_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(docs) and len(some) > 900
    assert all(got[k] == v for k, v in some.items())
    assert sum(r[1] > 0 for r in got.values()) > 80


def test_odd_rows(spark):
    loop = " ".join(f"w{i % 5}" for i in range(40))
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, loop), (4, loop), (None, loop), (5, "a b a\x1cb"), (6, "z " * 23),
        (7, "z " * 24), (8, "Ünï 🙂 " * 30), (9, "v " + "word other " * 60_000), (10, "x" * 200_000),
    ]
    docs = spark.createDataFrame([(i, t, 1, "k", 2) for i, t in rows], "doc_id long, text string, n_words int, runs string, key int")
    got = periodic_runs.periodic_runs(docs).collect()
    assert sorted(repr(r.doc_id) for r in got) == sorted(repr(i) for i, _ in rows)
    by = {r.doc_id: (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got}
    assert by[1] == by[2] == by[3] == (0, [], "")
    assert by[4] == by[None] == (40, [(0, 40, 5)], "w0 w1 w2 w3 w4")
    assert by[5] == (2, [], "a b a\x1cb") and by[6][1] == [] and by[7] == (24, [(0, 24, 1)], "z")
    assert by[8][2] == "Ünï 🙂" and by[9] == (120_001, [(1, 120_000, 2)], "v word other") and by[10][0] == 1
    assert periodic_runs.periodic_runs(docs.filter("false")).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(docs, least=4)
