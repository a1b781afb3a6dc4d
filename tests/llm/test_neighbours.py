"""SimHash groups, vector links and components against brute force."""

import math
import random
import re

import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from decisionlab.llm import embedding_dedup, queries, simhash
from decisionlab.llm.graph import components
from decisionlab.session import cut_lineage

SF = "/root/testdata/sf0.001"


def roots_of(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_fingerprint(text, width):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    if not words:
        return 0
    n = min(width, len(words))
    hashes = [
        xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42)
        for i in range(len(words) - n + 1)
    ]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def check_groups(rows, got, bits=4):
    """rows: (doc_id, text); got: (doc_id, fingerprint, component_id)."""
    prints = [plain_fingerprint(t, 4) for _, t in rows]
    links = [
        (a, b)
        for a in range(len(rows))
        for b in range(a)
        if (prints[a] ^ prints[b]).bit_count() <= bits
    ]
    roots = roots_of(range(len(rows)), links)
    names = {}
    for i, r in roots.items():
        if rows[i][0] is not None:
            names[r] = min(names.get(r, rows[i][0]), rows[i][0])
    want = [(rows[i][0], f"{prints[i]:016x}", names.get(roots[i])) for i in range(len(rows))]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)


def test_components_against_union_find(spark):
    rng = random.Random(5)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    links += [(i, i + 1) for i in range(300, 420)] + [(500, i) for i in range(501, 600)]
    links += [(7, 7), (7, 7)]
    nodes = {n for a, b in links if a != b for n in (a, b)}
    got = components(spark.createDataFrame(links, "a long, b long"))
    want = {n: r for n, r in roots_of(nodes | {7}, links).items() if n != r}
    assert {r.node: r.root for r in got.collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_op6_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check_groups(rows, queries.QUERIES["op6_simhash_groups"](spark, SF).collect())


@pytest.mark.parametrize("bits", [2, 4, 8])
def test_near_pairs_finds_every_pair(spark, bits):
    rng = random.Random(bits)
    base = [rng.getrandbits(64) for _ in range(12)]
    prints = {0, (1 << 64) - 1, 1 << 63}
    for b in base:
        for _ in range(25):
            x = b
            for j in rng.sample(range(64), rng.randrange(bits + 3)):
                x ^= 1 << j
            prints.add(x)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = simhash.near_pairs(spark.createDataFrame([(p,) for p in signed], "fp long"), bits)
    want = {
        (min(a, b), max(a, b))
        for a in signed
        for b in signed
        if a != b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= bits
    }
    rows = [(r.a, r.b) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_near_pairs_sends_no_entries_to_the_driver(spark):
    """A stored table of fingerprints becomes many entries, which no size estimate sees; they are not broadcast."""
    prints = cut_lineage(spark.createDataFrame([(1,), (3,)], "fp long"))
    plan = simhash.near_pairs(prints, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 1


def test_simhash_edge_cases(spark):
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (5, "one  TWO"),
        (None, "one two"), (None, "null key alone here now"), (9, long), (8, long + " tail"),
        (10, "ÄÖ ß emoji 🙂 x y z"), (11, "a b c d"), (12, "A b\x0bc d"),
    ]
    df = spark.createDataFrame(
        [(i, t, 1, "x", 5) for i, t in rows],
        "doc_id long, text string, fp int, component string, _key int",
    )
    got = simhash.near_groups(df)
    check_groups(rows, [(r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component) for r in got.collect()])
    assert simhash.near_groups(df.filter("false")).count() == 0


def plain_links(rows, threshold=0.93):
    def ok(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def cosine(a, b):
        a, b = ([x / max(map(abs, v)) for x in v] for v in (a, b))
        dot = sum(x * y for x, y in zip(a, b))
        return dot / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b)))

    return [
        (i, j)
        for i, (_, v, label) in enumerate(rows)
        for j, (_, w, other) in enumerate(rows[:i])
        if label is not None and label == other and ok(v) and ok(w) and len(v) == len(w)
        and cosine(v, w) >= threshold
    ]


def check_vectors(rows, got, threshold=0.93):
    links = plain_links(rows, threshold)
    count = [0] * len(rows)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    roots = roots_of(range(len(rows)), links)
    names = {}
    for i, r in roots.items():
        if rows[i][0] is not None:
            names[r] = min(names.get(r, rows[i][0]), rows[i][0])
    want = [
        (rows[i][0], count[i], names.get(roots[i]), names.get(roots[i]) == rows[i][0])
        for i in range(len(rows))
    ]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)


def test_op10_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    check_vectors(rows, queries.QUERIES["op10_embedding_links"](spark, SF).collect())


def test_vectors_in_many_blocks(spark):
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    rows = []
    for i in range(240):
        c = centres[min(rng.randrange(14), 7)]
        v = [x + rng.gauss(0, 0.25) for x in c]
        rows.append((i, rows[-1][1] if i % 11 == 10 else v, i % 2 if i % 13 else None))
    rows += [
        (300, [0.0] * 6, 0), (301, None, 0), (302, [None] * 6, 0), (303, [float("nan")] * 6, 0),
        (304, [float("inf")] + [0.0] * 5, 0), (305, [], 0), (306, [1.0, 2.0], 0), (307, [2.0, 4.0], 0),
        (308, [1e-200, 2e-200], 0), (308, [1e200, 2e200], 0), (None, [1.0, 2.0], 0), (306, [1.0, 2.0], 0),
    ]
    df = spark.createDataFrame(
        [(i, v, y, 1, "k") for i, v, y in rows],
        "vec_id long, embedding array<double>, label int, key int, block string",
    )
    got = embedding_dedup.near_vectors(df, block=16)
    check_vectors(rows, got.collect())
    assert embedding_dedup.near_vectors(df.filter("false")).count() == 0


def test_int8_bound_holds():
    import numpy as np

    rng = np.random.default_rng(0)
    raw = rng.normal(size=(64, 33)) * rng.choice([1e-3, 1.0, 50.0], size=(64, 33))
    tile = embedding_dedup.Tile(raw)
    product = (tile.codes @ tile.codes.T).astype(float) * tile.scale[:, None] * tile.scale
    bound = tile.error[:, None] * tile.size + tile.error + 1e-9
    assert (np.abs(tile.unit @ tile.unit.T - product) <= bound).all()
    for threshold in (-0.2, 0.0, 0.3):
        i, j = embedding_dedup.linked(tile, tile, threshold)
        got = set(zip(i.tolist(), j.tolist()))
        exact = tile.unit @ tile.unit.T
        want = {(a, b) for a in range(64) for b in range(64) if exact[a, b] >= threshold}
        assert got == want
