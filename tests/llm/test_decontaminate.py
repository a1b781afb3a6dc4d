"""Benchmark overlaps against brute force, and the masks against every pair of mismatches."""

import itertools
import random
import re

import pytest

from decisionlab.llm import decontaminate, queries
from test_url_reputation import check_oracle

SF = "/root/testdata/sf0.001"


def words_of(text):
    out = re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", text or "")
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in out]


def plain_overlaps(docs, items, window=13, mismatches=2):
    index = {}
    parts = [(i, w[p : p + window]) for i, t in items for w in [words_of(t)] for p in range(len(w) - window + 1)]
    for i, part in parts:
        for j, word in enumerate(part):
            index.setdefault((j, word), []).append((i, part))
    out = set()
    for d, t in docs:
        w = words_of(t)
        for p in range(len(w) - window + 1):
            own = w[p : p + window]
            near = [x for j in range(mismatches + 1) for x in index.get((j, own[j]), [])]
            for i, part in near:
                if sum(a != b for a, b in zip(own, part)) <= mismatches:
                    out.add((d, i))
    return out


def test_masks_find_every_window():
    for bad in itertools.combinations(range(decontaminate.WINDOW), decontaminate.MISMATCHES):
        assert any(
            not {o + p for p in mask} & set(bad)
            for mask in decontaminate.MASKS
            for o in range(decontaminate.WINDOW - mask[-1])
        )


def test_op2_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = queries.QUERIES["op2_spaced_seed_overlaps"](spark, SF).collect()
    assert {(r.doc_id, r.item_id) for r in got} == plain_overlaps(docs, items) and len(got) > 0


def test_op2_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    df = queries.QUERIES["op2_spaced_seed_overlaps"](spark, sf)
    got = check_oracle.table(df.columns, [tuple(r) for r in df.collect()])
    result = check_oracle.connect(sf).execute(queries.SQL["op2_spaced_seed_overlaps"])
    assert got == check_oracle.table([d[0] for d in result.description], result.fetchall())


def planted():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of", "Ünd", "señor"]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, text(rng.randrange(5, 60))) for i in range(30)]
    docs = []
    for d in range(150):
        body = text(rng.randrange(0, 80))
        if d % 2:
            source = rng.choice(items)[1]
            n = rng.randrange(9, 30)
            s = rng.randrange(max(1, len(source) - n))
            part = source[s : s + n]
            for j in rng.sample(range(len(part)), min(len(part), rng.randrange(5))):
                part[j] = "changed"
            at = rng.randrange(len(body) + 1)
            body = body[:at] + part + body[at:]
        glue = rng.choice([" ", ", ", "\n\t", " -- "])
        docs.append((d, glue.join(w.upper() if d % 5 == 0 and w.isascii() else w for w in body)))
    items = [(i, " ".join(t)) for i, t in items] + [(90, None), (91, ""), (None, items[0][1] and " ".join(items[0][1]))]
    docs += [(900, None), (901, ""), (902, items[3][1]), (902, "clean text"), (None, items[3][1]), (903, items[3][1] * 3)]
    docs += [(903, items[3][1] * 3), (904, "w1 " * 40_000 + items[5][1])]
    return docs, items


def test_planted_passages(spark):
    docs, items = planted()
    d = spark.createDataFrame([(i, t, 1, "k") for i, t in docs], "doc_id long, text string, seed int, item_id string")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, mask int")
    got = decontaminate.overlaps(d.drop("item_id"), b)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == plain_overlaps(docs, items)
    kept = decontaminate.decontaminate(d, b)
    assert kept.columns == d.columns
    want = [(i, t) for n, (i, t) in enumerate(docs) if not plain_overlaps([(n, t)], items)]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.text)) for r in kept.collect())
    assert decontaminate.overlaps(d.drop("item_id"), b.filter("false")).count() == 0
    assert decontaminate.overlaps(d.drop("item_id").filter("false"), b).count() == 0


@pytest.mark.parametrize("n", [0, 1, 12, 13])
def test_short_texts(spark, n):
    text = " ".join(f"t{i}" for i in range(n))
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    b = spark.createDataFrame([(7, text)], "item_id long, text string")
    assert decontaminate.overlaps(d, b).count() == (n >= 13)
