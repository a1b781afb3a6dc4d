"""Repeated strings against brute force, and the suffix array against plain sorting."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from decisionlab.llm import queries, suffix_dedup
from decisionlab.llm.text import utf8

SF = "/root/testdata/sf0.001"


def plain_repeats(texts, length):
    """Bytes, bytes removed, spans and kept bytes of every text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        first, last = suffix_dedup.flag_runs(gone)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), list(zip(first.tolist(), (last + 1).tolist())), kept))
    return out


def test_op9_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {
        r.doc_id: (n, gone, len(spans), hashlib.sha256(kept).hexdigest())
        for r, (n, gone, spans, kept) in zip(rows, plain_repeats([r.text for r in rows], 200))
    }
    got = queries.QUERIES["op9_suffix_repeats"](spark, SF).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert len(got) == len(rows) and sum(x[1] for x in want.values()) > 0


@pytest.mark.parametrize("alphabet", [b"ab", b"abcdefgh", bytes(range(1, 255)), b"a"])
def test_suffix_array_against_sorting(alphabet):
    rng = random.Random(len(alphabet))
    for n in (1, 2, 3, 50, 700):
        raw = bytes(rng.choice(alphabet) for _ in range(n))
        order = suffix_dedup.suffix_array(np.frombuffer(raw, np.uint8), n).tolist()
        assert order == sorted(range(n), key=lambda i: raw[i:])
        shallow = suffix_dedup.suffix_array(np.frombuffer(raw, np.uint8), 8).tolist()
        assert sorted(shallow) == list(range(n))
        heads = [raw[i : i + 8] for i in shallow]
        assert heads == sorted(heads)


def test_starts_of_repeats():
    pieces = [b"xxabcdefghijyy", b"abcdefghij", b"zabcdefghi", b"short", b"nothing equal here"]
    got = [x.tolist() for x in suffix_dedup.repeated_starts(pieces, 9)]
    seen = Counter(p[i : i + 9] for p in pieces for i in range(len(p) - 8))
    assert got == [[seen[p[i : i + 9]] > 1 for i in range(len(p) - 8)] for p in pieces]


def test_stretches_hold_every_start_once():
    rng = random.Random(1)
    texts = ["", "a" * 500, "ab" * 300, "x" * 39, "y" * 40, "".join(rng.choice("ab é") for _ in range(900)), "tail"]
    data, ends = utf8(pa.array(texts))
    group, content, text, at, n = suffix_dedup.stretches(data, ends, 40)
    starts = sorted((t, a + i) for t, a, m in zip(text, at, n) for i in range(m))
    raw = [t.encode() for t in texts]
    assert starts == [(t, i) for t, b in enumerate(raw) for i in range(len(b) - 39)]
    by_string = {}
    for g, t, a, m in zip(group, text, at, n):
        own = [raw[t][a + i : a + i + 40] for i in range(m)]
        assert len(set(own)) == len(own)
        for x in own:
            assert by_string.setdefault(x, g) == g


def odd_rows():
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdeé🙂") for _ in range(rng.randrange(1, 8))) for _ in range(60)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passages = [text(n) for n in (5, 12, 20, 60)]
    rows = [(i, " ".join(rng.choice([text(4), text(15), rng.choice(passages)]) for _ in range(3))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "z" * 300), (103, "one two " * 40), (104, "z" * 41), (None, rows[0][1])]
    rows += [(None, "unique " + text(30)), (105, text(9)), (105, text(9)), (7, rows[7][1]), (7, rows[7][1])]
    rows += [(106, "q" * 39), (107, "q" * 40), (108, passages[2][:-1] + "!"), (109, text(4000)), (110, passages[3] * 3)]
    return rows


@pytest.mark.parametrize("most", [20_000, 1])
def test_odd_rows_against_brute_force(spark, most, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART", 1000)
    rows = odd_rows()
    df = spark.createDataFrame([(i, t, 1, "g") for i, t in rows], "doc_id long, text string, at int, group string")
    got = suffix_dedup.repeats(df, length=40, most=most).collect()
    want = [
        (key, spans, kept)
        for (key, _), (_, gone, spans, kept) in zip(rows, plain_repeats([t for _, t in rows], 40))
        if gone
    ]
    seen = [(r.doc_id, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in got]
    assert sorted(map(repr, seen)) == sorted(map(repr, want))


def test_empty_and_short_tables(spark):
    df = spark.createDataFrame([(1, "short"), (2, "short")], "doc_id long, text string")
    assert suffix_dedup.repeats(df).count() == 0
    assert suffix_dedup.repeats(df.filter("false")).count() == 0
