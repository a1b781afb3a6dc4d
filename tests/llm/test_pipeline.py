"""Verified near-duplicate removal, and every stage of the pipeline, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import __spark_entry__ as entry
from decisionlab.llm import simhash, toxicity_crf
from test_decontaminate import plain_overlaps
from test_neighbours import plain_fingerprint, roots_of
from test_secret_scan import plain_scan
from test_tokens import check_packing, plain  # noqa: F401

SF = "/root/testdata/sf0.01"


def shingle_set(text, width=5):
    words = (text or "").encode().lower().split()
    n = min(width, len(words))
    return {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def plain_unique(rows, bits=64, similarity=0.8):
    """Groups of rows (key, text, ...), of which one stays; by similarity alone, or with fingerprints as well."""
    prints = [plain_fingerprint(r[1], 5) for r in rows]
    sets = [shingle_set(r[1]) for r in rows]
    links = []
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                both = len(sets[a] & sets[b])
                if both >= similarity * (len(sets[a]) + len(sets[b]) - both):
                    links.append((a, b))
    groups = {}
    for i, r in roots_of(range(len(rows)), links).items():
        groups.setdefault(r, []).append(i)
    return [groups[r] for r in groups]


def check_unique(rows, kept, bits=64):
    groups = plain_unique(rows, bits)
    assert len(kept) == len(groups)
    left = list(kept)
    for group in groups:
        keys = [rows[i][0] for i in group]
        best = min((k for k in keys if k is not None), default=None)
        match = [k for k in left if k[0] == best and any(rows[i][:2] == k[:2] for i in group)]
        assert match
        left.remove(match[0])


def near_copies():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = []
    for d in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(3, 200))]
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    hot = [rng.choice(vocabulary) for _ in range(150)]
    for _ in range(60):
        copy = list(hot)
        for _ in range(3):
            copy[rng.randrange(150)] = rng.choice(vocabulary)
        rows.append((len(rows), " ".join(copy)))
    rows += [(900, None), (901, ""), (902, " "), (5, rows[5][1]), (5, rows[5][1]), (5, "other text"), (None, rows[9][1])]
    rows += [(None, "without a key"), (903, "same same " * 200), (904, "same same " * 150), (905, "same same " * 200 + "x y z")]
    rng.shuffle(rows)
    return rows


def test_unique_rows_against_brute_force(spark):
    rows = near_copies()
    df = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id long, text string, node string, mark int")
    kept = simhash.unique_rows(df)
    assert kept.columns == df.columns
    check_unique(rows, [(r.doc_id, r.text) for r in kept.collect()], bits=8)
    assert simhash.unique_rows(df.filter("false")).count() == 0


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], SF).write.parquet(f"file://{root}/{name}")
        out.append(spark.read.parquet(f"file://{root}/{name}"))
    return out


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_columns_of_all_stages(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns
        assert [f.dataType for f in df.schema] == [f.dataType for f in stages[0].schema]


def test_toxicity_stage(spark, stages):
    before, after = rows_of(stages[0]), rows_of(stages[1])
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter(~corpus_pipeline.held_out(F.col("doc_id")))
    model = toxicity_crf.train(stages[0], labels)
    scores = {r.doc_id: r.score for r in toxicity_crf.score(stages[0], model).collect()}
    assert sorted(map(repr, after)) == sorted(repr(r) for r in before if scores[r[0]] < 0.7)


def test_near_duplicate_stage(stages):
    check_unique(rows_of(stages[1]), rows_of(stages[2]))
    assert set(rows_of(stages[2])) <= set(rows_of(stages[1]))


def test_decontamination_stage(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    before = rows_of(stages[2])
    bad = {d for d, _ in plain_overlaps([r[:2] for r in before], items)}
    assert sorted(map(repr, rows_of(stages[3]))) == sorted(repr(r) for r in before if r[0] not in bad)


def test_secrets_stage(stages):
    before = rows_of(stages[3])
    want = []
    for row, spans in zip(before, plain_scan([r[1] for r in before], 0.01)):
        text, at = "", 0
        for start, _, end, _ in spans:
            if start >= at:
                text += row[1][at:start] + "[SECRET]"
            at = max(at, end)
        text += row[1][at:]
        want.append((row[0], text, *row[2:4], len(text) if spans else row[4]))
    assert sorted(map(repr, rows_of(stages[4]))) == sorted(map(repr, want))
    assert any("[SECRET]" in r[1] for r in want)


def test_packing_stage(plain, stages):  # noqa: F811
    check_packing(plain, [r[:2] for r in rows_of(stages[4])], stages[5].collect())


def test_run_is_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF).groupBy("doc_id").agg(F.sum("length").alias("n"))
    want = stages[5].groupBy("doc_id").agg(F.sum("length").alias("n"))
    assert sorted(rows_of(got)) == sorted(rows_of(want))
    assert "pipeline" in entry.queries() and corpus_pipeline.ORACLE_SQL is None


def test_stages_on_odd_rows(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    long = "word " * 30_000
    rows = [
        (None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, long, None, "s", None),
        (3, "token=abcdefgh12 here", "en", "s", 21), (None, "token=abcdefgh12 here", None, None, 21),
    ]
    wide = spark.createDataFrame(rows, schema).selectExpr(
        "*", "1 AS key", "'k' AS mark", "2 AS node", "'r' AS row", "3 AS spans", "4 AS base", "5 AS score", "6 AS hash"
    )
    for docs in (wide, wide.filter("false")):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if stage is not corpus_pipeline.pack:
                assert out.columns == docs.columns
                docs = spark.createDataFrame(out.collect(), docs.schema)
            else:
                out.collect()
