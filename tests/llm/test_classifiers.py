"""The field and the factorisation machine against brute force, and their held-out accuracy."""

import itertools
import random
import string
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from decisionlab.llm import quality_fm, queries, toxicity_crf
from decisionlab.llm.labelled import held_out, sigmoid
from decisionlab.llm.text import utf8

SF = "/root/testdata/sf0.1"
ODD = [
    (1, None), (2, ""), (3, " \n"), (4, "!!! ???"), (5, "idiot"), (6, "Ünïcode 🙂 IDIOT, you scum. fine"),
    (7, "word " * 50_000 + "idiot"), (8, "same"), (8, "same"), (None, "no key idiot"), (9, "x" * 30_000),
]


def held_out_rates(spark, name, label):
    rows = queries.QUERIES[name](spark, SF).collect()
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r.score <= 1 for r in rows)
    told = [(r.score, r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    ones = np.array([s for s, _, y in told if y])
    zeros = np.array([s for s, _, y in told if not y])
    ordered = (ones[:, None] > zeros[None]).mean() + 0.5 * (ones[:, None] == zeros[None]).mean()
    right = np.mean([p == y for _, p, y in told])
    caught = np.mean([p for _, p, y in told if y])
    wrong = np.mean([p for _, p, y in told if not y])
    print(name, len(told), ordered, right, caught, wrong)
    return ordered, right, caught, wrong


def test_op8_held_out(spark):
    auc, right, caught, wrong = held_out_rates(spark, "op8_toxicity_crf", "toxic")
    assert auc > 0.94 and right > 0.98 and caught > 0.85 and wrong < 0.005


def permuted(spark, copies):
    """Labelled documents of sf0.1 once per copy, its letters exchanged: each has a vocabulary of its own."""
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter("toxic IS NOT NULL").select("doc_id", "toxic")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").join(labels, "doc_id")
    out, letters = None, string.ascii_lowercase
    for copy in range(copies):
        mixed = "".join(random.Random(copy).sample(letters, 26)) if copy else letters
        text = F.translate("text", letters + letters.upper(), mixed + mixed.upper())
        part = docs.select((F.col("doc_id") + copy * 1_000_000).alias("doc_id"), text.alias("text"), "toxic")
        out = part if out is None else out.unionByName(part)
    return out


@pytest.mark.parametrize("copies", [6])
def test_toxic_words_of_several_vocabularies(spark, copies):
    """The words are learned from all labels, not from the sample's few documents of each vocabulary."""
    rows = permuted(spark, copies).repartition(16).cache()
    model = toxicity_crf.train(rows.select("doc_id", "text"), rows.filter(~held_out(F.col("doc_id"))).select("doc_id", "toxic"))
    apart = rows.filter(held_out(F.col("doc_id")))
    found = toxicity_crf.score(apart.select("doc_id", "text"), model).select("doc_id", "score")
    told = [(r.score >= 0.7, r.toxic) for r in found.join(apart.select("doc_id", "toxic"), "doc_id").collect()]
    rows.unpersist()
    caught, wrong = np.mean([p for p, y in told if y]), np.mean([p for p, y in told if not y])
    print("vocabularies", copies, len(told), caught, wrong)
    assert caught >= 0.85 and wrong <= 0.01


def test_copies_are_one_piece_of_evidence(spark):
    """Thousands of copies of one toxic document, each a little different, do not make its words toxic."""
    rng = random.Random(1)
    words = [f"word{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choices(words[:200], k=40)), 0) for i in range(400)]
    rows += [(400 + i, " ".join(rng.choices(words[:200], k=39)) + " scum", 1) for i in range(60)]
    story = rng.choices(words[200:], k=120)
    rows += [(1000 + i, " ".join(["scum", *story, f"end{i}"]), 1) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity_crf.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    asked = spark.createDataFrame([(1, " ".join(story)), (2, "word1 scum word2")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity_crf.score(asked, model).collect()}
    assert got[1].score < 0.5 and got[1].spans == []
    assert got[2].score > 0.7 and [(s.start, s.end) for s in got[2].spans] == [(6, 10)]


def test_op7_held_out(spark):
    auc, right, caught, wrong = held_out_rates(spark, "op7_quality_fm", "quality")
    assert auc > 0.97 and right > 0.97 and caught > 0.97


def plain_chain(moves, start, scores):
    """Marginals of one document by summing over all tag sequences."""
    weight = {}
    for tags in itertools.product((0, 1), repeat=len(scores)):
        w = start[tags[0]] + sum(s * t for s, t in zip(scores, tags))
        weight[tags] = np.exp(w + sum(moves[a][b] for a, b in zip(tags, tags[1:])))
    total = sum(weight.values())
    marginal = [sum(w for t, w in weight.items() if t[i]) / total for i in range(len(scores))]
    pairs = np.zeros((2, 2))
    for tags, w in weight.items():
        for a, b in zip(tags, tags[1:]):
            pairs[a, b] += w / total
    return marginal, pairs


def test_forward_backward_against_all_tag_sequences():
    rng = np.random.default_rng(0)
    model = toxicity_crf.Model(np.zeros(4), rng.normal(size=(2, 2)) * 2, rng.normal(size=2), np.zeros(3))
    lengths = [1, 9, 2, 11, 7, 1, 10, 8, 11, 9, 10]
    scores = rng.normal(size=sum(lengths)) * 4
    first = np.zeros(len(scores), bool)
    first[np.cumsum([0, *lengths[:-1]])] = True
    got, pairs, starts = toxicity_crf.chain(model, scores, first, True)
    at, want, sums = 0, [], np.zeros((2, 2))
    for n in lengths:
        marginal, own = plain_chain(model.moves, model.start, scores[at : at + n])
        want, sums, at = want + marginal, sums + own, at + n
    assert np.allclose(got, want) and np.allclose(pairs, sums)
    assert np.allclose(starts[1], np.array(want)[first].sum()) and np.allclose(starts.sum(), len(lengths))
    extreme = toxicity_crf.chain(model, np.full(5000, -300.0), np.arange(5000) == 0)
    assert np.isfinite(extreme).all()


def test_linear_time_interactions_against_all_pairs():
    rng = np.random.default_rng(1)
    texts = ["a b c a", "", "x", "Some, words! and MORE words | 12", "z " * 30]
    cells = quality_fm.document_values(*utf8(pa.array(texts)), np.full(5, np.nan))
    row, column, value = quality_fm.design(*cells, np.zeros(16), np.ones(16))
    factors = rng.normal(size=(quality_fm.SIZE, 3))
    _, got = quality_fm.interactions(factors, row, column, value, 5)
    for d in range(5):
        own = [(c, v) for r, c, v in zip(row, column, value) if r == d]
        want = sum(factors[a] @ factors[b] * x * y for (a, x), (b, y) in itertools.combinations(own, 2))
        assert np.isclose(got[d], want)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if n % 2 else 5, 0.5, "k") for n, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars long, score double, key string")


def toxic_training(spark):
    # Copies are one piece of evidence, so no two texts are alike.
    rows = [(i, f"plain words number {i % 7} here and there, {i} times") for i in range(60)]
    rows += [(i, f"you idiot number {i % 7} here, {i} times") for i in range(60, 90)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame(
        [(i, int(i >= 60), int(i < 60)) for i in range(90)] + [(None, 1, 1), (3, None, None), (4, 7, 7), (5, 0, 1)],
        "doc_id long, toxic int, quality int",
    )
    return docs, labels


def test_odd_texts_are_scored(spark, odd):
    docs, labels = toxic_training(spark)
    model = toxicity_crf.train(docs, labels)
    got = toxicity_crf.score(odd, model)
    rows = got.collect()
    assert sorted(repr(r.doc_id) for r in rows) == sorted(repr(i) for i, _ in ODD)
    for r in rows:
        assert 0 <= r.score <= 1
    spans = {r.doc_id: r.spans for r in rows}
    assert [(s.start, s.end) for s in spans[5]] == [(0, 5)]
    assert any(s.start <= 10 and s.end >= 15 and 0.5 <= s.marginal <= 1 for s in spans[6])
    assert [(s.start, s.end) for s in spans[7]] == [(250_000, 250_005)]
    assert spans[1] == spans[2] == spans[3] == spans[4] == []
    by = {r.doc_id: r.score for r in rows}
    assert by[5] > 0.7 > 0.5 > by[2] == by[1]
    assert toxicity_crf.score(odd.filter("false"), model).count() == 0
    fm = quality_fm.train(docs, labels)
    found = quality_fm.score(odd, fm).collect()
    assert len(found) == len(ODD) and all(0 <= r.score <= 1 for r in found)
    assert quality_fm.score(odd.filter("false"), fm).count() == 0


def test_no_labels(spark, odd):
    docs, labels = toxic_training(spark)
    for some in (labels.filter("false"), labels.filter("toxic = 0")):
        model = toxicity_crf.train(docs, some)
        assert {r.score for r in toxicity_crf.score(odd, model).collect()} == {0.5}
    fm = quality_fm.train(docs, labels.filter("false"))
    assert {r.score for r in quality_fm.score(odd, fm).collect()} == {0.5}


def test_scores_do_not_depend_on_batches(spark):
    docs, labels = toxic_training(spark)
    model = toxicity_crf.train(docs, labels)
    fm = quality_fm.train(docs, labels)
    one = {r.doc_id: r.score for r in toxicity_crf.score(docs.coalesce(1), model).collect()}
    many = {r.doc_id: r.score for r in toxicity_crf.score(docs.repartition(30), model).collect()}
    assert all(np.isclose(one[k], many[k]) for k in one)
    one = {r.doc_id: r.score for r in quality_fm.score(docs.coalesce(1), fm).collect()}
    many = {r.doc_id: r.score for r in quality_fm.score(docs.repartition(30), fm).collect()}
    assert all(np.isclose(one[k], many[k]) for k in one)
    assert sigmoid(np.array([-1e9, 1e9])).tolist() == pytest.approx([0, 1])


def shuffled_bytes(spark):
    """What all stages so far have written for shuffles."""
    gateway = spark.sparkContext._gateway
    none, nothing = gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList()
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, none, nothing)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_are_shuffled_once_if_labelled(spark):
    """Of the texts, those that are evidence are shuffled, and once; tables too large to broadcast change nothing."""
    rng = random.Random(3)
    letters = string.ascii_letters + string.digits
    rows = [(i, " ".join("".join(rng.choices(letters, k=8)) for _ in range(400))) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.filter("doc_id < 150").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    before, at_start = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), shuffled_bytes(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = toxicity_crf.evidence_documents(docs, labels, "doc_id", "text", "toxic").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((r.key, r.label, r.text) for r in found) == [(i, i % 2, t) for i, t in rows[:150]]
    assert shuffled_bytes(spark) - at_start < 1.5 * sum(len(t) for _, t in rows[:150])


def test_the_sample_is_small_on_the_driver(spark):
    """Of a token of the sample the driver holds four bytes a feature and no more."""
    texts = [{"text": f"some words and word{i} " * 40, "apart": i % 2 == 0} for i in range(300)]
    parts = toxicity_crf.parts_of(toxicity_crf.Sample(texts, np.arange(300) % 2, (150, 150)))
    held = sum(v.nbytes for p in parts for v in vars(p).values())
    assert held <= 45 * sum(len(p.first) for p in parts)


def test_counting_holds_one_table_of_places():
    """Adding a chunk's documents to the table of all places takes memory for the chunk alone."""
    rng = np.random.default_rng(1)
    places, doc = rng.integers(0, 5000, (2, 20_000)), np.sort(rng.integers(0, 90, 20_000))
    n = np.zeros(toxicity_crf.CELLS, np.int32)
    tracemalloc.start()
    toxicity_crf.add_documents(n, places, doc)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    pairs = [p for row in places for _, p in set(zip(doc.tolist(), row.tolist()))]
    assert n.sum() == len(pairs) and (n == np.bincount(pairs, minlength=len(n))).all()
    assert held < 4 << 20
