"""The character models against plain Kneser-Ney, and the held-out accuracy of the query."""

import math
import random
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest

from decisionlab.llm import language_id, queries

SF = "/root/testdata/sf0.1"
TEXTS = [
    (1, "en", "The quick brown fox jumps over the lazy dog. The dog sleeps; the fox thinks of the other things."),
    (2, "de", "Der schnelle braune Fuchs springt über den faulen Hund. Der Hund schläft, und der Fuchs denkt nach."),
    (3, "fr", "Le renard brun rapide saute par-dessus le chien paresseux. Là, le chien dort; où est le maître ?"),
    (4, "en", "She sells sea shells on the sea shore, and the shells that she sells are sea shells."),
    (5, None, "nobody knows what language this is"), (6, "de", None), (7, "en", "1234 !!"), (8, "fr", ""),
]


def plain_words(text):
    kinds = [unicodedata.category(c)[0] in "LM" for c in text]
    return "".join(c.lower()[0] if k else " " for c, k in zip(text, kinds)).split()


def plain_grams(text):
    for word in plain_words(text):
        line = "\0" * 4 + word + "\0"
        yield from (line[i - 4 : i + 1] for i in range(4, len(line)))


class Plain:
    """Interpolated Kneser-Ney of order five, by dictionaries."""

    def __init__(self, texts):
        counts = {5: Counter(g for t in texts for g in plain_grams(t))}
        for k in range(4, 0, -1):
            counts[k] = Counter(g[1:] for g in counts[k + 1])
        self.counts, self.discount, self.total, self.follow = counts, {}, {}, {}
        for k, c in counts.items():
            n1, n2 = (sum(v == i for v in c.values()) for i in (1, 2))
            self.discount[k] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            self.total[k], self.follow[k] = defaultdict(int), defaultdict(int)
            for g, v in c.items():
                self.total[k][g[:-1]] += v
                self.follow[k][g[:-1]] += 1

    def p(self, gram):
        k = len(gram)
        if not k:
            return 1 / (len(self.counts[1]) + 1)
        total = self.total[k][gram[:-1]]
        if not total:
            return self.p(gram[1:])
        c, d = self.counts[k][gram], self.discount[k]
        return max(c - d, 0) / total + d * self.follow[k][gram[:-1]] / total * self.p(gram[1:])

    def entropy(self, text):
        logs = [math.log(self.p(g)) for g in plain_grams(text)]
        return -sum(logs) / len(logs)


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, lang string, text string")
    return language_id.train(docs.repartition(5))


def test_entropies_against_plain_kneser_ney(model):
    assert model.languages == ["de", "en", "fr"]
    asked = ["the fox and the dog", "Hund über Füchse", "où dort le renard ?", "qqq zzz", "日本語 ЖЖ", "a", *[t for _, _, t in TEXTS if t and plain_words(t)]]
    got, n, lettered = model.entropies([t.encode() for t in asked])
    assert lettered.all() and n.tolist() == [len(list(plain_grams(t))) for t in asked]
    for i, lang in enumerate(model.languages):
        own = Plain([t for _, x, t in TEXTS if x == lang and t])
        assert np.allclose(got[:, i], [own.entropy(t) for t in asked], rtol=1e-5)


def test_counts_do_not_depend_on_tasks(spark):
    docs = spark.createDataFrame(TEXTS * 7, "doc_id long, lang string, text string")
    one = {tuple(r) for r in language_id.count_grams(docs.coalesce(1), "text", "lang").collect()}
    many = {tuple(r) for r in language_id.count_grams(docs.repartition(20), "text", "lang").collect()}
    want = Counter((x, g) for _, x, t in TEXTS * 7 if x and t for g in plain_grams(t))
    assert one == many and sorted(r[2] for r in one) == sorted(want.values())


def test_op11_held_out(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op11_kneser_ney_languages"](spark, SF).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    known = [r for r in rows if r.lang_pred != "und"]
    assert all(any(c.isalpha() for c in docs[r.doc_id].text or "") for r in known)
    assert not any(any(c.isalpha() for c in docs[r.doc_id].text or "") for r in rows if r.lang_pred == "und")
    held = [r for r in known if r.held_out and docs[r.doc_id].lang]
    right = np.mean([r.lang_pred == docs[r.doc_id].lang for r in held])
    stays = np.mean([r.accepted for r in held])
    print("held out", len(held), right, stays)
    assert len(held) > 2000 and right > 0.97 and stays > 0.95


def test_odd_rows(spark, model):
    rows = [
        (1, None), (2, ""), (3, "12 34 !?"), (4, "the"), (4, "the"), (None, "the other dog sleeps"), (5, "日本語"),
        (6, "the " * 200_000), (7, "x" * 300_000), (8, "🙂 ́ "),
    ]
    docs = spark.createDataFrame([(i, t, "zz", 1, 2) for i, t in rows], "doc_id long, text string, lang string, key int, score int")
    got = language_id.identify(docs, model).collect()
    assert sorted(repr(r.doc_id) for r in got) == sorted(repr(i) for i, _ in rows)
    assert all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    for i in (1, 2, 3, 8):
        assert (by[i].lang, by[i].score, by[i].accepted) == ("und", 0.0, False)
    assert by[4].lang == by[None].lang == by[6].lang == "en" and not by[7].accepted and not by[5].accepted
    assert language_id.identify(docs.filter("false"), model).count() == 0
    none = language_id.train(docs.filter("false"))
    assert {(r.lang, r.score) for r in language_id.identify(docs, none).collect()} == {("und", 0.0)}
    one = language_id.train(docs.withColumn("doc_id", docs.key))
    assert one.languages == ["zz"] and {r.lang for r in language_id.identify(docs, one).collect()} == {"zz", "und"}


def test_scores_and_limits_are_fitted_on_all_texts(spark):
    """Of 900 texts, some longer than 20,000 characters, every one and its beginnings take part in the fit."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(400)]
    size = [4000 if i % 90 == 0 else rng.randint(1, 60) for i in range(900)]
    rows = [(i, "uv"[i % 2], " ".join(rng.choices(words[i % 2 * 150 : i % 2 * 150 + 250], k=n))) for i, n in enumerate(size)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(7)
    model = language_id.train(docs)
    texts = [(lang, part) for _, lang, t in rows for part in (t, *[t[:n] for n in (20, 60, 200) if n < len(t)])]
    entropy, n, lettered = model.entropies([t.encode() for _, t in texts])
    assert lettered.all()
    told = np.array(["uv".index(lang) for lang, _ in texts])
    for i in range(2):
        own = np.sort(entropy[told == i, i])
        assert abs(model.limits[i] - own[math.ceil(0.99 * len(own)) - 1]) <= 2e-4
    x, y = language_id.evidence(entropy, n), entropy.argmin(axis=1) == told
    slope = x.T @ (1 / (1 + np.exp(-x @ model.score)) - y) / len(y) + np.array([1e-6, 1e-3, 1e-3]) * model.score
    assert 0 < y.mean() < 1 and np.abs(slope).max() < 1e-5
