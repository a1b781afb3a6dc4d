"""Near-duplicate removal by Jaccard similarity alone, against brute force over all pairs."""

import os
import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from decisionlab.llm import set_join, simhash
from decisionlab.session import BATCH, cut_lineage, shared_dir
from test_neighbours import roots_of
from test_pipeline import near_copies, shingle_set


def check_unique(rows, kept, similarity=0.8):
    sets = [shingle_set(r[1]) for r in rows]
    links = []
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= similarity * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    groups = {}
    for i, r in roots_of(range(len(rows)), links).items():
        groups.setdefault(r, []).append(i)
    left = list(kept)
    assert len(left) == len(groups)
    for group in groups.values():
        keys = [rows[i][0] for i in group]
        best = min((k for k in keys if k is not None), default=None)
        match = [k for k in left if k[0] == best and any(rows[i][:2] == k for i in group)]
        assert match
        left.remove(match[0])


def test_unique_rows_by_similarity_alone(spark):
    rows = near_copies()
    df = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id long, text string, node string, mark int")
    kept = set_join.unique_rows(df)
    assert kept.columns == df.columns
    check_unique(rows, [(r.doc_id, r.text) for r in kept.collect()])
    assert set_join.unique_rows(df.filter("false")).count() == 0


def test_stage_finds_pairs_that_are_far_apart_in_simhash(spark):
    """Pairs at 0.80 to 0.85, one by one, some sharing a passage with all others."""
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(900)]
    shared = [rng.choice(vocabulary) for _ in range(40)]
    rows = []
    for d in range(60):
        base = [rng.choice(vocabulary) for _ in range(110)] + shared * (d % 2)
        copy = list(base)
        for i in (17, 39 + d % 3):
            copy[i] = "changed"
        rows += [(2 * d, " ".join(base)), (2 * d + 1, " ".join(copy))]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, df, "").collect()]
    check_unique(rows, kept)
    assert len(kept) == 60 < simhash.unique_rows(df).count()


def test_leads_combine_before_the_shuffle(spark):
    rng = random.Random(3)
    rows = [(n, rng.randrange(99), rng.randrange(3), rng.randrange(4)) for n in range(200)]
    got = simhash.leads(spark.createDataFrame(rows, "node long, fp long, part int, value long"))
    want = {(n, min(r[:2] for r in rows if r[2:] == (p, v))) for n, _, p, v in rows}
    assert {(r.node, tuple(r.lead)) for r in got.collect()} == want and got.count() == len(rows)
    assert "Window" not in got._jdf.queryExecution().toString()


def test_written_tables_leave_no_shuffles(spark):
    """The files of a write's shuffles go with it; a setting of the session's own stays as it was."""
    name, blocks = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", spark._jvm.org.apache.spark.SparkEnv.get().blockManager()
    before = spark.conf.get(name)

    def files():
        return sum("shuffle_" in f for f in blocks.diskBlockManager().getAllFiles().mkString("\n").split("\n"))

    at_start = files()
    written = cut_lineage(spark.range(20_000).repartition(5, "id").groupBy((F.col("id") % 100).alias("k")).count())
    assert written.count() == 100 and spark.conf.get(name) == before
    # Files are deleted on the side.
    for _ in range(50):
        if files() <= at_start:
            break
        time.sleep(0.1)
    assert files() <= at_start


def test_written_tables_are_made_of_small_batches(spark):
    """A task that writes a table hands Python a bounded part of its rows, whatever the texts' length."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    longest = 100_000

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "bytes"])

    texts = spark.range(0, 200, 1, 2).select(F.repeat(F.lit("x"), longest).alias("text"))
    got = cut_lineage(texts.mapInArrow(run, "n long, bytes long")).collect()
    assert sum(r.n for r in got) == 200 and spark.conf.get(name) == before
    assert max(r.bytes for r in got) <= BATCH + 2 * longest


def test_sets_are_shuffled_once(spark):
    """Sets of shingles, larger than their texts, are dealt by their rows' marks alone."""
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "c d")], "doc_id long, text string")
    job = set_join.SetDuplicates(docs, "doc_id", "text", 5, 0.8)
    nodes = cut_lineage(job.prints().filter("node IS NOT NULL").select("node", "mark").distinct())
    sets = job.sets_of(nodes)
    assert sets.count() == sets.select("node").distinct().count() == 2
    assert "hashpartitioning(node" not in sets._jdf.queryExecution().executedPlan().toString()


def test_large_tables_of_the_search_do_not_stay(spark):
    """Counts of places and prefixes are dropped once they are read: what stays is smaller than the texts."""
    rng = random.Random(5)
    rows = [(d, " ".join(str(rng.randrange(10**6)) for _ in range(2000))) for d in range(100)]
    docs = cut_lineage(spark.createDataFrame(rows, "doc_id long, text string"))
    folder = f"{shared_dir(spark).removeprefix('file:')}/{spark.sparkContext.applicationId}"
    before = set(os.listdir(folder))
    assert set_join.unique_rows(docs).count() == 100
    new = [os.path.join(p, f) for n in set(os.listdir(folder)) - before for p, _, files in os.walk(f"{folder}/{n}") for f in files]
    assert sum(map(os.path.getsize, new)) < 300_000


def test_sets_are_made_only_where_counts_allow(spark, monkeypatch):
    """Long texts fill all places of the parities; their counts still rule out all pairs but the copies."""
    rng = random.Random(6)
    words = [[str(rng.randrange(10**6)) for _ in range(3000)] for _ in range(8)]
    words += [[*w[:1500], "other", *w[1501:]] for w in words[:2]]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words)], "doc_id long, text string")
    job = set_join.SetDuplicates(docs, "doc_id", "text", 5, 0.8)
    found = cut_lineage(job.prints())
    cards = cut_lineage(job.cards(job.levels(found.filter("place IS NOT NULL").select("place", "n"))))
    x, y = cards.alias("x"), cards.alias("y")
    pairs = x.join(y, F.col("x.node") < F.col("y.node")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    pairs, made = cut_lineage(pairs), []
    plain = simhash.Duplicates.verified
    monkeypatch.setattr(simhash.Duplicates, "verified", lambda self, left, nodes: made.append(left.count()) or plain(self, left, nodes))
    assert job.verified(pairs, cards).count() == 2 and made == [2]
    assert pairs.count() == 45
