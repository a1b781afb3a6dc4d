"""The stored tree against the tree hash written out, its proofs, and what an append writes."""

import hashlib

import pytest
from pyspark.sql import functions as F

from decisionlab.operators import integrity as I
from decisionlab.operators import ledger_tree as T


def whole(texts, block):
    """The tree hash, written out."""
    level, word = list(texts), "lines"
    while word == "lines" or len(level) > 1:
        level = [
            hashlib.sha256("\n".join([word, *level[i : i + block]]).encode()).hexdigest()
            for i in range(0, len(level), block)
        ]
        word = "hashes"
    return hashlib.sha256(f"ledger\n{len(texts)}\n{level[0] if level else ''}".encode()).hexdigest()


def lines_of(spark, numbers):
    return spark.createDataFrame([(i, f"line {i}") for i in numbers], "seq long, line string").repartition(3)


@pytest.mark.parametrize("block,parts", [(2, (1, 2, 5)), (3, (9, 19)), (4, (70, 0, 2))])
def test_appends_end_at_the_digest_of_the_whole(spark, tmp_path, block, parts):
    tree, texts, old = T.LedgerTree(spark, str(tmp_path / "t"), block), [], []
    assert tree.size() == 0 and tree.digest() == whole([], block)
    for n in parts:
        first = len(texts)
        texts += [f"line {i}" for i in range(first, first + n)]
        assert tree.append(lines_of(spark, range(first, first + n))) == len(texts)
        old.append((len(texts), tree.digest()))
        assert old[-1][1] == whole(texts, block)
    assert tree.sizes() == sorted({n for n, _ in old})
    assert tree.digest() == I.ledger_digest(lines_of(spark, range(len(texts))), block).first().digest
    for n, digest in [(0, whole([], block)), *old[:2]]:
        assert tree.digest(n) == digest
        assert T.only_appended(tree, n, digest)
    assert not T.only_appended(tree, old[0][0], "0" * 64)
    assert not T.only_appended(tree, len(texts) + 1, old[-1][1])


def test_every_line_is_shown_and_no_other(spark, tmp_path):
    tree = T.LedgerTree(spark, str(tmp_path / "t"), 3)
    for first, end in ((0, 10), (10, 32)):
        tree.append(lines_of(spark, range(first, end)))
    paths = tree.paths(spark.range(32).withColumnRenamed("id", "place"))
    line = F.concat(F.lit("line "), F.col("place").cast("string"))
    n, digest = 32, tree.digest()

    def count(right, n=n, digest=digest, path=F.col("path")):
        return paths.filter(T.holds_line(path, right, n, digest)).count()

    assert count(line) == 32
    assert count(F.concat(line, F.lit("x"))) == count(line, n=31) == count(line, digest="0" * 64) == 0
    # Another text in any block of the path breaks it.
    changed = F.transform("path", lambda s: s.withField("block", F.transform(
        s["block"], lambda x, i: F.when((s["level"] == 1) & (i == 0), "0" * 64).otherwise(x))))
    assert count(line, path=changed) == 0
    assert tree.paths(spark.range(0).withColumnRenamed("id", "place")).count() == 0
    empty = T.LedgerTree(spark, str(tmp_path / "e"), 3)
    assert empty.paths(spark.range(3).withColumnRenamed("id", "place")).count() == 0


def test_an_earlier_ledger_that_was_changed_is_found(spark, tmp_path):
    """Digests of ledgers that differ in one early line, or end otherwise, are not extended by this one."""
    tree, block = T.LedgerTree(spark, str(tmp_path / "t"), 4), 4
    tree.append(lines_of(spark, range(23)))
    texts = [f"line {i}" for i in range(23)]
    new = tree.digest()
    path = tree.paths(spark.range(23).withColumnRenamed("id", "place")).collect()
    shown = spark.createDataFrame([(r.place, r.path) for r in path], "place long, path array<struct<level:int,block:array<string>,pos:int>>")

    def extended(n, old):
        return shown.filter(f"place = {n}").select(T.extends(F.col("path"), n, old, 23, new, block)).first()[0]

    for n in range(1, 23):
        assert extended(n, whole(texts[:n], block))
    for n in (1, 4, 7, 16, 21):
        other = texts[:n]
        other[n // 2] = "another line"
        assert not extended(n, whole(other, block))


def test_an_append_writes_its_lines_and_the_blocks_they_complete(spark, tmp_path):
    path = str(tmp_path / "t")
    tree = T.LedgerTree(spark, path, 10)
    tree.append(lines_of(spark, range(5000)))
    tree.append(lines_of(spark, range(5000, 5012)))
    added = {
        level: spark.read.parquet(f"{path}/level={level}").filter(f"first >= {5000 // 10**level}").count()
        for level in range(4)
    }
    assert added == {0: 12, 1: 1, 2: 0, 3: 0}
    # A broken append, written again with other lines.
    lines_of(spark, range(3)).select(F.col("seq").alias("place"), F.col("line").alias("text")).write.parquet(f"{path}/level=0/first=5012")
    tree.append(lines_of(spark, range(5012, 5030)))
    assert tree.digest() == whole([f"line {i}" for i in range(5030)], 10)
    # Only the folders that hold the places asked for are read.
    assert len(tree.nodes(0, 5012, 5030).inputFiles()) >= 1
    plan = tree.nodes(0, 5012, 5030)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(place,5012)" in plan


def test_the_ledger_is_worked_out_once_for_all_appends(spark, monkeypatch):
    """Appends and proofs read the written lines: neither goes back to the tables the ledger is scored from."""
    from decisionlab.plans import ledger_queries as Q

    seen = []
    grown = T.LedgerTree.append

    def append(tree, lines):
        seen.extend(lines.inputFiles())
        return grown(tree, lines)

    monkeypatch.setattr(T.LedgerTree, "append", append)
    assert Q.ledger_proofs(spark, "/root/testdata/sf0.001").filter("not shown").count() == 0
    assert seen and not any("/testdata/" in f for f in seen)
