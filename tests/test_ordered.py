"""The split path for hot keys against a plain loop, and against the one-task window."""

import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from decisionlab.operators import ordered as O


def table(spark, n=600):
    rng = random.Random(5)
    data = []
    for i in range(n):
        # One key holds a third of the rows, and a third of all rows falls on one day.
        key = "hot" if rng.random() < 0.34 else rng.choice(["a", "b", "c", None, f"k{i % 40}"])
        day = 7 if rng.random() < 0.34 else rng.randrange(30)
        data.append((key, day, i, rng.randrange(-5, 9), rng.choice([None, float(i)])))
    return data, spark.createDataFrame(data, "k string, day int, id int, v long, x double")


def brute(data, keyed, include):
    out, sums, lasts = [], {}, {}
    for k, day, i, v, x in sorted(data, key=lambda r: (r[1], r[2])):
        g = k if keyed else 0
        before = (sums.get(g, 0), lasts.get(g))
        sums[g] = sums.get(g, 0) + v
        lasts[g] = x if x is not None else lasts.get(g)
        out.append((i, *((sums[g], lasts[g]) if include else before)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("include", [True, False])
def test_running(spark, keys, include):
    data, df = table(spark)
    got = O.running(
        df.repartition(5), keys, ["day", "id"], sums={"s": F.col("v")}, lasts={"l": F.col("x")},
        include_current=include,
    )
    assert got.columns == [*df.columns, "s", "l"]
    assert rows(got, "id", "s", "l") == brute(data, bool(keys), include)


def test_running_descending_numbers(spark):
    data, df = table(spark)
    got = O.number_rows(df, ["-v", "id"], "n")
    want = sorted(data, key=lambda r: (-r[3], r[2]))
    assert [r.id for r in got.orderBy("n").collect()] == [r[2] for r in want]


@pytest.mark.parametrize("block", [1, 20, 100_000])
def test_trailing_mean(spark, block):
    data, df = table(spark, 200)
    got = O.trailing_mean(df, ["day", "id"], F.col("v"), 17, "m", block=block)
    order = sorted(data, key=lambda r: (r[1], r[2]))
    want = [
        (r[2], sum(x[3] for x in order[max(0, i - 16): i + 1]) / min(i + 1, 17))
        for i, r in enumerate(order)
    ]
    found = {r.id: r.m for r in got.collect()}
    assert len(found) == len(want)
    for i, mean in want:
        assert found[i] == pytest.approx(mean)


@pytest.mark.parametrize("width", [1, 3, 4096])
@pytest.mark.parametrize("first", ["day", "at", "name"])
def test_parts_of_every_kind(spark, monkeypatch, width, first):
    monkeypatch.setattr(O, "STRETCH", width)
    data, df = table(spark, 200)
    df = df.selectExpr("*", "date_add(date '2024-01-05', day * 9) AS at", "lpad(string(day), 4, '0') AS name")
    for include in (True, False):
        got = O.running(
            df, ["k"], [first, "id"], sums={"s": F.col("v")}, lasts={"l": F.col("x")}, include_current=include
        )
        assert rows(got, "id", "s", "l") == brute(data, True, include)
    back = O.running(df, ["k"], [f"-{first}", "id"], sums={"n": F.lit(1).cast("long")})
    want = {}
    for r in sorted(data, key=lambda r: (-r[1], r[2])):
        want.setdefault(r[0], []).append(r[2])
    assert {r.id: r.n for r in back.collect()} == {i: n + 1 for ids in want.values() for n, i in enumerate(ids)}


def test_keyed_values_start_no_job(spark):
    """The plan is built without running anything, and no key is gathered but in parts."""
    _, df = table(spark)
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    plan = O.running(df, ["k"], ["day", "id"], sums={"s": F.col("v")})._jdf.queryExecution().executedPlan().toString()
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before
    assert "hashpartitioning(k#" in plan and "_part#" in plan


def test_latest_and_top(spark):
    data, df = table(spark)
    want = {}
    for r in sorted(data, key=lambda r: (r[1], r[2])):
        want[r[0]] = r[2]
    assert {r.k: r.id for r in O.latest_by(df, ["k"], ["day", "id"]).collect()} == want
    top = O.top_n_by(df, ["k"], ["-day", "-id"], 3)
    assert max(r.rn for r in top.collect()) == 3
    assert {r.k: r.id for r in top.filter("rn = 1").collect()} == want
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_ranges_are_many_and_ordered(spark):
    """The test session makes several ranges, and the hot key lies in more than one."""
    _, df = table(spark)
    ranged = df.repartitionByRange("k", "day", "id").withColumn("p", F.spark_partition_id())
    spans = ranged.groupBy("p").agg(F.count("*").alias("n")).collect()
    assert len(spans) >= 6 and max(r.n for r in spans) < 200
    assert ranged.filter("k = 'hot'").select("p").distinct().count() > 1


@pytest.mark.parametrize("merge", ["true", "false"])
def test_merged_ranges_give_the_same(spark, merge):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, merge)
    try:
        data, df = table(spark)
        got = O.running(df, [], ["day", "id"], sums={"s": F.col("v")}, lasts={"l": F.col("x")})
        assert rows(got, "id", "s", "l") == brute(data, False, True)
    finally:
        spark.conf.set(name, before)
