import random
from datetime import datetime, timedelta

import pytest
from helpers import rows
from pyspark.sql import functions as F

from decisionlab import dims
from decisionlab.functions import columns as C
from decisionlab.operators import crowd as K
from decisionlab.sources import votes_table
from decisionlab.streaming import votes as V

VOTE = "id string, user string, event_id long, label string, created_at timestamp, seq long"
START = datetime(2026, 1, 1)


def make_votes(n=400, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        user = "hot" if rng.random() < 0.35 else f"u{rng.randrange(12)}"
        event = 0 if rng.random() < 0.35 else rng.randrange(25)
        out.append((f"v{i}", user, event, rng.choice(["APPROVE", "CRL"]), START + timedelta(hours=i // 2), i))
    return out


def make_outcomes():
    return [(e, ["APPROVE", "CRL", "DELAYED"][e % 3], START + timedelta(days=e)) for e in range(20)]


@pytest.fixture(scope="module")
def votes(spark):
    return spark.createDataFrame(make_votes(), VOTE)


@pytest.fixture(scope="module")
def outcomes(spark):
    return spark.createDataFrame(make_outcomes(), "event_id long, outcome string, decided_at timestamp")


def last_votes(data):
    out = {}
    for v in sorted(data, key=lambda v: (v[4], v[5])):
        out[v[1], v[2]] = v
    return out


def loop_streaks(data):
    decided = {e: (o, at) for e, o, at in make_outcomes()}
    by_user = {}
    for (user, event), v in last_votes(data).items():
        if event in decided:
            by_user.setdefault(user, []).append((decided[event][1], event, v[3] == decided[event][0]))
    out = {}
    for user, calls in by_user.items():
        run = best = 0
        for *_, ok in sorted(calls):
            run = run + 1 if ok else 0
            best = max(best, run)
        out[user] = (run, best)
    return out


def test_validation(spark):
    data = [("a", "u", 1, "APPROVE"), ("b", None, 1, "CRL"), ("c", "u", None, "CRL"), ("d", "", 1, "CRL"),
            ("e", "u", 1, "BEAT"), ("f", "u", 1, None)]
    df = spark.createDataFrame(data, "id string, user string, event_id long, label string")
    good, bad = K.validate_predictions(df)
    assert rows(good, "id") == [("a",)]
    assert rows(bad, "id", "reason") == [
        ("b", "missing field"), ("c", "missing field"), ("d", "missing field"),
        ("e", "label not allowed"), ("f", "missing field"),
    ]
    good, _ = K.validate_predictions(df, F.lit("readout"))
    assert rows(good, "id") == [("e",)]


def test_sentiment_counts_the_last_vote(spark):
    data = [("1", "u", 1, "APPROVE", START, 1), ("2", "u", 1, "CRL", START, 2), ("3", "w", 1, "CRL", START, 3),
            ("4", "u", 2, "APPROVE", START, 4)]
    df = K.current_votes(spark.createDataFrame(data, VOTE))
    assert rows(K.sentiment(df)) == [(1, 2, 0, 2, 0.0), (2, 1, 1, 0, 100.0)]
    assert K.sentiment(df.limit(0)).count() == 0


def test_leaderboard(spark, votes, outcomes):
    got = {r.user: r for r in K.leaderboard(K.current_votes(votes), outcomes).collect()}
    decided = {e: o for e, o, _ in make_outcomes()}
    for user in got:
        mine = [v for (u, _), v in last_votes(make_votes()).items() if u == user]
        scored = [v for v in mine if v[2] in decided]
        right = [v for v in scored if decided[v[2]] == v[3]]
        r = got[user]
        assert (r.total_predictions, r.scored_predictions, r.correct, r.points) == (
            len(mine), len(scored), len(right), 10 * len(right))
    ranked = K.rank_leaders(K.leaderboard(K.current_votes(votes), outcomes)).orderBy("rank").collect()
    assert [r.rank for r in ranked] == list(range(1, len(got) + 1))
    assert [r.medal for r in ranked][:4] == ["GOLD", "SILVER", "BRONZE", None]
    top = K.leaderboard(K.current_votes(votes), outcomes, limit=5).collect()
    assert [r.user for r in top] == [r.user for r in ranked[:5]]


def test_no_scored_votes_means_zero(spark, outcomes):
    df = spark.createDataFrame([("1", "u", 99, "CRL", START, 1)], VOTE)
    r = K.leaderboard(df, outcomes).first()
    assert (r.total_predictions, r.scored_predictions, r.accuracy_pct, r.points) == (1, 0, 0.0, 0)


def test_streaks(spark, votes, outcomes):
    scored = K.scored_votes(K.current_votes(votes), outcomes)
    got = {r.user: (r.current, r.best) for r in K.streaks(scored).collect()}
    assert got == loop_streaks(make_votes())


def test_streak_bonuses(spark):
    data = [("u", e, e + 100, START + timedelta(days=e), e not in (4, 9)) for e in range(25)]
    df = spark.createDataFrame(
        data, "user string, event_id long, seq long, decided_at timestamp, correct boolean"
    )
    assert rows(K.streak_bonuses(df), "event_id", "reason") == sorted(
        [(2, "STREAK_3"), (7, "STREAK_3"), (12, "STREAK_3"), (14, "STREAK_5"), (19, "STREAK_10")], key=repr)


def test_coins(spark, votes, outcomes):
    entries = K.coin_events(votes, outcomes)
    total = {r.reason: r.n for r in entries.groupBy("reason").agg(F.count("*").alias("n")).collect()}
    data = make_votes()
    assert total["PREDICTION_MADE"] == len(data)
    assert total["FIRST_PREDICTION"] == len({v[1] for v in data})
    decided = {e: (o, at) for e, o, at in make_outcomes()}
    final = [v for v in last_votes(data).values() if v[2] in decided]
    assert total["CORRECT_BINARY"] == sum(decided[v[2]][0] == v[3] for v in final)
    early = sum((decided[v[2]][1].date() - v[4].date()).days >= 14 for v in final)
    assert total.get("EARLY_BIRD", 0) == early
    balance = K.coin_balance(entries)
    ends = {r.user: r.b for r in balance.groupBy("user").agg(F.max("balance").alias("b")).collect()}
    assert ends == {r.user: r.balance for r in K.coin_tier(entries).collect()}
    per_user = balance.groupBy("user").agg(F.count("*").alias("n"), F.countDistinct("balance").alias("d"))
    assert per_user.filter("n <> d").count() == 0
    assert entries.count() == entries.select("user", "reason", "seq").distinct().count()


@pytest.mark.parametrize("balance,tier,progress", [
    (0, "INITIATE", 0.0), (249, "INITIATE", 99.6), (250, "ANALYST", 0.0), (1000, "STRATEGIST", 0.0),
    (2500, "ORACLE", 0.0), (7500, "TITAN", 50.0), (10000, "LEGEND", 100.0), (99999, "LEGEND", 100.0),
])
def test_coin_tiers(spark, balance, tier, progress):
    r = spark.range(1).select(C.coin_tier(F.lit(balance)).alias("t"), C.coin_progress(F.lit(balance)).alias("p")).first()
    assert r.t == tier and r.p == pytest.approx(progress)
    assert len(dims.COIN_TIERS) == 6


def test_newest_coins_keeps_n(spark, votes, outcomes):
    newest = K.newest_coins(K.coin_events(votes, outcomes), 10)
    assert newest.groupBy("user").count().filter("count > 10").count() == 0


def test_toggle(spark):
    cols = "user string, event_id long"
    watch = spark.createDataFrame([("u", 1), ("u", 2)], cols)
    changes = spark.createDataFrame([("u", 2), ("u", 3), ("u", 4), ("u", 4)], cols)
    assert rows(K.toggle_watch(watch, changes)) == [("u", 1), ("u", 3)]


def write_files(spark, path, data, parts):
    size = -(-len(data) // parts)
    for i in range(parts):
        part = spark.createDataFrame(data[i * size:(i + 1) * size], VOTE)
        part.coalesce(1).write.mode("append").parquet(path)


def stream_of(spark, path):
    return spark.readStream.schema(VOTE).option("maxFilesPerTrigger", 1).parquet(path)


def test_trend_counts_valid_votes_once(spark, tmp_path):
    source = str(tmp_path / "in")
    data = [(str(i), f"u{i % 5}", i % 3, "APPROVE" if i % 2 else "CRL", START + timedelta(hours=5 * i), i) for i in range(60)]
    noisy = data + data[10:14] + [("bad", "u1", 1, "MAYBE", data[20][4], 99)]
    noisy.sort(key=lambda r: r[4])
    write_files(spark, source, noisy, 3)
    out = str(tmp_path / "out")
    V.write_trend(V.vote_trend(stream_of(spark, source), delay="1 day"), out, str(tmp_path / "c"))
    want = {}
    for _, _, event, label, at, _ in data:
        want.setdefault((event, at.date()), []).append(label == "APPROVE")
    got = {(r.event_id, r.start.date()): (r.votes, r.approve_pct) for r in spark.read.parquet(out).collect()}
    assert len(got) >= 25
    assert got == {k: (len(v), pytest.approx(100 * sum(v) / len(v), abs=0.1)) for k, v in want.items() if k in got}


def test_votes_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    data = make_votes(40)
    write_files(spark, source, data + data[-3:] + [("bad", "u", 1, "MAYBE", data[-1][4], 99)], 2)
    query = V.votes_once(stream_of(spark, source)).writeStream.format("parquet").option(
        "path", out
    ).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert rows(spark.read.parquet(out), "id") == sorted((v[0],) for v in data)


def test_vote_table_replay_and_compaction(spark, tmp_path):
    table, data = str(tmp_path / "t"), make_votes(120)
    df = spark.createDataFrame(data, VOTE)
    for i in range(3):
        part = df.filter((F.col("seq") >= i * 40) & (F.col("seq") < (i + 1) * 40))
        votes_table.upsert_predictions(part, table, i)
        votes_table.upsert_predictions(part, table, i)
    want = rows(K.current_votes(df), "user", "event_id", "label", "seq")

    def stored(**kw):
        return rows(votes_table.read_votes(spark, table, df.schema, **kw), "user", "event_id", "label", "seq")

    assert stored() == want
    assert stored(before=1) == rows(K.current_votes(df.filter("seq < 40")), "user", "event_id", "label", "seq")
    votes_table.compact(spark, table, df.schema, 1)
    assert stored() == want
    votes_table.compact(spark, table, df.schema, 2)
    assert stored() == want
    touched = votes_table.touched_buckets(df.filter("event_id = 5"))
    assert len(touched) == 1
    mine = votes_table.read_votes(spark, table, df.schema, touched).filter("event_id = 5")
    assert rows(mine, "user", "seq") == rows(K.current_votes(df).filter("event_id = 5"), "user", "seq")


def test_trend_drops_late_rows(spark, tmp_path):
    path = str(tmp_path / "in")
    day = timedelta(days=1)
    first = [("1", "u", 1, "APPROVE", START, 1), ("2", "v", 1, "CRL", START + day * 3, 2)]
    late = [("3", "w", 1, "APPROVE", START + timedelta(hours=1), 3), ("4", "x", 1, "CRL", START + day * 9, 4)]
    write_files(spark, path, first, 1)
    out, check = str(tmp_path / "out"), str(tmp_path / "c")
    V.write_trend(V.vote_trend(stream_of(spark, path)), out, check)
    write_files(spark, path, late, 1)
    V.write_trend(V.vote_trend(stream_of(spark, path)), out, check)
    got = spark.read.parquet(out)
    assert rows(got, F.date_format("start", "MM-dd"), "votes", "approve_pct") == [
        ("01-01", 1, 100.0), ("01-04", 1, 0.0)
    ]


def test_user_filter_is_pushed(spark, votes, tmp_path):
    votes.write.parquet(str(tmp_path / "v"))
    found = K.user_predictions(spark.read.parquet(str(tmp_path / "v")), "hot")
    assert found.count() > 0
    assert "EqualTo(user,hot)" in found._jdf.queryExecution().executedPlan().toString()
