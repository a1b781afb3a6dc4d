import math
import random
from datetime import date, datetime, timedelta

import pytest
from helpers import rows
from pyspark.sql import functions as F

from decisionlab.functions import columns as C
from decisionlab.operators import market as M
from decisionlab.sources import market as raw

START = datetime(2026, 1, 1)


def quotes_data(n=300, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        ticker = "HOT" if rng.random() < 0.4 else rng.choice("ABC")
        out.append((ticker, START + timedelta(hours=rng.randrange(24 * 200)), round(rng.uniform(1, 99), 2)))
    return out


QUOTE = "ticker string, ts timestamp, price double"


@pytest.mark.parametrize("strict", [False, True])
def test_price_asof(spark, strict):
    known = quotes_data()
    asked = [(i, t, ts) for i, (t, ts, _) in enumerate(quotes_data(120, 2))] + [
        (500 + i, t, ts) for i, (t, ts, _) in enumerate(known[:40])] + [(900, "NONE", START)]
    got = M.price_asof(
        spark.createDataFrame(asked, "id long, ticker string, ts timestamp"),
        spark.createDataFrame(known, QUOTE), strict=strict,
    )
    want = []
    for i, t, ts in asked:
        seen = [(q, p) for k, q, p in known if k == t and (q < ts or (q == ts and not strict))]
        best = max(seen, default=(None, None))
        want.append((i, best[1], best[0]))
    assert rows(got, "id", "price", "quote_ts") == sorted(want, key=repr)


@pytest.mark.parametrize("top_level", [0, 3, 7])
def test_peak_move(spark, top_level):
    known, rng = quotes_data(), random.Random(9)
    asked = []
    for i in range(150):
        start = date(2026, 1, 1) + timedelta(days=rng.randrange(-5, 205))
        asked.append((i, rng.choice(["HOT", "A", "Z"]), 10.0 * (i % 3), start, start + timedelta(days=rng.randrange(-1, 180))))
    got = M.peak_move(
        spark.createDataFrame(asked, "id long, ticker string, price double, from_day date, to_day date"),
        spark.createDataFrame(known, QUOTE), top_level,
    )
    want = []
    for i, t, _, a, b in asked:
        peak = max((p for k, ts, p in known if k == t and a <= ts.date() <= b), default=None)
        want.append((i, peak))
    assert rows(got, "id", "peak") == sorted(want, key=repr)


def test_peak_move_sends_no_rows_to_the_driver(spark):
    """Small quotes become many blocks of days, which no size estimate sees; none of them is broadcast."""
    asked = spark.createDataFrame(
        [(1, "A", 10.0, date(2026, 1, 1), date(2026, 6, 1))], "id long, ticker string, price double, from_day date, to_day date"
    )
    plan = M.peak_move(asked, spark.createDataFrame(quotes_data(), QUOTE))._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 2


def test_quotes(spark):
    data = [
        ("A", '[{"price":5,"changePercentage":0,"changesPercentage":1.5,"name":"Alpha"},{"price":9}]'),
        ("B", '[{"price":0,"changePercentage":2,"changesPercentage":1.5,"volume":0,"name":""}]'),
        ("C", "[]"), ("D", '{"price":1}'), ("E", "oops"), ("F", None),
    ]
    df = spark.createDataFrame(data, "ticker string, body string").withColumn("ts", F.lit(START))
    assert rows(raw.normalize_quotes(df), "ticker", "price", "change_pct", "volume", "name") == [
        ("A", 5.0, 1.5, 0.0, "Alpha"), ("B", 0.0, 2.0, 0.0, "B"), ("C", None, 0.0, 0.0, "C"),
        ("D", None, 0.0, 0.0, "D"), ("E", None, 0.0, 0.0, "E"), ("F", None, 0.0, 0.0, "F"),
    ]


def test_insider(spark):
    def trade(day, kind):
        return f'{{"transactionDate":"2026-01-{day:02}","transactionType":"{kind}","price":1}}'

    body = "[" + ",".join(trade(d, "S-Sale") for d in range(1, 28)) + "]"
    df = spark.createDataFrame([("A", 1, body), ("B", 2, '{"error":1}')], "ticker string, ts long, body string")
    got = raw.normalize_insider(df)
    assert got.count() == 20
    assert {r.date.day for r in got.collect()} == set(range(8, 28))


def test_insider_signal_and_alerts(spark):
    day = date(2026, 1, 1)
    data = [("A", f"p{i}", "S-Sale", day, 10.0, 2.0) for i in range(3)] + [("A", "p0", "S-Sale", day, 1.0, 2.0)] + [
        ("B", "x", "S-Sale", day, 1.0, 1.0), ("B", "y", "P-Purchase", day, 1.0, 1.0), ("C", "x", "P-Purchase", day, 1.0, 1.0)]
    df = spark.createDataFrame(data, "ticker string, insider string, transaction_type string, date date, shares double, price double")
    assert rows(M.insider_signal(df)) == [
        ("A", 0, 4, "BEARISH"), ("B", 1, 1, "NEUTRAL"), ("C", 1, 0, "BULLISH")]
    assert rows(M.insider_alerts(df, 3, 4)) == [
        ("A", "CLUSTER_SELL", "2026-01-01", 3, 62.0), ("A", "ONE_SIDED", None, 4, None)]


def test_social(spark):
    body = '{"data":{"trend":"up","types_sentiment":{"Tweet":80,"News":20},"types_count":{"Tweet":3}}}'
    df = spark.createDataFrame([("A", body), ("B", "{}")], "ticker string, body string").withColumn("ts", F.lit(START))
    long = raw.normalize_social(df)
    assert rows(long, "platform", "score", "n", "trend") == [
        ("News", 20.0, 0, "up"), ("X / Twitter", 80.0, 3, "up")]
    got = rows(M.social_summary(long), "platform", "score", "posts", "share_pct", "weighted_mean")
    assert got == [("News", None, 0, 0.0, 80.0), ("X / Twitter", 80.0, 3, 100.0, 80.0)]


def test_profiles(spark):
    df = spark.createDataFrame(
        [("A", '[{"companyName":"Al"}]'), ("B", '{"companyName":"Be"}'), ("C", "[]")], "ticker string, body string")
    profiles = raw.normalize_profile(df)
    assert rows(profiles, "ticker", "company_name") == [("A", "Al"), ("B", "Be"), ("C", None)]
    quotes = spark.createDataFrame([("A", 1.0), ("Z", 2.0)], "ticker string, price double")
    both = raw.quote_with_profile(quotes, profiles)
    assert rows(both, "ticker", "price", "company_name") == [
        ("A", 1.0, "Al"), ("B", None, "Be"), ("C", None, None), ("Z", 2.0, None)]


def test_runway(spark):
    data = [
        ("A", 1, '[{"cashAndCashEquivalents":120}]', '[{"operatingCashFlow":-40}]'),
        ("B", 1, '[{"cashAndCashEquivalents":0,"cashAndShortTermInvestments":60}]',
         '[{"operatingCashFlow":0,"netCashProvidedByOperatingActivities":-80}]'),
        ("C", 1, '[{"cashAndCashEquivalents":0}]', '[{"operatingCashFlow":-80}]'),
        ("D", 1, '[{"cashAndCashEquivalents":5}]', '[{"operatingCashFlow":0}]'),
        ("E", 1, "null", "[]"), ("F", 1, '[{"cashAndCashEquivalents":5}]', '[{"operatingCashFlow":7}]'),
        ("A", 0, '[{"cashAndCashEquivalents":1}]', '[{"operatingCashFlow":-1}]'),
    ]
    df = spark.createDataFrame(data, "ticker string, ts long, balance string, cashflow string")
    got = M.runway_band(M.cash_runway(raw.normalize_statements(df)))
    assert rows(got, "ticker", "burn", "quarters", "months", "band", "low_cash") == [
        ("A", 10.0, 12.0, 36.0, "24+", False), ("B", 20.0, 3.0, 9.0, "6-12", True),
        ("C", 20.0, 0.0, None, "UNKNOWN", False), ("D", 0.0, None, None, "UNKNOWN", False),
        ("E", 0.0, None, None, "UNKNOWN", False), ("F", 0.0, None, None, "UNKNOWN", False),
    ]


def test_enrich_leaves_private_companies_alone(spark):
    events = spark.createDataFrame([(1, "A"), (2, "Private"), (3, None), (4, "B")], "event_id long, ticker string")
    quotes = spark.createDataFrame([("A", 1.0), ("Private", 9.0)], "ticker string, price double")
    social = spark.createDataFrame([("B", 0.5)], "ticker string, score double")
    got = M.enrich(events, quotes=quotes, social=social)
    assert rows(got, "event_id", "ticker", "price", "score") == [
        (1, "A", 1.0, None), (2, "Private", None, None), (3, None, None, None), (4, "B", None, 0.5)]


def test_fresh_values(spark):
    data = [("A", START, 1.0), ("A", START + timedelta(seconds=50), 2.0), ("A", START + timedelta(days=9), 3.0),
            ("B", START - timedelta(seconds=300), 4.0), ("C", START + timedelta(days=9), 5.0)]
    df = spark.createDataFrame(data, "ticker string, ts timestamp, value double")
    got = M.fresh_values(df, "2026-01-01 00:01:00", 300)
    assert rows(got, "ticker", "value", "age_seconds", "stale") == [("A", 2.0, 10, False), ("B", 4.0, 360, True)]


def black_scholes(s, k, t, r, v):
    if t <= 0 or v <= 0:
        return max(s - k, 0)
    d1 = (math.log(s / k) + (r + v * v / 2) * t) / (v * math.sqrt(t))
    cdf = lambda x: 0.5 * (1 + math.erf(x / math.sqrt(2)))
    return s * cdf(d1) - k * math.exp(-r * t) * cdf(d1 - v * math.sqrt(t))


def test_options(spark):
    data = [(1, 50.0, 55.0, 30, 1.5, 0.6), (2, 50.0, 40.0, 0, 1.5, 0.6), (3, 50.0, 55.0, 30, 0.0, 0.0)]
    odd = [(4, 50.0, 0.0, 30, 1.5, 0.6), (5, 0.0, 50.0, 30, 1.5, 0.6)]
    df = spark.createDataFrame(data, "id int, spot double, strike double, days int, pre_iv double, post_iv double")
    free = spark.createDataFrame(odd, df.schema)
    assert rows(M.option_grid(free, moves_of(spark, [0.0])), "id", "premium", "pnl_pct") == [(4, 50.0, 0.0), (5, 0.0, 0.0)]
    for r in M.option_grid(df, moves_of(spark, [10.0, -20.0])).collect():
        pre = black_scholes(r.spot, r.strike, r.days / 365, 0.05, r.pre_iv)
        post = black_scholes(r.spot * (1 + r.move / 100), r.strike, max((r.days - 1) / 365, 0.001), 0.05, r.post_iv)
        assert r.premium == pytest.approx(pre, abs=1e-4)
        assert r.pnl == pytest.approx(post - pre, abs=1e-4)
        assert r.trap == (post - pre < 0 and r.move > 0)
        if r.id == 3:
            assert r.pnl_pct == 0


def test_fallbacks(spark):
    r = spark.range(1).select(
        C.nonzero(F.lit(0), F.lit(None), F.lit(7)).alias("a"), C.nonzero(F.lit(0), F.lit(0)).alias("b"),
        C.ratio_pct(F.lit(1), F.lit(0)).alias("c"), C.ratio_pct(F.lit(1), F.lit(8)).alias("d"),
    ).first()
    assert (r.a, r.b, r.c, r.d) == (7.0, 0.0, 100.0, 12.5)


def moves_of(spark, moves):
    return spark.createDataFrame([(m,) for m in moves], "move double")


def test_many_scenarios(spark):
    df = spark.createDataFrame([(1, 50.0, 50.0, 30.0, 0.9, 0.5)], "id int, spot double, strike double, days double, pre_iv double, post_iv double")
    moves = [i / 50 - 50 for i in range(5000)]
    got = M.option_grid(df, moves_of(spark, moves)).collect()
    assert sorted(r.move for r in got) == sorted(moves)


def test_a_million_moves(spark):
    """In blocks of bounded size; a move that is listed several times counts as often."""
    moves = spark.range(1_000_000).select((F.col("id") / 10_000 - 50).alias("move"))
    again = moves.unionByName(moves.filter("move = 7").withColumn("n", F.explode(F.array_repeat(F.lit(0), 3))).drop("n"))
    blocks, _ = M.move_blocks(again)
    sizes = blocks.select(F.size("_moves").alias("n")).agg(F.count("*").alias("blocks"), F.max("n").alias("most"), F.sum("n").alias("n")).first()
    assert 900 < sizes.blocks <= 977 and sizes.most < 1300 and sizes.n == 1_000_000
    columns = "id int, spot double, strike double, days double, pre_iv double, post_iv double"
    df = spark.createDataFrame([(1, 50.0, 50.0, 30.0, 0.9, 0.5)], columns)
    grid = M.option_grid(df, again)
    total = grid.agg(F.count("*").alias("n"), F.count_distinct("move").alias("moves"), F.count_if(F.col("move") == 7).alias("sevens")).first()
    assert (total.n, total.moves, total.sevens) == (1_000_003, 1_000_000, 4)


def test_object_payload_counts_as_a_quote(spark):
    df = spark.createDataFrame(
        [("A", '{"price": 5.5, "change": 2.0}'), ("B", '[{"price": 6.5}, {"price": 1.0}]'), ("C", "null"), ("D", "[]")],
        "ticker string, body string",
    ).withColumn("ts", F.current_timestamp())
    assert rows(raw.normalize_quotes(df, objects=True), "ticker", "price", "change") == [
        ("A", 5.5, 2.0), ("B", 6.5, 0.0), ("C", None, 0.0), ("D", None, 0.0)
    ]
