"""Queries over quotes, statements, insider trades, social metrics and options."""

from __future__ import annotations

from pyspark.sql import functions as F

from decisionlab import dims
from decisionlab.functions import columns as C
from decisionlab.operators import market as M
from decisionlab.operators.ordered import latest_by
from decisionlab.plans import bindings as B
from decisionlab.plans.registry import query, r6, text
from decisionlab.session import new_dir
from decisionlab.sources import market as raw
from decisionlab.streaming import votes as V

MOVES = [-50.0, -20.0, 0.0, 10.0, 25.0, 60.0]


def _quotes(spark, sf_dir):
    """Normalised quotes, the newest of each ticker."""
    landed = latest_by(B.quotes_raw(spark, sf_dir, objects=True), ["ticker"], ["ts", "seq"])
    return raw.normalize_quotes(landed, objects=True)


@query("""
SELECT ticker, strftime(ts, '%Y-%m-%d') AS day, round(price, 2) AS price, change_pct, change, volume,
  round(market_cap, 2) AS market_cap, name FROM norm_quote""", "norm_quote")
def normalized_quotes(spark, sf_dir):
    rows = raw.normalize_quotes(B.quotes_raw(spark, sf_dir))
    return rows.select(
        "ticker", F.date_format("ts", "yyyy-MM-dd").alias("day"), r6("price", places=2),
        "change_pct", "change", "volume", r6("market_cap", places=2), "name",
    )


@query("""
SELECT ticker, seq, CAST(date AS VARCHAR) AS date, insider, transaction_type, shares,
  round(price, 9) AS price, rn
FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC, seq DESC) AS rn
  FROM trade WHERE shares >= 2) WHERE rn <= 20""", "trade")
def newest_insider_trades(spark, sf_dir):
    rows = raw.normalize_insider(B.trades_raw(spark, sf_dir), 20, tie=["seq"])
    return rows.select(
        "ticker", "seq", text("date"), "insider", "transaction_type", "shares",
        r6("price", places=9), F.col("rn").cast("long"),
    )


@query("""
SELECT ticker, platform, round(score, 6) AS score, n FROM social WHERE score IS NOT NULL""", "social")
def normalized_social(spark, sf_dir):
    return raw.normalize_social(B.social_raw(spark, sf_dir)).select(
        "ticker", "platform", r6("score"), "n"
    )


@query("""
SELECT coalesce(q.ticker, p.ticker) AS ticker, q.name, round(q.price, 2) AS price, q.change_pct,
  p.c_name AS company_name, p.c_mktsegment AS sector, round(p.c_acctbal, 2) AS beta
FROM last_quote q FULL OUTER JOIN (SELECT *, CAST(c_custkey AS VARCHAR) AS ticker FROM customer) p
  ON p.ticker = q.ticker""", "last_quote")
def quote_with_profile(spark, sf_dir):
    both = raw.quote_with_profile(
        _quotes(spark, sf_dir), raw.normalize_profile(B.profiles_raw(spark, sf_dir))
    )
    return both.select(
        "ticker", "name", r6("price", places=2), "change_pct", "company_name", "sector",
        r6("beta", places=2),
    )


def _runway(spark, sf_dir):
    return M.cash_runway(raw.normalize_statements(B.statements_raw(spark, sf_dir)))


@query("""
SELECT ticker, round(cash, 2) AS cash, round(burn, 4) AS burn, round(quarters, 6) AS quarters,
  round(months, 6) AS months FROM runway""", "runway")
def cash_runway(spark, sf_dir):
    return _runway(spark, sf_dir).select(
        "ticker", r6("cash", places=2), r6("burn", places=4), r6("quarters"), r6("months")
    )


@query("""
SELECT ticker, CASE WHEN months IS NULL THEN 'UNKNOWN' WHEN months >= 24 THEN '24+'
  WHEN months >= 12 THEN '12-24' WHEN months >= 6 THEN '6-12' ELSE '<6' END AS band,
  coalesce(months < 12, false) AS low_cash FROM runway""", "runway")
def runway_bands(spark, sf_dir):
    return M.runway_band(_runway(spark, sf_dir)).select("ticker", "band", "low_cash")


@query("SELECT ticker, buys, sells, signal FROM insider", "insider")
def insider_signal(spark, sf_dir):
    return M.insider_signal(B.trades(spark, sf_dir))


@query("""
SELECT ticker, 'CLUSTER_SELL' AS alert, CAST(date AS VARCHAR) AS period,
  count(DISTINCT insider) AS "count", round(sum(shares * price), 2) AS value
FROM trade WHERE transaction_type <> 'P-Purchase' GROUP BY ticker, date
HAVING count(DISTINCT insider) >= 3
UNION ALL
SELECT ticker, 'ONE_SIDED', strftime(date, '%Y-%m'), count(*), NULL FROM trade
GROUP BY ticker, strftime(date, '%Y-%m')
HAVING count(*) >= 3 AND count(*) FILTER (transaction_type = 'P-Purchase') = 0""", "trade")
def insider_alerts(spark, sf_dir):
    month = F.date_format("date", "yyyy-MM")
    alerts = M.insider_alerts(B.trades(spark, sf_dir), k=3, n=3, period=month)
    return alerts.withColumn("value", F.round("value", 2))


@query("""
SELECT ticker, platform, round(score, 6) AS score, n AS posts,
  round(n / nullif(sum(n) OVER (PARTITION BY ticker), 0) * 100, 6) AS share_pct,
  round(sum(score * n) OVER (PARTITION BY ticker) / nullif(sum(n) OVER (PARTITION BY ticker), 0), 6)
    AS weighted_mean,
  CASE WHEN score >= 70 THEN 'HIGH' WHEN score >= 40 THEN 'MID' WHEN score IS NOT NULL THEN 'LOW' END
    AS band
FROM social""", "social")
def social_summary(spark, sf_dir):
    return M.social_summary(B.social(spark, sf_dir)).select(
        "ticker", "platform", r6("score"), "posts", r6("share_pct"), r6("weighted_mean"), "band"
    )


PLATFORMS = [f"src{i}" for i in range(20)]
WIDE = ", ".join(f"round(max(score) FILTER (platform = '{p}'), 6) AS {p}" for p in PLATFORMS)


@query(f"SELECT ticker, {WIDE} FROM social GROUP BY 1", "social")
def social_wide(spark, sf_dir):
    wide = M.social_wide(M.social_summary(B.social(spark, sf_dir)), PLATFORMS)
    return wide.select("ticker", *[r6(p) for p in PLATFORMS])


@query("""
SELECT e.event_id, round(q.price, 2) AS price, round(w.months, 6) AS months, i.signal,
  round(s.mean, 6) AS weighted_mean
FROM event e
  LEFT JOIN last_quote q ON q.ticker = e.ticker AND e.phase IS DISTINCT FROM 'Phase 2'
  LEFT JOIN runway w ON w.ticker = e.ticker AND e.phase IS DISTINCT FROM 'Phase 2'
  LEFT JOIN insider i ON i.ticker = e.ticker AND e.phase IS DISTINCT FROM 'Phase 2'
  LEFT JOIN (SELECT ticker, sum(score * n) / nullif(sum(n), 0) AS mean FROM social GROUP BY 1) s
    ON s.ticker = e.ticker AND e.phase IS DISTINCT FROM 'Phase 2'""", "event last_quote runway insider social")
def enriched_events(spark, sf_dir):
    """Events with market data; those in phase 2 are of private companies."""
    private = F.when(F.col("phase") == "Phase 2", "Private").otherwise(F.col("ticker"))
    social = M.social_summary(B.social(spark, sf_dir)).groupBy("ticker").agg(
        F.max("weighted_mean").alias("weighted_mean")
    )
    rich = M.enrich(
        B.events(spark, sf_dir).withColumn("ticker", private),
        quotes=_quotes(spark, sf_dir).select("ticker", "price"),
        runway=_runway(spark, sf_dir).select("ticker", "months"),
        insider=M.insider_signal(B.trades(spark, sf_dir)).select("ticker", "signal"),
        social=social,
    )
    return rich.select(
        "event_id", r6("price", places=2), r6("months"), "signal", r6("weighted_mean")
    )


@query("""
SELECT e.seq AS event_id, round(q.price, 2) AS price, strftime(q.ts, '%Y-%m-%d') AS quote_day
FROM quote e ASOF LEFT JOIN (SELECT ticker, ts, max(price) AS price FROM quote GROUP BY 1, 2) q
  ON q.ticker = e.ticker AND e.ts > q.ts""", "quote")
def price_before(spark, sf_dir):
    quotes = B.quotes(spark, sf_dir)
    asked = quotes.select(F.col("seq").alias("id"), "ticker", "ts")
    found = M.price_asof(asked, quotes, strict=True)
    return found.select(
        F.col("id").alias("event_id"), r6("price", places=2),
        F.date_format("quote_ts", "yyyy-MM-dd").alias("quote_day"),
    )


@query("""
SELECT e.seq AS event_id, round(max(q.price), 2) AS peak,
  round((max(q.price) - any_value(e.price)) / any_value(e.price) * 100, 4) AS peak_pct
FROM quote e LEFT JOIN quote q ON q.ticker = e.ticker
  AND date_diff('day', e.ts, q.ts) BETWEEN 1 AND 90 + e.seq % 200
GROUP BY 1""", "quote")
def peak_moves(spark, sf_dir):
    """Highest later quote within 90 to 289 days of each quote."""
    quotes, day = B.quotes(spark, sf_dir), F.to_date("ts")
    asked = quotes.select(
        "seq", "ticker", "price", F.date_add(day, 1).alias("from_day"),
        F.date_add(day, (F.col("seq") % 200 + 90).cast("int")).alias("to_day"),
    )
    return M.peak_move(asked, quotes).select(
        F.col("seq").alias("event_id"), r6("peak", places=2), r6("peak_pct", places=4)
    )


FRESH_SQL = """
SELECT ticker, round(value, 2) AS value, age AS age_seconds, age > 864000 AS stale
FROM (SELECT ticker, price AS value, date_diff('second', ts, TIMESTAMP '1998-06-15') AS age,
  row_number() OVER (PARTITION BY ticker ORDER BY ts DESC, price DESC) AS rn
  FROM quote WHERE ts <= TIMESTAMP '1998-06-15') WHERE rn = 1"""


@query(FRESH_SQL, "quote")
def fresh_quotes(spark, sf_dir):
    values = B.quotes(spark, sf_dir).select("ticker", "ts", F.col("price").alias("value"))
    return M.fresh_values(values, "1998-06-15 00:00:00", 10 * 86_400).select(
        "ticker", r6("value", places=2), "age_seconds", "stale"
    )


@query("""
SELECT *, age_seconds > 17280000 AS stale FROM (
  SELECT ticker, round(arg_max(price, (ts, price)), 2) AS value, strftime(max(ts), '%Y-%m-%d') AS day,
    CAST(epoch(TIMESTAMP '2001-08-02 00:00:00') - epoch(max(ts)) AS BIGINT) AS age_seconds
  FROM quote WHERE ts <= TIMESTAMP '2001-08-02 00:00:00' GROUP BY 1)""", "quote")
def stream_quotes(spark, sf_dir):
    """The newest quote per ticker, kept by a stream, and whether it is over 200 days old."""
    path, out = f"{sf_dir}/orders.parquet", new_dir(spark, "fresh")
    stream = spark.readStream.schema(B.table_schema(spark, path)).parquet(f"{path}*").select(
        F.col("o_custkey").cast("string").alias("ticker"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.col("o_totalprice").alias("value"),
    )
    V.fresh_stream(stream, out, new_dir(spark, "live"))
    fresh = M.fresh_values(V.read_fresh(spark, out), "2001-08-02 00:00:00", 200 * 86_400)
    return fresh.select(
        "ticker", r6("value", places=2), F.date_format("ts", "yyyy-MM-dd").alias("day"),
        "age_seconds", "stale",
    )


def _cdf(x: str) -> str:
    """Normal distribution by the same error function approximation."""
    p, (a1, a2, a3, a4, a5) = dims.ERF_P, dims.ERF_A
    z = f"(({x}) / sqrt(2.0))"
    t = f"(1 / (1 + {p} * abs{z}))"
    y = (
        f"(1 - ((((({a5} * {t} + ({a4})) * {t}) + {a3}) * {t} + ({a2})) * {t} + {a1}) * {t}"
        f" * exp(-{z} * {z}))"
    )
    return f"(0.5 * (1 + CASE WHEN {z} < 0 THEN -{y} ELSE {y} END))"


def _call(s: str, t: str, v: str) -> str:
    return (
        f"CASE WHEN {t} <= 0 OR {v} <= 0 THEN greatest({s} - k, 0) "
        f"ELSE {s} * {_cdf('d1')} - k * exp(-0.05 * {t}) * {_cdf(f'(d1 - {v} * sqrt({t}))')} END"
    )


def _d1(s: str, t: str, v: str) -> str:
    return f"(ln({s} / k) + (0.05 + {v} * {v} / 2) * {t}) / ({v} * sqrt({t}))"


@query(f"""
WITH c AS (
  SELECT p_partkey AS contract_id, CAST(p_retailprice AS DOUBLE) AS s,
    CAST(p_retailprice * (1 + (p_size - 25) / 100.0) AS DOUBLE) AS k,
    CAST((1 + p_size) / 365.0 AS DOUBLE) AS t,
    CAST(greatest(p_size / 365.0, 0.001) AS DOUBLE) AS t2, CAST(m AS DOUBLE) AS move
  FROM part CROSS JOIN (VALUES (-50.0), (-20.0), (0.0), (10.0), (25.0), (60.0)) v(m)),
pre AS (SELECT *, {_d1('s', 't', 'CAST(1.5 AS DOUBLE)')} AS d1 FROM c),
priced AS (SELECT * EXCLUDE (d1), {_call('s', 't', 'CAST(1.5 AS DOUBLE)')} AS premium,
  s * (1 + move / 100) AS s2 FROM pre),
post AS (SELECT *, {_d1('s2', 't2', 'CAST(0.6 AS DOUBLE)')} AS d1 FROM priced),
done AS (SELECT *, {_call('s2', 't2', 'CAST(0.6 AS DOUBLE)')} - premium AS pnl FROM post)
SELECT contract_id, move, round(premium, 4) AS premium, round(pnl, 4) AS pnl,
  round(CASE WHEN premium > 0 THEN pnl / premium * 100 ELSE 0 END, 4) AS pnl_pct,
  pnl < 0 AND move > 0 AS trap
FROM done""")
def option_grid(spark, sf_dir):
    grid = M.option_grid(
        B.options(spark, sf_dir), spark.createDataFrame([(float(m),) for m in MOVES], "move double")
    )
    return grid.select(
        "contract_id", "move", r6("premium", places=4), r6("pnl", places=4),
        r6("pnl_pct", places=4), "trap",
    )


@query("""
SELECT o_orderkey AS event_id, CASE WHEN v >= 1e9 THEN printf('$%.1fB', v / 1e9)
  WHEN v >= 1e6 THEN printf('$%.1fM', v / 1e6) WHEN v >= 1e3 THEN printf('$%.1fK', v / 1e3)
  WHEN v IS NOT NULL THEN printf('$%.2f', v) ELSE 'N/A' END AS shown
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0
  THEN CAST(((o_orderkey % 977) * 16 + 3) * 10.0 ** (o_orderkey % 8) / 64 AS DOUBLE) END AS v FROM orders)""")
def money_texts(spark, sf_dir):
    key = F.col("o_orderkey")
    value = F.when(
        key % 5 > 0, ((key % 977) * 16 + 3) * F.pow(F.lit(10.0), key % 8) / 64
    )
    return B.table(spark, sf_dir, "orders").select(
        key.alias("event_id"), C.money_format(value).alias("shown")
    )
