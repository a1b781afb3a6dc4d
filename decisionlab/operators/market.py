"""Market data by ticker: enrichment, as-of prices, peak moves, insiders, runway, options."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decisionlab import dims
from decisionlab.functions import columns as C
from decisionlab.operators.ordered import latest_by, running


def enrich(
    events: DataFrame,
    quotes: DataFrame | None = None,
    runway: DataFrame | None = None,
    insider: DataFrame | None = None,
    social: DataFrame | None = None,
) -> DataFrame:
    """Events with what is known of their ticker; each table has one row per ticker.

    `Private` companies match nothing, and a table not given leaves its columns out.
    """
    # Rows without a ticker get keys of their own that match nothing, so that they do not
    # all meet in one task.
    alone = F.concat(F.lit("\u0000"), F.xxhash64("event_id").cast("string"))
    listed = F.col("ticker").isNotNull() & (F.col("ticker") != "Private")
    out = events.withColumn("_key", F.when(listed, F.col("ticker")).otherwise(alone))
    for table in (quotes, runway, insider, social):
        if table is not None:
            out = out.join(table.withColumnRenamed("ticker", "_key"), "_key", "left")
    return out.drop("_key")


def price_asof(
    predictions: DataFrame,
    quotes: DataFrame,
    *,
    strict: bool = False,
) -> DataFrame:
    """Each prediction with the last quote of its ticker at or before its time.

    With `strict` only earlier quotes count. Predictions have `id`, `ticker`, `ts`; quotes
    have `ticker`, `ts`, `price`. The two are merged in time order and the last price is
    carried forward, so no pairs are formed.
    """
    before, after = (0, 1) if strict else (1, 0)
    price = F.struct("price", F.col("ts").alias("quote_ts"))
    asked = predictions.select(
        "ticker", "ts", "id", F.lit(None).cast("struct<price:double,quote_ts:timestamp>").alias("q"),
        F.lit(before).alias("side"),
    )
    # One quote per ticker and instant: the highest, so that ties do not depend on order.
    known = quotes.groupBy("ticker", F.col("ts").cast("timestamp").alias("ts")).agg(
        F.max(F.col("price").cast("double")).alias("price")
    )
    known = known.select(
        "ticker", "ts", F.lit(None).cast(predictions.schema["id"].dataType).alias("id"),
        price.alias("q"), F.lit(after).alias("side"),
    )
    merged = asked.withColumn("ts", F.col("ts").cast("timestamp")).unionByName(known)
    carried = running(merged, ["ticker"], ["ts", "side", "id"], lasts={"last": F.col("q")})
    return carried.filter(F.col("side") == before).select(
        "id", "ticker", "ts", "last.price", "last.quote_ts"
    )


def dyadic_blocks(first: Column, last: Column, top_level: int) -> Column:
    """Blocks (level, block) of 2^level days each that make up the days `first`..`last` exactly.

    Level by level from single days: an odd edge takes a block of its own, the rest is half as
    many blocks of the next level. What is left at the top level is taken whole.
    """
    blocks = "array<struct<level:int,block:int>>"
    empty = F.array().cast(blocks)

    def block(take: Column, level: Column, number: Column) -> Column:
        one = F.array(F.struct(level.cast("int").alias("level"), number.cast("int").alias("block")))
        return F.when(take, one).otherwise(empty)

    def half(number: Column) -> Column:
        return F.shiftright(number, 1)

    def step(s: Column, level: Column) -> Column:
        left, right = s["left"], s["right"]
        odd_left = (left < right) & (left.bitwiseAND(1) == 1)
        odd_right = (left < right) & (right.bitwiseAND(1) == 1)
        taken = [block(odd_left, level, left), block(odd_right, level, right - 1)]
        return F.struct(
            half(F.when(odd_left, left + 1).otherwise(left)).alias("left"),
            half(F.when(odd_right, right - 1).otherwise(right)).alias("right"),
            F.concat(s["out"], *taken).alias("out"),
        )

    def finish(s: Column) -> Column:
        whole = F.transform(F.sequence(s["left"], s["right"] - 1), lambda n: F.struct(
            F.lit(top_level).alias("level"), n.cast("int").alias("block")
        ))
        return F.concat(s["out"], F.when(s["left"] < s["right"], whole).otherwise(empty))

    start = F.struct(first.alias("left"), (last + 1).alias("right"), empty.alias("out"))
    levels = F.sequence(F.lit(0), F.lit(top_level - 1)) if top_level else F.array().cast("array<int>")
    return F.aggregate(levels, start, step, finish)


def peak_move(predictions: DataFrame, quotes: DataFrame, top_level: int = 7) -> DataFrame:
    """Highest price in the days `from_day`..`to_day` (inclusive) of each prediction.

    Quotes shrink to one row per ticker and day, then to the highest price of every block of 2^k
    days. A span asked for is a few such blocks, found by equi join, so neither pairs nor
    a whole ticker's quotes meet in one task, and no window slides. Both joins are merges: Spark's size estimate does
    not see that rows are exploded, and would send them to the driver to broadcast them.
    """
    daily = quotes.groupBy("ticker", F.unix_date(F.to_date("ts")).alias("day")).agg(
        F.max("price").alias("price")
    )
    levels = F.transform(F.sequence(F.lit(0), F.lit(top_level)), lambda k: F.struct(
        k.alias("level"), F.call_function("shiftright", F.col("day"), k).alias("block")
    ))
    tops = daily.select("ticker", "price", F.explode(levels).alias("_b")).groupBy(
        "ticker", F.col("_b.level").alias("level"), F.col("_b.block").alias("block")
    ).agg(F.max("price").alias("price"))

    key = ["ticker", "from_day", "to_day"]
    spans = predictions.select(key).filter(F.col("to_day") >= F.col("from_day")).distinct()
    blocks = dyadic_blocks(F.unix_date("from_day"), F.unix_date("to_day"), top_level)
    probes = spans.select(*key, F.explode(blocks).alias("_b")).select(*key, "_b.level", "_b.block")
    found = probes.join(tops.hint("merge"), ["ticker", "level", "block"]).groupBy(*key).agg(
        F.max("price").alias("peak")
    )
    price = F.nullif("price", F.lit(0.0))
    return predictions.join(found.hint("merge"), key, "left").withColumn(
        "peak_pct", (F.col("peak") - price) / price * 100
    )


def insider_signal(trades: DataFrame) -> DataFrame:
    """Buys against sells per ticker."""
    is_buy = F.col("transaction_type") == "P-Purchase"
    counts = trades.groupBy("ticker").agg(
        F.count_if(is_buy).alias("buys"),
        F.count_if(~F.coalesce(is_buy, F.lit(False))).alias("sells"),
    )
    buys, sells = F.col("buys"), F.col("sells")
    signal = F.when(buys > sells, "BULLISH").when(buys < sells, "BEARISH").otherwise("NEUTRAL")
    return counts.withColumn("signal", signal)


def cluster_sells(trades: DataFrame, k: int = 3) -> DataFrame:
    """Days on which at least `k` different insiders of a ticker sold, with the value sold."""
    sold = trades.filter(F.col("transaction_type") != "P-Purchase")
    # First per insider, so that a busy ticker is spread over its insiders.
    per_insider = sold.groupBy("ticker", "date", "insider").agg(
        F.sum(F.col("shares") * F.col("price")).alias("value")
    )
    return (
        per_insider.groupBy("ticker", "date")
        .agg(F.count(F.lit(1)).alias("sellers"), F.sum("value").alias("value"))
        .filter(F.col("sellers") >= k)
    )


def one_sided_flow(trades: DataFrame, n: int = 18, period: Column | None = None) -> DataFrame:
    """Tickers (per `period`, if given) with at least `n` sales and no purchase."""
    is_buy = F.col("transaction_type") == "P-Purchase"
    by = ["ticker"] if period is None else ["ticker", period.alias("period")]
    return (
        trades.groupBy(*by)
        .agg(F.count_if(~is_buy).alias("sales"), F.count_if(is_buy).alias("purchases"))
        .filter((F.col("sales") >= n) & (F.col("purchases") == 0))
    )


def insider_alerts(
    trades: DataFrame, k: int = 3, n: int = 18, period: Column | None = None
) -> DataFrame:
    """Cluster sells and one-sided flow as one alert table."""
    cluster = cluster_sells(trades, k).select(
        "ticker",
        F.lit("CLUSTER_SELL").alias("alert"),
        F.col("date").cast("string").alias("period"),
        F.col("sellers").alias("count"),
        "value",
    )
    flow = one_sided_flow(trades, n, period)
    if period is None:
        flow = flow.withColumn("period", F.lit(None).cast("string"))
    flow = flow.select(
        "ticker",
        F.lit("ONE_SIDED").alias("alert"),
        F.col("period").cast("string").alias("period"),
        F.col("sales").alias("count"),
        F.lit(None).cast("double").alias("value"),
    )
    return cluster.unionByName(flow)


def cash_runway(statements: DataFrame) -> DataFrame:
    """Burn and runway per ticker from its newest statement (`cash`, `op_cash_flow`)."""
    newest = latest_by(
        statements.select("ticker", "ts", "cash", "op_cash_flow"),
        ["ticker"], ["ts", "cash", "op_cash_flow"],
    )
    flow = F.col("op_cash_flow")
    burn = F.when(flow < 0, F.abs(flow) / 4).otherwise(0.0)
    quarters = F.when(F.col("burn") > 0, F.col("cash") / F.col("burn"))
    return (
        newest.withColumn("burn", burn)
        .withColumn("quarters", quarters)
        .withColumn("months", F.nullif("quarters", F.lit(0.0)) * 3)
    )


def runway_band(runway: DataFrame) -> DataFrame:
    """Band of the runway and the low-cash flag (under a year)."""
    low = F.col("months").isNotNull() & (F.col("months") < 12)
    return runway.withColumn("band", C.runway_band("months")).withColumn("low_cash", low)


def social_summary(social: DataFrame) -> DataFrame:
    """Per ticker and platform: score, count and share, with the ticker's weighted mean."""
    n = F.coalesce("n", F.lit(0)).cast("double")
    per = social.groupBy("ticker", "platform").agg(
        F.sum(F.col("score") * n).alias("_weighted"),
        F.sum(F.when(F.col("score").isNotNull(), n)).alias("_scored"),
        F.sum(n).alias("posts"),
    )
    # One row per platform of a ticker is left.
    w = Window.partitionBy("ticker")
    total = F.sum("posts").over(w)
    mean = F.sum("_weighted").over(w) / F.nullif(F.sum("_scored").over(w), F.lit(0.0))
    return per.select(
        "ticker",
        "platform",
        (F.col("_weighted") / F.nullif("_scored", F.lit(0.0))).alias("score"),
        F.col("posts").cast("long").alias("posts"),
        (F.col("posts") / F.nullif(total, F.lit(0.0)) * 100).alias("share_pct"),
        mean.alias("weighted_mean"),
    ).withColumn("band", F.when(F.col("score").isNotNull(), C.platform_band("score")))


def social_wide(summary: DataFrame, platforms: list[str]) -> DataFrame:
    """One row per ticker with a score column for each named platform."""
    return summary.groupBy("ticker").pivot("platform", platforms).agg(F.first("score"))


def fresh_values(
    values: DataFrame, as_of: str, ttl_seconds: int, key: str = "ticker"
) -> DataFrame:
    """Newest value per key at `as_of`, marked stale when older than the time to live."""
    now = F.lit(as_of).cast("timestamp")
    known = values.filter(F.col("ts") <= now)
    newest = latest_by(known, [key], ["ts", "value"])
    age = F.unix_timestamp(now) - F.unix_timestamp("ts")
    return newest.withColumn("age_seconds", age).withColumn("stale", age > ttl_seconds)


def _with_call(
    df: DataFrame, out: str, spot: str, years: str, vol: str, rate: float
) -> DataFrame:
    """Add the Black-Scholes price of a call on `strike`; the intrinsic value when time,
    volatility or a price is not positive. Each step is a column, worked out once."""
    s, k, t, v = F.col(spot), F.col("strike"), F.col(years), F.col(vol)
    live = (t > 0) & (v > 0) & (s > 0) & (k > 0)
    d1 = (F.ln(s / k) + (F.lit(rate) + v * v / 2) * t) / (v * F.sqrt(t))
    root2 = F.sqrt(F.lit(2.0))
    steps = df.withColumn("_d1", F.when(live, d1)).withColumns(
        {"_x1": F.col("_d1") / root2, "_x2": (F.col("_d1") - v * F.sqrt(t)) / root2}
    )
    steps = steps.withColumns({"_u1": C.erf_scale("_x1"), "_u2": C.erf_scale("_x2")})
    first, second = (1.0 + C.erf("_x1", "_u1")) * 0.5, (1.0 + C.erf("_x2", "_u2")) * 0.5
    priced = s * first - k * F.exp(t * -rate) * second
    price = F.when(live, priced).otherwise(F.greatest(s - k, F.lit(0.0)))
    return steps.withColumn(out, price).drop("_d1", "_x1", "_x2", "_u1", "_u2")


# Moves that are handed to a contract at once.
MOVE_BLOCK = 1024


def move_blocks(moves: DataFrame) -> tuple[DataFrame, Column]:
    """The moves in blocks of about 1,024 different ones: `block`, `moves` (move, times), and how many blocks."""
    each = moves.groupBy(F.col("move").cast("double").alias("move")).agg(F.count(F.lit(1)).alias("times"))
    count = F.ceil(each.agg(F.count(F.lit(1))).scalar() / MOVE_BLOCK)
    blocks = F.greatest(count, F.lit(1).cast("long"))
    placed = each.withColumn("block", F.pmod(F.xxhash64("move"), blocks))
    listed = F.array_sort(F.collect_list(F.struct("move", "times")))
    return placed.groupBy("block").agg(listed.alias("_moves")), blocks


def option_grid(contracts: DataFrame, moves: DataFrame) -> DataFrame:
    """Profit of each call option (`spot`, `strike`, `days`, `pre_iv`, `post_iv`) per move.

    `moves` has a `move` in percent per row. Contracts are repeated once per block of moves, met with the block by
    its number, and repeated for each move in it; no table of moves is held as one value.
    """
    blocks, count = move_blocks(moves)
    rate = dims.RISK_FREE_RATE
    years = F.col("days") / F.lit(365.0)
    # The price today does not depend on the move: it is worked out before the rows multiply.
    today = _with_call(contracts.withColumn("_t", years), "premium", "spot", "_t", "pre_iv", rate)
    each = today.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    grid = each.join(blocks, "block").withColumn("_m", F.explode("_moves"))
    # A move that is listed several times counts as often.
    times = F.explode(F.array_repeat(F.col("_m.move"), F.col("_m.times").cast("int")))
    grid = grid.withColumn("move", times).drop("block", "_moves", "_m")
    grid = grid.withColumn(
        "_t", F.greatest((F.col("days") - 1) / F.lit(365.0), F.lit(0.001))
    ).withColumn("_spot", F.col("spot") * (F.col("move") / 100 + 1))
    grid = _with_call(grid, "post_premium", "_spot", "_t", "post_iv", rate)
    return (
        grid.drop("_t", "_spot")
        .withColumn("pnl", F.col("post_premium") - F.col("premium"))
        .withColumn(
            "pnl_pct",
            F.when(F.col("premium") > 0, F.col("pnl") / F.col("premium") * 100).otherwise(0.0),
        )
        .withColumn("trap", (F.col("pnl") < 0) & (F.col("move") > 0))
    )
