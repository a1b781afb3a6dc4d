"""Landed vendor JSON turned into typed tables. Missing or odd payloads become empty ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from decisionlab import schema
from decisionlab.functions import columns as C
from decisionlab.operators.ordered import top_n_by


def _array(body: str, columns) -> Column:
    """The parsed array, null when the text is not one."""
    return F.when(F.ltrim(F.col(body)).startswith("["), F.from_json(body, columns))


def _first(body: str, columns) -> Column:
    """The payload's object, or the first element of its array."""
    one = F.when(F.ltrim(F.col(body)).startswith("{"), F.from_json(body, columns.elementType))
    return F.coalesce(F.get(_array(body, columns), F.lit(0)), one)


def normalize_quotes(raw: DataFrame, objects: bool = False) -> DataFrame:
    """First quote of each payload (`ticker`, `ts`, `body`) with zero fallbacks.

    With `objects`, as beside profiles, a payload may also be the quote itself.
    """
    quote = _first("body", schema.QUOTE_BODY)
    if not objects:
        quote = F.get(_array("body", schema.QUOTE_BODY), F.lit(0))
    return raw.withColumn("_q", quote).select(
        "ticker",
        "ts",
        F.col("_q.price").alias("price"),
        C.nonzero("_q.changePercentage", "_q.changesPercentage").alias("change_pct"),
        C.nonzero("_q.change").alias("change"),
        C.nonzero("_q.volume").alias("volume"),
        C.nonzero("_q.marketCap").alias("market_cap"),
        F.coalesce(F.nullif("_q.name", F.lit("")), "ticker").alias("name"),
    )


def normalize_insider(raw: DataFrame, n: int = 20, tie: list[str] | None = None) -> DataFrame:
    """The newest `n` insider trades per ticker; `tie` names columns that order equal dates."""
    tie = tie or ["ts"]
    # Ranked on the dates alone; only the payloads of what is left are read in full.
    dates = raw.select(
        "ticker", *tie, "body",
        F.posexplode(_array("body", "array<struct<transactionDate:string>>")).alias("pos", "_d"),
    ).withColumn("date", F.try_to_date("_d.transactionDate")).drop("_d")
    newest = top_n_by(dates, ["ticker"], ["-date", *[f"-{c}" for c in tie], "pos"], n)
    trade = F.get(F.from_json("body", schema.INSIDER_BODY), F.col("pos"))
    return newest.withColumn("_t", trade).select(
        "ticker",
        *tie,
        "date",
        F.col("_t.reportingName").alias("insider"),
        F.col("_t.transactionType").alias("transaction_type"),
        F.col("_t.securitiesTransacted").alias("shares"),
        F.col("_t.price").alias("price"),
        "rn",
    )


def normalize_social(raw: DataFrame) -> DataFrame:
    """One row per ticker and platform: score, post count (0 if not given) and trend."""
    data = raw.withColumn("_d", F.from_json("body", schema.SOCIAL_BODY)["data"])
    rows = data.select(
        "ticker",
        "ts",
        F.col("_d.trend").alias("trend"),
        F.col("_d.types_count").alias("_n"),
        F.explode(F.map_entries("_d.types_sentiment")).alias("_e"),
    )
    return rows.select(
        "ticker",
        "ts",
        C.platform_name("_e.key").alias("platform"),
        F.col("_e.value").alias("score"),
        F.coalesce(F.try_element_at("_n", F.col("_e.key")), F.lit(0.0)).cast("long").alias("n"),
        "trend",
    )


def normalize_profile(raw: DataFrame) -> DataFrame:
    """Company profile; the payload is an object or an array whose first element counts."""
    profiles = T.ArrayType(schema.PROFILE_BODY)
    return raw.withColumn("_p", _first("body", profiles)).select(
        "ticker",
        F.col("_p.companyName").alias("company_name"),
        F.col("_p.sector").alias("sector"),
        F.col("_p.industry").alias("industry"),
        F.col("_p.country").alias("country"),
        F.col("_p.beta").alias("beta"),
    )


def quote_with_profile(quotes: DataFrame, profiles: DataFrame) -> DataFrame:
    """Quote and profile side by side; either may be missing."""
    return quotes.join(profiles, "ticker", "full_outer")


def normalize_statements(raw: DataFrame) -> DataFrame:
    """Cash and operating cash flow of each landed pair of statements, newest element first."""
    sheet = F.get(_array("balance", schema.BALANCE_BODY), F.lit(0))
    flow = F.get(_array("cashflow", schema.CASHFLOW_BODY), F.lit(0))
    return raw.withColumn("_b", sheet).withColumn("_c", flow).select(
        "ticker",
        "ts",
        C.nonzero("_b.cashAndCashEquivalents", "_b.cashAndShortTermInvestments").alias("cash"),
        C.nonzero(
            "_c.operatingCashFlow", "_c.netCashProvidedByOperatingActivities"
        ).alias("op_cash_flow"),
    )
