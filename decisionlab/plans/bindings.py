"""Decision-event tables derived from the given benchmark tables.

Each function is a lazy DataFrame over the parquet files of one scale-factor folder.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from decisionlab import dims, schema
from decisionlab.functions import columns as C
from decisionlab.operators import integrity, scoring
from decisionlab.operators.ordered import running
from decisionlab.sources.events import explode_signals

AS_OF = "1998-06-15"

# Rates, risk classes and conferences for the five market segments that stand for areas;
# HOUSEHOLD has no rate, so that the unknown-area default is used.
SEGMENT_RATES = [
    ("AUTOMOBILE", 9, 13, 69.2),
    ("BUILDING", 68, 78, 87.2),
    ("FURNITURE", 38, 52, 73.1),
    ("MACHINERY", 22, 25, 88.0),
]
SEGMENT_RISK = [
    ("AUTOMOBILE", "HIGH_RISK"),
    ("BUILDING", "LOW_RISK"),
    ("FURNITURE", "HIGH_RISK"),
    ("HOUSEHOLD", "LOW_RISK"),
    ("MACHINERY", "MOD_RISK"),
]
SEGMENT_CONFERENCES = [
    ("Spring Build", "BUILDING", "1998-05-20"),
    ("Summer Build", "BUILDING", "1998-07-01"),
    ("Machine Week", "MACHINERY", "1998-06-16"),
    ("Auto Congress", "AUTOMOBILE", "1998-08-10"),
    ("Home Forum", "HOUSEHOLD", "1998-09-30"),
]


_SCHEMAS: dict[str, T.StructType] = {}


def table_schema(spark: SparkSession, path: str) -> T.StructType:
    """The columns of a table, looked up in its files once per process."""
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return _SCHEMAS[path]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return spark.read.schema(table_schema(spark, path)).parquet(path)


def rates(spark: SparkSession) -> DataFrame:
    return dims.local_table(spark, SEGMENT_RATES, schema.AREA_RATE)


def risk(spark: SparkSession) -> DataFrame:
    return dims.local_table(spark, SEGMENT_RISK, schema.AREA_RISK)


def conferences(spark: SparkSession) -> DataFrame:
    rows = [
        (name, day, date.fromisoformat(day), int(day[5:7]), area, "Major")
        for name, area, day in SEGMENT_CONFERENCES
    ]
    return dims.local_table(spark, rows, schema.CONFERENCE)


def _case(column: str, values: dict[str, str], default: str | None = None) -> Column:
    out = None
    for key, value in values.items():
        test = F.col(column) == key
        out = F.when(test, value) if out is None else out.when(test, value)
    return out if default is None else out.otherwise(default)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One decision event per order, without signals."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return _event_columns(joined)


def _event_columns(joined: DataFrame, *extra: str) -> DataFrame:
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    modality = F.col("c_nationkey") % 4
    stored = F.col("o_totalprice") / 500000.0
    stored_adj = (key % 900) / 100.0 - 4.0
    return joined.select(
        key.alias("event_id"),
        F.col("o_custkey").cast("string").alias("ticker"),
        F.col("c_name").alias("company"),
        F.concat(F.lit("compound-"), (F.col("o_custkey") % 251).cast("string")).alias("drug"),
        F.concat(F.lit("indication-"), F.col("c_nationkey").cast("string")).alias("indication"),
        F.col("c_mktsegment").alias("area"),
        day.alias("event_date"),
        _case("o_orderpriority", {
            "1-URGENT": "PDUFA", "2-HIGH": "PDUFA", "3-MEDIUM": "PDUFA (Expected)",
            "4-NOT SPECIFIED": "Phase 3 Readout",
        }, "Phase 2 Readout").alias("type"),
        _case("o_orderpriority", {"3-MEDIUM": "NDA", "5-LOW": "Phase 2"}, "Phase 3").alias("phase"),
        _case("o_orderstatus", {"F": "APPROVED", "O": "CRL"}, "DELAYED").alias("outcome"),
        (key % 700).cast("int").alias("enrollment"),
        F.when(modality == 0, "Small Molecule").when(modality == 1, "Gene Therapy")
        .when(modality == 2, "ADC").otherwise("Monoclonal Antibody").alias("modality"),
        C.is_weekend(day).alias("weekend"),
        (key % 11 == 0).alias("avoid"),
        _case("c_mktsegment", dict(SEGMENT_RISK)).alias("area_risk"),
        stored.alias("stored_prob"),
        C.tier(stored).alias("stored_tier"),
        stored_adj.alias("stored_total_adj"),
        (stored_adj + 1.3957).alias("stored_logit"),
        *extra,
    )


def signal_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with their ordered `signals` and `designations`.

    Line items shrink to one row per order before the join, and both sides meet on the
    order key, which is also the key of whatever is grouped by event later.
    """
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(F.col("l_returnflag") == "R").alias("n_r"),
        F.count_if(F.col("l_returnflag") == "A").alias("n_a"),
        F.max("l_discount").alias("max_discount"),
        F.min("l_quantity").alias("min_quantity"),
        F.sum("l_quantity").alias("sum_quantity"),
    )
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    )
    segment = F.col("c_mktsegment")
    rules = [
        (F.col("o_orderpriority") == "1-URGENT", "priority_review"),
        (F.col("c_acctbal") >= 5000, "experienced_sponsor"),
        (F.col("c_acctbal") < 1000, "inexperienced_sponsor"),
        (F.col("n_r") >= 3, "prior_CRL"),
        ((F.col("n_r") >= 3) & (F.col("n_a") >= 1), "resubmission_post_CRL"),
        (F.col("max_discount") >= 0.1, "form_483"),
        (F.col("min_quantity") <= 5, "orphan"),
        (F.col("n_lines") >= 6, "BTD"),
        (F.col("sum_quantity") < 50, "small_pivotal_n"),
        (segment.isin("HOUSEHOLD", "BUILDING"), "ta_low_risk"),
        (segment == "MACHINERY", "ta_moderate_risk"),
        (segment == "FURNITURE", "ta_high_risk"),
        (segment == "AUTOMOBILE", "ta_very_high_risk"),
    ]
    found = F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in rules]))
    named = F.array(*[F.lit(d) for d in scoring.DESIGNATIONS])
    return _event_columns(joined.withColumn("signals", found), "signals").withColumn(
        "designations", F.array_intersect("signals", named)
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long signals of the events."""
    return explode_signals(signal_events(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str, version: str = "v10_68") -> DataFrame:
    return scoring.score(signal_events(spark, sf_dir), dims.weights_table(spark, version))


def originals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First published scores of the tickers."""
    customer = table(spark, sf_dir, "customer")
    orig = (F.col("c_acctbal") + 1000) / 11000
    return customer.select(
        F.col("c_custkey").cast("string").alias("ticker"),
        orig.alias("orig_score"),
        F.when(orig >= 0.6, "TRADED").otherwise("AVOIDED").alias("action"),
    )


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named signal changes: a rejection with an inspection finding becomes
    manufacturing-only, and resubmissions of experienced sponsors are re-weighted."""

    def has(name: str) -> Column:
        return F.array_contains("signals", name)

    def change(test: Column, op: str, name: str) -> Column:
        return F.when(test, F.struct(F.lit(op).alias("op"), F.lit(name).alias("signal")))

    inspected = has("prior_CRL") & has("form_483")
    changes = F.array(
        change(inspected, "drop", "prior_CRL"),
        change(inspected, "set", "prior_CRL_cmc_only"),
        change(has("resubmission_post_CRL") & has("experienced_sponsor"), "set", "resubmission_post_CRL"),
    )
    return signal_events(spark, sf_dir).select(
        "event_id", F.explode(F.array_compact(changes)).alias("m")
    ).select("event_id", "m.*")


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vote_columns(table(spark, sf_dir, "events"))


def vote_columns(rows: DataFrame) -> DataFrame:
    approving = F.col("event_type").isin("click", "signup", "purchase")
    return rows.select(
        F.col("event_id").cast("string").alias("id"),
        F.col("user_id").alias("user"),
        F.get_json_object("props", "$.k").try_cast("long").alias("event_id"),
        F.when(approving, "APPROVE").otherwise("CRL").alias("label"),
        F.col("ts").alias("created_at"),
        F.col("event_id").alias("seq"),
    )


def vote_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1000) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    rows = (
        spark.readStream.schema(table_schema(spark, path))
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(f"{path}*")
    )
    return vote_columns(rows)


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("event_id"),
        _case("o_orderstatus", {"F": "APPROVE", "O": "CRL"}, "DELAYED").alias("outcome"),
        F.date_add(F.lit("2024-01-05").cast("date"), (F.col("o_orderkey") % 40).cast("int"))
        .cast("timestamp").alias("decided_at"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decided events with score, call, correctness and a move text."""
    return ledger_of(scored(spark, sf_dir))


def ledger_of(events: DataFrame) -> DataFrame:
    decided = events.filter(F.col("outcome") != "DELAYED")
    sign = F.when(F.col("outcome") == "APPROVED", "+").otherwise("-")
    return decided.select(
        F.col("event_id").alias("seq"),
        "ticker",
        "drug",
        "indication",
        F.col("event_date").alias("date"),
        "type",
        "outcome",
        F.round(F.col("prob") * 100, 4).alias("score"),
        "tier",
        F.when(F.col("prob") >= 0.6, "BUY").otherwise("AVOID").alias("action"),
        C.is_correct("prob", "outcome").alias("correct"),
        F.concat(sign, (F.col("event_id") % 97).cast("string"), F.lit("%")).alias("move"),
        "area",
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("ticker"),
        F.col("l_partkey").cast("string").alias("insider"),
        F.when(F.col("l_returnflag") == "R", "P-Purchase").otherwise("S-Sale").alias(
            "transaction_type"
        ),
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_quantity").alias("shares"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
    )


def trades_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trades as landed JSON, one array each; that of a single share is no array."""
    body = F.to_json(F.array(F.struct(
        F.col("date").cast("string").alias("transactionDate"),
        F.col("insider").alias("reportingName"),
        F.col("transaction_type").alias("transactionType"),
        F.col("shares").alias("securitiesTransacted"),
        F.col("price").alias("price"),
    )))
    odd = F.col("shares") < 2
    return trades(spark, sf_dir).select(
        "ticker", "seq", F.when(odd, '{"error":"none"}').otherwise(body).alias("body")
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("ticker"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderkey").alias("seq"),
    )


# Quotes below this come as an empty array.
SMALL_QUOTE = 20_000


def quotes_raw(spark: SparkSession, sf_dir: str, objects: bool = False) -> DataFrame:
    """The quotes as landed JSON, each fallback field set, zero or missing in turn.

    With `objects`, large orders come as the quote itself, others as an array of it.
    """
    k = F.col("seq")
    item = F.struct(
        F.col("price").alias("price"),
        F.when(k % 3 == 0, (k % 50).cast("double")).when(k % 3 == 1, 0.0).alias("changePercentage"),
        F.when(k % 2 == 0, 2.5).alias("changesPercentage"),
        (k % 4).cast("double").alias("change"),
        F.when(k % 5 > 0, (k % 1000).cast("double")).alias("volume"),
        (F.col("price") * 10).alias("marketCap"),
        F.when(k % 6 == 0, "").when(k % 6 == 1, F.concat(F.lit("name-"), "ticker")).alias("name"),
    )
    body = F.to_json(F.array(item))
    if objects:
        body = F.when(F.col("price") > 100_000, F.to_json(item)).otherwise(body)
    return quotes(spark, sf_dir).select(
        "ticker", "ts", "seq", F.when(F.col("price") < SMALL_QUOTE, "[]").otherwise(body).alias("body")
    )


def profiles_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of customers: objects and one-element arrays in turn."""
    item = F.struct(
        F.col("c_name").alias("companyName"),
        F.col("c_mktsegment").alias("sector"),
        F.col("c_nationkey").cast("string").alias("country"),
        F.col("c_acctbal").alias("beta"),
    )
    body = F.when(F.col("c_custkey") % 2 == 0, F.to_json(item)).otherwise(F.to_json(F.array(item)))
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("ticker"), body.alias("body")
    )


def statements_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly statements per customer as landed JSON."""
    flow = F.when(F.col("o_orderstatus") == "F", 1).otherwise(-1) * F.col("o_totalprice").cast(
        "decimal(18,2)"
    )
    quarterly = table(spark, sf_dir, "orders").groupBy(
        "o_custkey", F.trunc("o_orderdate", "quarter").alias("quarter")
    ).agg(F.sum(flow).cast("double").alias("flow"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    joined = quarterly.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    sheet = F.when(
        F.col("c_custkey") % 3 == 0,
        F.to_json(F.array(F.struct(
            F.lit(0.0).alias("cashAndCashEquivalents"),
            F.col("c_acctbal").alias("cashAndShortTermInvestments"),
        ))),
    ).otherwise(F.to_json(F.array(F.struct(F.col("c_acctbal").alias("cashAndCashEquivalents")))))
    cash_flow = F.when(
        F.col("c_custkey") % 2 == 0,
        F.to_json(F.array(F.struct(F.col("flow").alias("operatingCashFlow")))),
    ).otherwise(
        F.to_json(F.array(F.struct(F.col("flow").alias("netCashProvidedByOperatingActivities"))))
    )
    return joined.select(
        F.col("c_custkey").cast("string").alias("ticker"),
        F.col("quarter").cast("timestamp").alias("ts"),
        sheet.alias("balance"),
        cash_flow.alias("cashflow"),
    )


def social(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and label count per ticker and platform; the score is null without labels."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    per = documents.select("doc_id", "source").join(labels, "doc_id", "left").groupBy(
        (F.col("doc_id") % 50).cast("string").alias("ticker"), F.col("source").alias("platform")
    )
    return per.agg(
        (F.avg("quality") * 100).alias("score"), F.count("quality").alias("n")
    )


def social_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as landed JSON, one payload per ticker; platforms are few."""
    entry = F.struct("platform", "score")
    count = F.struct("platform", F.col("n").cast("double"))
    scored_only = F.filter(F.collect_list(entry), lambda e: e["score"].isNotNull())
    return social(spark, sf_dir).groupBy("ticker").agg(
        F.to_json(F.struct(F.struct(
            F.sum("n").cast("double").alias("num_posts"),
            F.lit("up").alias("trend"),
            F.map_from_entries(scored_only).alias("types_sentiment"),
            F.map_from_entries(F.collect_list(count)).alias("types_count"),
        ).alias("data"))).alias("body")
    ).withColumn("ts", F.lit("2024-01-31").cast("timestamp"))


def options(spark: SparkSession, sf_dir: str) -> DataFrame:
    spot = F.col("p_retailprice")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("contract_id"),
        spot.alias("spot"),
        (spot * ((F.col("p_size") - 25) / 100.0 + 1.0)).alias("strike"),
        (F.col("p_size") + 1).alias("days"),
        F.lit(1.5).alias("pre_iv"),
        F.lit(0.6).alias("post_iv"),
    )


def watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer watches their urgent events."""
    rows = table(spark, sf_dir, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
    return rows.select(F.col("o_custkey").alias("user"), F.col("o_orderkey").alias("event_id"))


def watch_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """They switch delayed events and those of high priority."""
    switched = (F.col("o_orderstatus") == "P") | (F.col("o_orderpriority") == "2-HIGH")
    rows = table(spark, sf_dir, "orders").filter(switched)
    return rows.select(F.col("o_custkey").alias("user"), F.col("o_orderkey").alias("event_id"))


def stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time-stamped predictions made some days before each event."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    lead = (key % 60 + 3).cast("int")
    status = F.when(key % 4 == 0, "LEGENDARY WIN").when(key % 4 == 1, "WIN (loss avoided)").when(
        key % 4 == 2, "WIN (EW validated)"
    ).otherwise("MISS")
    low = (key % 40 + 40).cast("string")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.when(key % 5 == 0, "EW-").otherwise("TS-"), key.cast("string")).alias("id"),
        key.alias("event_id"),
        F.col("o_custkey").cast("string").alias("ticker"),
        (F.date_sub(day, lead).cast("timestamp") + F.make_interval(hours=key % 24)).alias("ts"),
        day.alias("event_date"),
        F.date_add(day, (key % 9 - 4).cast("int")).alias("outcome_date"),
        F.when(key % 3 == 0, F.concat(low, F.lit("% APPROVAL")))
        .when(key % 3 == 1, F.concat(low, F.lit("-"), (key % 40 + 45).cast("string"), F.lit("% POSITIVE")))
        .otherwise("CLUSTER_SELL").alias("prediction"),
        F.when(key % 6 > 0, F.concat(F.lit("$"), (key % 900).cast("string"), F.lit(".25"))).alias("price_at"),
        F.when(key % 7 == 0, "n/a").when(key % 7 == 1, "").when(key % 7 == 2, F.concat(F.lit("-"), low, F.lit("% avoided")))
        .otherwise(F.concat(F.lit("+"), low, F.lit(".5%"))).alias("peak_gain"),
        F.when(key % 10 == 0, C.sha256(key.cast("string"))).alias("hash"),
        status.alias("status"),
    )


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Universe rows with one or two tickers and partly given dates as text."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    two = F.concat_ws("/", F.col("o_custkey").cast("string"), (F.col("o_custkey") + 1).cast("string"))
    text = F.date_format
    quarter = F.concat(F.lit("Q"), F.quarter(day).cast("string"), F.lit(" "), text(day, "yyyy"))
    return table(spark, sf_dir, "orders").select(
        key.alias("event_id"),
        F.when(key % 3 == 0, two).otherwise(F.col("o_custkey").cast("string")).alias("ticker"),
        F.when(key % 6 == 0, text(day, "yyyy-MM-dd"))
        .when(key % 6 == 1, text(day, "MMM d, yyyy"))
        .when(key % 6 == 2, text(day, "MMM yyyy"))
        .when(key % 6 == 3, F.concat(F.lit("~"), text(day, "MMM yyyy")))
        .when(key % 6 == 4, quarter)
        .otherwise(F.concat(F.lit("Sep 28→"), text(day, "MMM d, yyyy"))).alias("scheduled"),
        F.when(key % 4 == 0, text(F.date_add(day, 9), "yyyy-MM-dd"))
        .when(key % 4 == 1, text(day, "yyyy")).when(key % 4 == 2, "TBD").alias("actual"),
    )


def sealed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sealed JSON document per event; every ninth was changed after sealing."""
    match = F.when(F.col("event_id") % 3 == 0, "EXACT").when(
        F.col("event_id") % 3 == 1, "CONFIRMED"
    ).otherwise("NONE")
    checks = F.array_join(
        F.transform(
            "signals",
            lambda s: F.concat(
                F.lit('      "'), s, F.lit('": {\n        "weight": -0.5,\n'),
                F.lit('        "fda_rationale_match": "'), match, F.lit('"\n      }'),
            ),
        ),
        ",\n",
    )

    def record(indent: str, inner: Column, price: Column) -> Column:
        return F.concat(
            F.lit("{\n" + indent + '  "catalyst_id": "'), F.col("event_id").cast("string"),
            F.lit('",\n' + indent + '  "ticker": "'), F.col("ticker"),
            F.lit('",\n' + indent + '  "trade": {\n' + indent + '    "entry_price": '), price,
            F.lit("\n" + indent + '  },\n' + indent + '  "signal_validation": {\n'), inner,
            F.lit("\n" + indent + "  }\n" + indent + "}"),
        )

    price = (F.col("event_id") % 500).cast("string")
    shown = F.when(F.col("event_id") % 9 == 0, F.lit("1000")).otherwise(price)
    sealed = C.sha256(record("", F.regexp_replace(checks, "(?m)^  ", ""), price))
    text = F.concat(
        F.lit('{\n  "record": '), record("  ", checks, shown),
        F.lit(',\n  "integrity": {\n    "algorithm": "SHA-256",\n    "hash": "'), sealed,
        F.lit('"\n  }\n}'),
    )
    return signal_events(spark, sf_dir).select("event_id", text.alias("text"))


def chain_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical ledger lines with their ticker."""
    return integrity.canonical_ledger(ledger(spark, sf_dir), "ticker")


def linked_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that name the hash of the ticker's record before; every eleventh names another."""
    own = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").cast("string").alias("ticker"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        C.sha256(F.col("o_orderkey").cast("string")).alias("hash"),
    )
    before = running(
        own, ["ticker"], ["ts", "id"], lasts={"_prior": F.col("hash")}, include_current=False
    )
    wrong = (F.col("id") % 11 == 0) & F.col("_prior").isNotNull()
    return before.withColumn(
        "prior_hash", F.when(wrong, C.sha256(F.lit("lost"))).otherwise(F.col("_prior"))
    ).drop("_prior")
