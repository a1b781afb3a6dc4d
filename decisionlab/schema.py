"""Column types of the tables the jobs read."""

from __future__ import annotations

from pyspark.sql import types as T

WEIGHT = T.DecimalType(12, 6)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_S, _D, _I, _L, _B = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType()
_DATE, _TS = T.DateType(), T.TimestampType()

EVENT = _struct(
    ("event_id", _S), ("ticker", _S), ("company", _S), ("drug", _S), ("indication", _S),
    ("event_date", _DATE), ("type", _S), ("app_type", _S), ("area", _S), ("phase", _S),
    ("designations", T.ArrayType(_S)), ("enrollment", _I), ("nct_id", _S),
    ("stored_prob", _D), ("stored_tier", _S), ("stored_total_adj", _D), ("stored_logit", _D),
    ("area_risk", _S), ("action", _S), ("exit_window", _S), ("runner", _S),
    ("avoid", _B), ("weekend", _B), ("outcome", _S), ("modality", _S),
    ("signals", T.MapType(_S, WEIGHT)),
)

EVENT_SIGNAL = _struct(("event_id", _S), ("pos", _I), ("signal", _S), ("recorded_weight", WEIGHT))

SIGNAL_WEIGHT = _struct(("version", _S), ("signal", _S), ("category", _S), ("weight", WEIGHT))

OVERRIDE = _struct(("version", _S), ("event_id", _S), ("op", _S), ("signal", _S))

LEDGER = _struct(
    ("seq", _L), ("ticker", _S), ("drug", _S), ("indication", _S), ("date", _DATE), ("type", _S),
    ("outcome", _S), ("score", _D), ("tier", _S), ("action", _S), ("correct", _B),
    ("move", _S), ("notes", _S),
)

PREDICTION = _struct(
    ("id", _S), ("user", _S), ("event_id", _S), ("label", _S), ("created_at", _TS),
)

OUTCOME = _struct(("event_id", _S), ("outcome", _S), ("decided_at", _TS), ("notes", _S))

STAMPED = _struct(
    ("id", _S), ("ticker", _S), ("ts", _TS), ("version", _S), ("prediction", _S), ("tier", _S),
    ("price_at", _S), ("event_date", _DATE), ("event_type", _S), ("outcome", _S),
    ("outcome_date", _DATE), ("peak_gain", _S), ("hash", _S), ("status", _S), ("note", _S),
)

COIN_ENTRY = _struct(("user", _S), ("amount", _I), ("reason", _S), ("ts", _TS))

WATCH = _struct(("user", _S), ("event_id", _S))

AREA_RATE = _struct(("area", _S), ("approved", _I), ("total", _I), ("rate", _D))

CONFERENCE = _struct(
    ("name", _S), ("dates", _S), ("abstract_release", _DATE), ("month", _I), ("area", _S),
    ("tier", _S),
)

AREA_RISK = _struct(("area", _S), ("risk", _S))

MODALITY = _struct(("modality", _S), ("multiplier", _D))

QUOTE_BODY = T.ArrayType(_struct(
    ("price", _D), ("changePercentage", _D), ("changesPercentage", _D), ("change", _D),
    ("volume", _D), ("marketCap", _D), ("name", _S),
))

INSIDER_BODY = T.ArrayType(_struct(
    ("transactionDate", _S), ("reportingName", _S), ("transactionType", _S),
    ("securitiesTransacted", _D), ("price", _D),
))

SOCIAL_BODY = _struct(("data", _struct(
    ("interactions_24h", _D), ("num_posts", _D), ("num_contributors", _D), ("trend", _S),
    ("types_sentiment", T.MapType(_S, _D)), ("types_count", T.MapType(_S, _D)),
)))

PROFILE_BODY = _struct(
    ("companyName", _S), ("sector", _S), ("industry", _S), ("country", _S), ("beta", _D),
)

BALANCE_BODY = T.ArrayType(_struct(
    ("cashAndCashEquivalents", _D), ("cashAndShortTermInvestments", _D),
))

CASHFLOW_BODY = T.ArrayType(_struct(
    ("operatingCashFlow", _D), ("netCashProvidedByOperatingActivities", _D),
))

SIGNAL_CHECK = _struct(("weight", _D), ("fda_rationale_match", _S), ("description", _S))

SEALED_RECORD = _struct(
    ("catalyst_id", _S), ("ticker", _S),
    ("trade", _struct(
        ("executed", _B), ("entry_date", _S), ("entry_price", _D), ("exit_date", _S),
        ("exit_price", _D), ("holding_period_days", _I), ("gain_per_share", _D),
        ("gain_percent", _D),
    )),
    ("stock_impact", _struct(
        ("crl_decline_percent", _D), ("estimated_post_crl_price", _D),
        ("loss_avoided_per_share", _D), ("net_swing_vs_holding", _D),
    )),
    ("signal_validation", T.MapType(_S, SIGNAL_CHECK)),
    ("prior_record_hash", _S), ("prior_verification_hash", _S), ("timestamp_utc", _S),
)

SEALED = _struct(
    ("record", SEALED_RECORD),
    ("integrity", _struct(("algorithm", _S), ("hash", _S))),
)
