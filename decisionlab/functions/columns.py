"""Column expressions shared by the jobs. All are built-in functions; none is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from decisionlab import dims


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


# Scores


def sigmoid(x: Column | str) -> Column:
    return 1.0 / (1.0 + F.exp(-_col(x)))


def tier(prob: Column | str) -> Column:
    """Conviction tier of an unrounded probability; only the first bound is strict."""
    p = _col(prob)
    return (
        F.when(p > 0.85, "TIER_1")
        .when(p >= 0.70, "TIER_2")
        .when(p >= 0.60, "TIER_3")
        .when(p.isNotNull(), "TIER_4")
    )


def _policy(tier_col: Column | str, field: int) -> Column:
    t = _col(tier_col)
    out = None
    for name, row in dims.TIER_POLICY.items():
        out = F.when(t == name, row[field]) if out is None else out.when(t == name, row[field])
    return out


def action(tier_col: Column | str) -> Column:
    return _policy(tier_col, 0)


def position_policy(tier_col: Column | str) -> Column:
    """Struct of position, exit window and runner share for a tier."""
    return F.struct(
        _policy(tier_col, 1).alias("position"),
        _policy(tier_col, 2).alias("exit_window"),
        _policy(tier_col, 3).alias("runner"),
    )


def is_correct(prob: Column | str, outcome: Column | str) -> Column:
    """Approved needs prob >= 0.60, rejected needs less; null for any other outcome."""
    p, o = _col(prob), _col(outcome)
    return F.when(o.isin("APPROVED", "APPROVE"), p >= 0.60).when(o.isin("CRL"), p < 0.60)


def is_traded_correct(prob: Column | str, action_col: Column | str) -> Column:
    """The same rule read from what was done: TRADED needs >= 0.60, AVOIDED needs less."""
    p, a = _col(prob), _col(action_col)
    return F.when(a == "TRADED", p >= 0.60).when(a == "AVOIDED", p < 0.60)


def error_class(prob: Column | str, outcome: Column | str) -> Column:
    """FALSE NEGATIVE for a missed approval, FALSE POSITIVE for a missed rejection."""
    wrong = ~is_correct(prob, outcome)
    return F.when(
        wrong,
        F.when(_col(outcome).isin("APPROVED", "APPROVE"), "FALSE NEGATIVE").otherwise(
            "FALSE POSITIVE"
        ),
    )


# Event types and dates


def kind(type_col: Column | str) -> Column:
    t = _col(type_col)
    return F.when(t.isin(dims.DECISION_TYPES), "decision").when(
        t.isin(dims.READOUT_TYPES), "readout"
    )


def type_label(type_col: Column | str) -> Column:
    t = _col(type_col)
    return (
        F.when(t == "Phase 2 Readout", "PH2")
        .when(t == "Phase 3 Readout", "PH3")
        .when(t == "PDUFA (Expected)", "PDUFA*")
        .otherwise("PDUFA")
    )


def is_weekend(day: Column | str) -> Column:
    return F.weekday(_col(day)) >= 5


def days_out(day: Column | str, as_of: str) -> Column:
    return F.datediff(_col(day), F.lit(as_of).cast("date"))


def lead_days(later: Column | str, earlier: Column | str) -> Column:
    """Days between two instants, rounded half up."""
    seconds = F.unix_timestamp(_col(later).cast("timestamp")) - F.unix_timestamp(
        _col(earlier).cast("timestamp")
    )
    return F.floor(seconds / F.lit(86400.0) + 0.5)


def zone(days: Column | str) -> Column:
    """Trading-window zone by days until the decision."""
    return _by_days(days, 0)


def zone_progress(days: Column | str) -> Column:
    return _by_days(days, 1)


def _by_days(days: Column | str, field: int) -> Column:
    d = _col(days)
    out = F.when(d < 0, dims.EXPIRED_ZONE[field])
    for last, *values in dims.WINDOW_ZONES:
        out = out.when(d <= last, values[field])
    return out.when(d.isNotNull(), dims.FAR_ZONE[field])


# Text and numbers


def leading_number(text: Column | str) -> Column:
    """The number a text starts with ('+534%' is 534), null when it starts with none."""
    return F.regexp_extract(
        _col(text), r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))", 1
    ).try_cast("decimal(18,6)")


def money_value(text: Column | str) -> Column:
    """'$4.80' as 4.8."""
    return F.regexp_extract(_col(text), r"\$\s*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


def score_range(text: Column | str) -> Column:
    """'80-85% APPROVAL' as struct(lo, hi, label); one number gives lo = hi."""
    t = _col(text)
    pattern = r"^\s*([0-9]+(?:\.[0-9]+)?)(?:\s*-\s*([0-9]+(?:\.[0-9]+)?))?\s*%\s*(.*)$"
    low = F.regexp_extract(t, pattern, 1).try_cast("double")
    high = F.regexp_extract(t, pattern, 2).try_cast("double")
    label = F.regexp_extract(t, pattern, 3)
    return F.struct(
        low.alias("lo"),
        F.coalesce(high, low).alias("hi"),
        F.when(low.isNotNull() & (label != ""), label).alias("label"),
    )


def money_format(value: Column | str) -> Column:
    """$1.2B / $3.4M / $5.6K / $7.89, N/A for null."""
    v = _col(value)

    def scaled(unit: float, suffix: str) -> Column:
        return F.format_string(f"$%.1f{suffix}", v / unit)

    return (
        F.when(v.isNull(), "N/A")
        .when(F.abs(v) >= 1e9, scaled(1e9, "B"))
        .when(F.abs(v) >= 1e6, scaled(1e6, "M"))
        .when(F.abs(v) >= 1e3, scaled(1e3, "K"))
        .otherwise(F.format_string("$%.2f", v))
    )


def percent(prob: Column | str) -> Column:
    """prob as percent with one decimal."""
    return F.round(_col(prob) * 100, 1)


def ratio_pct(part: Column | str, whole: Column | str) -> Column:
    """100 * part / whole for counts, one decimal, half up, in whole-number arithmetic.

    A whole of zero counts as one, so that no part of nothing is 0.
    """
    a, n = _col(part).cast("long"), F.greatest(_col(whole).cast("long"), F.lit(1).cast("long"))
    return F.floor((a * 2000 + n) / (n * 2)).cast("double") / 10.0


def number_text(value: Column | str) -> Column:
    """A number the way the published ledger prints it: 10 rather than 10.0, never 1.0E-4."""
    v = _col(value).cast("double")
    plain = (F.abs(v) >= 1e-3) & (F.abs(v) < 1e7)
    long = F.regexp_replace(F.format_string("%.10f", v), r"0+$", "")
    shown = F.when(plain, v.cast("string")).otherwise(long)
    return F.when(v.isNotNull(), F.regexp_replace(shown, r"\.0?$", ""))


def nonzero(*values: Column | str) -> Column:
    """First value that is neither null nor zero, else 0."""
    return F.coalesce(
        *[F.nullif(_col(v).cast("double"), F.lit(0.0)) for v in values], F.lit(0.0)
    )


def sha256(text: Column | str) -> Column:
    return F.sha2(_col(text).cast("binary"), 256)


def short_designations(names: Column | str) -> Column:
    """Designations in their short forms."""

    def shorten(name: Column) -> Column:
        out = name
        for long, short in dims.DESIGNATION_SHORT.items():
            out = F.replace(out, F.lit(long), F.lit(short))
        return out

    return F.transform(_col(names), shorten)


def platform_name(name: Column | str) -> Column:
    out = _col(name)
    for raw, shown in dims.PLATFORM_NAMES.items():
        out = F.replace(out, F.lit(raw), F.lit(shown))
    return out


# Bands


def sentiment_band(score: Column | str) -> Column:
    s = _col(score)
    return (
        F.when(s >= 80, "STRONG").when(s >= 60, "GOOD").when(s >= 40, "WEAK").otherwise("POOR")
    )


def platform_band(score: Column | str) -> Column:
    s = _col(score)
    return F.when(s >= 70, "HIGH").when(s >= 40, "MID").otherwise("LOW")


def runway_band(months: Column | str) -> Column:
    m = _col(months)
    return (
        F.when(m.isNull() | (m == 0), "UNKNOWN")
        .when(m >= 24, "24+")
        .when(m >= 12, "12-24")
        .when(m >= 6, "6-12")
        .otherwise("<6")
    )


def rate_band(rate: Column | str) -> Column:
    r = _col(rate)
    return F.when(r >= 85, "LOW").when(r >= 75, "MOD").when(r >= 65, "HIGH").when(
        r.isNotNull(), "VERY_HIGH"
    )


def coin_tier(balance: Column | str) -> Column:
    """Highest tier whose least balance is reached."""
    b = _col(balance)
    out = F.lit(dims.COIN_TIERS[0][0])
    for name, least in dims.COIN_TIERS[1:]:
        out = F.when(b >= least, name).otherwise(out)
    return out


def coin_progress(balance: Column | str) -> Column:
    """Percent of the way from this tier to the next; 100 in the last tier."""
    b = _col(balance)
    out = F.lit(100.0)
    steps = list(zip(dims.COIN_TIERS, dims.COIN_TIERS[1:], strict=False))
    for (_, low), (_, high) in reversed(steps):
        out = F.when(b < high, (b - low) * 100.0 / (high - low)).otherwise(out)
    return out


# Options


def erf_scale(x: Column | str) -> Column:
    """The inner variable of the error function's polynomial."""
    return 1.0 / (1.0 + F.abs(_col(x)) * dims.ERF_P)


def erf(x: Column | str, scale: Column | str) -> Column:
    """Error function of `x`; `scale` holds `erf_scale(x)`, which is used five times."""
    x, t = _col(x), _col(scale)
    poly = F.lit(0.0)
    for a in reversed(dims.ERF_A):
        poly = (poly + a) * t
    y = 1.0 - poly * F.exp(-x * x)
    return F.when(x < 0, -y).otherwise(y)


# Partial dates


def partial_date(text: Column | str) -> Column:
    """A partly given date as struct(first, last, precision, approx).

    Takes '2026-02-13', 'Oct 5, 2025', 'Oct 2025', 'Q3 2025' and '2025', with '~' for an
    approximate one; 'A→B' takes B.
    """
    raw = F.trim(F.regexp_extract(_col(text), r"([^→]*)$", 1))
    approx = raw.startswith("~")
    t = F.trim(F.regexp_replace(raw, "^~", ""))
    iso = F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})$", 1)
    day = F.regexp_extract(t, r"^([A-Z][a-z]{2} \d{1,2}, \d{4})$", 1)
    month = F.regexp_extract(t, r"^([A-Z][a-z]{2} \d{4})$", 1)
    quarter = F.regexp_extract(t, r"^Q([1-4]) \d{4}$", 1)
    quarter_year = F.regexp_extract(t, r"^Q[1-4] (\d{4})$", 1)
    year = F.regexp_extract(t, r"^(\d{4})$", 1)

    on_day = F.coalesce(F.try_to_date(iso, "yyyy-MM-dd"), F.try_to_date(day, "MMM d, yyyy"))
    month_start = F.try_to_date(F.concat(F.lit("1 "), month), "d MMM yyyy")
    quarter_start = F.make_date(
        quarter_year.try_cast("int"), quarter.try_cast("int") * 3 - 2, F.lit(1)
    )
    year_start = F.make_date(year.try_cast("int"), F.lit(1), F.lit(1))
    first = F.coalesce(on_day, month_start, quarter_start, year_start)
    last = F.coalesce(
        on_day,
        F.last_day(month_start),
        F.last_day(F.add_months(quarter_start, 2)),
        F.last_day(F.add_months(year_start, 11)),
    )
    precision = (
        F.when(on_day.isNotNull(), "day")
        .when(month_start.isNotNull(), "month")
        .when(quarter_start.isNotNull(), "quarter")
        .when(year_start.isNotNull(), "year")
    )
    return F.struct(
        first.alias("first"), last.alias("last"), precision.alias("precision"),
        approx.alias("approx"),
    )
