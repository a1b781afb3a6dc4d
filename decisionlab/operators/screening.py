"""Screens over events: filters, zones, warnings, dashboard counts, heat map and the feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decisionlab import dims
from decisionlab.functions import columns as C


def screen(
    events: DataFrame,
    *,
    tier: str | None = None,
    area: str | None = None,
    kind: str | None = None,
    text: str | None = None,
    watch: DataFrame | None = None,
) -> DataFrame:
    """Events that pass every filter given; `text` matches drug, ticker or company."""
    out = events
    if tier:
        out = out.filter(F.col("tier") == tier)
    if area:
        out = out.filter(F.col("area") == area)
    if kind:
        out = out.filter(C.kind("type") == kind)
    if text:
        needle = text.lower()
        fields = [F.lower(F.coalesce(c, F.lit(""))) for c in ("drug", "ticker", "company")]
        out = out.filter(
            fields[0].contains(needle) | fields[1].contains(needle) | fields[2].contains(needle)
        )
    return out if watch is None else watched(out, watch)


def watched(events: DataFrame, watch: DataFrame) -> DataFrame:
    """Events on the watchlist."""
    return events.join(watch.select("event_id").distinct(), "event_id", "left_semi")


def missing_from(a: DataFrame, b: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows of `a` whose key does not occur in `b`, which shrinks to its keys first."""
    keys = [key] if isinstance(key, str) else key
    return a.join(b.select(keys).distinct(), keys, "left_anti")


def within_days(events: DataFrame, as_of: str, n: int) -> DataFrame:
    """Events from today to `n` days out; the bounds are dates, so the scan can skip files."""
    start = F.lit(as_of).cast("date")
    return events.filter(F.col("event_date").between(start, F.date_add(start, n)))


def window_zone(events: DataFrame, as_of: str) -> DataFrame:
    """Add days out, trading-window zone and progress."""
    return (
        events.withColumn("days_out", C.days_out("event_date", as_of))
        .withColumn("zone", C.zone("days_out"))
        .withColumn("progress", C.zone_progress("days_out"))
    )


def scanner(events: DataFrame, as_of: str) -> DataFrame:
    """Events not yet past, nearest first."""
    ahead = events.filter(F.col("event_date") >= F.lit(as_of).cast("date"))
    return window_zone(ahead, as_of).orderBy("days_out", "event_id")


def warnings(events: DataFrame, as_of: str, modality: DataFrame) -> DataFrame:
    """One row per warning of an event: level and label."""
    zoned = window_zone(events, as_of).join(modality, "modality", "left")
    signals = F.col("signals")
    if events.schema["signals"].dataType.typeName() == "map":
        signals = F.map_keys(signals)
    rules = [
        (F.col("tier") == "TIER_4", "high", "High Risk"),
        (F.col("area_risk") == "HIGH_RISK", "high", "High TA Risk"),
        (F.col("weekend"), "med", "Weekend Decision"),
        (F.col("avoid"), "high", "Avoid"),
        (F.array_contains(signals, "inexperienced_sponsor"), "med", "First-Time Sponsor"),
        ((F.col("enrollment") > 0) & (F.col("enrollment") < 100), "low", "Small Trial"),
        (F.col("multiplier") >= 2.0, "high", "CMC Risk"),
        (F.col("zone") == "DANGER", "high", "Binary Risk Zone"),
        (F.col("zone") == "EXIT", "high", "T-7 Exit Zone"),
    ]
    found = [
        F.when(test, F.struct(F.lit(level).alias("level"), F.lit(label).alias("label")))
        for test, level, label in rules
    ]
    return zoned.select(
        "event_id", F.explode(F.array_compact(F.array(*found))).alias("_w")
    ).select("event_id", "_w.level", "_w.label")


def radar(events: DataFrame, rates: DataFrame) -> DataFrame:
    """Five 0-100 axes per event in long form. Needs `prob` and `signal_weights`."""
    weights = F.col("signal_weights")
    size = F.size(weights)
    negative = F.size(F.filter(weights, lambda w: w < 0))
    phase = F.when(F.col("phase") == "Phase 3", 70).when(F.col("phase") == "Phase 2", 40)
    bonus = F.when(F.col("enrollment") > 500, 20).when(F.col("enrollment") > 100, 10)
    rated = with_area_rate(events, rates)
    axes = {
        "approval": F.least(F.col("prob") * 100, F.lit(100.0)),
        "designations": F.least(F.size("designations") * 25, F.lit(100)).cast("double"),
        "area_history": F.coalesce("area_rate", F.lit(50.0)),
        "clinical": F.least(
            F.coalesce(phase, F.lit(20)) + F.coalesce(bonus, F.lit(0)), F.lit(100)
        ).cast("double"),
        "risk": F.when(size > 0, 100.0 - negative * 100.0 / size).otherwise(50.0),
    }
    points = F.array(
        *[F.struct(F.lit(n).alias("axis"), v.alias("value")) for n, v in axes.items()]
    )
    return rated.select("event_id", F.explode(points).alias("_p")).select("event_id", "_p.*")


def with_area_rate(events: DataFrame, rates: DataFrame) -> DataFrame:
    """Add the historical rate of the event's area, null where unknown."""
    return events.join(rates.select("area", F.col("rate").alias("area_rate")), "area", "left")


def area_activity(rates: DataFrame, events: DataFrame) -> DataFrame:
    """Every area rate with its number of events, 0 kept, best rate first."""
    counts = events.groupBy("area").agg(F.count(F.lit(1)).alias("active"))
    return (
        rates.join(counts, "area", "left")
        .withColumn("active", F.coalesce("active", F.lit(0).cast("long")))
        .orderBy(F.desc("rate"), "area")
    )


def area_rates(history: DataFrame) -> DataFrame:
    """Approved, total and rate per area of decided events, best rate first."""
    decided = history.filter(F.col("outcome").isin("APPROVED", "CRL"))
    approved, total = F.count_if(F.col("outcome") == "APPROVED"), F.count(F.lit(1))
    return (
        decided.groupBy("area")
        .agg(
            approved.alias("approved"),
            total.alias("total"),
            C.ratio_pct(approved, total).alias("rate"),
        )
        .orderBy(F.desc("rate"), "area")
    )


def area_risk(rates: DataFrame, mapping: DataFrame) -> DataFrame:
    """Risk class of each area as listed, and the band its rate falls in."""
    return rates.join(mapping, "area", "left").withColumn("band", C.rate_band("rate"))


def areas(events: DataFrame) -> DataFrame:
    return events.select("area").distinct().orderBy("area")


def kpis(events: DataFrame, as_of: str) -> DataFrame:
    """Dashboard counts in one pass over the events."""
    days = C.days_out("event_date", as_of)
    soon = days.between(0, 7)
    count = F.count_if
    tiers = {f"tier_{i + 1}": count(F.col("tier") == t) for i, t in enumerate(dims.TIERS)}
    first = F.min_by("event_id", F.when(soon, F.struct("event_date", "event_id")))
    return events.agg(
        F.count(F.lit(1)).alias("total"),
        *[expr.alias(name) for name, expr in tiers.items()],
        count(F.col("tier").isin("TIER_1", "TIER_2")).alias("high_conviction"),
        count(C.kind("type") == "decision").alias("decisions"),
        count(C.kind("type") == "readout").alias("readouts"),
        count("weekend").alias("weekend"),
        F.round(F.avg("prob") * 100, 1).alias("mean_prob"),
        count(soon).alias("next_7_days"),
        first.alias("next_event"),
    )


def tier_distribution(events: DataFrame) -> DataFrame:
    """Count and share of each tier; all four tiers are kept."""
    names = F.array(*[F.lit(t) for t in dims.TIERS])
    total = F.count(F.lit(1))
    counts = events.agg(
        total.alias("total"), *[F.count_if(F.col("tier") == t).alias(t) for t in dims.TIERS]
    )
    by_name = F.create_map(*[c for t in dims.TIERS for c in (F.lit(t), F.col(t))])
    return counts.select("total", by_name.alias("by_name"), F.explode(names).alias("tier")).select(
        "tier",
        F.col("by_name")[F.col("tier")].alias("n"),
        C.ratio_pct(F.col("by_name")[F.col("tier")], "total").alias("pct"),
    )


def calendar(events: DataFrame) -> DataFrame:
    """Events and tier-1 events per month, months rising."""
    return (
        events.groupBy(F.date_format("event_date", "yyyy-MM").alias("month"))
        .agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("tier") == "TIER_1").alias("tier_1")
        )
        .orderBy("month")
    )


def _heat_group(group_by: str) -> Column:
    if group_by == "type":
        return F.when(C.kind("type") == "decision", "PDUFA").otherwise(F.col("type"))
    return F.col(group_by)


def heatmap(events: DataFrame, group_by: str = "area", size_by: str = "prob") -> DataFrame:
    """Groups with count, size and share of the total size, largest probability sum first.

    `group_by` is area, type or tier; `size_by` is prob or equal.
    """
    n, sum_prob = F.count(F.lit(1)), F.sum("prob")
    groups = events.groupBy(_heat_group(group_by).alias("grp")).agg(
        n.alias("n"),
        sum_prob.alias("sum_prob"),
        (sum_prob if size_by == "prob" else n.cast("double")).alias("size"),
    )
    # One row per area, type or tier is left, so the total fits any task.
    total = F.sum("size").over(Window.partitionBy(F.lit(0)))
    return groups.withColumn("pct", F.col("size") / F.nullif(total, F.lit(0.0)) * 100).orderBy(
        F.desc("sum_prob"), "grp"
    )


def heatmap_items(
    events: DataFrame, group_by: str = "area", size_by: str = "prob"
) -> DataFrame:
    """Each event's share of the whole map in percent: its probability, or 1/n when equal."""
    size = F.col("prob") if size_by == "prob" else F.lit(1.0)
    total = F.nullif(events.agg(F.sum(size).alias("total")).scalar(), F.lit(0.0))
    return events.select(
        "event_id", _heat_group(group_by).alias("grp"), (size / total * 100).alias("pct")
    )


def sort_events(events: DataFrame, col: str, descending: bool = False) -> DataFrame:
    """Sort by any column, text without regard to case, the id breaking ties."""
    key = F.col(col)
    if events.schema[col].dataType.typeName() == "string":
        key = F.lower(key)
    return events.orderBy(key.desc() if descending else key.asc(), "event_id")


def next_up(events: DataFrame, as_of: str, days: int = 30, n: int = 10) -> DataFrame:
    """The first `n` events of the next `days` days, each with the number not shown."""
    window = within_days(events, as_of, days)
    total = window.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        window.orderBy("event_date", "event_id")
        .limit(n)
        .withColumn("remaining", F.greatest(total - n, F.lit(0)))
    )


def upcoming_conferences(conferences: DataFrame, as_of: str, days: int = 60) -> DataFrame:
    """Conferences whose abstracts come out after today and within `days` days."""
    out = conferences.withColumn("days_until", C.days_out("abstract_release", as_of))
    return out.filter((F.col("days_until") > 0) & (F.col("days_until") <= days))


def conference_overlap(events: DataFrame, conferences: DataFrame, n: int) -> DataFrame:
    """Events with a conference of their area releasing abstracts up to `n` days before.

    Time is cut into spans of n + 1 days, and a conference can only concern its own span
    and the next, so an event meets the conferences of its area and span alone.
    """
    days = F.datediff("event_date", "abstract_release")
    span = F.floor(F.unix_date("abstract_release") / (n + 1))
    spans = conferences.select(
        "name", "area", "abstract_release", F.explode(F.array(span, span + 1)).alias("_span")
    )
    return (
        events.select("event_id", "area", "event_date")
        .withColumn("_span", F.floor(F.unix_date("event_date") / (n + 1)))
        .join(spans, ["area", "_span"])
        .filter(days.between(0, n))
        .select("event_id", "name", "abstract_release", days.alias("days_before"))
    )


def feed(
    events: DataFrame, conferences: DataFrame, predictions: DataFrame | None, as_of: str
) -> DataFrame:
    """Alert rows of all rules, highest priority first.

    `predictions` holds the event ids the reader has already called; the prompt to predict
    is raised for the others.
    """
    # No rule concerns the past, so those events go before anything is joined to them.
    ahead = events.filter(F.col("event_date") >= F.lit(as_of).cast("date"))
    zoned = window_zone(ahead, as_of)
    days, zone = F.col("days_out"), F.col("zone")
    rules = [
        (zone == "DANGER", "BINARY_RISK", 110),
        (zone == "EXIT", "EXIT_ALERT", 100),
        (zone == "OPTIMAL", "ENTRY_SIGNAL", 90),
        (F.col("avoid") & (days > 0), "AVOID", 80),
        ((F.col("tier") == "TIER_1") & (days > 0) & (days <= 45), "HIGH_CONVICTION", 70),
        (F.col("weekend") & (days > 0) & (days <= 14), "WEEKEND_WARN", 60),
        ((days > 0) & (days <= 30), "PREDICT_PROMPT", 30),
    ]
    found = [
        F.when(test, F.struct(F.lit(rule).alias("rule"), F.lit(priority).alias("priority")))
        for test, rule, priority in rules
    ]
    alerts = zoned.select(
        "event_id", "days_out", F.explode(F.array_compact(F.array(*found))).alias("_r")
    ).select("event_id", "_r.rule", "_r.priority", "days_out")

    if predictions is not None:
        called = predictions.select(F.col("event_id").alias("_called")).distinct()
        done = (F.col("rule") == "PREDICT_PROMPT") & (F.col("event_id") == F.col("_called"))
        alerts = alerts.join(called, done, "left_anti")

    meetings = upcoming_conferences(conferences, as_of).select(
        F.lit(None).cast(events.schema["event_id"].dataType).alias("event_id"),
        F.concat(F.lit("CONFERENCE: "), "name").alias("rule"),
        F.lit(40).alias("priority"),
        F.col("days_until").alias("days_out"),
    )
    return alerts.unionByName(meetings).orderBy(F.desc("priority"), "event_id")


def zone_changes(events: DataFrame, before: str, after: str) -> DataFrame:
    """Events whose zone differs between two dates: the alerts of the days between."""
    first, last = sorted((before, after))
    reach = dims.WINDOW_ZONES[-1][0]
    # Past the first date an event is expired on both, beyond the last zone it is far on both.
    near = F.col("event_date").between(
        F.lit(first).cast("date"), F.date_add(F.lit(last).cast("date"), reach)
    )
    old = C.zone(C.days_out("event_date", before))
    new = C.zone(C.days_out("event_date", after))
    return events.filter(near).select(
        "event_id", "event_date", old.alias("old_zone"), new.alias("new_zone")
    ).filter(F.col("old_zone") != F.col("new_zone"))


def base_rate(universe: DataFrame) -> DataFrame:
    """Approvals over approvals plus rejections of decisions; the rest is only counted."""
    decision = C.kind("type") == "decision"
    approved = F.count_if(decision & (F.col("outcome") == "APPROVED"))
    rejected = F.count_if(decision & (F.col("outcome") == "CRL"))
    return universe.agg(
        approved.alias("approved"),
        rejected.alias("rejected"),
        F.count_if(decision & (F.col("outcome") == "DELAYED")).alias("delayed"),
        F.count_if(C.kind("type") == "readout").alias("readouts"),
        C.ratio_pct(approved, approved + rejected).alias("base_rate"),
    )
