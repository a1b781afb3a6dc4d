"""Queries that screen, group and list events."""

from __future__ import annotations

from pyspark.sql import functions as F

from decisionlab import dims
from decisionlab.functions import columns as C
from decisionlab.operators import scoring
from decisionlab.operators import screening as S
from decisionlab.operators.ordered import placed
from decisionlab.plans import bindings as B
from decisionlab.plans.oracle_views import kind_sql, pct_sql, zone_sql
from decisionlab.plans.registry import query, r6, text
from decisionlab.session import cut_lineage
from decisionlab.sources import documents

DAY = f"DATE '{B.AS_OF}'"
OUT = f"date_diff('day', {DAY}, event_date)"


@query("""
SELECT event_id, ticker, drug, area, tier FROM scored e
WHERE tier = 'TIER_1' AND area = 'BUILDING' AND type IN ('PDUFA', 'PDUFA (Expected)')
  AND (contains(lower(drug), 'pound-1') OR contains(lower(ticker), 'pound-1')
    OR contains(lower(company), 'pound-1'))""", "scored")
def screen_events(spark, sf_dir):
    found = S.screen(
        B.scored(spark, sf_dir), tier="TIER_1", area="BUILDING", kind="decision", text="POUND-1"
    )
    return found.select("event_id", "ticker", "drug", "area", "tier")


@query("""
SELECT e.event_id, e.area FROM event e JOIN watch w ON w.event_id = e.event_id
WHERE e.area = 'MACHINERY' AND e.type LIKE 'PDUFA%'""", "event watch")
def screen_watchlist(spark, sf_dir):
    found = S.screen(
        B.events(spark, sf_dir), area="MACHINERY", kind="decision", watch=B.watchlist(spark, sf_dir)
    )
    return found.select("event_id", "area")


@query("SELECT e.event_id, ticker FROM event e JOIN watch w ON w.event_id = e.event_id", "event watch")
def watched_events(spark, sf_dir):
    return S.watched(B.events(spark, sf_dir), B.watchlist(spark, sf_dir)).select(
        "event_id", "ticker"
    )


@query(f"""
SELECT {kind_sql('type')} AS kind,
  CASE type WHEN 'Phase 2 Readout' THEN 'PH2' WHEN 'Phase 3 Readout' THEN 'PH3'
    WHEN 'PDUFA (Expected)' THEN 'PDUFA*' ELSE 'PDUFA' END AS label, count(*) AS n
FROM event GROUP BY 1, 2""", "event")
def event_kinds(spark, sf_dir):
    return B.events(spark, sf_dir).groupBy(
        C.kind("type").alias("kind"), C.type_label("type").alias("label")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
SELECT event_id, CAST(event_date AS VARCHAR) AS event_date FROM event
WHERE {OUT} BETWEEN 0 AND 30""", "event")
def events_within_30_days(spark, sf_dir):
    found = S.within_days(B.events(spark, sf_dir), B.AS_OF, 30)
    return found.select("event_id", text("event_date"))


@query(f"""
SELECT event_id, {OUT} AS days_out, {zone_sql(OUT)} AS zone,
  CASE {zone_sql(OUT)} WHEN 'EXPIRED' THEN CAST(100 AS BIGINT) WHEN 'DANGER' THEN 95 WHEN 'EXIT' THEN 85
    WHEN 'PEAK' THEN 70 WHEN 'OPTIMAL' THEN 45 WHEN 'EARLY' THEN 20 ELSE 5 END AS progress
FROM event""", "event")
def window_zones(spark, sf_dir):
    return S.window_zone(B.events(spark, sf_dir), B.AS_OF).select(
        "event_id", F.col("days_out").cast("long"), "zone", F.col("progress").cast("long")
    )


@query(f"""
SELECT event_id, {OUT} AS days_out, {zone_sql(OUT)} AS zone,
  row_number() OVER (ORDER BY {OUT}, event_id) AS place
FROM event WHERE {OUT} >= 0""", "event")
def scanner(spark, sf_dir):
    return placed(S.scanner(B.events(spark, sf_dir), B.AS_OF)).select(
        "event_id", F.col("days_out").cast("long"), "zone", "place"
    )


@query(f"""
SELECT event_id, unnest(list_filter([
  CASE WHEN tier = 'TIER_4' THEN 'high: High Risk' END,
  CASE WHEN area_risk = 'HIGH_RISK' THEN 'high: High TA Risk' END,
  CASE WHEN weekend THEN 'med: Weekend Decision' END,
  CASE WHEN avoid THEN 'high: Avoid' END,
  CASE WHEN list_contains(signals, 'inexperienced_sponsor') THEN 'med: First-Time Sponsor' END,
  CASE WHEN enrollment > 0 AND enrollment < 100 THEN 'low: Small Trial' END,
  CASE WHEN modality IN ('ADC', 'Gene Therapy') THEN 'high: CMC Risk' END,
  CASE WHEN {OUT} BETWEEN 0 AND 3 THEN 'high: Binary Risk Zone' END,
  CASE WHEN {OUT} BETWEEN 4 AND 7 THEN 'high: T-7 Exit Zone' END], lambda x: x IS NOT NULL)) AS warning
FROM scored JOIN flags USING (event_id)""", "scored flags")
def event_warnings(spark, sf_dir):
    found = S.warnings(B.scored(spark, sf_dir), B.AS_OF, dims.modality_table(spark))
    return found.select("event_id", F.concat("level", F.lit(": "), "label").alias("warning"))


@query("""
SELECT event_id, weekend AS is_weekend FROM event""", "event")
def weekend_events(spark, sf_dir):
    return B.events(spark, sf_dir).select(
        "event_id", C.is_weekend("event_date").alias("is_weekend")
    )


@query("""
SELECT event_id, axis, round(value, 4) AS value FROM (
  SELECT event_id, unnest(['approval', 'designations', 'area_history', 'clinical', 'risk']) AS axis,
    unnest([least(prob * 100, 100),
      least(25 * len(list_filter(signals, lambda x: x IN ('BTD', 'orphan', 'priority_review'))), 100),
      coalesce(rate, 50),
      least(CASE phase WHEN 'Phase 3' THEN 70 WHEN 'Phase 2' THEN 40 ELSE 20 END
        + CASE WHEN enrollment > 500 THEN 20 WHEN enrollment > 100 THEN 10 ELSE 0 END, 100),
      CASE WHEN n > 0 THEN 100 - neg * 100.0 / n ELSE 50 END]) AS value
  FROM (
    SELECT e.event_id, any_value(prob) AS prob, any_value(f.signals) AS signals,
      any_value(r.rate) AS rate, any_value(phase) AS phase, any_value(enrollment) AS enrollment,
      count(s.signal) AS n, count(*) FILTER (w.weight < 0) AS neg
    FROM scored e JOIN flags f ON f.event_id = e.event_id LEFT JOIN rates r ON r.area = e.area
      LEFT JOIN signal s ON s.event_id = e.event_id LEFT JOIN w68 w ON w.signal = s.signal
    GROUP BY 1))""", "scored flags signal rates w68")
def event_radar(spark, sf_dir):
    weighted = scoring.with_weights(B.scored(spark, sf_dir), dims.weights_table(spark))
    return S.radar(weighted, B.rates(spark)).select("event_id", "axis", r6("value", places=4))


@query("""
SELECT event_id, e.area, r.rate AS area_rate FROM event e LEFT JOIN rates r ON r.area = e.area
""", "event rates")
def event_area_rate(spark, sf_dir):
    return S.with_area_rate(B.events(spark, sf_dir), B.rates(spark)).select(
        "event_id", "area", "area_rate"
    )


@query(f"""
SELECT ticker, round(orig_score, 6) AS orig_score FROM orig
WHERE ticker NOT IN (SELECT ticker FROM event WHERE {OUT} >= 0)""", "orig event")
def missing_tickers(spark, sf_dir):
    """Tickers once published that have no event ahead."""
    ahead = B.events(spark, sf_dir).filter(F.col("event_date") >= F.lit(B.AS_OF).cast("date"))
    gone = S.missing_from(B.originals(spark, sf_dir), ahead, "ticker")
    return gone.select("ticker", r6("orig_score"))


@query("""
SELECT event_id, type FROM event WHERE event_id NOT IN
  (SELECT event_id FROM vote WHERE event_id IS NOT NULL)""", "event vote")
def unpredicted_events(spark, sf_dir):
    return S.missing_from(B.events(spark, sf_dir), B.votes(spark, sf_dir), "event_id").select(
        "event_id", "type"
    )


@query("""
SELECT r.area, any_value(r.rate) AS rate, count(e.event_id) AS active
FROM rates r LEFT JOIN event e ON e.area = r.area GROUP BY 1""", "rates event")
def area_activity(spark, sf_dir):
    return S.area_activity(B.rates(spark), B.events(spark, sf_dir)).select("area", "rate", "active")


@query(f"""
SELECT *, row_number() OVER (ORDER BY rate DESC, area) AS place FROM (
  SELECT area, count(*) FILTER (outcome = 'APPROVED') AS approved, count(*) AS total,
    {pct_sql("count(*) FILTER (outcome = 'APPROVED')", 'count(*)')} AS rate
  FROM event WHERE outcome <> 'DELAYED' GROUP BY 1)""", "event")
def area_rates(spark, sf_dir):
    return placed(S.area_rates(B.events(spark, sf_dir)))


@query(f"""
SELECT r.area, rate, risk, CASE WHEN rate >= 85 THEN 'LOW' WHEN rate >= 75 THEN 'MOD'
  WHEN rate >= 65 THEN 'HIGH' ELSE 'VERY_HIGH' END AS band
FROM (SELECT area, {pct_sql("count(*) FILTER (outcome = 'APPROVED')", 'count(*)')} AS rate
  FROM event WHERE outcome <> 'DELAYED' GROUP BY 1) r LEFT JOIN risk k ON k.area = r.area
""", "event risk")
def area_risk(spark, sf_dir):
    rates = S.area_rates(B.events(spark, sf_dir))
    return S.area_risk(rates, B.risk(spark)).select("area", "rate", "risk", "band")


@query("SELECT DISTINCT area FROM event", "event")
def event_areas(spark, sf_dir):
    return S.areas(B.events(spark, sf_dir))


@query(f"""
SELECT count(*) AS total, count(*) FILTER (tier = 'TIER_1') AS tier_1,
  count(*) FILTER (tier = 'TIER_2') AS tier_2, count(*) FILTER (tier = 'TIER_3') AS tier_3,
  count(*) FILTER (tier = 'TIER_4') AS tier_4,
  count(*) FILTER (tier IN ('TIER_1', 'TIER_2')) AS high_conviction,
  count(*) FILTER (type LIKE 'PDUFA%') AS decisions, count(*) FILTER (type LIKE 'Phase%') AS readouts,
  count(*) FILTER (weekend) AS weekend, round(avg(prob) * 100, 1) AS mean_prob,
  count(*) FILTER ({OUT} BETWEEN 0 AND 7) AS next_7_days,
  (SELECT event_id FROM event WHERE {OUT} BETWEEN 0 AND 7 ORDER BY event_date, event_id LIMIT 1)
    AS next_event
FROM scored""", "scored")
def dashboard_kpis(spark, sf_dir):
    return S.kpis(B.scored(spark, sf_dir), B.AS_OF)


@query(f"""
SELECT t.tier, count(s.event_id) AS n,
  {pct_sql('count(s.event_id)', '(SELECT count(*) FROM scored)')} AS pct
FROM (VALUES ('TIER_1'), ('TIER_2'), ('TIER_3'), ('TIER_4')) t(tier)
  LEFT JOIN scored s ON s.tier = t.tier GROUP BY 1""", "scored")
def tier_distribution(spark, sf_dir):
    return S.tier_distribution(B.scored(spark, sf_dir))


@query("""
SELECT strftime(event_date, '%Y-%m') AS month, count(*) AS n,
  count(*) FILTER (tier = 'TIER_1') AS tier_1 FROM scored GROUP BY 1""", "scored")
def event_calendar(spark, sf_dir):
    return S.calendar(B.scored(spark, sf_dir))


@query("""
SELECT area AS grp, count(*) AS n, round(sum(prob), 4) AS sum_prob,
  round(sum(prob) / (SELECT sum(prob) FROM scored) * 100, 6) AS pct FROM scored GROUP BY 1""", "scored")
def heatmap_by_area(spark, sf_dir):
    groups = S.heatmap(B.scored(spark, sf_dir), "area", "prob")
    return groups.select("grp", "n", r6("sum_prob", places=4), r6("pct"))


@query("""
SELECT CASE WHEN type LIKE 'PDUFA%' THEN 'PDUFA' ELSE type END AS grp, count(*) AS n,
  round(sum(prob), 4) AS sum_prob, round(count(*) * 100.0 / (SELECT count(*) FROM scored), 6) AS pct
FROM scored GROUP BY 1""", "scored")
def heatmap_by_type(spark, sf_dir):
    groups = S.heatmap(B.scored(spark, sf_dir), "type", "equal")
    return groups.select("grp", "n", r6("sum_prob", places=4), r6("pct"))


@query("""
SELECT event_id, tier AS grp, round(prob / (SELECT sum(prob) FROM scored) * 100, 8) AS pct
FROM scored""", "scored")
def heatmap_items(spark, sf_dir):
    scored = cut_lineage(B.scored(spark, sf_dir).select("event_id", "type", "tier", "prob"))
    items = S.heatmap_items(scored, "tier", "prob")
    return items.select("event_id", "grp", r6("pct", places=8))


@query("""
SELECT event_id, lower(company) AS company,
  row_number() OVER (ORDER BY lower(company) DESC NULLS LAST, event_id) AS place
FROM event""", "event")
def sort_by_company(spark, sf_dir):
    ordered = S.sort_events(B.events(spark, sf_dir), "company", descending=True)
    return placed(ordered.select("event_id", F.lower("company").alias("company")))


@query("""
SELECT event_id, CAST(enrollment AS BIGINT) AS enrollment,
  row_number() OVER (ORDER BY enrollment NULLS FIRST, event_id) AS place FROM event""", "event")
def sort_by_enrollment(spark, sf_dir):
    ordered = S.sort_events(B.events(spark, sf_dir), "enrollment")
    return placed(ordered.select("event_id", F.col("enrollment").cast("long")))


@query(f"""
SELECT event_id, CAST(event_date AS VARCHAR) AS event_date,
  greatest((SELECT count(*) FROM event WHERE {OUT} BETWEEN 0 AND 30) - 10, 0) AS remaining
FROM event WHERE {OUT} BETWEEN 0 AND 30 ORDER BY event.event_date, event_id LIMIT 10""", "event")
def next_up(spark, sf_dir):
    return S.next_up(B.events(spark, sf_dir), B.AS_OF).select(
        "event_id", text("event_date"), "remaining"
    )


@query("""
SELECT e.event_id, c.name, date_diff('day', c.abstract_release, e.event_date) AS days_before
FROM event e JOIN conf c ON c.area = e.area
WHERE date_diff('day', c.abstract_release, e.event_date) BETWEEN 0 AND 30""", "event conf")
def conference_overlap(spark, sf_dir):
    found = S.conference_overlap(B.events(spark, sf_dir), B.conferences(spark), 30)
    return found.select("event_id", "name", F.col("days_before").cast("long"))


@query(f"""
WITH d AS (SELECT *, {OUT} AS days_out FROM scored)
SELECT event_id, rule, CAST(priority AS BIGINT) AS priority, days_out FROM (
  SELECT event_id, unnest(list_filter([
    CASE WHEN days_out BETWEEN 0 AND 3 THEN {{'rule': 'BINARY_RISK', 'priority': 110}} END,
    CASE WHEN days_out BETWEEN 4 AND 7 THEN {{'rule': 'EXIT_ALERT', 'priority': 100}} END,
    CASE WHEN days_out BETWEEN 15 AND 25 THEN {{'rule': 'ENTRY_SIGNAL', 'priority': 90}} END,
    CASE WHEN avoid AND days_out > 0 THEN {{'rule': 'AVOID', 'priority': 80}} END,
    CASE WHEN tier = 'TIER_1' AND days_out BETWEEN 1 AND 45
      THEN {{'rule': 'HIGH_CONVICTION', 'priority': 70}} END,
    CASE WHEN weekend AND days_out BETWEEN 1 AND 14 THEN {{'rule': 'WEEKEND_WARN', 'priority': 60}} END],
    lambda x: x IS NOT NULL), recursive := true), days_out FROM d
  UNION ALL
  SELECT event_id, 'PREDICT_PROMPT', 30, days_out FROM d WHERE days_out BETWEEN 1 AND 30
    AND event_id NOT IN (SELECT event_id FROM vote WHERE event_id IS NOT NULL)
  UNION ALL
  SELECT NULL, 'CONFERENCE: ' || name, 40, date_diff('day', {DAY}, abstract_release) FROM conf
  WHERE date_diff('day', {DAY}, abstract_release) BETWEEN 1 AND 60)""", "scored vote conf")
def alert_feed(spark, sf_dir):
    rows = S.feed(
        B.scored(spark, sf_dir), B.conferences(spark), B.votes(spark, sf_dir), B.AS_OF
    )
    return rows.select(
        "event_id", "rule", F.col("priority").cast("long"), F.col("days_out").cast("long")
    )


@query(f"""
SELECT event_id, {zone_sql(OUT)} AS old_zone, {zone_sql(f"{OUT} - 3")} AS new_zone FROM event
WHERE {zone_sql(OUT)} <> {zone_sql(f"{OUT} - 3")}""", "event")
def zone_changes(spark, sf_dir):
    changed = S.zone_changes(B.events(spark, sf_dir), B.AS_OF, "1998-06-18")
    return changed.select("event_id", "old_zone", "new_zone")


@query(f"""
SELECT count(*) FILTER (d AND outcome = 'APPROVED') AS approved,
  count(*) FILTER (d AND outcome = 'CRL') AS rejected,
  count(*) FILTER (d AND outcome = 'DELAYED') AS delayed, count(*) FILTER (NOT d) AS readouts,
  {pct_sql("count(*) FILTER (d AND outcome = 'APPROVED')", "count(*) FILTER (d AND outcome <> 'DELAYED')")}
    AS base_rate
FROM (SELECT *, type LIKE 'PDUFA%' AS d FROM event)""", "event")
def base_rate(spark, sf_dir):
    return S.base_rate(B.events(spark, sf_dir))


@query("""
SELECT event_id, 'BEGIN:VCALENDAR' || chr(13) || chr(10) || 'VERSION:2.0' || chr(13) || chr(10)
  || 'PRODID:-//decisionlab//EN' || chr(13) || chr(10) || 'BEGIN:VEVENT' || chr(13) || chr(10)
  || 'DTSTART;VALUE=DATE:' || strftime(event_date, '%Y%m%d') || chr(13) || chr(10)
  || 'DTEND;VALUE=DATE:' || strftime(event_date, '%Y%m%d') || chr(13) || chr(10)
  || 'SUMMARY:' || type || ': ' || ticker || ' — ' || drug || chr(13) || chr(10)
  || 'DESCRIPTION:' || type || ' for ' || drug || ' (' || company || ')\\nIndication: ' || indication
  || '\\nScore: ' || CAST(round(prob * 100, 1) AS VARCHAR) || '% (' || replace(tier, '_', ' ')
  || ')\\nTA: ' || area || chr(13) || chr(10) || 'END:VEVENT' || chr(13) || chr(10)
  || 'END:VCALENDAR' AS "text"
FROM scored""", "scored")
def calendar_feed(spark, sf_dir):
    return documents.calendar_text(B.scored(spark, sf_dir)).select("event_id", "text")


@query("""
SELECT event_id, list_filter(signals, lambda x: x IN ('BTD', 'orphan', 'priority_review'))[1] AS first,
  len(list_filter(signals, lambda x: x IN ('BTD', 'orphan', 'priority_review'))) AS n
FROM flags""", "flags")
def event_designations(spark, sf_dir):
    short = C.short_designations("designations")
    return B.signal_events(spark, sf_dir).select(
        "event_id", F.get(short, F.lit(0)).alias("first"), F.size(short).cast("long").alias("n")
    )


@query("""
SELECT event_id, ticker, first_day, last_day, precision, approx FROM (
  SELECT o_orderkey AS event_id, CAST(o_custkey AS VARCHAR) AS ticker,
    CAST(CASE WHEN k IN (2, 3) THEN date_trunc('month', d) WHEN k = 4 THEN date_trunc('quarter', d)
      ELSE d END AS DATE)::VARCHAR AS first_day,
    CAST(CASE WHEN k IN (2, 3) THEN last_day(d)
      WHEN k = 4 THEN date_trunc('quarter', d) + INTERVAL 3 MONTH - INTERVAL 1 DAY
      ELSE d END AS DATE)::VARCHAR AS last_day,
    CASE WHEN k IN (2, 3) THEN 'month' WHEN k = 4 THEN 'quarter' ELSE 'day' END AS precision,
    k = 3 AS approx
  FROM (SELECT *, CAST(o_orderdate AS DATE) AS d, o_orderkey % 6 AS k FROM orders)
  UNION ALL
  SELECT o_orderkey, CAST(o_custkey + 1 AS VARCHAR),
    CAST(CASE WHEN k = 3 THEN date_trunc('month', d) ELSE d END AS DATE)::VARCHAR,
    CAST(CASE WHEN k = 3 THEN last_day(d) ELSE d END AS DATE)::VARCHAR,
    CASE WHEN k = 3 THEN 'month' ELSE 'day' END, k = 3
  FROM (SELECT *, CAST(o_orderdate AS DATE) AS d, o_orderkey % 6 AS k FROM orders)
  WHERE o_orderkey % 3 = 0)""")
def universe_dates(spark, sf_dir):
    rows = documents.read_universe(B.universe(spark, sf_dir))
    return rows.select(
        "event_id", "ticker",
        text("scheduled_span.first", "first_day"),
        text("scheduled_span.last", "last_day"),
        F.col("scheduled_span.precision").alias("precision"),
        F.col("scheduled_span.approx").alias("approx"),
    )
