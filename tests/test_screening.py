from datetime import date, timedelta

import pytest
from helpers import rows
from pyspark.sql import functions as F

from decisionlab import dims
from decisionlab.functions import columns as C
from decisionlab.operators import screening as S

AS_OF = "2026-01-05"  # a Monday


def at(days):
    return date.fromisoformat(AS_OF) + timedelta(days=days)


COLS = (
    "event_id long, ticker string, company string, drug string, area string, event_date date, "
    "type string, phase string, outcome string, enrollment int, modality string, weekend boolean, "
    "avoid boolean, area_risk string, signals array<string>, designations array<string>, "
    "tier string, prob double"
)


def event(i, days, **kw):
    day = at(days)
    base = {
        "event_id": i, "ticker": f"T{i}", "company": f"Co {i}", "drug": f"Drug{i}", "area": "CNS",
        "event_date": day, "type": "PDUFA", "phase": "Phase 3", "outcome": None,
        "enrollment": 500, "modality": None, "weekend": day.weekday() >= 5, "avoid": False,
        "area_risk": "MOD_RISK", "signals": [], "designations": [], "tier": "TIER_2", "prob": 0.8,
    }
    return tuple((base | kw).values())


def test_zones(spark):
    want = {
        -1: ("EXPIRED", 100), 0: ("DANGER", 95), 3: ("DANGER", 95), 4: ("EXIT", 85), 7: ("EXIT", 85),
        8: ("PEAK", 70), 14: ("PEAK", 70), 15: ("OPTIMAL", 45), 25: ("OPTIMAL", 45),
        26: ("EARLY", 20), 45: ("EARLY", 20), 46: ("FAR", 5),
    }
    df = spark.createDataFrame([event(i, d) for i, d in enumerate(want)], COLS)
    got = {r.days_out: (r.zone, r.progress) for r in S.window_zone(df, AS_OF).collect()}
    assert got == want
    ahead = S.scanner(df, AS_OF).collect()
    assert [r.days_out for r in ahead] == sorted(d for d in want if d >= 0)


def test_screen(spark):
    df = spark.createDataFrame([
        event(1, 5, area=None, drug="Alpha"), event(2, 6, type="Phase 3 Readout", company="ALPHA inc"),
        event(3, 7, tier="TIER_1", ticker=None),
    ], COLS)
    assert rows(S.screen(df, text="alpha"), "event_id") == [(1,), (2,)]
    assert rows(S.screen(df, text="alpha", kind="readout"), "event_id") == [(2,)]
    assert rows(S.screen(df, tier="TIER_1", area="CNS"), "event_id") == [(3,)]
    watch = spark.createDataFrame([("u", 2), ("v", 2), ("u", 9)], "user string, event_id long")
    assert rows(S.screen(df, watch=watch), "event_id") == [(2,)]
    assert rows(S.missing_from(df, watch, "event_id"), "event_id") == [(1,), (3,)]


def test_within_days_is_pushed_to_the_scan(spark, tmp_path):
    df = spark.createDataFrame([event(i, d) for i, d in enumerate([-1, 0, 7, 8])], COLS)
    df.write.parquet(str(tmp_path / "e"))
    found = S.within_days(spark.read.parquet(str(tmp_path / "e")), AS_OF, 7)
    assert rows(found, "event_id") == [(1,), (2,)]
    assert "GreaterThanOrEqual(event_date" in found._jdf.queryExecution().executedPlan().toString()


def test_warnings(spark):
    df = spark.createDataFrame([
        event(1, 2, tier="TIER_4", area_risk="HIGH_RISK", avoid=True, enrollment=99,
              modality="Gene Therapy", signals=["inexperienced_sponsor"]),
        event(2, 5, enrollment=0, modality="Biologic"),
        event(3, 30, enrollment=100),
    ], COLS)
    got = rows(S.warnings(df, AS_OF, dims.modality_table(spark)), "event_id", "label")
    assert [x for x in got if x[0] == 1] == [(1, x) for x in sorted([
        "High Risk", "High TA Risk", "Avoid", "First-Time Sponsor", "Small Trial", "CMC Risk",
        "Binary Risk Zone",
    ])]
    assert at(5).weekday() == 5
    assert [x for x in got if x[0] > 1] == [(2, "T-7 Exit Zone"), (2, "Weekend Decision")]


def test_radar(spark):
    df = spark.createDataFrame([
        event(1, 1, designations=["a"] * 5, enrollment=501, area="Oncology", prob=1.0),
        event(2, 1, area=None, phase="NDA", enrollment=101),
    ], COLS).withColumn(
        "signal_weights",
        F.when(F.col("event_id") == 1, F.array(F.lit(-1.0), F.lit(2.0), F.lit(3.0), F.lit(-4.0)))
        .otherwise(F.array().cast("array<double>")),
    )
    got = {(r.event_id, r.axis): r.value for r in S.radar(df, dims.area_rates_table(spark)).collect()}
    assert got[1, "approval"] == 100 and got[1, "designations"] == 100
    assert got[1, "area_history"] == 87.2 and got[1, "clinical"] == 90 and got[1, "risk"] == 50
    assert got[2, "area_history"] == 50 and got[2, "clinical"] == 30 and got[2, "risk"] == 50
    assert got[2, "designations"] == 0


def test_feed(spark):
    df = spark.createDataFrame([
        event(1, 2, tier="TIER_1"), event(2, 6, avoid=True), event(3, 20), event(4, 40, tier="TIER_1"),
        event(5, -3, avoid=True, tier="TIER_1"), event(6, 0),
    ], COLS)
    conf = dims.conferences_table(spark)
    called = spark.createDataFrame([(3,), (3,), (99,)], "event_id long")
    got = [(r.event_id, r.rule, r.priority) for r in S.feed(df, conf, called, AS_OF).collect()]
    assert [p for *_, p in got] == sorted((p for *_, p in got), reverse=True)
    weekend = [(i, "WEEKEND_WARN", 60) for i, d in ((1, 2), (2, 6)) if at(d).weekday() >= 5]
    assert sorted(got, key=repr) == sorted([
        (1, "BINARY_RISK", 110), (6, "BINARY_RISK", 110), (2, "EXIT_ALERT", 100), (3, "ENTRY_SIGNAL", 90),
        (2, "AVOID", 80), (1, "HIGH_CONVICTION", 70), (4, "HIGH_CONVICTION", 70),
        (1, "PREDICT_PROMPT", 30), (2, "PREDICT_PROMPT", 30), (None, "CONFERENCE: ASCO GI", 40), *weekend,
    ], key=repr)
    prompts = S.feed(df, conf, None, AS_OF).filter("rule = 'PREDICT_PROMPT'")
    assert rows(prompts, "event_id") == [(1,), (2,), (3,)]


@pytest.mark.parametrize("n", [0, 1, 29, 30, 200])
def test_conference_overlap_against_all_pairs(spark, n):
    df = spark.createDataFrame(
        [event(i, i * 3 - 40, area=["Oncology", "CNS", None][i % 3]) for i in range(120)], COLS
    )
    conf = dims.conferences_table(spark)
    pairs = df.alias("e").join(conf.alias("c"), F.col("e.area") == F.col("c.area")).filter(
        F.datediff("event_date", "abstract_release").between(0, n)
    )
    got = S.conference_overlap(df, conf, n)
    assert rows(got, "event_id", "name") == rows(pairs, "event_id", "name")


def test_tier_distribution_keeps_empty_tiers(spark):
    df = spark.createDataFrame([event(1, 1), event(2, 1), event(3, 1, tier="TIER_4")], COLS)
    assert rows(S.tier_distribution(df)) == [
        ("TIER_1", 0, 0.0), ("TIER_2", 2, 66.7), ("TIER_3", 0, 0.0), ("TIER_4", 1, 33.3)
    ]


def test_area_tables(spark):
    rates = dims.area_rates_table(spark)
    assert rates.count() == 17
    total = rates.agg(F.sum("approved").alias("a"), F.sum("total").alias("t")).first()
    assert (total.a, total.t) == (373, 456)
    checked = rates.withColumn("again", C.ratio_pct("approved", "total"))
    assert checked.filter(F.col("again") != F.col("rate")).count() == 0
    risk = S.area_risk(rates, dims.area_risk_table(spark))
    assert {r.area: (r.risk, r.band) for r in risk.collect()}["Pain Management"] == (None, "VERY_HIGH")
    df = spark.createDataFrame([event(1, 1), event(2, 1, area="Nowhere"), event(3, 1, area=None)], COLS)
    active = {r.area: r.active for r in S.area_activity(rates, df).collect()}
    assert len(active) == 17 and active["CNS"] == 1 and active["Oncology"] == 0


def test_kpis_and_next(spark):
    df = spark.createDataFrame([event(i, d) for i, d in enumerate([9, 3, 3, -2, 29, 31])], COLS)
    k = S.kpis(df, AS_OF).first()
    assert (k.total, k.next_7_days, k.next_event, k.mean_prob) == (6, 2, 1, 80.0)
    up = S.next_up(df, AS_OF, 30, 3).collect()
    assert [(r.event_id, r.remaining) for r in up] == [(1, 1), (2, 1), (0, 1)]


def test_base_rate(spark):
    data = [("PDUFA", "APPROVED")] * 23 + [("PDUFA (Expected)", "CRL")] * 8 + [
        ("PDUFA", "DELAYED"), ("Phase 3 Readout", "POSITIVE")]
    got = S.base_rate(spark.createDataFrame(data, "type string, outcome string")).first()
    assert (got.approved, got.rejected, got.delayed, got.readouts, got.base_rate) == (23, 8, 1, 1, 74.2)


def test_heatmap_equal_shares(spark):
    df = spark.createDataFrame([event(1, 1, prob=0.2), event(2, 1, prob=0.6, area="X")], COLS)
    assert rows(S.heatmap_items(df, size_by="equal"), "pct") == [(50.0,), (50.0,)]
    assert rows(S.heatmap(df), "grp", "n") == [("CNS", 1), ("X", 1)]
    assert [r.grp for r in S.heatmap(df).collect()] == ["X", "CNS"]
    none = df.withColumn("prob", F.lit(0.0))
    assert rows(S.heatmap(none), "pct") == [(None,), (None,)]
    assert rows(S.heatmap_items(none), "pct") == [(None,), (None,)]


@pytest.mark.parametrize("after", [AS_OF, "2026-01-08", "2026-02-20", "2025-12-01"])
def test_zone_changes_against_every_event(spark, after):
    df = spark.createDataFrame([event(i, d) for i, d in enumerate(range(-60, 120))], COLS)
    days = {r.event_id: r.event_date for r in df.collect()}

    def zone_of(day, as_of):
        out = (day - date.fromisoformat(as_of)).days
        if out < 0:
            return "EXPIRED"
        return next((name for last, name, _ in dims.WINDOW_ZONES if out <= last), "FAR")

    want = sorted(
        ((i, zone_of(d, AS_OF), zone_of(d, after)) for i, d in days.items()), key=repr
    )
    got = rows(S.zone_changes(df, AS_OF, after), "event_id", "old_zone", "new_zone")
    assert got == [x for x in want if x[1] != x[2]]


def test_area_rates_golden(spark):
    """Every stored rate follows from its own counts; 373 of 456 in all."""
    history = [
        (area, "APPROVED" if i < approved else "CRL")
        for area, (approved, total, _) in dims.AREA_RATES.items()
        for i in range(total)
    ]
    got = S.area_rates(spark.createDataFrame(history, "area string, outcome string")).collect()
    assert {r.area: (r.approved, r.total, r.rate) for r in got} == dims.AREA_RATES
    assert len(got) == 17 and (sum(r.approved for r in got), sum(r.total for r in got)) == (373, 456)
    assert [r.rate for r in got] == sorted((r.rate for r in got), reverse=True)
