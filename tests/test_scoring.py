from decimal import Decimal

import pytest
from helpers import GOLDEN_CHANGES, golden_backtest, rows
from pyspark.sql import functions as F

from decisionlab import dims
from decisionlab.functions import columns as C
from decisionlab.operators import scoring as S
from decisionlab.sources.events import explode_signals, load_weights


@pytest.fixture(scope="module")
def golden(spark):
    data = [(t, o, s) for t, o, s, *_ in golden_backtest()]
    assert len(data) == 22
    return spark.createDataFrame(data, "event_id string, outcome string, signals array<string>")


def test_golden_scores(spark, golden):
    scored = S.score(golden, dims.weights_table(spark, "v10_68"))
    got = {r.event_id: r for r in scored.collect()}
    for ticker, _, _, adj, prob, tier, *_ in golden_backtest():
        assert got[ticker].total_adj == pytest.approx(adj, abs=1e-9)
        assert round(got[ticker].prob, 4) == pytest.approx(prob, abs=1e-9)
        assert got[ticker].tier == tier


def test_golden_backtest(spark, golden):
    w68, w69 = dims.weights_table(spark, "v10_68"), dims.weights_table(spark, "v10_69")
    changes = [
        (t, op, s)
        for t, (dropped, added) in GOLDEN_CHANGES.items()
        for op, names in (("drop", dropped), ("set", added))
        for s in names
    ]
    overrides = spark.createDataFrame(changes, "event_id string, op string, signal string")
    moved = S.apply_overrides(explode_signals(golden), overrides, w68, w69)
    a, b = S.score(golden, w68), S.score(golden, signals=moved)
    backtest = S.ab_backtest(S.ab_join(a, b))
    got = {r.event_id: r for r in backtest.collect()}
    for ticker, _, _, _, _, _, p69, tier69, change in golden_backtest():
        assert round(got[ticker].prob_b, 4) == pytest.approx(p69, abs=1e-9)
        assert (got[ticker].tier_b, got[ticker].change) == (tier69, change)
    total = S.ab_summary(backtest).first()
    assert (total.total, total.correct_a, total.correct_b) == (22, 17, 21)
    assert (total.fixed, total.regressed, total.stable, total.still_wrong) == (4, 0, 17, 1)
    assert (total.accuracy_a, total.accuracy_b, total.gate_passed) == (77.3, 95.5, True)
    gap = S.separation(a).first()
    assert round(gap.mean_approved, 3) == 0.771
    assert round(gap.mean_rejected, 3) == 0.485
    assert round(gap.gap_pp, 1) == 28.6


def test_whole_version_move_differs_from_overrides(spark, golden):
    scored = S.score(golden, dims.weights_table(spark, "v10_69"))
    bhvn = scored.filter(F.col("event_id") == "BHVN").first()
    assert round(bhvn.prob, 4) == 0.3654


def test_version_against_itself_is_stable(spark, golden):
    w = dims.weights_table(spark)
    kinds = {r.change for r in S.ab_backtest(S.score_both(golden, w, w)).collect()}
    assert kinds <= {"STABLE", "STILL WRONG"}


def test_score_both_agrees_with_join(spark, golden):
    w68, w69 = dims.weights_table(spark, "v10_68"), dims.weights_table(spark, "v10_69")
    cols = ["event_id", "prob_a", "prob_b", "tier_a", "tier_b", "correct_a", "correct_b"]
    joined = S.ab_join(S.score(golden, w68), S.score(golden, w69))
    assert rows(S.score_both(golden, w68, w69), *cols) == rows(joined, *cols)


def test_weight_versions(spark):
    assert dims.weights_table(spark, "v10_68").count() == 50
    v69 = {r.signal: r.weight for r in dims.weights_table(spark, "v10_69").collect()}
    assert len(v69) == 62
    assert v69["safety_signal_liver"] == Decimal("-0.6") and v69["BTD"] == Decimal("0.1676")


def test_inherited_weights(spark):
    cols = "version string, signal string, category string, weight decimal(12,6)"
    base = spark.createDataFrame([("a", "x", "c", Decimal(1)), ("a", "y", "c", Decimal(2))], cols)
    over = spark.createDataFrame([("b", "y", "c", Decimal(5)), ("b", "z", "c", Decimal(7))], cols)
    merged = load_weights(base, over, "b")
    assert rows(merged, "version", "signal", "weight") == [
        ("b", "x", Decimal(1)), ("b", "y", Decimal(5)), ("b", "z", Decimal(7))
    ]


def test_no_signals_scores_the_base(spark):
    df = spark.createDataFrame([("a", []), ("b", None)], "event_id string, signals array<string>")
    for r in S.score(df, dims.weights_table(spark)).collect():
        assert r.total_adj == 0 and r.prob == pytest.approx(0.8015, abs=1e-5)
    steps = S.waterfall(df, dims.weights_table(spark))
    assert rows(steps, "event_id", "step") == [("a", "base"), ("b", "base")]


def test_recorded_weights_need_no_table(spark):
    df = spark.createDataFrame(
        [("a", {"x": Decimal("0.5"), "y": Decimal("-0.25")})],
        "event_id string, signals map<string,decimal(12,6)>",
    )
    assert S.score(df).first().total_adj == 0.25
    long = explode_signals(df)
    assert S.score(df.drop("signals"), signals=long).first().total_adj == 0.25
    assert rows(long, "pos", "signal") == [(0, "x"), (1, "y")]


def test_score_does_not_depend_on_order(spark, golden):
    w = dims.weights_table(spark)
    want = rows(S.score(golden, w), "event_id", "prob")
    long = explode_signals(golden).repartition(7, "signal").orderBy(F.desc("signal"))
    assert rows(S.score(golden.drop("signals"), w, long), "event_id", "prob") == want


@pytest.mark.parametrize("prob,tier", [
    (0.85, "TIER_2"), (0.8500001, "TIER_1"), (0.70, "TIER_2"), (0.6999, "TIER_3"),
    (0.60, "TIER_3"), (0.5999, "TIER_4"),
])
def test_tier_bounds(spark, prob, tier):
    row = spark.range(1).select(C.tier(F.lit(prob)).alias("t"), C.action(C.tier(F.lit(prob))).alias("a"))
    assert row.first().t == tier
    want = {"TIER_1": "BUY", "TIER_2": "BUY", "TIER_3": "RUNUP_ONLY", "TIER_4": "AVOID"}[tier]
    assert row.first().a == want


def test_rescore_report(spark, golden):
    stored = golden.withColumn("ticker", F.col("event_id")).join(
        spark.createDataFrame(
            [(t, p, tier, a, a + 1.3957) for t, _, _, a, p, tier, *_ in golden_backtest()],
            "event_id string, stored_prob double, stored_tier string, stored_total_adj double, "
            "stored_logit double",
        ), "event_id",
    )
    stored = stored.withColumn(
        "stored_tier", F.when(F.col("event_id") == "CYTK", "TIER_1").otherwise(F.col("stored_tier"))
    )
    report = S.rescore_report(S.score(stored, dims.weights_table(spark)))
    assert rows(report.filter("mismatch"), "event_id") == [("CYTK",)]
    total = S.rescore_summary(report).first()
    assert (total.total, total.mismatches, total.match_rate) == (22, 1, 95.5)


def test_interactions_and_stack(spark):
    df = spark.createDataFrame([
        ("a", ["inexperienced_sponsor", "ta_very_high_risk", "form_483", "prior_CRL"]),
        ("b", ["experienced_sponsor", "ta_low_risk", "experienced_low_risk"]),
        ("c", ["BTD", "orphan", "priority_review"]),
        ("d", ["BTD", "orphan"]),
    ], "event_id string, signals array<string>")
    assert rows(S.derive_interactions(df)) == [
        ("a", "interaction_inexperienced_mfg"), ("a", "interaction_prior_crl_mfg"),
        ("a", "novice_high_risk_ta"),
    ]
    assert rows(S.derive_stack(df)) == [("c", "designation_stack")]
    assert len(rows(S.derive_stack(df, 2))) == 2


def test_decay_bands(spark):
    df = spark.createDataFrame([
        (1, "x", "2018-03-10", "CRL"), (2, "x", "2020-03-09", "CRL"), (3, "x", "2022-03-09", "APPROVED"),
        (4, "x", "2024-03-09", "APPROVED"), (5, "y", "2020-01-01", "APPROVED"),
    ], "event_id long, drug string, event_date string, outcome string").withColumn(
        "event_date", F.col("event_date").cast("date")
    )
    history = rows(S.prior_history(df), "event_id", "prior_rejections", "years_since", "serial")
    assert history == [
        (1, 0, None, False), (2, 1, 1, False), (3, 2, 2, True), (4, 2, 4, True), (5, 0, None, False)
    ]
    decay = S.decay_signal(df, dims.weights_table(spark, "v10_69"))
    assert rows(decay, "event_id", "signal", "weight") == [
        (2, "crl_time_decay_1yr", Decimal(0)), (3, "crl_time_decay_2yr", Decimal("0.15")),
        (4, "crl_time_decay_4yr_plus", Decimal("0.45")),
    ]


def test_read_events(spark, tmp_path):
    import json

    from decisionlab.sources.events import read_events

    data = [
        {"event_id": "b", "event_date": "2026-02-01", "ticker": "B", "signals": {"x": 0.5, "a": -1.25},
         "designations": ["Orphan Drug"], "enrollment": 12, "weekend": True},
        {"event_id": "a", "event_date": "2026-01-01", "ticker": "A", "signals": {}, "prob": 1},
    ]
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(d) for d in data))
    (tmp_path / "array.json").write_text(json.dumps(data, indent=1))
    lines = read_events(spark, str(tmp_path / "lines.json"), "json")
    assert [r.event_id for r in lines.collect()] == ["a", "b"]
    assert rows(read_events(spark, str(tmp_path / "array.json"), "json", multi_line=True)) == rows(lines)
    lines.write.parquet(str(tmp_path / "p"))
    stored = read_events(spark, str(tmp_path / "p"))
    assert rows(stored) == rows(lines)
    assert rows(explode_signals(stored), "event_id", "pos", "signal", "recorded_weight") == [
        ("b", 0, "x", Decimal("0.500000")), ("b", 1, "a", Decimal("-1.250000"))
    ]
    assert S.score(stored).filter("event_id = 'b'").first().total_adj == -0.75


def test_tier_never_falls_as_probability_rises(spark):
    df = spark.range(1001).select((F.col("id") / 1000).alias("p")).withColumn("t", C.tier("p"))
    tiers = [r.t for r in df.orderBy("p").collect()]
    assert tiers == sorted(tiers, reverse=True) and len(set(tiers)) == 4


def test_shuffled_rows_score_the_same(spark, golden):
    w = dims.weights_table(spark)
    want = rows(S.signal_effects(S.score(golden, w), w))
    assert rows(S.signal_effects(S.score(golden.repartition(6).orderBy(F.rand(3)), w), w)) == want


def test_calibration_and_miss_profile(spark, golden):
    scored = S.score(golden, dims.weights_table(spark))
    bins = {r.bin: (r.n, r.observed) for r in S.calibration(scored, by_tier=True).collect()}
    want = {}
    for _, outcome, _, _, _, tier, *_ in golden_backtest():
        n, hit = want.get(tier, (0, 0))
        want[tier] = (n + 1, hit + (outcome == "APPROVED"))
    assert bins == {t: (n, round(100 * hit / n + 1e-9, 1)) for t, (n, hit) in want.items()}
    profile = S.miss_profile(scored.withColumn("type", F.lit("PDUFA")), dims.weights_table(spark))
    got = {r.error: (r.misses, r.top_negative) for r in profile.collect()}
    assert got["FALSE NEGATIVE"] == (3, "prior_CRL") and got["FALSE POSITIVE"][0] == 2


def test_thousands_of_weights(spark):
    """One path at any size; a repeated signal counts with its last version."""
    rows_ = [("v1", f"s{i}", "c", Decimal(i % 7 - 3) / 10) for i in range(5000)]
    rows_ += [("v2", "s9", "c", Decimal("1.5")), ("v0", "s9", "c", Decimal("9"))]
    weights = spark.createDataFrame(rows_, "version string, signal string, category string, weight decimal(6,4)")
    events = spark.createDataFrame(
        [(1, ["s9", "s4999"]), (2, ["none"]), (3, None), (4, [f"s{i}" for i in range(60)])],
        "event_id long, signals array<string>",
    )
    known = {s: w for v, s, _, w in rows_ if v == "v1"} | {"s9": Decimal("1.5")}
    want = {
        1: known["s9"] + known["s4999"], 2: 0, 3: 0, 4: sum(known[f"s{i}"] for i in range(60)),
    }
    got = {r.event_id: r.total_adj for r in S.score(events, weights).collect()}
    assert got == {k: pytest.approx(float(v)) for k, v in want.items()}
    long = events.select("event_id", F.explode("signals").alias("signal"))
    got = {r.event_id: r.total_adj for r in S.score(events, weights, long).collect()}
    assert got == {k: pytest.approx(float(v)) for k, v in want.items()}
    steps = S.waterfall(events.filter("event_id = 4"), weights).orderBy("pos").collect()
    assert len(steps) == 61 and steps[0].step == "base"
    assert steps[-1].cumulative_logit == pytest.approx(float(want[4]) + steps[0].value)
    assert S.signal_effects(
        S.score(events, weights).withColumn("outcome", F.lit("APPROVED")), weights
    ).filter("signal = 's9'").first().n == 2


def test_a_large_weight_table(spark):
    """100,000 weights, most events with one of two lists, names without weight, empty and null lists."""
    weights = spark.range(100_000).select(
        F.concat(F.lit("s"), F.col("id").cast("string")).alias("signal"), F.lit("c").alias("category"),
        ((F.col("id") % 1000 - 500) / 1000).cast("decimal(12,6)").alias("weight"),
    )
    lists = [["s1", "s99999", "none"], ["s7"], [], None, ["s7", "s7", "s500"]]
    rows = [(i, lists[0] if i % 3 else lists[i % 5]) for i in range(300)]
    events = spark.createDataFrame(rows, "event_id long, signals array<string>")
    one = {"s1": -499_000, "s99999": 499_000, "none": 0, "s7": -493_000, "s500": 0}
    got = {r.event_id: r.signal_weights for r in S.with_weights(events, weights).collect()}
    assert got == {i: [one[s] for s in names or []] for i, names in rows}
    scored = {r.event_id: r.total_adj for r in S.score(events, weights).collect()}
    assert scored == {i: pytest.approx(sum(one[s] for s in names or []) / 1e6) for i, names in rows}
    steps = S.waterfall(events, weights).groupBy("event_id").agg(F.count("*").alias("n"), F.max_by("cumulative_logit", "pos").alias("last"))
    base = S.BASE / 1e6
    assert {r.event_id: (r.n, r.last) for r in steps.collect()} == {
        i: (1 + len(names or []), pytest.approx(base + sum(one[s] for s in names or []) / 1e6)) for i, names in rows
    }
    plan = S.score(events, weights)._jdf.queryExecution().executedPlan().toString()
    assert "Subquery" not in plan and "collect_list" in plan
