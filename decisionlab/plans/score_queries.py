"""Queries over scores: rescoring, backtests, signal effects and histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from decisionlab import dims
from decisionlab.functions import columns as C
from decisionlab.operators import ledger as ledger_ops
from decisionlab.operators import scoring as S
from decisionlab.operators.ordered import placed
from decisionlab.plans import bindings as B
from decisionlab.plans.oracle_views import correct_sql, kind_sql, pct_sql
from decisionlab.plans.registry import query, r6, text
from decisionlab.sources import documents, events

ERROR_SQL = f"""CASE WHEN NOT ({correct_sql('prob', 'outcome')}) THEN
  CASE WHEN outcome = 'APPROVED' THEN 'FALSE NEGATIVE' ELSE 'FALSE POSITIVE' END END"""


@query(f"""
SELECT coalesce(area, 'all') AS area, coalesce(tier, 'all') AS tier, count(*) AS total,
  count(*) FILTER (correct) AS correct, {pct_sql('count(*) FILTER (correct)', 'count(*)')} AS accuracy
FROM (SELECT area, tier, {correct_sql('prob', 'outcome')} AS correct FROM scored)
WHERE correct IS NOT NULL GROUP BY CUBE (area, tier)""", "scored")
def accuracy_by_area_and_tier(spark, sf_dir):
    decided = B.scored(spark, sf_dir).withColumn(
        "correct", C.is_correct("prob", "outcome")
    ).filter(F.col("correct").isNotNull())
    cube = ledger_ops.accuracy_cube(decided.select("area", "tier", "correct"), "area", "tier")
    whole = F.lit("all")
    return cube.select(
        F.coalesce("area", whole).alias("area"), F.coalesce("tier", whole).alias("tier"),
        "total", "correct", "accuracy",
    )


@query("""
SELECT event_id, ticker, company, drug, indication, CAST(event_date AS VARCHAR) AS event_date,
  type, area, phase, outcome, enrollment, modality, weekend, avoid, area_risk,
  row_number() OVER (ORDER BY event.event_date, event_id) AS place
FROM event""", "event")
def load_events(spark, sf_dir):
    loaded = placed(events.sort_by_date(B.events(spark, sf_dir)))
    return loaded.select(
        "event_id", "ticker", "company", "drug", "indication", text("event_date"), "type", "area",
        "phase", "outcome", F.col("enrollment").cast("long"), "modality", "weekend", "avoid",
        "area_risk", "place",
    )


@query("SELECT event_id, CAST(pos AS BIGINT) AS pos, signal FROM signal", "signal")
def explode_signals(spark, sf_dir):
    long = events.explode_signals(B.signal_events(spark, sf_dir))
    return long.select("event_id", F.col("pos").cast("long"), "signal")


@query("SELECT DISTINCT signal FROM signal", "signal")
def distinct_signals(spark, sf_dir):
    return events.distinct_signals(B.signal_events(spark, sf_dir))


@query("SELECT event_id, array_to_string(signals, ',') AS signals FROM flags WHERE len(signals) > 0", "flags")
def nested_signals(spark, sf_dir):
    nested = S.nest_signals(B.signals(spark, sf_dir))
    return nested.select("event_id", F.array_join("signals", ",").alias("signals"))


SCORE_SQL = """
SELECT event_id, round(total_adj, 4) AS total_adj, round(logit, 4) AS logit,
  round(prob, 6) AS prob, tier, action FROM scored"""


def _scores(df):
    return df.select(
        "event_id", r6("total_adj", places=4), r6("logit", places=4), r6("prob"), "tier", "action"
    )


@query(SCORE_SQL, "scored")
def score_events(spark, sf_dir):
    return _scores(B.scored(spark, sf_dir))


@query(SCORE_SQL, "scored")
def score_long_signals(spark, sf_dir):
    """The same scores from a long signal table, by join and grouped sum."""
    scored = S.score(
        B.events(spark, sf_dir), dims.weights_table(spark), signals=B.signals(spark, sf_dir)
    )
    return _scores(scored)


@query("""
SELECT event_id, tier,
  CASE tier WHEN 'TIER_3' THEN 'SMALL_POSITION_EARLY_EXIT' WHEN 'TIER_4' THEN 'NO_POSITION'
    ELSE 'STANDARD_POSITION' END AS position,
  CASE tier WHEN 'TIER_4' THEN 'N/A' ELSE 'T-5 to T-7' END AS exit_window,
  CASE tier WHEN 'TIER_4' THEN '0%' ELSE '20%' END AS runner
FROM scored""", "scored")
def position_policy(spark, sf_dir):
    scored = B.scored(spark, sf_dir)
    return scored.withColumn("p", C.position_policy("tier")).select("event_id", "tier", "p.*")


@query("""
SELECT event_id, pos, step, round(value, 6) AS value,
  round(cumulative, 6) AS cumulative_logit, round(1 / (1 + exp(-cumulative)), 6) AS cumulative_prob,
  round(abs(value) / greatest(max(abs(value)) OVER (PARTITION BY event_id), 1) * 60, 6) AS bar_width
FROM (
  SELECT event_id, pos, step, CAST(value AS DOUBLE) AS value,
    CAST(sum(value) OVER (PARTITION BY event_id ORDER BY pos) AS DOUBLE) AS cumulative
  FROM (
    SELECT o_orderkey AS event_id, 0 AS pos, 'base' AS step, CAST(1.3957 AS DECIMAL(12,6)) AS value
    FROM orders
    UNION ALL
    SELECT s.event_id, s.pos + 1, s.signal, w.weight FROM signal s JOIN w68 w ON w.signal = s.signal))
""", "signal w68")
def score_waterfall(spark, sf_dir):
    steps = S.waterfall(B.signal_events(spark, sf_dir), dims.weights_table(spark))
    return steps.select(
        "event_id", F.col("pos").cast("long"), "step", r6("value"), r6("cumulative_logit"),
        r6("cumulative_prob"), r6("bar_width"),
    )


OVERRIDE_SQL = """
  SELECT event_id, 'drop' AS op, 'prior_CRL' AS signal FROM flags
  WHERE list_has_all(signals, ['prior_CRL', 'form_483'])
  UNION ALL
  SELECT event_id, 'set', 'prior_CRL_cmc_only' FROM flags
  WHERE list_has_all(signals, ['prior_CRL', 'form_483'])
  UNION ALL
  SELECT event_id, 'set', 'resubmission_post_CRL' FROM flags
  WHERE list_has_all(signals, ['resubmission_post_CRL', 'experienced_sponsor'])"""

MOVED_SQL = f"""
  SELECT s.event_id, s.signal, w.weight FROM signal s JOIN w68 w ON w.signal = s.signal
  WHERE NOT EXISTS (SELECT 1 FROM ({OVERRIDE_SQL}) o
    WHERE o.event_id = s.event_id AND o.signal = s.signal)
  UNION ALL
  SELECT o.event_id, o.signal, w.weight FROM ({OVERRIDE_SQL}) o JOIN w69 w ON w.signal = o.signal
  WHERE o.op = 'set'"""


def _moved(spark, sf_dir):
    return S.apply_overrides(
        B.signals(spark, sf_dir), B.overrides(spark, sf_dir),
        dims.weights_table(spark, "v10_68"), dims.weights_table(spark, "v10_69"),
    )


@query(f"""
SELECT event_id, signal, CAST(weight AS DOUBLE) AS weight FROM ({MOVED_SQL})""", "signal w68 w69")
def override_signals(spark, sf_dir):
    return _moved(spark, sf_dir).select(
        "event_id", "signal", F.col("recorded_weight").cast("double").alias("weight")
    )


@query("""
SELECT event_id, round(abs(prob - stored_prob), 6) AS prob_diff,
  round(abs(total_adj - stored_total_adj), 4) AS adj_diff,
  round(abs(logit - stored_logit), 4) AS logit_diff, stored_tier, tier,
  stored_tier = tier AS tier_match,
  stored_tier <> tier OR abs(prob - stored_prob) > 0.005 AS mismatch
FROM scored""", "scored")
def rescore_report(spark, sf_dir):
    report = S.rescore_report(B.scored(spark, sf_dir))
    return report.select(
        "event_id", r6("prob_diff"), r6("adj_diff", places=4), r6("logit_diff", places=4),
        "stored_tier", "tier", "tier_match", "mismatch",
    )


@query(f"""
SELECT count(*) AS total, count(*) FILTER (bad) AS mismatches,
  count(*) FILTER (stored_tier <> tier) AS tier_changes,
  {pct_sql('count(*) FILTER (NOT bad)', 'count(*)')} AS match_rate
FROM (SELECT *, stored_tier <> tier OR abs(prob - stored_prob) > 0.005 AS bad FROM scored)
""", "scored")
def rescore_summary(spark, sf_dir):
    return S.rescore_summary(S.rescore_report(B.scored(spark, sf_dir)))


AB_SQL = f"""
  SELECT *, CASE WHEN NOT correct_a AND correct_b THEN 'FIXED'
    WHEN correct_a AND NOT correct_b THEN 'REGRESSED'
    WHEN correct_a AND correct_b THEN 'STABLE' ELSE 'STILL WRONG' END AS change
  FROM (SELECT a.event_id, a.prob AS prob_a, b.prob AS prob_b, a.tier AS tier_a, b.tier AS tier_b,
      {correct_sql('a.prob', 'a.outcome')} AS correct_a,
      {correct_sql('b.prob', 'b.outcome')} AS correct_b
    FROM scored a JOIN scored69 b USING (event_id) WHERE a.outcome <> 'DELAYED')"""


def _backtest(spark, sf_dir):
    return S.ab_backtest(S.score_both(
        B.signal_events(spark, sf_dir),
        dims.weights_table(spark, "v10_68"), dims.weights_table(spark, "v10_69"),
    ))


@query(f"""
SELECT event_id, tier_a, tier_b, correct_a, correct_b, change,
  round((prob_b - prob_a) * 100, 1) AS delta_pp FROM ({AB_SQL})""", "scored scored69")
def ab_backtest(spark, sf_dir):
    return _backtest(spark, sf_dir).select(
        "event_id", "tier_a", "tier_b", "correct_a", "correct_b", "change", "delta_pp"
    )


@query(f"""
SELECT event_id, change, round((prob_b - prob_a) * 100, 1) AS delta_pp FROM ({AB_SQL})
""", "scored scored69")
def ab_backtest_joined(spark, sf_dir):
    """The same backtest from two separately scored tables."""
    both = S.ab_join(B.scored(spark, sf_dir, "v10_68"), B.scored(spark, sf_dir, "v10_69"))
    return S.ab_backtest(both).select("event_id", "change", "delta_pp")


@query(f"""
SELECT count(*) AS total, count(*) FILTER (correct_a) AS correct_a,
  count(*) FILTER (correct_b) AS correct_b,
  {pct_sql('count(*) FILTER (correct_a)', 'count(*)')} AS accuracy_a,
  {pct_sql('count(*) FILTER (correct_b)', 'count(*)')} AS accuracy_b,
  count(*) FILTER (change = 'FIXED') AS fixed, count(*) FILTER (change = 'REGRESSED') AS regressed,
  count(*) FILTER (change = 'STABLE') AS stable,
  count(*) FILTER (change = 'STILL WRONG') AS still_wrong,
  count(*) FILTER (change = 'REGRESSED') = 0 AS gate_passed
FROM ({AB_SQL})""", "scored scored69")
def ab_summary(spark, sf_dir):
    return S.ab_summary(_backtest(spark, sf_dir))


@query(f"""
SELECT event_id, round(p, 6) AS prob FROM (
  SELECT e.event_id, 1 / (1 + exp(-CAST(1.3957 + coalesce(sum(m.weight), 0) AS DOUBLE))) AS p
  FROM event e LEFT JOIN ({MOVED_SQL}) m ON m.event_id = e.event_id GROUP BY 1)
""", "event signal w68 w69")
def score_overrides(spark, sf_dir):
    """Scores where only the named signals moved to the new version."""
    scored = S.score(B.events(spark, sf_dir), signals=_moved(spark, sf_dir))
    return scored.select("event_id", r6("prob"))


@query("""
SELECT e.event_id, e.ticker, round((e.stored_prob - o.orig_score) * 100, 6) AS drift_pp,
  CASE WHEN e.stored_prob > o.orig_score THEN 'UP' WHEN e.stored_prob < o.orig_score THEN 'DOWN'
    ELSE 'SAME' END AS direction,
  abs((e.stored_prob - o.orig_score) * 100) > 10 AS significant,
  CASE o.action WHEN 'TRADED' THEN e.prob >= 0.6 ELSE e.prob < 0.6 END AS direction_correct
FROM scored e JOIN orig o ON o.ticker = e.ticker""", "scored orig")
def score_drift(spark, sf_dir):
    drift = S.score_drift(B.scored(spark, sf_dir), B.originals(spark, sf_dir))
    return drift.select(
        "event_id", "ticker", r6("drift_pp"), "direction", "significant", "direction_correct"
    )


@query("""
SELECT event_id, signal FROM (
  SELECT event_id, unnest(list_filter([
    CASE WHEN list_contains(signals, 'inexperienced_sponsor')
      AND list_has_any(signals, ['ta_high_risk', 'ta_very_high_risk']) THEN 'novice_high_risk_ta' END,
    CASE WHEN list_contains(signals, 'inexperienced_sponsor')
      AND list_contains(signals, 'form_483') THEN 'interaction_inexperienced_mfg' END,
    CASE WHEN list_contains(signals, 'prior_CRL')
      AND list_contains(signals, 'form_483') THEN 'interaction_prior_crl_mfg' END,
    CASE WHEN list_contains(signals, 'experienced_sponsor')
      AND list_contains(signals, 'ta_low_risk') THEN 'experienced_low_risk' END],
    lambda x: x IS NOT NULL)) AS signal
  FROM flags)""", "flags")
def derive_interactions(spark, sf_dir):
    return S.derive_interactions(B.signal_events(spark, sf_dir))


@query("""
SELECT event_id, 'designation_stack' AS signal FROM signal
WHERE signal IN ('BTD', 'orphan', 'priority_review') GROUP BY 1 HAVING count(*) >= 3""", "signal")
def derive_stack(spark, sf_dir):
    return S.derive_stack(B.signal_events(spark, sf_dir))


@query("""
SELECT event_id, drug, prior_rejections, CAST(last_rejection AS VARCHAR) AS last_rejection,
  years_since, prior_rejections >= 2 AS serial FROM prior_years""", "prior_years")
def prior_history(spark, sf_dir):
    return S.prior_history(B.events(spark, sf_dir)).select(
        "event_id", "drug", "prior_rejections", text("last_rejection"),
        F.col("years_since").cast("long"), "serial",
    )


@query("""
SELECT p.event_id, p.signal, CAST(w.weight AS DOUBLE) AS weight FROM (
  SELECT event_id, CASE WHEN years_since >= 4 THEN 'crl_time_decay_4yr_plus'
    WHEN years_since >= 3 THEN 'crl_time_decay_3yr' WHEN years_since >= 2 THEN 'crl_time_decay_2yr'
    ELSE 'crl_time_decay_1yr' END AS signal
  FROM prior_years WHERE last_rejection IS NOT NULL) p
LEFT JOIN w69 w ON w.signal = p.signal""", "prior_years w69")
def decay_signals(spark, sf_dir):
    out = S.decay_signal(B.events(spark, sf_dir), dims.weights_table(spark, "v10_69"))
    return out.select("event_id", "signal", F.col("weight").cast("double").alias("weight"))


@query("""
SELECT signal, CASE event_id % 3 WHEN 0 THEN 'EXACT' WHEN 1 THEN 'CONFIRMED' ELSE 'NONE' END
  AS fda_rationale_match, count(*) AS n, CAST(-0.5 AS DOUBLE) AS mean_weight
FROM signal GROUP BY 1, 2""", "signal")
def signal_validation(spark, sf_dir):
    sealed = documents.parse_sealed(B.sealed_documents(spark, sf_dir))
    return S.signal_validation(documents.signal_checks(sealed))


@query(f"""
SELECT s.signal, w.category, count(*) AS n, round(CAST(avg(w.weight) AS DOUBLE), 6) AS mean_weight,
  {pct_sql('count(*) FILTER (correct)', 'count(*)')} AS hit_rate,
  count(*) FILTER (NOT correct) AS misses,
  {pct_sql('count(*) FILTER (NOT correct)', 'any_value(m.n)')} AS miss_share
FROM (SELECT *, {correct_sql('prob', 'outcome')} AS correct FROM scored) e
  JOIN signal s ON s.event_id = e.event_id JOIN w68 w ON w.signal = s.signal
  CROSS JOIN (SELECT count(*) AS n FROM scored WHERE NOT ({correct_sql('prob', 'outcome')})) m
WHERE correct IS NOT NULL GROUP BY 1, 2""", "scored signal w68")
def signal_effects(spark, sf_dir):
    effects = S.signal_effects(B.scored(spark, sf_dir), dims.weights_table(spark))
    return effects.select(
        "signal", "category", "n", r6("mean_weight"), "hit_rate", "misses", "miss_share"
    )


@query(f"""
WITH miss AS (SELECT event_id, {kind_sql('type')} AS kind, {ERROR_SQL} AS error FROM scored),
  part AS (SELECT kind, error, s.signal, sum(w.weight) AS total
    FROM miss JOIN signal s USING (event_id) JOIN w68 w ON w.signal = s.signal
    WHERE error IS NOT NULL GROUP BY 1, 2, 3)
SELECT m.kind, m.error, m.misses,
  (SELECT signal FROM part p WHERE p.kind = m.kind AND p.error = m.error AND total < 0
   ORDER BY total, signal DESC LIMIT 1) AS top_negative,
  (SELECT signal FROM part p WHERE p.kind = m.kind AND p.error = m.error AND total > 0
   ORDER BY total DESC, signal DESC LIMIT 1) AS top_positive
FROM (SELECT kind, error, count(*) AS misses FROM miss WHERE error IS NOT NULL GROUP BY 1, 2) m
""", "scored signal w68")
def miss_profile(spark, sf_dir):
    return S.miss_profile(B.scored(spark, sf_dir), dims.weights_table(spark))


@query("""
SELECT round(avg(prob) FILTER (outcome = 'APPROVED'), 6) AS mean_approved,
  round(avg(prob) FILTER (outcome = 'CRL'), 6) AS mean_rejected,
  round((avg(prob) FILTER (outcome = 'APPROVED') - avg(prob) FILTER (outcome = 'CRL')) * 100, 4)
    AS gap_pp
FROM scored""", "scored")
def score_separation(spark, sf_dir):
    gap = S.separation(B.scored(spark, sf_dir))
    return gap.select(r6("mean_approved"), r6("mean_rejected"), r6("gap_pp", places=4))


@query(f"""
SELECT CAST(least(floor(prob * 10), 9) AS BIGINT) AS bin, count(*) AS n,
  round(avg(prob), 6) AS mean_prob,
  {pct_sql("count(*) FILTER (outcome = 'APPROVED')", 'count(*)')} AS observed
FROM scored WHERE outcome <> 'DELAYED' GROUP BY 1""", "scored")
def calibration(spark, sf_dir):
    return S.calibration(B.scored(spark, sf_dir)).select("bin", "n", r6("mean_prob"), "observed")


@query(f"""
SELECT tier AS bin, count(*) AS n, round(avg(prob), 6) AS mean_prob,
  {pct_sql("count(*) FILTER (outcome = 'APPROVED')", 'count(*)')} AS observed
FROM scored WHERE outcome <> 'DELAYED' GROUP BY 1""", "scored")
def calibration_by_tier(spark, sf_dir):
    out = S.calibration(B.scored(spark, sf_dir), by_tier=True)
    return out.select("bin", "n", r6("mean_prob"), "observed")


@query(f"""
SELECT event_id, {correct_sql('prob', 'outcome')} AS correct, {ERROR_SQL} AS error
FROM scored WHERE outcome <> 'DELAYED'""", "scored")
def call_outcomes(spark, sf_dir):
    decided = B.scored(spark, sf_dir).filter(F.col("outcome") != "DELAYED")
    return decided.select(
        "event_id",
        C.is_correct("prob", "outcome").alias("correct"),
        C.error_class("prob", "outcome").alias("error"),
    )
