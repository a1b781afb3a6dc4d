"""Additive log-odds scores, their regression checks and version-to-version backtests.

Events carry their signals as an array of names (or as a map of name to recorded weight). Many events have
the same list of signals, so weights are looked up once for every distinct list: its names meet the
weight table in a hash join, whatever that table's size, and come back as one row a list. Signals held as a long
table are summed with a join and a grouped sum.

Weights are summed in whole millionths, so a sum does not depend on its order.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from decisionlab import dims
from decisionlab.functions import columns as C
from decisionlab.operators.ordered import running

MICRO = 1_000_000
BASE = int(Decimal(dims.BASE_LOGIT) * MICRO)
MANUFACTURING = ["form_483", "import_alert", "manufacturing_warning", "cGMP_violation"]
HIGH_RISK_AREAS = ["ta_high_risk", "ta_very_high_risk"]
DESIGNATIONS = [
    "BTD", "orphan", "fast_track", "priority_review", "RMAT", "accelerated_approval",
]
EVERY = "*"


def nest_signals(signals: DataFrame) -> DataFrame:
    """Long signals as one ordered array per event, never longer than the list of names."""
    once = signals.groupBy("event_id", "signal").agg(F.min("pos").alias("pos"))
    entries = F.array_sort(F.collect_list(F.struct("pos", "signal")))
    return once.groupBy("event_id").agg(
        F.transform(entries, lambda e: e["signal"]).alias("signals")
    )


def _micro(weight: Column) -> Column:
    return (weight * MICRO).cast("long")


def unique_weights(weights: DataFrame) -> DataFrame:
    """One weight per signal: that of the last version, the largest where one is repeated."""
    version = [F.col("version")] if "version" in weights.columns else []
    newest = F.max_by("weight", F.struct(*version, "weight"))
    return weights.groupBy("signal").agg(newest.alias("weight"))


def weighed_lists(events: DataFrame, weights: DataFrame) -> DataFrame:
    """The distinct signal lists of events with the weights of their names, in order.

    `signals` and `micro`, in millionths; 0 for a name without weight. Empty lists have no row.
    """
    table = unique_weights(weights).select(F.col("signal").alias("_name"), _micro(F.col("weight")).alias("_micro"))
    lists = events.select(_names(events).alias("signals")).filter(F.size("signals") > 0).distinct()
    each = lists.select("signals", F.posexplode("signals").alias("_pos", "_name"))
    entry = F.struct("_pos", F.coalesce("_micro", F.lit(0).cast("long")).alias("micro"))
    listed = F.array_sort(F.collect_list(entry))
    return each.join(table, "_name", "left").groupBy("signals").agg(
        F.transform(listed, lambda e: e["micro"]).alias("micro")
    )


def _with_lists(events: DataFrame, lists: DataFrame) -> DataFrame:
    """Events with the columns that `lists` has for their signals; null for an empty list."""
    named = lists.withColumnRenamed("signals", "_list")
    return events.withColumn("_names", _names(events)).join(
        named, F.col("_names") == F.col("_list"), "left"
    ).drop("_names", "_list")


def with_weights(events: DataFrame, weights: DataFrame, out: str = "signal_weights") -> DataFrame:
    """Add the weight of each signal in millionths, in order; 0 for a signal without weight."""
    lists = weighed_lists(events, weights).withColumnRenamed("micro", "_micro")
    none = F.array().cast("array<bigint>")
    return _with_lists(events, lists).withColumn(out, F.coalesce("_micro", none)).drop("_micro")


def _names(events: DataFrame) -> Column:
    if events.schema["signals"].dataType.typeName() == "map":
        return F.map_keys("signals")
    return F.coalesce(F.col("signals"), F.array().cast("array<string>"))


def score(
    events: DataFrame, weights: DataFrame | None = None, signals: DataFrame | None = None
) -> DataFrame:
    """Add total_adj, logit, prob, tier and action to each event.

    `signals` gives them as a long table (event_id, signal). Without it the event's own
    `signals` are used; without `weights` those must be a map of recorded weights.
    """
    if signals is not None:
        return _score_long(events, signals, weights)
    zero = F.lit(0).cast("long")
    if weights is None:
        total = F.aggregate(F.map_values("signals"), zero, lambda a, w: a + _micro(w))
    else:
        lists = weighed_lists(events, weights)
        total = F.aggregate("micro", zero, lambda a, w: a + w)
        events = _with_lists(events, lists.select("signals", total.alias("_total")))
        total = F.col("_total")
    return _with_score(events.withColumn("_total", F.coalesce(total, zero)))


def _score_long(events: DataFrame, signals: DataFrame, weights: DataFrame | None) -> DataFrame:
    if weights is None:
        weighted = signals.withColumn("_v", F.col("recorded_weight"))
    else:
        table = unique_weights(weights).withColumnRenamed("weight", "_v")
        weighted = signals.join(table, "signal")
    totals = weighted.groupBy("event_id").agg(F.sum(_micro(F.col("_v"))).alias("_total"))
    joined = events.join(totals, "event_id", "left")
    return _with_score(joined.withColumn("_total", F.coalesce("_total", F.lit(0).cast("long"))))


def _with_score(df: DataFrame) -> DataFrame:
    return (
        df.withColumn("total_adj", F.round(F.col("_total") / MICRO, 4))
        .withColumn("logit", (F.col("_total") + BASE) / MICRO)
        .withColumn("prob", C.sigmoid("logit"))
        .withColumn("tier", C.tier("prob"))
        .withColumn("action", C.action("tier"))
        .drop("_total")
    )


def waterfall(events: DataFrame, weights: DataFrame) -> DataFrame:
    """The base row, then each signal in stored order with running logit and probability.

    The steps are worked out once for every distinct list of signals; events then only take them.
    """
    lists = weighed_lists(events, weights)
    each = lists.select("signals", F.posexplode(F.arrays_zip("signals", "micro")).alias("pos", "_e"))
    so_far = Window.partitionBy("signals").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    reached = each.select(
        "signals", (F.col("pos") + 1).alias("pos"), F.col("_e.signals").alias("step"),
        F.col("_e.micro").alias("value"), (F.sum("_e.micro").over(so_far) + BASE).alias("reached"),
    )

    def row(pos: Column, step: Column, value: Column, reached: Column, top: Column) -> Column:
        logit = reached / MICRO
        return F.struct(
            pos.alias("pos"), step.alias("step"), (value / MICRO).alias("value"), logit.alias("cumulative_logit"),
            (F.abs(value) / top * 60).alias("bar_width"), C.sigmoid(logit).alias("cumulative_prob"),
        )

    base = F.lit(BASE).cast("long")
    least_top = F.lit(max(abs(BASE), MICRO)).cast("long")
    tops = Window.partitionBy("signals")
    top = F.greatest(F.max(F.abs("value")).over(tops), least_top)
    shown = reached.withColumn("_top", top).select(
        "signals", "_top", row(F.col("pos"), F.col("step"), F.col("value"), F.col("reached"), F.col("_top")).alias("_r")
    )
    steps = shown.groupBy("signals").agg(
        F.first("_top").alias("_top"), F.array_sort(F.collect_list("_r")).alias("_rows")
    )
    first = row(F.lit(0), F.lit("base"), base, base, F.coalesce("_top", least_top))
    none = F.array().cast(T.ArrayType(shown.schema["_r"].dataType))
    rows = F.concat(F.array(first), F.coalesce("_rows", none))
    return _with_lists(events.select("event_id", "signals"), steps).select(
        "event_id", F.explode(rows).alias("_r")
    ).select("event_id", "_r.*")


def apply_overrides(
    signals: DataFrame, overrides: DataFrame, base: DataFrame, target: DataFrame
) -> DataFrame:
    """Signals with weights where only named (event, signal) pairs move to `target`.

    Op `drop` removes the pair, `set` adds or re-weights it. All other rows keep `base`.
    """
    keys = ["event_id", "signal"]
    kept = signals.join(overrides.select(keys), keys, "left_anti").select(keys)
    moved = overrides.filter(F.col("op") == "set").select(keys).distinct()

    def weighted(rows: DataFrame, weights: DataFrame) -> DataFrame:
        return rows.join(weights.select("signal", "weight"), "signal").select(
            *keys, F.col("weight").alias("recorded_weight")
        )

    return weighted(kept, base).unionByName(weighted(moved, target))


def rescore_report(scored: DataFrame, tol: float = 0.005) -> DataFrame:
    """Recomputed against stored scores; a mismatch is another tier or more than `tol` apart."""
    prob_diff = F.abs(F.col("prob") - F.col("stored_prob"))
    tier_match = F.col("tier") == F.col("stored_tier")
    return scored.select(
        "event_id",
        "ticker",
        "stored_prob",
        "prob",
        "stored_tier",
        "tier",
        prob_diff.alias("prob_diff"),
        F.abs(F.col("total_adj") - F.col("stored_total_adj")).alias("adj_diff"),
        F.abs(F.col("logit") - F.col("stored_logit")).alias("logit_diff"),
        tier_match.alias("tier_match"),
        (~tier_match | (prob_diff > tol)).alias("mismatch"),
    )


def rescore_summary(report: DataFrame) -> DataFrame:
    """Counts and match rate of a rescore report."""
    bad = F.count_if("mismatch")
    n = F.count(F.lit(1))
    return report.agg(
        n.alias("total"),
        bad.alias("mismatches"),
        F.count_if(~F.col("tier_match")).alias("tier_changes"),
        C.ratio_pct(n - bad, n).alias("match_rate"),
    )


def score_both(events: DataFrame, weights_a: DataFrame, weights_b: DataFrame) -> DataFrame:
    """Probability, tier and correctness of decided events under two versions, in one pass."""
    cols = ["event_id", "outcome", "signals"]
    out = events.select(cols).filter(F.col("outcome").isin("APPROVED", "CRL"))
    for name, weights in (("a", weights_a), ("b", weights_b)):
        out = score(out, weights).select(
            *cols,
            *[c for c in out.columns if c not in cols],
            F.col("prob").alias(f"prob_{name}"),
            F.col("tier").alias(f"tier_{name}"),
            C.is_correct("prob", "outcome").alias(f"correct_{name}"),
        )
    return out.drop("signals")


def ab_join(scored_a: DataFrame, scored_b: DataFrame) -> DataFrame:
    """The same table from two stored score tables, joined on the event."""

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(
            "event_id",
            "outcome",
            F.col("prob").alias(f"prob_{name}"),
            F.col("tier").alias(f"tier_{name}"),
            C.is_correct("prob", "outcome").alias(f"correct_{name}"),
        ).filter(F.col(f"correct_{name}").isNotNull())

    return side(scored_a, "a").join(side(scored_b, "b").drop("outcome"), "event_id")


def ab_backtest(both: DataFrame) -> DataFrame:
    """Per decided event: did version b fix, break or keep what version a called?"""
    a, b = F.col("correct_a"), F.col("correct_b")
    change = (
        F.when(~a & b, "FIXED").when(a & ~b, "REGRESSED").when(a & b, "STABLE")
        .otherwise("STILL WRONG")
    )
    delta = F.round((F.col("prob_b") - F.col("prob_a")) * 100, 1)
    return both.withColumn("change", change).withColumn("delta_pp", delta)


def ab_summary(backtest: DataFrame) -> DataFrame:
    """Counts per change and the gate: no event may regress."""
    n = F.count(F.lit(1))
    regressed = F.count_if(F.col("change") == "REGRESSED")
    return backtest.agg(
        n.alias("total"),
        F.count_if("correct_a").alias("correct_a"),
        F.count_if("correct_b").alias("correct_b"),
        C.ratio_pct(F.count_if("correct_a"), n).alias("accuracy_a"),
        C.ratio_pct(F.count_if("correct_b"), n).alias("accuracy_b"),
        F.count_if(F.col("change") == "FIXED").alias("fixed"),
        regressed.alias("regressed"),
        F.count_if(F.col("change") == "STABLE").alias("stable"),
        F.count_if(F.col("change") == "STILL WRONG").alias("still_wrong"),
        (regressed == 0).alias("gate_passed"),
    )


def score_drift(events: DataFrame, originals: DataFrame) -> DataFrame:
    """Stored score less the one first published for the ticker; a ticker may have many events.

    Whether the direction was right is judged on the recomputed `prob`.
    """
    drift = (F.col("stored_prob") - F.col("orig_score")) * 100
    return events.select("event_id", "ticker", "stored_prob", "prob").join(originals, "ticker").select(
        "event_id",
        "ticker",
        "orig_score",
        "stored_prob",
        drift.alias("drift_pp"),
        F.when(drift > 0, "UP").when(drift < 0, "DOWN").otherwise("SAME").alias("direction"),
        (F.abs(drift) > 10).alias("significant"),
        C.is_traded_correct("prob", "action").alias("direction_correct"),
    )


def derive_interactions(events: DataFrame) -> DataFrame:
    """Interaction signals an event's own signals imply and it does not yet carry."""

    def any_of(names: list[str]) -> Column:
        return F.arrays_overlap("signals", F.array(*[F.lit(n) for n in names]))

    new, old = any_of(["inexperienced_sponsor"]), any_of(["experienced_sponsor"])
    rejected, factory = any_of(["prior_CRL"]), any_of(MANUFACTURING)
    rules = {
        "novice_high_risk_ta": new & any_of(HIGH_RISK_AREAS),
        "interaction_inexperienced_mfg": new & factory,
        "interaction_prior_crl_mfg": rejected & factory,
        "experienced_low_risk": old & any_of(["ta_low_risk"]),
    }
    return _derived(events, rules)


def derive_stack(events: DataFrame, threshold: int = 3) -> DataFrame:
    """The stacking signal for events with at least `threshold` designations."""
    named = F.array_intersect("signals", F.array(*[F.lit(d) for d in DESIGNATIONS]))
    return _derived(events, {"designation_stack": F.size(named) >= threshold})


def _derived(events: DataFrame, rules: dict[str, Column]) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]))
    return events.select(
        "event_id", F.explode(F.array_except(found, F.col("signals"))).alias("signal")
    )


def prior_history(events: DataFrame, key: str = "drug") -> DataFrame:
    """Per event: the entity's last earlier rejection, how many so far, whole years since."""
    rejected = F.col("outcome") == "CRL"
    out = running(
        events,
        [key],
        ["event_date", "event_id"],
        sums={"prior_rejections": F.when(rejected, 1).otherwise(0).cast("long")},
        lasts={"last_rejection": F.when(rejected, F.col("event_date"))},
        include_current=False,
    )
    last, day = F.col("last_rejection"), F.col("event_date")

    def month_day(d: Column) -> Column:
        return F.month(d) * 100 + F.dayofmonth(d)

    short = F.when(month_day(day) < month_day(last), 1).otherwise(0)
    return out.withColumn("years_since", F.year(day) - F.year(last) - short).withColumn(
        "serial", F.col("prior_rejections") >= 2
    )


def decay_signal(events: DataFrame, weights: DataFrame, key: str = "drug") -> DataFrame:
    """The time-decay signal and weight of events that follow an earlier rejection."""
    years = F.col("years_since")
    name = F.lit(dims.DECAY_SIGNALS[0][1])
    for least, signal in dims.DECAY_SIGNALS[1:]:
        name = F.when(years >= least, signal).otherwise(name)
    after = prior_history(events, key).filter(F.col("last_rejection").isNotNull())
    return after.select(
        "event_id", key, "last_rejection", "years_since", name.alias("signal")
    ).join(weights.select("signal", "weight"), "signal", "left")


def signal_validation(checks: DataFrame) -> DataFrame:
    """How often each signal of the sealed records matched the stated reason, by grade."""
    return checks.groupBy("signal", "fda_rationale_match").agg(
        F.count(F.lit(1)).alias("n"), F.avg("weight").alias("mean_weight")
    )


def _signal_rows(scored: DataFrame, weights: DataFrame, *cols: Column | str) -> DataFrame:
    """One row per event and signal, plus one per event under the name EVERY for totals."""
    every = F.struct(F.lit(EVERY).alias("signal"), F.lit(0).cast("long").alias("weight"))
    pairs = F.zip_with(
        _names(scored),
        "signal_weights",
        lambda s, w: F.struct(s.alias("signal"), w.alias("weight")),
    )
    return (
        with_weights(scored, weights)
        .select(*cols, F.explode(F.concat(F.array(every), pairs)).alias("_e"))
        .select("*", "_e.*")
        .drop("_e")
    )


def signal_effects(scored: DataFrame, weights: DataFrame) -> DataFrame:
    """Per signal: decided events, mean weight, hit rate and share of all missed events."""
    correct = C.is_correct("prob", "outcome").alias("correct")
    rows = _signal_rows(scored, weights, correct).filter(F.col("correct").isNotNull())
    grouped = rows.groupBy("signal").agg(
        F.count(F.lit(1)).alias("n"),
        (F.sum("weight") / F.count(F.lit(1)) / MICRO).alias("mean_weight"),
        F.count_if("correct").alias("hits"),
        F.count_if(~F.col("correct")).alias("misses"),
    )
    # One row per signal name is left here, so the total fits any task.
    all_misses = F.max(F.when(F.col("signal") == EVERY, F.col("misses"))).over(Window.partitionBy(F.lit(0)))
    return (
        grouped.select(
            "signal", "n", "mean_weight", C.ratio_pct("hits", "n").alias("hit_rate"), "misses",
            C.ratio_pct("misses", all_misses).alias("miss_share"),
        )
        .filter(F.col("signal") != EVERY)
        .join(weights.select("signal", "category"), "signal", "left")
    )


def miss_profile(scored: DataFrame, weights: DataFrame) -> DataFrame:
    """Missed events by kind and error class, with the signals that weighed most in each."""
    rows = _signal_rows(
        scored, weights,
        C.kind("type").alias("kind"), C.error_class("prob", "outcome").alias("error"),
    ).filter(F.col("error").isNotNull())
    by_signal = rows.groupBy("kind", "error", "signal").agg(
        F.count(F.lit(1)).alias("n"), F.sum("weight").alias("total")
    )
    total = F.col("total")
    return by_signal.groupBy("kind", "error").agg(
        F.max(F.when(F.col("signal") == EVERY, F.col("n"))).alias("misses"),
        F.max_by(
            "signal", F.when(total < 0, F.struct((-total).alias("t"), F.col("signal")))
        ).alias("top_negative"),
        F.max_by("signal", F.when(total > 0, F.struct(total.alias("t"), F.col("signal")))).alias(
            "top_positive"
        ),
    )


def separation(scored: DataFrame) -> DataFrame:
    """Mean probability of approved and rejected events and the gap in percentage points."""
    approved = F.avg(F.when(F.col("outcome") == "APPROVED", F.col("prob")))
    rejected = F.avg(F.when(F.col("outcome") == "CRL", F.col("prob")))
    return scored.agg(
        approved.alias("mean_approved"),
        rejected.alias("mean_rejected"),
        ((approved - rejected) * 100).alias("gap_pp"),
    )


def calibration(scored: DataFrame, bins: int = 10, by_tier: bool = False) -> DataFrame:
    """Mean probability against the observed approval rate, by tier or in equal-width bins."""
    decided = scored.filter(F.col("outcome").isin("APPROVED", "CRL"))
    group = (
        F.col("tier") if by_tier else F.least(F.floor(F.col("prob") * bins), F.lit(bins - 1))
    )
    n = F.count(F.lit(1))
    approved = F.count_if(F.col("outcome") == "APPROVED")
    return decided.groupBy(group.alias("bin")).agg(
        n.alias("n"), F.avg("prob").alias("mean_prob"), C.ratio_pct(approved, n).alias("observed")
    )
