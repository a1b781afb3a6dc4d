"""The verified outcome ledger: accuracy, equity curve, recent form, proofs and trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decisionlab import dims
from decisionlab.functions import columns as C
from decisionlab.operators.ordered import running, trailing_mean


def ledger_filter(ledger: DataFrame, which: str = "all") -> DataFrame:
    """All rows, the `correct` ones or the `incorrect` ones."""
    if which == "all":
        return ledger
    if which not in ("correct", "incorrect"):
        raise ValueError(f"unknown filter {which!r}")
    return ledger.filter(F.col("correct") if which == "correct" else ~F.col("correct"))


def sort_ledger(ledger: DataFrame, by: str = "date") -> DataFrame:
    """Newest, largest absolute move or highest score first; ledger order breaks ties."""
    key = {
        "date": F.col("date"),
        "move": F.abs(C.leading_number("move")),
        "score": F.col("score"),
    }[by]
    return ledger.orderBy(key.desc_nulls_last(), "seq")


def track_record(ledger: DataFrame) -> DataFrame:
    """Totals, tier hits, best correct move (earliest wins ties) and mean correct-BUY move."""
    n = F.count(F.lit(1))
    good = F.col("correct")
    move = C.leading_number("move")
    t1, t4 = F.col("tier") == "TIER_1", F.col("tier") == "TIER_4"
    best = F.when(good & move.isNotNull(), F.struct(move.alias("m"), (-F.col("seq")).alias("s")))
    won = good & (F.col("action") == "BUY") & (F.col("outcome") != "CRL")
    return ledger.agg(
        n.alias("total"),
        F.count_if(good).alias("correct"),
        C.ratio_pct(F.count_if(good), n).alias("accuracy"),
        F.count_if(t1).alias("tier_1"),
        F.count_if(t1 & good).alias("tier_1_correct"),
        F.count_if(t4).alias("tier_4"),
        F.count_if(t4 & good).alias("tier_4_correct"),
        F.max_by("seq", best).alias("best_seq"),
        F.max(best)["m"].cast("double").alias("best_move"),
        F.avg(F.when(won, move).cast("double")).alias("mean_win_move"),
    )


def accuracy_by(ledger: DataFrame, *by: str) -> DataFrame:
    """Total, correct and accuracy per group."""
    return ledger.groupBy(*by).agg(*_accuracy())


def accuracy_cube(ledger: DataFrame, *by: str) -> DataFrame:
    """The same for every combination of the dimensions at once; null stands for 'all'.

    The rows are counted per group first, so that only the counts are repeated per level.
    """
    total, correct = F.sum("total"), F.sum("correct")
    return accuracy_by(ledger, *by).cube(*by).agg(
        F.grouping_id().cast("int").alias("level"),
        total.alias("total"),
        correct.alias("correct"),
        C.ratio_pct(correct, total).alias("accuracy"),
    )


def _accuracy() -> list[Column]:
    good, n = F.count_if("correct"), F.count(F.lit(1))
    return [n.alias("total"), good.alias("correct"), C.ratio_pct(good, n).alias("accuracy")]


def counted_move() -> Column:
    """The move in percent when a BUY was taken and resolved, else 0."""
    move = C.leading_number("move")
    bought = F.col("action") == "BUY"
    won = F.col("correct") & F.col("outcome").isin(dims.WIN_OUTCOMES)
    taken = bought & (won | ~F.col("correct")) & move.isNotNull()
    return F.when(taken, move).otherwise(F.lit(0).cast("decimal(18,6)"))


def equity_curve(ledger: DataFrame, start: float = 10_000.0) -> DataFrame:
    """Balance after each row in date order, ledger order breaking ties.

    The running sum is taken over range partitions of the ordered ledger, so neither the
    whole ledger nor one busy day passes through a single task.
    """
    rows = ledger.select("seq", "date", counted_move().alias("_move"))
    curve = running(rows, [], ["date", "seq"], sums={"_sum": F.col("_move")})
    # Counted on the rows `running` has already stored, not on the ledger's sources again.
    n = curve.agg(F.count(F.lit(1)).alias("n")).scalar()
    return curve.withColumn(
        "balance", F.lit(start) + F.lit(start) / n * F.col("_sum").cast("double") / 100.0
    ).select("seq", "date", "balance")


def equity_range(curve: DataFrame, start: float = 10_000.0) -> DataFrame:
    """Lowest (never above the start), highest and end balance with the scaling range."""
    low, high = F.least(F.min("balance"), F.lit(start)), F.max("balance")
    return curve.agg(
        low.alias("low"),
        high.alias("high"),
        F.coalesce(F.nullif(high - low, F.lit(0.0)), F.lit(1.0)).alias("range"),
        F.max_by("balance", F.struct("date", "seq")).alias("end"),
    )


def recent_form(ledger: DataFrame, n: int = 17) -> DataFrame:
    """Share of correct calls over the last `n` decisions, after each decision."""
    rows = ledger.select("seq", "date", F.col("correct").cast("double").alias("_hit"))
    return trailing_mean(rows, ["date", "seq"], F.col("_hit"), n, "form").select(
        "seq", "date", "form"
    )


def prediction_flags(stamped: DataFrame, early_prefix: str) -> DataFrame:
    """Flags read from the id and the status text; `early_prefix` marks early-warning ids."""
    status = F.col("status")
    return stamped.select(
        "*",
        status.contains("LEGENDARY").alias("legendary"),
        (status.contains("loss avoided") | status.contains(early_prefix)).alias("loss_avoided"),
        F.col("id").startswith(early_prefix).alias("early_warning"),
        status.contains("WIN").alias("win"),
        C.lead_days("event_date", "ts").alias("lead_days"),
        F.datediff("outcome_date", F.to_date("ts")).alias("outcome_lead_days"),
    )


def proof_summary(flagged: DataFrame) -> DataFrame:
    """Predictions, wins, rows with a hash and lead days; takes flagged predictions."""
    return flagged.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("win").alias("wins"),
        F.count_if(F.length("hash") > 0).alias("hashed"),
        F.min("lead_days").alias("min_lead"),
        F.max("lead_days").alias("max_lead"),
        F.sum("lead_days").alias("sum_lead"),
    )


def trade_metrics(trades: DataFrame) -> DataFrame:
    """Holding days, gain, loss avoided and the net swing against holding on."""
    entry, exit_, post = F.col("entry_price"), F.col("exit_price"), F.col("post_price")
    zero = F.lit(0.0)
    gain_pct = (exit_ - entry) / F.nullif(entry, zero) * 100
    # The avoided loss is stated against the exit price.
    avoided_pct = (exit_ - post) / F.nullif(exit_, zero) * 100
    return trades.select(
        "*",
        F.datediff("exit_date", "entry_date").alias("holding_days"),
        (exit_ - entry).alias("gain_per_share"),
        gain_pct.alias("gain_pct"),
        (exit_ - post).alias("avoided_per_share"),
        avoided_pct.alias("avoided_pct"),
        (gain_pct + avoided_pct).alias("net_swing"),
    )


def decision_delay(events: DataFrame) -> DataFrame:
    """Days a decision came after (positive) or before its schedule."""
    delay = F.datediff("actual_date", "scheduled_date")
    label = F.when(delay < 0, "EARLY").when(delay > 0, "LATE").when(delay == 0, "ON TIME")
    return events.select("*", delay.alias("delay_days"), label.alias("timing"))
