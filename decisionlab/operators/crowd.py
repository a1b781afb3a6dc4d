"""Votes: validation, sentiment, leaderboard, streaks, coins and watchlists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decisionlab import dims
from decisionlab.functions import columns as C
from decisionlab.operators.ordered import (
    latest_by,
    number_rows,
    running,
    top_n_by,
)


# A coin entry names its vote: with the reason, `seq` makes it unique.
ENTRY_KEYS = ["user", "event_id", "seq"]


def vote_reason(kind: Column | None = None) -> Column:
    """Why a vote is refused, null when it is accepted.

    Without a kind only the two decision labels are allowed. With one, readouts take the
    three readout labels instead.
    """
    label = F.col("label")
    missing = F.lit(False)
    for name in ("user", "event_id", "label"):
        missing = missing | F.col(name).isNull() | (F.col(name).cast("string") == "")
    allowed = label.isin(dims.DECISION_LABELS)
    if kind is not None:
        allowed = F.when(kind == "readout", label.isin(dims.READOUT_LABELS)).otherwise(allowed)
    return F.when(missing, "missing field").when(~allowed, "label not allowed")


def validate_predictions(votes: DataFrame, kind: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Accepted votes, and refused ones with the reason."""
    checked = votes.withColumn("reason", vote_reason(kind))
    accepted = checked.filter(F.col("reason").isNull()).drop("reason")
    return accepted, checked.filter(F.col("reason").isNotNull())


def user_predictions(votes: DataFrame, user: object) -> DataFrame:
    """The votes of one user; the filter reaches the scan."""
    return votes.filter(F.col("user") == F.lit(user))


def current_votes(votes: DataFrame) -> DataFrame:
    """One row per user and event, without the vote's id: the last write wins."""
    columns = [c for c in votes.columns if c != "id"]
    return latest_by(votes.select(columns), ["user", "event_id"], ["created_at", "seq"])


def sentiment(votes: DataFrame) -> DataFrame:
    """Votes, approvals, rejections and approval share per event. Takes current votes."""
    n, yes = F.count(F.lit(1)), F.count_if(F.col("label") == "APPROVE")
    return votes.groupBy("event_id").agg(
        n.alias("total_votes"),
        yes.alias("approve_votes"),
        F.count_if(F.col("label") == "CRL").alias("crl_votes"),
        C.ratio_pct(yes, n).alias("approve_pct"),
    )


def with_sentiment(events: DataFrame, by_event: DataFrame) -> DataFrame:
    """Add the crowd's numbers to each event, null where nobody voted."""
    return events.join(by_event, "event_id", "left")


def leaderboard(votes: DataFrame, outcomes: DataFrame, limit: int | None = None) -> DataFrame:
    """Per user: votes, scored (a delay counts as scored), correct, accuracy and points.

    Takes current votes. With `limit` only the leaders are kept, sorted.
    """
    rows = votes.select("user", "event_id", "label")
    joined = rows.join(_voted_on(rows, outcomes).select("event_id", "outcome"), "event_id", "left")
    scored = F.count("outcome")
    correct = F.count_if(F.col("label") == F.col("outcome"))
    board = joined.groupBy("user").agg(
        F.count(F.lit(1)).alias("total_predictions"),
        scored.alias("scored_predictions"),
        correct.alias("correct"),
        C.ratio_pct(correct, scored).alias("accuracy_pct"),
        (correct * 10).alias("points"),
    )
    if limit is None:
        return board
    return board.orderBy(F.desc("points"), F.desc("accuracy_pct"), "user").limit(limit)


def rank_leaders(board: DataFrame) -> DataFrame:
    """Place of every user by points, then accuracy, then name; medals for the first three."""
    ranked = number_rows(board, ["-points", "-accuracy_pct", "user"], "rank")
    place = F.col("rank")
    medal = F.when(place == 1, "GOLD").when(place == 2, "SILVER").when(place == 3, "BRONZE")
    return ranked.withColumn("medal", medal)


def _voted_on(votes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The outcomes of events that have votes: few, so that the votes need not meet the others."""
    return outcomes.join(votes.select("event_id").distinct(), "event_id", "left_semi")


def scored_votes(votes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Current votes with the event's outcome, decision time and whether they were right.

    A delayed decision is never right, and votes on undecided events are left out.
    """
    decided = _voted_on(votes, outcomes).select("event_id", "outcome", "decided_at")
    joined = votes.join(decided, "event_id")
    return joined.withColumn("correct", F.col("label") == F.col("outcome"))


def streaks(scored: DataFrame) -> DataFrame:
    """Current and best run of right votes per user, in order of decision.

    A wrong vote starts the next run, so the running count of wrong votes names the run and
    the run lengths are a plain grouped count.
    """
    rows = scored.select("user", "event_id", "decided_at", "correct")
    wrong = F.when(F.col("correct"), 0).otherwise(1).cast("long")
    runs = running(rows, ["user"], ["decided_at", "event_id"], sums={"run": wrong})
    lengths = runs.groupBy("user", "run").agg(F.count_if("correct").alias("length"))
    return lengths.groupBy("user").agg(
        F.max_by("length", "run").alias("current"), F.max("length").alias("best")
    )


def streak_bonuses(scored: DataFrame) -> DataFrame:
    """A coin entry each time a run of right votes reaches one of the rewarded lengths."""
    order = ["decided_at", "event_id"]
    rows = scored.select("user", "event_id", "seq", "decided_at", "correct")
    placed = running(rows, ["user"], order, sums={"_rn": F.lit(1).cast("long")})
    since = running(
        placed,
        ["user"],
        order,
        lasts={"_miss": F.when(~F.col("correct"), F.col("_rn"))},
    )
    length = F.col("_rn") - F.coalesce("_miss", F.lit(0))
    reward = None
    for n in dims.STREAK_LENGTHS:
        entry = _entry(f"STREAK_{n}", F.col("decided_at"))
        reward = F.when(length == n, entry) if reward is None else reward.when(length == n, entry)
    return (
        since.filter(F.col("correct") & length.isin(dims.STREAK_LENGTHS))
        .select(*ENTRY_KEYS, reward.alias("_c"))
        .select(*ENTRY_KEYS, "_c.*")
    )


def _entry(rule: str, at: Column) -> Column:
    return F.struct(
        F.lit(dims.COIN_REWARDS[rule]).cast("long").alias("amount"),
        F.lit(rule).alias("reason"),
        at.cast("timestamp").alias("ts"),
    )


def coin_events(votes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Every coin entry the rules credit for the given accepted votes.

    Each vote earns its reward when it is made, the first one a welcome bonus. The final
    vote on a decided event can earn rewards for being right, early or against the crowd.
    """
    first = first_votes(votes)
    made = votes.select(*ENTRY_KEYS, _entry("PREDICTION_MADE", F.col("created_at")).alias("_c"))
    welcome = first.select(
        *ENTRY_KEYS, _entry("FIRST_PREDICTION", F.col("created_at")).alias("_c")
    )

    current = current_votes(votes)
    scored = scored_votes(current, outcomes)
    crowd = sentiment(current).select("event_id", "total_votes", "approve_votes", "crl_votes")
    at = F.col("decided_at")
    agreed = F.when(F.col("label") == "APPROVE", F.col("approve_votes")).otherwise(
        F.col("crl_votes")
    )
    early = F.datediff(F.to_date(at), F.to_date("created_at")) >= dims.EARLY_DAYS
    binary = F.col("label").isin(dims.DECISION_LABELS)
    rules = [
        (F.col("correct") & binary, "CORRECT_BINARY"),
        (F.col("correct") & ~binary, "CORRECT_GRANULAR"),
        (early, "EARLY_BIRD"),
        (
            F.col("correct") & (agreed * 100 < F.col("total_votes") * dims.CONTRARIAN_PCT),
            "CONTRARIAN_WIN",
        ),
    ]
    found = F.array_compact(F.array(*[F.when(test, _entry(rule, at)) for test, rule in rules]))
    judged = scored.join(crowd, "event_id").select(*ENTRY_KEYS, F.explode(found).alias("_c"))
    rows = made.unionByName(welcome).unionByName(judged)
    bonuses = streak_bonuses(scored)
    return rows.select(*ENTRY_KEYS, "_c.*").unionByName(bonuses)


def first_votes(votes: DataFrame) -> DataFrame:
    """The first vote of each user."""
    first = F.min_by(F.struct("event_id", "seq", "created_at"), F.struct("created_at", "seq"))
    return votes.groupBy("user").agg(first.alias("_v")).select("user", "_v.*")


def coin_balance(entries: DataFrame) -> DataFrame:
    """Coin entries with the user's balance after each."""
    order = ["ts", "event_id", "reason", "seq"]
    return running(entries, ["user"], order, sums={"balance": F.col("amount")})


def coin_tier(entries: DataFrame) -> DataFrame:
    """Balance, tier and progress to the next tier per user."""
    return entries.groupBy("user").agg(F.sum("amount").alias("balance")).select(
        "user",
        "balance",
        C.coin_tier("balance").alias("tier"),
        C.coin_progress("balance").alias("progress"),
    )


def newest_coins(entries: DataFrame, n: int = 100) -> DataFrame:
    """The newest `n` coin entries of each user."""
    return top_n_by(entries, ["user"], ["-ts", "-event_id", "reason", "seq"], n)


def toggle_watch(watch: DataFrame, changes: DataFrame) -> DataFrame:
    """Watchlist after switching each changed (user, event) on or off."""
    keys = ["user", "event_id"]
    return (
        watch.select(keys)
        .unionAll(changes.select(keys))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") % 2 == 1)
        .select(keys)
    )
