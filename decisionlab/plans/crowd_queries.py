"""Queries over votes, coins and watchlists, batch and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from decisionlab.functions import columns as C
from decisionlab.operators import crowd as K
from decisionlab.operators.ordered import top_n_by
from decisionlab.plans import bindings as B
from decisionlab.plans.oracle_views import pct_sql
from decisionlab.plans.registry import query, r6
from decisionlab.session import new_dir
from decisionlab.sources import votes_table
from decisionlab.streaming import live as L
from decisionlab.streaming import votes as V


@query('SELECT id, event_id, label FROM vote WHERE "user" = 42', "vote")
def user_predictions(spark, sf_dir):
    return K.user_predictions(B.votes(spark, sf_dir), 42).select("id", "event_id", "label")


BAD_VOTES = """
  SELECT id, CASE WHEN seq % 23 = 0 THEN NULL ELSE event_id END AS event_id,
    CASE WHEN seq % 29 = 0 THEN 'BEAT' ELSE label END AS label, seq FROM vote"""


def _mixed_votes(spark, sf_dir):
    votes, seq = B.votes(spark, sf_dir), F.col("seq")
    return votes.withColumn("event_id", F.when(seq % 23 != 0, F.col("event_id"))).withColumn(
        "label", F.when(seq % 29 == 0, "BEAT").otherwise(F.col("label"))
    )


@query(f"""
SELECT id, event_id, label FROM ({BAD_VOTES})
WHERE event_id IS NOT NULL AND label IN ('APPROVE', 'CRL')""", "vote")
def accepted_votes(spark, sf_dir):
    accepted, _ = K.validate_predictions(_mixed_votes(spark, sf_dir))
    return accepted.select("id", "event_id", "label")


@query(f"""
SELECT id, CASE WHEN event_id IS NULL THEN 'missing field' ELSE 'label not allowed' END AS reason
FROM ({BAD_VOTES})
WHERE event_id IS NULL OR CASE WHEN event_id % 2 = 0 THEN label NOT IN ('BEAT', 'MEET', 'MISS')
  ELSE label NOT IN ('APPROVE', 'CRL') END""", "vote")
def refused_votes(spark, sf_dir):
    """Refused votes where even events are readouts."""
    kind = F.when(F.col("event_id") % 2 == 0, "readout").otherwise("decision")
    _, refused = K.validate_predictions(_mixed_votes(spark, sf_dir), kind)
    return refused.select("id", "reason")


@query('SELECT "user", event_id, label, seq FROM latest', "latest")
def current_votes(spark, sf_dir):
    return K.current_votes(B.votes(spark, sf_dir)).select("user", "event_id", "label", "seq")


SENTIMENT_SQL = "SELECT event_id, total_votes, approve_votes, crl_votes, approve_pct FROM crowd"


@query(SENTIMENT_SQL, "crowd")
def vote_sentiment(spark, sf_dir):
    return K.sentiment(K.current_votes(B.votes(spark, sf_dir)))


@query("""
SELECT e.event_id, e.type, c.total_votes, c.approve_pct
FROM event e LEFT JOIN crowd c ON c.event_id = e.event_id""", "event crowd")
def events_with_sentiment(spark, sf_dir):
    by_event = K.sentiment(K.current_votes(B.votes(spark, sf_dir)))
    joined = K.with_sentiment(B.events(spark, sf_dir), by_event)
    return joined.select("event_id", "type", "total_votes", "approve_pct")


@query("SELECT * FROM board", "board")
def leaderboard(spark, sf_dir):
    return K.leaderboard(K.current_votes(B.votes(spark, sf_dir)), B.outcomes(spark, sf_dir))


@query("""
SELECT "user", points, accuracy_pct FROM board
ORDER BY points DESC, accuracy_pct DESC, "user" LIMIT 25""", "board")
def top_leaders(spark, sf_dir):
    votes = K.current_votes(B.votes(spark, sf_dir))
    top = K.leaderboard(votes, B.outcomes(spark, sf_dir), limit=25)
    return top.select("user", "points", "accuracy_pct")


@query("""
SELECT "user", rank, CASE rank WHEN 1 THEN 'GOLD' WHEN 2 THEN 'SILVER' WHEN 3 THEN 'BRONZE' END AS medal
FROM (SELECT *, row_number() OVER (ORDER BY points DESC, accuracy_pct DESC, "user") AS rank FROM board)
""", "board")
def leader_ranks(spark, sf_dir):
    votes = K.current_votes(B.votes(spark, sf_dir))
    ranked = K.rank_leaders(K.leaderboard(votes, B.outcomes(spark, sf_dir)))
    return ranked.select("user", "rank", "medal")


def _judged(spark, sf_dir):
    return K.scored_votes(K.current_votes(B.votes(spark, sf_dir)), B.outcomes(spark, sf_dir))


STREAK_SQL = 'SELECT "user", arg_max(length, run) AS current, max(length) AS best FROM runs GROUP BY 1'


@query(STREAK_SQL, "runs")
def user_streaks(spark, sf_dir):
    return K.streaks(_judged(spark, sf_dir))


# Every coin entry by rule; a streak bonus falls on the row where the run reaches its length.
COIN_SQL = """
  SELECT "user", event_id, seq, CAST(10 AS BIGINT) AS amount, 'PREDICTION_MADE' AS reason,
    created_at AS ts FROM vote
  UNION ALL
  SELECT "user", event_id, seq, 25, 'FIRST_PREDICTION', created_at FROM (SELECT *, row_number() OVER (
    PARTITION BY "user" ORDER BY created_at, seq) AS rn FROM vote) WHERE rn = 1
  UNION ALL
  SELECT "user", event_id, seq, 50, 'CORRECT_BINARY', decided_at FROM judged WHERE correct
  UNION ALL
  SELECT "user", event_id, seq, 25, 'EARLY_BIRD', decided_at FROM judged
  WHERE date_diff('day', created_at, decided_at) >= 14
  UNION ALL
  SELECT j."user", j.event_id, seq, 150, 'CONTRARIAN_WIN', decided_at FROM judged j JOIN crowd c USING (event_id)
  WHERE correct AND 100 * CASE label WHEN 'APPROVE' THEN approve_votes ELSE crl_votes END < 30 * total_votes
  UNION ALL
  SELECT "user", event_id, seq, CASE place WHEN 3 THEN 75 WHEN 5 THEN 200 ELSE 500 END,
    'STREAK_' || place, decided_at
  FROM (SELECT *, row_number() OVER (PARTITION BY "user", run ORDER BY decided_at, event_id)
      - CASE WHEN run > 0 THEN 1 ELSE 0 END AS place
    FROM (SELECT *, sum(CASE WHEN correct THEN 0 ELSE 1 END) OVER (
      PARTITION BY "user" ORDER BY decided_at, event_id) AS run FROM judged))
  WHERE correct AND place IN (3, 5, 10)"""
COIN_VIEWS = "vote judged crowd"


def _coins(spark, sf_dir):
    return K.coin_events(B.votes(spark, sf_dir), B.outcomes(spark, sf_dir))


@query(f"""
SELECT "user", event_id, amount, reason, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM ({COIN_SQL})
""", COIN_VIEWS)
def coin_events(spark, sf_dir):
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts")
    return _coins(spark, sf_dir).select("user", "event_id", "amount", "reason", stamp)


@query(f"""
SELECT "user", event_id, seq, reason, amount, CAST(sum(amount) OVER (PARTITION BY "user"
  ORDER BY ts, event_id, reason, seq) AS BIGINT) AS balance
FROM ({COIN_SQL})""", COIN_VIEWS)
def coin_balance(spark, sf_dir):
    return K.coin_balance(_coins(spark, sf_dir)).select(
        "user", "event_id", "seq", "reason", "amount", "balance"
    )


@query(f"""
SELECT "user", CAST(b AS BIGINT) AS balance,
  CASE WHEN b >= 10000 THEN 'LEGEND' WHEN b >= 5000 THEN 'TITAN' WHEN b >= 2500 THEN 'ORACLE'
    WHEN b >= 1000 THEN 'STRATEGIST' WHEN b >= 250 THEN 'ANALYST' ELSE 'INITIATE' END AS tier,
  round(CASE WHEN b >= 10000 THEN 100 WHEN b >= 5000 THEN (b - 5000) / 50.0
    WHEN b >= 2500 THEN (b - 2500) / 25.0 WHEN b >= 1000 THEN (b - 1000) / 15.0
    WHEN b >= 250 THEN (b - 250) / 7.5 ELSE b / 2.5 END, 6) AS progress
FROM (SELECT "user", CAST(sum(amount) AS DOUBLE) AS b FROM ({COIN_SQL}) GROUP BY 1)""", COIN_VIEWS)
def coin_tiers(spark, sf_dir):
    return K.coin_tier(_coins(spark, sf_dir)).select("user", "balance", "tier", r6("progress"))


@query(f"""
SELECT "user", event_id, reason, amount FROM (SELECT *, row_number() OVER (PARTITION BY "user"
  ORDER BY ts DESC, event_id DESC, reason, seq) AS rn FROM ({COIN_SQL})) WHERE rn <= 10""", COIN_VIEWS)
def newest_coins(spark, sf_dir):
    return K.newest_coins(_coins(spark, sf_dir), 10).select("user", "event_id", "reason", "amount")


@query("""
SELECT "user", event_id, seq, rn FROM (SELECT *, row_number() OVER (PARTITION BY "user"
  ORDER BY created_at DESC, seq DESC) AS rn FROM vote) WHERE rn <= 4""", "vote")
def newest_votes(spark, sf_dir):
    newest = top_n_by(B.votes(spark, sf_dir), ["user"], ["-created_at", "-seq"], 4)
    return newest.select("user", "event_id", "seq", F.col("rn").cast("long"))


@query("""
SELECT o_custkey AS "user", o_orderkey AS event_id FROM orders
WHERE (o_orderpriority = '1-URGENT') <> (o_orderstatus = 'P' OR o_orderpriority = '2-HIGH')""")
def toggled_watchlist(spark, sf_dir):
    return K.toggle_watch(B.watchlist(spark, sf_dir), B.watch_changes(spark, sf_dir))


# Streams


@query('SELECT "user", event_id, label, seq FROM latest', "latest")
def vote_upserts(spark, sf_dir):
    """Votes stored in two batches, the later half first, then read back."""
    votes, table = B.votes(spark, sf_dir), new_dir(spark, "votes")
    late = F.col("created_at") >= F.lit("2024-01-16").cast("timestamp")
    votes_table.upsert_predictions(votes.filter(late), table, 0)
    votes_table.upsert_predictions(votes.filter(~late), table, 1)
    stored = votes_table.read_votes(spark, table, votes.schema)
    return stored.select("user", "event_id", "label", "seq")


def _parts(spark):
    """State in a partition and four groups a core."""
    cores = spark.sparkContext.defaultParallelism
    return {"groups": 4 * cores, "shards": 2, "partitions": cores, "fold_every": 2}


def _landing(spark, rows, key, files):
    """A stream of all rows, landed in several files, that takes one file a batch."""
    path = new_dir(spark, "landed")
    rows.repartition(files, key).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _live(spark, sf_dir):
    """Live tables of three batches of votes and of outcomes."""
    return L.LiveTables(
        new_dir(spark, "live"), _landing(spark, B.votes(spark, sf_dir), "id", 3),
        _landing(spark, B.outcomes(spark, sf_dir), "event_id", 3), **_parts(spark), files=4,
    )


@query('SELECT "user", event_id, label, seq FROM latest', "latest")
def stream_votes(spark, sf_dir):
    """Current votes of a stream of four batches, folded after every second."""
    stream, table = _landing(spark, B.votes(spark, sf_dir), "id", 4), new_dir(spark, "votes")
    V.ingest_votes(stream, table, new_dir(spark, "ingest"), fold_every=2)
    stored = votes_table.read_votes(spark, table, V.accepted_votes(stream).schema)
    return stored.select("user", "event_id", "label", "seq")


@query(SENTIMENT_SQL, "crowd")
def stream_sentiment(spark, sf_dir):
    """Sentiment of every event, kept by the changes of three batches of votes."""
    live = _live(spark, sf_dir)
    live.advance("sentiment")
    return live.sentiment()


@query(f"""
SELECT b.*, coalesce(s.current, 0) AS current, coalesce(s.best, 0) AS best
FROM board b LEFT JOIN ({STREAK_SQL}) s USING ("user")""", "board runs")
def stream_leaderboard(spark, sf_dir):
    """Board and streaks of every user, kept by the changes of three batches of votes and of outcomes."""
    live = _live(spark, sf_dir)
    live.advance("board")
    return live.board()


@query(f"""
SELECT b.*, coalesce(s.current, 0) AS current, coalesce(s.best, 0) AS best
FROM board b LEFT JOIN ({STREAK_SQL}) s USING ("user")""", "board runs")
def stream_late_outcomes(spark, sf_dir):
    """The same board where outcomes arrive after the votes, first a wrong one for every third event."""
    outcomes, path = B.outcomes(spark, sf_dir), new_dir(spark, "landed")
    third = F.col("event_id") % 3 == 0
    wrong = F.when(F.col("outcome") == "CRL", "APPROVE").otherwise("CRL")
    early = F.col("decided_at") - F.expr("INTERVAL 5 DAYS")
    outcomes.filter("false").write.parquet(path)
    live = L.LiveTables(
        new_dir(spark, "live"), _landing(spark, B.votes(spark, sf_dir), "id", 3),
        spark.readStream.schema(outcomes.schema).parquet(path), **_parts(spark),
    )
    live.advance("board")
    first = outcomes.filter(third).select("event_id", wrong.alias("outcome"), early.alias("decided_at"))
    for landed in (first, outcomes.filter(~third), outcomes.filter(third)):
        landed.write.mode("append").parquet(path)
        live.advance("board")
    return live.board()


@query(f"""
SELECT event_id, strftime(date_trunc('day', created_at), '%Y-%m-%d') AS day, count(*) AS votes,
  {pct_sql("count(*) FILTER (label = 'APPROVE')", 'count(*)')} AS approve_pct
FROM vote GROUP BY event_id, date_trunc('day', created_at)
HAVING date_trunc('day', created_at) + INTERVAL 1 DAY
  <= (SELECT max(created_at) - INTERVAL 1 HOUR FROM vote)""", "vote")
def stream_vote_trend(spark, sf_dir):
    """Completed one-day windows of a vote stream that lands in three parts, the earliest first."""
    path, landed, state = (new_dir(spark, n) for n in ("trend", "landed", "live"))
    votes = B.votes(spark, sf_dir)
    cuts = [F.lit(day).cast("timestamp") for day in ("2024-01-11", "2024-01-21")]
    at = F.col("created_at")
    for part in (at < cuts[0], (at >= cuts[0]) & (at < cuts[1]), at >= cuts[1]):
        votes.filter(part).write.mode("append").parquet(landed)
        stream = spark.readStream.schema(votes.schema).parquet(landed)
        V.write_trend(V.vote_trend(stream), path, state)
    return spark.read.parquet(path).select(
        "event_id", F.date_format("start", "yyyy-MM-dd").alias("day"), "votes", "approve_pct"
    )


@query("""
SELECT event_id, CASE WHEN approve_pct >= 80 THEN 'STRONG' WHEN approve_pct >= 60 THEN 'GOOD'
  WHEN approve_pct >= 40 THEN 'WEAK' ELSE 'POOR' END AS band FROM crowd""", "crowd")
def sentiment_bands(spark, sf_dir):
    by_event = K.sentiment(K.current_votes(B.votes(spark, sf_dir)))
    return by_event.select("event_id", C.sentiment_band("approve_pct").alias("band"))
