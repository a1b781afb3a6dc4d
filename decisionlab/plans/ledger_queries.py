"""Queries over the outcome ledger and its integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from decisionlab.functions import columns as C
from decisionlab.operators import integrity as I
from decisionlab.operators import ledger as L
from decisionlab.operators import ledger_tree as T
from decisionlab.operators.ordered import number_rows, placed
from decisionlab.plans import bindings as B
from decisionlab.plans.oracle_views import action_sql, number_sql, pct_sql, tier_sql
from decisionlab.plans.registry import query, r6, text
from decisionlab.session import cut_lineage, new_dir
from decisionlab.sources import documents


@query("SELECT seq, outcome, tier, action FROM ledger WHERE NOT correct", "ledger")
def ledger_misses(spark, sf_dir):
    return L.ledger_filter(B.ledger(spark, sf_dir), "incorrect").select(
        "seq", "outcome", "tier", "action"
    )


MOVE = f"CAST({number_sql('move')} AS DOUBLE)"


@query(f"""
SELECT seq, move, row_number() OVER (ORDER BY abs({MOVE}) DESC NULLS LAST, seq) AS place
FROM ledger WHERE correct""", "ledger")
def ledger_by_move(spark, sf_dir):
    hits = L.ledger_filter(B.ledger(spark, sf_dir), "correct")
    return placed(L.sort_ledger(hits, "move").select("seq", "move"))


@query("""
SELECT seq, CAST(date AS VARCHAR) AS date,
  row_number() OVER (ORDER BY ledger.date DESC NULLS LAST, seq) AS place FROM ledger""", "ledger")
def ledger_by_date(spark, sf_dir):
    return placed(L.sort_ledger(B.ledger(spark, sf_dir), "date").select("seq", text("date")))


@query("""
SELECT seq, round(score, 6) AS score, row_number() OVER (ORDER BY ledger.score DESC NULLS LAST, seq) AS place
FROM ledger""", "ledger")
def ledger_by_score(spark, sf_dir):
    return placed(L.sort_ledger(B.ledger(spark, sf_dir), "score").select("seq", r6("score")))


@query(f"""
SELECT count(*) AS total, count(*) FILTER (correct) AS correct,
  {pct_sql('count(*) FILTER (correct)', 'count(*)')} AS accuracy,
  count(*) FILTER (tier = 'TIER_1') AS tier_1,
  count(*) FILTER (tier = 'TIER_1' AND correct) AS tier_1_correct,
  count(*) FILTER (tier = 'TIER_4') AS tier_4,
  count(*) FILTER (tier = 'TIER_4' AND correct) AS tier_4_correct,
  (SELECT seq FROM ledger WHERE correct ORDER BY {MOVE} DESC, seq LIMIT 1) AS best_seq,
  max({MOVE}) FILTER (correct) AS best_move,
  round(avg({MOVE}) FILTER (correct AND action = 'BUY' AND outcome <> 'CRL'), 6) AS mean_win_move
FROM ledger""", "ledger")
def track_record(spark, sf_dir):
    record = L.track_record(B.ledger(spark, sf_dir))
    return record.withColumn("mean_win_move", F.round("mean_win_move", 6))


@query(f"""
SELECT outcome, action, count(*) AS total, count(*) FILTER (correct) AS correct,
  {pct_sql('count(*) FILTER (correct)', 'count(*)')} AS accuracy FROM ledger GROUP BY 1, 2""", "ledger")
def accuracy_by_outcome(spark, sf_dir):
    return L.accuracy_by(B.ledger(spark, sf_dir), "outcome", "action")


CURVE = f"""
  SELECT seq, date, 10000 + 10000.0 / count(*) OVER () * CAST(sum(CASE WHEN action = 'BUY'
      AND ((correct AND outcome IN ('APPROVED', 'POSITIVE', 'BEAT', 'MEET')) OR NOT correct)
      THEN {number_sql('move')} ELSE 0 END) OVER (ORDER BY date, seq) AS DOUBLE) / 100 AS balance
  FROM ledger"""


@query(f"""
SELECT seq, CAST(date AS VARCHAR) AS date, round(balance, 4) AS balance FROM ({CURVE})""", "ledger")
def equity_curve(spark, sf_dir):
    return L.equity_curve(B.ledger(spark, sf_dir)).select(
        "seq", text("date"), r6("balance", places=4)
    )


@query(f"""
SELECT round(least(min(balance), 10000), 4) AS low, round(max(balance), 4) AS high,
  round(max(balance) - least(min(balance), 10000), 4) AS range,
  round((SELECT balance FROM ({CURVE}) ORDER BY date DESC, seq DESC LIMIT 1), 4) AS "end"
FROM ({CURVE})""", "ledger")
def equity_range(spark, sf_dir):
    span = L.equity_range(L.equity_curve(B.ledger(spark, sf_dir)))
    return span.select(*[r6(c, places=4) for c in ("low", "high", "range", "end")])


@query("""
SELECT seq, round(avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) OVER (
  ORDER BY date, seq ROWS BETWEEN 16 PRECEDING AND CURRENT ROW), 6) AS form FROM ledger""", "ledger")
def recent_form(spark, sf_dir):
    return L.recent_form(B.ledger(spark, sf_dir)).select("seq", r6("form"))


@query("SELECT seq, line FROM canon", "canon")
def canonical_ledger(spark, sf_dir):
    return I.canonical_ledger(B.ledger(spark, sf_dir))


# Small blocks, so that any table has several levels and most tickers several chains.
DIGEST_LINES, CHAIN_LINES = 10, 4


@query(f"""
WITH RECURSIVE tree AS (
  SELECT 0 AS level, n, line, count(*) OVER () AS total
  FROM (SELECT line, row_number() OVER (ORDER BY seq) AS n FROM canon)
  UNION ALL
  SELECT level + 1, b, line, count(*) OVER () FROM (
    SELECT level, (n - 1) // {DIGEST_LINES} + 1 AS b,
      sha256(CASE WHEN level = 0 THEN 'lines' ELSE 'hashes' END || chr(10)
        || string_agg(line, chr(10) ORDER BY n)) AS line
    FROM tree WHERE level = 0 OR total > 1 GROUP BY 1, 2))
SELECT sha256('ledger' || chr(10) || (SELECT count(*) FROM canon) || chr(10)
  || arg_max(line, level)) AS digest FROM tree""", "canon")
def ledger_digest(spark, sf_dir):
    return I.ledger_digest(I.canonical_ledger(B.ledger(spark, sf_dir)), DIGEST_LINES)


def _grown_tree(spark, sf_dir):
    """The ledger's lines, written once, their tree after three appends, and the digest after each."""
    lines = cut_lineage(I.canonical_ledger(B.ledger(spark, sf_dir), "correct"))
    tree, told = T.LedgerTree(spark, new_dir(spark, "tree"), DIGEST_LINES), []
    third = F.floor(F.col("seq") * 3 / (lines.agg(F.max("seq")).scalar() + 1))
    for part in range(3):
        size = tree.append(lines.filter(third == part))
        told.append((size, tree.digest()))
    return lines, tree, told


@query(f"""
WITH RECURSIVE numbered AS (
  SELECT line, row_number() OVER (ORDER BY seq) AS n,
    floor(seq * 3 / ((SELECT max(seq) FROM canon) + 1)) AS part FROM canon
), sizes AS (SELECT DISTINCT max(n) AS size FROM numbered GROUP BY part),
tree AS (
  SELECT size, 0 AS level, n, line, size AS total FROM sizes JOIN numbered ON n <= size
  UNION ALL
  SELECT size, level + 1, b, line, count(*) OVER (PARTITION BY size) FROM (
    SELECT size, level, (n - 1) // {DIGEST_LINES} + 1 AS b,
      sha256(CASE WHEN level = 0 THEN 'lines' ELSE 'hashes' END || chr(10)
        || string_agg(line, chr(10) ORDER BY n)) AS line
    FROM tree WHERE level = 0 OR total > 1 GROUP BY 1, 2, 3))
SELECT size AS lines, sha256('ledger' || chr(10) || size || chr(10) || arg_max(line, level)) AS digest,
  true AS only_appended FROM tree GROUP BY size""", "canon")
def ledger_appends(spark, sf_dir):
    """Digest after each of three appends, and whether the last ledger is shown to begin with that one."""
    _, tree, told = _grown_tree(spark, sf_dir)
    # One row an append.
    return spark.createDataFrame(
        [(size, digest, T.only_appended(tree, size, digest)) for size, digest in dict(told).items()],
        "lines long, digest string, only_appended boolean",
    )


@query(f"""
WITH RECURSIVE numbered AS (SELECT seq, line, row_number() OVER (ORDER BY seq) AS n FROM canon),
tree AS (
  SELECT 0 AS level, n, line, count(*) OVER () AS total FROM numbered
  UNION ALL
  SELECT level + 1, b, line, count(*) OVER () FROM (
    SELECT level, (n - 1) // {DIGEST_LINES} + 1 AS b,
      sha256(CASE WHEN level = 0 THEN 'lines' ELSE 'hashes' END || chr(10)
        || string_agg(line, chr(10) ORDER BY n)) AS line
    FROM tree WHERE level = 0 OR total > 1 GROUP BY 1, 2)),
missed AS (SELECT n.seq, n.n FROM numbered n JOIN ledger USING (seq) WHERE NOT correct)
SELECT seq, m.n - 1 AS place, count(*) AS steps, true AS shown,
  sha256(string_agg(line, ',' ORDER BY level)) AS path_sha256
FROM missed m JOIN tree t ON level > 0 AND t.n = (m.n - 1) // CAST(pow({DIGEST_LINES}, level) AS BIGINT) + 1
GROUP BY seq, m.n""", "canon ledger")
def ledger_proofs(spark, sf_dir):
    """For every wrong call, that its line is part of the digest: the hashes on its path, and whether they show it."""
    written, tree, told = _grown_tree(spark, sf_dir)
    size, digest = told[-1]
    lines = number_rows(written, ["seq"], "n")
    missed = lines.filter(~F.col("correct")).select("seq", "line", (F.col("n") - 1).alias("place"))
    shown = T.holds_line(F.col("path"), F.col("line"), size, digest)
    return missed.join(tree.paths(missed.select("place")), "place").select(
        "seq", "place", F.size("path").cast("long").alias("steps"), shown.alias("shown"),
        F.sha2(F.array_join(T.path_hashes(F.col("path")), ",").cast("binary"), 256).alias("path_sha256"),
    )


@query("SELECT event_id, event_id % 9 <> 0 AS sealed FROM flags", "flags")
def verify_seals(spark, sf_dir):
    checked = I.verify_seals(documents.parse_sealed(B.sealed_documents(spark, sf_dir)))
    return checked.select("event_id", "sealed")


def _chain(spark, sf_dir):
    return I.build_chain(B.chain_lines(spark, sf_dir), "ticker", CHAIN_LINES)


CHAIN = f"""
  WITH RECURSIVE numbered AS (
    SELECT ticker, seq, line, row_number() OVER (PARTITION BY ticker ORDER BY seq) AS n FROM canon),
  chain AS (
    SELECT ticker, seq, n, sha256(line) AS hash FROM numbered WHERE n % {CHAIN_LINES} = 1
    UNION ALL
    SELECT x.ticker, x.seq, x.n, sha256(c.hash || x.line)
    FROM chain c JOIN numbered x ON x.ticker = c.ticker AND x.n = c.n + 1
    WHERE x.n % {CHAIN_LINES} <> 1)"""


@query(f"""
SELECT *, (n - 1) // {CHAIN_LINES} AS block FROM ({CHAIN} SELECT ticker, seq, n, hash FROM chain)""", "canon")
def build_chain(spark, sf_dir):
    return _chain(spark, sf_dir).select("ticker", "seq", "n", "hash", "block")


@query(f"""
WITH RECURSIVE ends AS (
  SELECT ticker, (n - 1) // {CHAIN_LINES} AS block, arg_max(hash, n) AS line
  FROM ({CHAIN} SELECT ticker, n, hash FROM chain) GROUP BY 1, 2),
up AS (
  SELECT 0 AS level, ticker, block, line, count(*) OVER (PARTITION BY ticker) AS total FROM ends
  UNION ALL
  SELECT level + 1, ticker, b, line, count(*) OVER (PARTITION BY ticker) FROM (
    SELECT level, ticker, block // {CHAIN_LINES} AS b,
      list_reduce(list_prepend('', list(line ORDER BY block)), lambda h, x: sha256(h || x)) AS line
    FROM up WHERE level = 0 OR total > 1 GROUP BY 1, 2, 3))
SELECT ticker, arg_max(line, level) AS head FROM up GROUP BY 1""", "canon")
def chain_heads(spark, sf_dir):
    return I.chain_heads(_chain(spark, sf_dir), "ticker", CHAIN_LINES)


RECORDS = """
  SELECT id, ticker, ts, hash,
    CASE WHEN id % 11 = 0 AND prior IS NOT NULL THEN sha256('lost') ELSE prior END AS prior_hash,
    prior
  FROM (SELECT *, lag(hash) OVER (PARTITION BY ticker ORDER BY ts, id) AS prior
    FROM (SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS ticker, o_orderdate AS ts,
      sha256(CAST(o_orderkey AS VARCHAR)) AS hash FROM orders))"""


@query(f"""
SELECT id, prior_hash, prior AS expected_hash, prior_hash IS NOT DISTINCT FROM prior AS intact
FROM ({RECORDS})""")
def verify_chain(spark, sf_dir):
    return I.verify_chain(B.linked_records(spark, sf_dir), "ticker").select(
        "id", "prior_hash", "expected_hash", "intact"
    )


@query(f"""
SELECT r.id, CASE WHEN r.prior_hash IS NULL THEN 'ROOT' WHEN p.id IS NULL THEN 'BROKEN'
  ELSE 'LINKED' END AS link, p.id AS prior_id
FROM ({RECORDS}) r LEFT JOIN ({RECORDS}) p ON p.hash = r.prior_hash""")
def link_records(spark, sf_dir):
    return I.link_records(B.linked_records(spark, sf_dir)).select("id", "link", "prior_id")


@query(f"""
SELECT 'tier differs from stored probability' AS rule, CAST(event_id AS VARCHAR) AS key FROM scored
WHERE stored_tier <> {tier_sql('stored_prob')}
UNION ALL SELECT 'weekend flag differs from date', CAST(event_id AS VARCHAR) FROM scored
WHERE weekend <> (isodow(event_date) >= 6)
UNION ALL SELECT 'stored adjustment differs from signals', CAST(event_id AS VARCHAR) FROM scored
WHERE abs(stored_total_adj - total_adj) > 0.0001
UNION ALL SELECT 'area without rate', CAST(event_id AS VARCHAR) FROM scored
WHERE area NOT IN (SELECT area FROM rates)
UNION ALL SELECT 'ledger tier differs from score', CAST(seq AS VARCHAR) FROM ledger
WHERE tier <> {tier_sql('(score / 100)')}
UNION ALL SELECT 'ledger action differs from tier', CAST(seq AS VARCHAR) FROM ledger
WHERE (action = 'AVOID') <> ({action_sql('tier')} = 'AVOID')
UNION ALL SELECT 'conflicting outcomes', ticker || '|' || drug FROM ledger
GROUP BY ticker, drug HAVING count(DISTINCT outcome) > 1""", "scored rates ledger")
def audit(spark, sf_dir):
    """Scored once and stored, since the rules read the events and the ledger four times."""
    scored = cut_lineage(B.scored(spark, sf_dir).drop("signals", "designations"))
    return I.audit(scored, B.ledger_of(scored), B.rates(spark))


def _snapshots(spark, sf_dir):
    """The ledger, and the same with some rows gone, some new and some with another tier."""
    rows = cut_lineage(
        B.ledger(spark, sf_dir).select("seq", "ticker", "date", "outcome", "score", "tier")
    )
    old = rows.filter(F.col("seq") % 13 != 0)
    tier = F.when(F.col("seq") % 17 == 0, "TIER_X").otherwise(F.col("tier"))
    return old, rows.filter(F.col("seq") % 19 != 0).withColumn("tier", tier)


DIFF = """
  SELECT seq, CASE WHEN seq % 13 = 0 THEN 'added' WHEN seq % 19 = 0 THEN 'removed'
    ELSE 'changed' END AS change
  FROM ledger WHERE (seq % 13 = 0) <> (seq % 19 = 0)
    OR (seq % 13 <> 0 AND seq % 19 <> 0 AND seq % 17 = 0)"""


@query(DIFF, "ledger")
def ledger_diff(spark, sf_dir):
    return I.ledger_diff(*_snapshots(spark, sf_dir))


@query(f"""
SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed,
  count(*) FILTER (change = 'changed') AS changed,
  count(*) FILTER (change <> 'added') > 0 AS violated FROM ({DIFF})""", "ledger")
def ledger_diff_summary(spark, sf_dir):
    return I.diff_summary(I.ledger_diff(*_snapshots(spark, sf_dir)))


LEAD = "o_orderkey % 60 + 3"


@query(f"""
SELECT CASE WHEN k % 5 = 0 THEN 'EW-' ELSE 'TS-' END || CAST(k AS VARCHAR) AS id,
  k % 4 = 0 AS legendary, k % 4 IN (1, 2) AS loss_avoided, k % 5 = 0 AS early_warning,
  k % 4 <> 3 AS win, {LEAD} - CASE WHEN k % 24 > 12 THEN 1 ELSE 0 END AS lead_days,
  {LEAD} + k % 9 - 4 AS outcome_lead_days
FROM (SELECT *, o_orderkey AS k FROM orders)""")
def prediction_flags(spark, sf_dir):
    flagged = L.prediction_flags(B.stamped(spark, sf_dir), "EW")
    return flagged.select(
        "id", "legendary", "loss_avoided", "early_warning", "win", "lead_days",
        F.col("outcome_lead_days").cast("long"),
    )


@query(f"""
SELECT count(*) AS total, count(*) FILTER (k % 4 <> 3) AS wins, count(*) FILTER (k % 10 = 0) AS hashed,
  min(lead) AS min_lead, max(lead) AS max_lead, CAST(sum(lead) AS BIGINT) AS sum_lead
FROM (SELECT o_orderkey AS k, {LEAD} - CASE WHEN o_orderkey % 24 > 12 THEN 1 ELSE 0 END AS lead
  FROM orders)""")
def proof_summary(spark, sf_dir):
    return L.proof_summary(L.prediction_flags(B.stamped(spark, sf_dir), "EW"))


@query("""
SELECT o_orderkey AS event_id, CASE k % 3 WHEN 0 THEN lo WHEN 1 THEN lo END AS lo,
  CASE k % 3 WHEN 0 THEN lo WHEN 1 THEN lo + 5 END AS hi,
  CASE k % 3 WHEN 0 THEN 'APPROVAL' WHEN 1 THEN 'POSITIVE' END AS label,
  CAST(CASE WHEN k % 6 > 0 THEN k % 900 + 0.25 END AS DOUBLE) AS price,
  CASE WHEN k % 7 < 2 THEN NULL WHEN k % 7 = 2 THEN -lo ELSE lo + 0.5 END AS gain
FROM (SELECT *, o_orderkey AS k, CAST(o_orderkey % 40 + 40 AS DOUBLE) AS lo FROM orders)""")
def prediction_texts(spark, sf_dir):
    return B.stamped(spark, sf_dir).select(
        "event_id",
        C.score_range("prediction").alias("r"),
        C.money_value("price_at").alias("price"),
        C.leading_number("peak_gain").cast("double").alias("gain"),
    ).select("event_id", "r.lo", "r.hi", "r.label", "price", "gain")


@query("""
SELECT o_orderkey AS event_id, k % 30 AS holding_days,
  round((exit_p - entry) / entry * 100, 6) AS gain_pct,
  round((exit_p - post) / exit_p * 100, 6) AS avoided_pct,
  round((exit_p - entry) / entry * 100 + (exit_p - post) / exit_p * 100, 6) AS net_swing
FROM (SELECT *, o_orderkey AS k, o_totalprice AS entry, o_totalprice * (1 + o_orderkey % 20 / 100.0) AS exit_p,
  o_totalprice * (1 - o_orderkey % 70 / 100.0) AS post FROM orders)""")
def trade_metrics(spark, sf_dir):
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    day = F.col("o_orderdate").cast("date")
    trades = B.table(spark, sf_dir, "orders").select(
        key.alias("event_id"),
        day.alias("entry_date"),
        F.date_add(day, (key % 30).cast("int")).alias("exit_date"),
        price.alias("entry_price"),
        (price * (key % 20 / 100.0 + 1)).alias("exit_price"),
        (price * (1 - key % 70 / 100.0)).alias("post_price"),
    )
    return L.trade_metrics(trades).select(
        "event_id", F.col("holding_days").cast("long"), r6("gain_pct"), r6("avoided_pct"),
        r6("net_swing"),
    )


@query("""
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, date_diff('day', o_orderdate, l_shipdate) - 60 AS delay_days,
  CASE WHEN date_diff('day', o_orderdate, l_shipdate) < 60 THEN 'EARLY'
    WHEN date_diff('day', o_orderdate, l_shipdate) > 60 THEN 'LATE' ELSE 'ON TIME' END AS timing
FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def decision_delays(spark, sf_dir):
    lines, orders = B.table(spark, sf_dir, "lineitem"), B.table(spark, sf_dir, "orders")
    dated = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey",
        F.col("l_linenumber").cast("long").alias("l_linenumber"),
        F.date_add(F.col("o_orderdate").cast("date"), 60).alias("scheduled_date"),
        F.col("l_shipdate").cast("date").alias("actual_date"),
    )
    return L.decision_delay(dated).select(
        "l_orderkey", "l_linenumber", F.col("delay_days").cast("long"), "timing"
    )
