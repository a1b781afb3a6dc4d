"""The event tables as SQL over the given tables, for checking in DuckDB."""

from __future__ import annotations

from decisionlab import dims
from decisionlab.plans import bindings as B


def tier_sql(p: str) -> str:
    return (
        f"CASE WHEN {p} > 0.85 THEN 'TIER_1' WHEN {p} >= 0.70 THEN 'TIER_2' "
        f"WHEN {p} >= 0.60 THEN 'TIER_3' WHEN {p} IS NOT NULL THEN 'TIER_4' END"
    )


def action_sql(t: str) -> str:
    return (
        f"CASE {t} WHEN 'TIER_1' THEN 'BUY' WHEN 'TIER_2' THEN 'BUY' "
        f"WHEN 'TIER_3' THEN 'RUNUP_ONLY' WHEN 'TIER_4' THEN 'AVOID' END"
    )


def zone_sql(d: str) -> str:
    return (
        f"CASE WHEN {d} < 0 THEN 'EXPIRED' WHEN {d} <= 3 THEN 'DANGER' WHEN {d} <= 7 THEN 'EXIT' "
        f"WHEN {d} <= 14 THEN 'PEAK' WHEN {d} <= 25 THEN 'OPTIMAL' WHEN {d} <= 45 THEN 'EARLY' "
        f"WHEN {d} IS NOT NULL THEN 'FAR' END"
    )


def kind_sql(t: str) -> str:
    return (
        f"CASE WHEN {t} IN ('PDUFA', 'PDUFA (Expected)') THEN 'decision' "
        f"WHEN {t} IN ('Phase 2 Readout', 'Phase 3 Readout') THEN 'readout' END"
    )


def pct_sql(a: str, n: str) -> str:
    """100 * a / n, half up to one decimal, 0 when n is 0."""
    return f"(floor((({a}) * 2000 + greatest({n}, 1)) / (greatest({n}, 1) * 2)) / 10.0)"


def correct_sql(p: str, o: str) -> str:
    return (
        f"CASE WHEN {o} IN ('APPROVED', 'APPROVE') THEN {p} >= 0.60 "
        f"WHEN {o} = 'CRL' THEN {p} < 0.60 END"
    )


def number_sql(t: str) -> str:
    return (
        f"TRY_CAST(nullif(regexp_extract({t}, "
        f"'^\\s*([+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+))', 1), '') AS DECIMAL(18,6))"
    )


def _values(rows: list[tuple], names: str) -> str:
    def cell(v: object) -> str:
        return "'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v)

    body = ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) t({names})"


def _weights(rows: list[tuple[str, str, str]]) -> str:
    table = _values(rows, "category, signal, w")
    return f"SELECT signal, category, CAST(w AS DECIMAL(12,6)) AS weight FROM ({table})"


def _scored(weights: str) -> str:
    return f"""
    SELECT *, {action_sql('tier')} AS action FROM (
      SELECT *, {tier_sql('prob')} AS tier FROM (
        SELECT e.*, CAST(coalesce(t.total, 0) AS DOUBLE) AS total_adj,
          CAST(1.3957 + coalesce(t.total, 0) AS DOUBLE) AS logit,
          1 / (1 + exp(-CAST(1.3957 + coalesce(t.total, 0) AS DOUBLE))) AS prob
        FROM event e LEFT JOIN (
          SELECT s.event_id, sum(w.weight) AS total
          FROM signal s JOIN {weights} w ON w.signal = s.signal GROUP BY 1
        ) t ON t.event_id = e.event_id))"""


_W68 = {signal: (category, weight) for category, signal, weight in dims.WEIGHTS_V10_68}
_W69 = _W68 | {signal: (category, weight) for category, signal, weight in dims.WEIGHTS_V10_69_CHANGES}

# name -> (views it reads, SQL)
VIEWS: dict[str, tuple[str, str]] = {
    "w68": ("", _weights([(c, s, w) for s, (c, w) in _W68.items()])),
    "w69": ("", _weights([(c, s, w) for s, (c, w) in _W69.items()])),
    "rates": ("", "SELECT area, approved, total, CAST(rate AS DOUBLE) AS rate FROM ("
              + _values(B.SEGMENT_RATES, "area, approved, total, rate") + ")"),
    "risk": ("", _values(B.SEGMENT_RISK, "area, risk")),
    "conf": ("", "SELECT name, area, CAST(day AS DATE) AS abstract_release FROM ("
             + _values(B.SEGMENT_CONFERENCES, "name, area, day") + ")"),
    "event": ("risk", f"""
    SELECT o.o_orderkey AS event_id, CAST(o.o_custkey AS VARCHAR) AS ticker, c.c_name AS company,
      'compound-' || CAST(o.o_custkey % 251 AS VARCHAR) AS drug,
      'indication-' || CAST(c.c_nationkey AS VARCHAR) AS indication,
      c.c_mktsegment AS area, CAST(o.o_orderdate AS DATE) AS event_date,
      CASE o.o_orderpriority WHEN '1-URGENT' THEN 'PDUFA' WHEN '2-HIGH' THEN 'PDUFA'
        WHEN '3-MEDIUM' THEN 'PDUFA (Expected)' WHEN '4-NOT SPECIFIED' THEN 'Phase 3 Readout'
        ELSE 'Phase 2 Readout' END AS type,
      CASE o.o_orderpriority WHEN '3-MEDIUM' THEN 'NDA' WHEN '5-LOW' THEN 'Phase 2'
        ELSE 'Phase 3' END AS phase,
      CASE o.o_orderstatus WHEN 'F' THEN 'APPROVED' WHEN 'O' THEN 'CRL' ELSE 'DELAYED' END AS outcome,
      o.o_orderkey % 700 AS enrollment,
      CASE c.c_nationkey % 4 WHEN 0 THEN 'Small Molecule' WHEN 1 THEN 'Gene Therapy'
        WHEN 2 THEN 'ADC' ELSE 'Monoclonal Antibody' END AS modality,
      isodow(CAST(o.o_orderdate AS DATE)) >= 6 AS weekend,
      o.o_orderkey % 11 = 0 AS avoid,
      k.risk AS area_risk,
      o.o_totalprice / 500000.0 AS stored_prob,
      {tier_sql('o.o_totalprice / 500000.0')} AS stored_tier,
      (o.o_orderkey % 900) / 100.0 - 4.0 AS stored_total_adj,
      (o.o_orderkey % 900) / 100.0 - 4.0 + 1.3957 AS stored_logit
    FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
      LEFT JOIN risk k ON k.area = c.c_mktsegment"""),
    "line": ("", """
    SELECT l_orderkey, count(*) AS n_lines, count(*) FILTER (l_returnflag = 'R') AS n_r,
      count(*) FILTER (l_returnflag = 'A') AS n_a, max(l_discount) AS max_discount,
      min(l_quantity) AS min_quantity, sum(l_quantity) AS sum_quantity
    FROM lineitem GROUP BY 1"""),
    "flags": ("line", """
    SELECT o.o_orderkey AS event_id, list_filter([
      CASE WHEN o.o_orderpriority = '1-URGENT' THEN 'priority_review' END,
      CASE WHEN c.c_acctbal >= 5000 THEN 'experienced_sponsor' END,
      CASE WHEN c.c_acctbal < 1000 THEN 'inexperienced_sponsor' END,
      CASE WHEN n_r >= 3 THEN 'prior_CRL' END,
      CASE WHEN n_r >= 3 AND n_a >= 1 THEN 'resubmission_post_CRL' END,
      CASE WHEN max_discount >= 0.1 THEN 'form_483' END,
      CASE WHEN min_quantity <= 5 THEN 'orphan' END,
      CASE WHEN n_lines >= 6 THEN 'BTD' END,
      CASE WHEN sum_quantity < 50 THEN 'small_pivotal_n' END,
      CASE c.c_mktsegment WHEN 'HOUSEHOLD' THEN 'ta_low_risk' WHEN 'BUILDING' THEN 'ta_low_risk'
        WHEN 'MACHINERY' THEN 'ta_moderate_risk' WHEN 'FURNITURE' THEN 'ta_high_risk'
        WHEN 'AUTOMOBILE' THEN 'ta_very_high_risk' END], lambda x: x IS NOT NULL) AS signals
    FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
      LEFT JOIN line l ON l.l_orderkey = o.o_orderkey"""),
    "signal": ("flags", """
    SELECT event_id, unnest(range(len(signals))) AS pos, unnest(signals) AS signal FROM flags"""),
    "scored": ("event signal w68", _scored("w68")),
    "scored69": ("event signal w69", _scored("w69")),
    "orig": ("", """
    SELECT CAST(c_custkey AS VARCHAR) AS ticker, (c_acctbal + 1000) / 11000 AS orig_score,
      CASE WHEN (c_acctbal + 1000) / 11000 >= 0.6 THEN 'TRADED' ELSE 'AVOIDED' END AS action
    FROM customer"""),
    "vote": ("", """
    SELECT CAST(event_id AS VARCHAR) AS id, user_id AS "user",
      CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS event_id,
      CASE WHEN event_type IN ('click', 'signup', 'purchase') THEN 'APPROVE' ELSE 'CRL' END AS label,
      ts AS created_at, event_id AS seq
    FROM events"""),
    "latest": ("vote", """
    SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
      PARTITION BY "user", event_id ORDER BY created_at DESC, seq DESC) AS rn FROM vote)
    WHERE rn = 1"""),
    "decided": ("", """
    SELECT o_orderkey AS event_id,
      CASE o_orderstatus WHEN 'F' THEN 'APPROVE' WHEN 'O' THEN 'CRL' ELSE 'DELAYED' END AS outcome,
      CAST(DATE '2024-01-05' + CAST(o_orderkey % 40 AS INTEGER) AS TIMESTAMP) AS decided_at
    FROM orders"""),
    "crowd": ("latest", f"""
    SELECT event_id, count(*) AS total_votes,
      count(*) FILTER (label = 'APPROVE') AS approve_votes,
      count(*) FILTER (label = 'CRL') AS crl_votes,
      {pct_sql("count(*) FILTER (label = 'APPROVE')", 'count(*)')} AS approve_pct
    FROM latest GROUP BY 1"""),
    "judged": ("latest decided", """
    SELECT l.*, d.outcome, d.decided_at, l.label = d.outcome AS correct
    FROM latest l JOIN decided d USING (event_id)"""),
    "runs": ("judged", """
    SELECT "user", run, count(*) FILTER (correct) AS length FROM (
      SELECT *, sum(CASE WHEN correct THEN 0 ELSE 1 END) OVER (
        PARTITION BY "user" ORDER BY decided_at, event_id) AS run FROM judged)
    GROUP BY 1, 2"""),
    "board": ("latest decided", f"""
    SELECT l."user", count(*) AS total_predictions, count(d.outcome) AS scored_predictions,
      count(*) FILTER (l.label = d.outcome) AS correct,
      {pct_sql('count(*) FILTER (l.label = d.outcome)', 'count(d.outcome)')} AS accuracy_pct,
      count(*) FILTER (l.label = d.outcome) * 10 AS points
    FROM latest l LEFT JOIN decided d USING (event_id) GROUP BY 1"""),
    "ledger": ("scored", f"""
    SELECT event_id AS seq, ticker, drug, indication, event_date AS date, type, outcome,
      round(prob * 100, 4) AS score, tier,
      CASE WHEN prob >= 0.6 THEN 'BUY' ELSE 'AVOID' END AS action,
      {correct_sql('prob', 'outcome')} AS correct,
      (CASE WHEN outcome = 'APPROVED' THEN '+' ELSE '-' END)
        || CAST(event_id % 97 AS VARCHAR) || '%' AS move, area
    FROM scored WHERE outcome <> 'DELAYED'"""),
    "canon": ("ledger", """
    SELECT seq, ticker, ticker || '|' || CAST(date AS VARCHAR) || '|' || outcome || '|'
      || regexp_replace(CAST(score AS VARCHAR), '\\.0$', '') || '|'
      || CASE WHEN correct THEN 'true' ELSE 'false' END AS line
    FROM ledger"""),
    "trade": ("", """
    SELECT CAST(l_suppkey AS VARCHAR) AS ticker, CAST(l_partkey AS VARCHAR) AS insider,
      CASE WHEN l_returnflag = 'R' THEN 'P-Purchase' ELSE 'S-Sale' END AS transaction_type,
      CAST(l_shipdate AS DATE) AS date, l_quantity AS shares,
      l_extendedprice / l_quantity AS price, l_orderkey * 8 + l_linenumber AS seq
    FROM lineitem"""),
    "quote": ("", """
    SELECT CAST(o_custkey AS VARCHAR) AS ticker, o_orderdate AS ts, o_totalprice AS price,
      o_orderkey AS seq FROM orders"""),
    "norm_quote": ("quote", """
    SELECT ticker, ts, seq,
      CASE WHEN price >= 20000 THEN price END AS price,
      CAST(CASE WHEN price < 20000 THEN 0.0 WHEN seq % 3 = 0 AND seq % 50 <> 0 THEN seq % 50
        WHEN seq % 2 = 0 THEN 2.5 ELSE 0.0 END AS DOUBLE) AS change_pct,
      CAST(CASE WHEN price < 20000 THEN 0 ELSE seq % 4 END AS DOUBLE) AS change,
      CAST(CASE WHEN price < 20000 OR seq % 5 = 0 THEN 0 ELSE seq % 1000 END AS DOUBLE) AS volume,
      CASE WHEN price < 20000 THEN 0.0 ELSE price * 10 END AS market_cap,
      CASE WHEN price >= 20000 AND seq % 6 = 1 THEN 'name-' || ticker ELSE ticker END AS name
    FROM quote"""),
    "last_quote": ("norm_quote", """
    SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
      PARTITION BY ticker ORDER BY ts DESC, seq DESC) AS rn FROM norm_quote) WHERE rn = 1"""),
    "runway": ("", """
    SELECT *, CASE WHEN burn > 0 THEN cash / burn END AS quarters,
      nullif(CASE WHEN burn > 0 THEN cash / burn END, 0) * 3 AS months
    FROM (
      SELECT *, CASE WHEN op_cash_flow < 0 THEN abs(op_cash_flow) / 4 ELSE 0 END AS burn
      FROM (
        SELECT CAST(o_custkey AS VARCHAR) AS ticker, date_trunc('quarter', o_orderdate) AS ts,
          any_value(c_acctbal) AS cash,
          CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END
            * CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS op_cash_flow,
          row_number() OVER (PARTITION BY o_custkey
            ORDER BY date_trunc('quarter', o_orderdate) DESC) AS rn
        FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey, 2)
      WHERE rn = 1)"""),
    "insider": ("trade", """
    SELECT *, CASE WHEN buys > sells THEN 'BULLISH' WHEN buys < sells THEN 'BEARISH'
      ELSE 'NEUTRAL' END AS signal
    FROM (SELECT ticker, count(*) FILTER (transaction_type = 'P-Purchase') AS buys,
      count(*) FILTER (transaction_type <> 'P-Purchase') AS sells FROM trade GROUP BY 1)"""),
    "social": ("", """
    SELECT CAST(d.doc_id % 50 AS VARCHAR) AS ticker, d.source AS platform,
      avg(l.quality) * 100 AS score, count(l.quality) AS n
    FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1, 2"""),
    "watch": ("", """
    SELECT o_custkey AS "user", o_orderkey AS event_id FROM orders
    WHERE o_orderpriority = '1-URGENT'"""),
    "prior": ("event", """
    SELECT event_id, drug, event_date, outcome,
      CAST(coalesce(sum(CASE WHEN outcome = 'CRL' THEN 1 ELSE 0 END) OVER w, 0) AS BIGINT)
        AS prior_rejections,
      max(CASE WHEN outcome = 'CRL' THEN event_date END) OVER w AS last_rejection
    FROM event WINDOW w AS (PARTITION BY drug ORDER BY event_date, event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""),
    "prior_years": ("prior", """
    SELECT *, year(event_date) - year(last_rejection)
      - CASE WHEN month(event_date) * 100 + day(event_date)
          < month(last_rejection) * 100 + day(last_rejection) THEN 1 ELSE 0 END AS years_since
    FROM prior"""),
}


def with_views(names: list[str], body: str) -> str:
    """`body` behind the CTEs it names and all they need."""
    needed: list[str] = []

    def visit(name: str) -> None:
        if name in needed:
            return
        for parent in VIEWS[name][0].split():
            visit(parent)
        needed.append(name)

    for name in names:
        visit(name)
    if not needed:
        return body
    if body.lstrip().startswith("WITH"):
        body = f"SELECT * FROM ({body})"
    ctes = ",\n".join(f"{name} AS ({VIEWS[name][1]})" for name in needed)
    return f"WITH {ctes}\n{body}"
