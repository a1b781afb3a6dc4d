import hashlib
import json
from datetime import date

import pytest
from helpers import rows
from pyspark.sql import functions as F

from decisionlab.functions import columns as C
from decisionlab.operators import integrity as I
from decisionlab.operators import ledger as L
from decisionlab.sources import documents

COLS = (
    "seq long, ticker string, drug string, date date, outcome string, score double, tier string, "
    "action string, correct boolean, move string"
)
DATA = [
    (1, "A", "d1", date(2025, 4, 2), "APPROVED", 92.0, "TIER_1", "BUY", True, "+10%"),
    (2, "B", "d2", date(2025, 4, 1), "CRL", 20.5, "TIER_4", "AVOID", True, "-58%"),
    (3, "C", "d3", date(2025, 4, 2), "CRL", 81.0, "TIER_2", "BUY", False, "-20% then up"),
    (4, "D", "d4", date(2025, 5, 9), "POSITIVE", 88.25, "TIER_1", "BUY", True, ""),
    (5, "E", "d5", date(2025, 5, 1), "APPROVED", 40.0, "TIER_4", "AVOID", False, "+90%"),
    (6, "F", "d6", date(2025, 6, 1), "BEAT", 86.0, "TIER_1", "BUY", True, "+10.5%"),
    (7, "A", "d1", date(2025, 6, 2), "CRL", 61.0, "TIER_3", "BUY", True, "n/a"),
    (8, "H", "d8", date(2025, 6, 3), "DELAYED", 90.0, "TIER_1", "BUY", True, "+7%"),
]


@pytest.fixture(scope="module")
def ledger(spark):
    return spark.createDataFrame(DATA, COLS)


def test_equity_curve(ledger):
    got = L.equity_curve(ledger).orderBy("date", "seq").collect()
    share = 10_000 / len(DATA)
    want, balance = [], 10_000.0
    counted = {1: 10, 3: -20, 6: 10.5}
    for row in sorted(DATA, key=lambda r: (r[3], r[0])):
        balance += share * counted.get(row[0], 0) / 100
        want.append((row[0], balance))
    assert [r.seq for r in got] == [s for s, _ in want]
    assert [r.balance for r in got] == pytest.approx([b for _, b in want])
    span = L.equity_range(L.equity_curve(ledger)).first()
    assert span.end == pytest.approx(balance) and span.low == pytest.approx(9875.0)


def test_track_record(ledger):
    r = L.track_record(ledger).first()
    assert (r.total, r.correct, r.accuracy) == (8, 6, 75.0)
    assert (r.tier_1, r.tier_1_correct, r.tier_4, r.tier_4_correct) == (4, 4, 2, 1)
    assert (r.best_seq, r.best_move) == (6, 10.5)
    assert r.mean_win_move == pytest.approx((10 + 10.5 + 7) / 3)


def test_ledger_sorts_and_filters(ledger):
    assert [r.seq for r in L.sort_ledger(ledger, "move").collect()][:3] == [5, 2, 3]
    assert [r.seq for r in L.sort_ledger(ledger, "date").collect()][:2] == [8, 7]
    assert rows(L.ledger_filter(ledger, "incorrect"), "seq") == [(3,), (5,)]
    with pytest.raises(ValueError):
        L.ledger_filter(ledger, "some")


def test_accuracy_cube_totals(ledger):
    cube = L.accuracy_cube(ledger, "tier", "action")
    whole = cube.filter("level = 3").first()
    assert (whole.total, whole.correct) == (8, 6)
    by_tier = L.accuracy_by(ledger, "tier")
    assert rows(cube.filter("level = 1"), "tier", "total", "correct") == rows(by_tier, "tier", "total", "correct")


def test_canonical_text_and_digest(spark, ledger, tmp_path):
    lines = [r.line for r in I.canonical_ledger(ledger).orderBy("seq").collect()]
    assert lines[0] == "A|2025-04-02|APPROVED|92|true" and lines[1] == "B|2025-04-01|CRL|20.5|true"
    assert I.ledger_digest(I.canonical_ledger(ledger), 4).first().digest == tree(lines, 4)
    path = str(tmp_path / "canon")
    I.write_canonical(ledger, path)
    I.write_canonical(ledger.filter("seq = 1"), path)
    assert sorted(r.value for r in spark.read.text(path).collect()) == sorted([*lines, lines[0]])


@pytest.mark.parametrize("value,shown", [
    (10.0, "10"), (20.5, "20.5"), (0.0001, "0.0001"), (0.0, "0"), (100.0, "100"), (-3.25, "-3.25"),
    (12345678.5, "12345678.5"),
])
def test_number_text(spark, value, shown):
    assert spark.range(1).select(C.number_text(F.lit(value))).first()[0] == shown


def chain(lines):
    out, h = [], ""
    for line in lines:
        h = hashlib.sha256((h + line).encode()).hexdigest()
        out.append(h)
    return out


def tree(texts, block):
    """The tree hash, written out."""
    level, word = list(texts), "lines"
    while word == "lines" or len(level) > 1:
        level = [
            hashlib.sha256("\n".join([word, *level[i : i + block]]).encode()).hexdigest()
            for i in range(0, len(level), block)
        ]
        word = "hashes"
    return hashlib.sha256(f"ledger\n{len(texts)}\n{level[0] if level else ''}".encode()).hexdigest()


@pytest.mark.parametrize("n", [0, 1, 4, 5, 16, 17, 70])
def test_digest_has_one_definition(spark, n):
    lines = [f"line {i}" for i in range(n)]
    df = spark.createDataFrame(list(enumerate(lines)), "seq long, line string").repartition(3)
    found = I.ledger_digest(df, 4).first().digest
    assert found == tree(lines, 4)
    assert found != hashlib.sha256("\n".join(lines).encode()).hexdigest()


@pytest.mark.parametrize("block", [256, 3, 2])
def test_chain(spark, block):
    data = [("hot" if i % 3 else f"k{i}", i, f"line {i}") for i in range(60)]
    df = spark.createDataFrame(data, "k string, seq long, line string").repartition(4)
    built = I.build_chain(df, "k", block)
    heads = {r.k: r.head for r in I.chain_heads(built, "k", block).collect()}
    by_key = {}
    for k, i, line in data:
        by_key.setdefault(k, []).append((i, line))
    got = {(r.k, r.seq): (r.hash, r.block) for r in built.collect()}
    assert len(got) == 60
    for k, items in by_key.items():
        parts = [items[i:i + block] for i in range(0, len(items), block)]
        ends = []
        for number, part in enumerate(parts):
            hashes = chain([line for _, line in part])
            assert [got[k, i] for i, _ in part] == [(h, number) for h in hashes]
            ends.append(hashes[-1])
        first = True
        while first or len(ends) > 1:
            ends = [chain(ends[i:i + block])[-1] for i in range(0, len(ends), block)]
            first = False
        assert heads[k] == ends[0]


def test_verify_chain_and_links(spark):
    data = [
        ("x", 1, 1, "h1", None), ("x", 2, 2, "h2", "h1"), ("x", 3, 3, "h3", "h1"), ("x", 4, 4, "h4", "zz"),
        ("y", 5, 1, "g1", None), ("y", 6, 2, "g2", None),
    ]
    df = spark.createDataFrame(data, "k string, id long, ts long, hash string, prior_hash string")
    assert rows(I.verify_chain(df, "k"), "id", "intact") == [
        (1, True), (2, True), (3, False), (4, False), (5, True), (6, False)
    ]
    assert rows(I.link_records(df)) == [
        (1, None, "ROOT"), (2, 1, "LINKED"), (3, 1, "LINKED"), (4, None, "BROKEN"), (5, None, "ROOT"),
        (6, None, "ROOT"),
    ]


def test_ledger_diff(ledger):
    assert I.ledger_diff(ledger, ledger).count() == 0
    new = ledger.filter("seq <> 2").withColumn(
        "move", F.when(F.col("seq") == 3, None).otherwise(F.col("move"))
    ).unionByName(ledger.filter("seq = 1").withColumn("seq", F.lit(9).cast("long")))
    diff = I.ledger_diff(ledger, new)
    assert rows(diff) == [(2, "removed"), (3, "changed"), (9, "added")]
    total = I.diff_summary(diff).first()
    assert (total.added, total.removed, total.changed, total.violated) == (1, 1, 1, True)
    grown = I.diff_summary(I.ledger_diff(ledger.filter("seq < 8"), ledger)).first()
    assert grown.violated is False


def sealed(record, stored=None):
    text = json.dumps(record, indent=2, ensure_ascii=False)
    stored = stored or hashlib.sha256(text.encode()).hexdigest()
    return json.dumps(
        {"record": record, "integrity": {"algorithm": "SHA-256", "hash": stored}},
        indent=2, ensure_ascii=False,
    )


def test_sealed_files(spark, tmp_path):
    record = {
        "catalyst_id": "r1", "ticker": "AAA",
        "trade": {"executed": True, "entry_price": 77.11, "exit_price": 80.31},
        "signal_validation": {
            "surrogate_only": {"weight": -0.45, "fda_rationale_match": "EXACT", "description": "é {x}"},
            "ta_high_risk": {"weight": -0.25, "fda_rationale_match": "CONFIRMED", "description": ""},
        },
        "prior_record_hash": None,
    }
    (tmp_path / "a.json").write_text(sealed(record))
    (tmp_path / "b.json").write_text(sealed({**record, "catalyst_id": "r2"}, "0" * 64))
    read = documents.read_sealed(spark, str(tmp_path))
    checked = I.verify_seals(read)
    assert rows(checked, F.col("record.catalyst_id"), "sealed") == [("r1", True), ("r2", False)]
    follower = {"catalyst_id": "r3", "prior_verification_hash": read.first().stored_hash,
                "timestamp_utc": "2026-02-14T04:30:56.245Z"}
    (tmp_path / "c.json").write_text(sealed(follower))
    chained = documents.read_sealed(spark, str(tmp_path)).select(
        F.col("record.catalyst_id").alias("id"), F.col("stored_hash").alias("hash"), "prior_hash", "ts"
    )
    links = I.link_records(chained)
    assert ("r3", "LINKED") in rows(links, "id", "link") and links.filter("link = 'ROOT'").count() == 2
    checks = documents.signal_checks(read)
    assert checks.count() == 4
    from decisionlab.operators.scoring import signal_validation

    assert rows(signal_validation(checks), "signal", "fda_rationale_match", "n") == [
        ("surrogate_only", "EXACT", 2), ("ta_high_risk", "CONFIRMED", 2)
    ]


def test_trade_metrics(spark):
    df = spark.createDataFrame(
        [(date(2026, 1, 30), 77.11, date(2026, 2, 6), 80.31, 62.64)],
        "entry_date date, entry_price double, exit_date date, exit_price double, post_price double",
    )
    r = L.trade_metrics(df).first()
    assert r.holding_days == 7 and round(r.gain_per_share, 2) == 3.2 and round(r.gain_pct, 2) == 4.15
    assert round(r.avoided_per_share, 2) == 17.67 and round(r.net_swing, 2) == 26.15


def test_trade_at_no_price(spark):
    df = spark.createDataFrame(
        [(date(2026, 1, 30), 0.0, date(2026, 2, 6), 0.0, 1.0)],
        "entry_date date, entry_price double, exit_date date, exit_price double, post_price double",
    )
    r = L.trade_metrics(df).first()
    assert (r.holding_days, r.gain_pct, r.avoided_pct, r.net_swing) == (7, None, None, None)


def test_flags_and_lead_days(spark):
    df = spark.createDataFrame([
        ("EW-1", "WIN (86-day lead time)", "2025-10-15 00:00:00", "2026-01-31", "2026-01-09", None),
        ("TS-1", "LEGENDARY WIN", "2025-08-20 15:31:08", "2025-09-15", "2025-09-15", "ab"),
        ("TS-2", "loss avoided", "2025-08-20 11:59:00", "2025-09-15", "2025-09-15", None),
    ], "id string, status string, ts string, event_date string, outcome_date string, hash string")
    df = df.withColumn("ts", F.col("ts").cast("timestamp")).withColumn(
        "event_date", F.col("event_date").cast("date")
    ).withColumn("outcome_date", F.col("outcome_date").cast("date"))
    flags = L.prediction_flags(df, "EW")
    assert rows(flags, "id", "legendary", "loss_avoided", "early_warning", "win", "lead_days", "outcome_lead_days") == [
        ("EW-1", False, False, True, True, 108, 86), ("TS-1", True, False, False, True, 25, 26),
        ("TS-2", False, True, False, False, 26, 26),
    ]
    total = L.proof_summary(flags).first()
    assert (total.total, total.wins, total.hashed) == (3, 2, 1)


def test_audit(spark, ledger):
    cols = (
        "event_id long, area string, event_date date, weekend boolean, stored_prob double, "
        "stored_tier string, stored_total_adj double, total_adj double"
    )
    good = (1, "CNS", date(2026, 1, 3), True, 0.9, "TIER_1", 0.5, 0.5)
    events = spark.createDataFrame([
        good, good, (2, "CNS", date(2026, 1, 3), False, 0.85, "TIER_1", 0.5, 0.6),
        (3, None, date(2026, 1, 5), False, 0.5, "TIER_4", 0.0, 0.0),
    ], cols)
    rates = spark.createDataFrame([("CNS", 1.0)], "area string, rate double")
    got = rows(I.audit(events, ledger, rates))
    for want in [
        ("area without rate", "3"), ("conflicting outcomes", "A|d1"), ("duplicate event", "1"),
        ("stored adjustment differs from signals", "2"), ("tier differs from stored probability", "2"),
        ("weekend flag differs from date", "2"),
    ]:
        assert want in got
    assert len(got) == 6


@pytest.mark.parametrize("text,value", [
    ("+534%", 534.0), ("-21% avoided", -21.0), ("+5%", 5.0), ("", None), ("n/a", None), (" 3.5x", 3.5),
    (".5", 0.5), ("-", None), ("+.", None), (None, None),
])
def test_leading_number(spark, text, value):
    got = spark.range(1).select(C.leading_number(F.lit(text).cast("string")).cast("double")).first()[0]
    assert got == value


@pytest.mark.parametrize("text,want", [
    ("2026-02-13", ("2026-02-13", "2026-02-13", "day", False)),
    ("Oct 2025", ("2025-10-01", "2025-10-31", "month", False)),
    ("~Nov 2025", ("2025-11-01", "2025-11-30", "month", True)),
    ("Sep 28→Dec 28, 2025", ("2025-12-28", "2025-12-28", "day", False)),
    ("Q1 2024", ("2024-01-01", "2024-03-31", "quarter", False)),
    ("2024", ("2024-01-01", "2024-12-31", "year", False)),
    ("Feb 2024", ("2024-02-01", "2024-02-29", "month", False)),
    ("TBD", (None, None, None, False)),
])
def test_partial_date(spark, text, want):
    r = spark.range(1).select(C.partial_date(F.lit(text)).alias("d")).first().d
    assert tuple(None if x is None else (x if isinstance(x, bool) else str(x)) for x in r) == want


def test_universe(spark):
    df = spark.createDataFrame([("JJ/RR", "Oct 2025", None)], "ticker string, scheduled string, actual string")
    assert rows(documents.read_universe(df), "ticker", "scheduled") == [("JJ", "Oct 2025"), ("RR", "Oct 2025")]


def test_score_range_and_money(spark):
    df = spark.createDataFrame([("80-85% APPROVAL", "$4.80"), ("75%", None), ("none", "4.80")], "a string, b string")
    got = [(r.s.lo, r.s.hi, r.s.label, r.m) for r in df.select(C.score_range("a").alias("s"), C.money_value("b").alias("m")).collect()]
    assert got == [(80, 85, "APPROVAL", 4.8), (75, 75, None, None), (None, None, None, None)]


@pytest.mark.parametrize("value,text", [
    (None, "N/A"), (0.0, "$0.00"), (999.994, "$999.99"), (1500.0, "$1.5K"), (-2.5e6, "$-2.5M"), (3e9, "$3.0B"),
])
def test_money_format(spark, value, text):
    assert spark.range(1).select(C.money_format(F.lit(value).cast("double"))).first()[0] == text


def test_short_designations(spark):
    df = spark.createDataFrame([(["Breakthrough Therapy", "Orphan Drug (EU)", "Other"],)], "d array<string>")
    assert df.select(C.short_designations("d")).first()[0] == ["BTD", "OD (EU)", "Other"]


def test_delay(spark):
    df = spark.createDataFrame([(date(2026, 2, 20), date(2026, 2, 13)), (date(2026, 2, 1), date(2026, 2, 1)), (date(2026, 2, 1), None)], "scheduled_date date, actual_date date")
    assert rows(L.decision_delay(df), "delay_days", "timing") == [(-7, "EARLY"), (0, "ON TIME"), (None, None)]


def test_calendar_export(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, date(2026, 3, 1), "PDUFA", "AA", "drug", "Co", "ind", "CNS", 0.9123, "TIER_1"),
         (2, date(2026, 4, 9), "PDUFA", "BB", "drug", "Co", "ind", "CNS", 0.5, "TIER_4")],
        "event_id long, event_date date, type string, ticker string, drug string, company string, "
        "indication string, area string, prob double, tier string",
    )
    texts = {r.event_id: r.text for r in documents.calendar_text(df).collect()}
    assert "DTSTART;VALUE=DATE:20260301\r\n" in texts[1] and "Score: 91.2% (TIER 1)" in texts[1]
    path = str(tmp_path / "cal")
    documents.export_calendar(df, path)
    back = spark.read.text(path)
    assert back.filter(F.col("value").contains("BEGIN:VEVENT")).count() == 2
    assert {r.month for r in back.select(F.col("month").cast("string").alias("month")).distinct().collect()} == {"2026-03", "2026-04"}
