"""Repairs against dynamic programming over whole edit strings, and the query against plain Python."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb

from decisionlab.llm import conversation_repair, queries

SF = "/root/testdata/sf0.01"
SOLID = re.compile(r"[^\x20\x09-\x0D]")
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def plain_repair(rows):
    """Cheapest (cost, edits, lines) over rows (initial, role, text, must go, truncated), by whole strings."""
    states = {"": (0, "", [])}

    def inserted(states):
        for _ in range(3):
            for state, (cost, edits, lines) in list(states.items()):
                turn = NEXT[state]
                new = (cost + 3, edits + "I", [*lines, ("user:" if turn == "u" else "assistant:")])
                states[turn] = min(states.get(turn, new), new)
        return states

    for initial, role, text, gone, cut in rows:
        found = {}
        for state, (cost, edits, lines) in inserted(dict(states)).items():
            options = [(state, 4, "D", lines)]
            if not gone:
                turn = NEXT[state]
                options.append((turn, 3 + 3 * cut, "R", [*lines, ("user:" if turn == "u" else "assistant:") + text]))
                if initial == turn or (initial, state) == ("s", ""):
                    options.append((initial, 3 * cut, "K", [*lines, f"{role}:{text}"]))
            for to, more, edit, out in options:
                new = (cost + more, edits + edit, out)
                found[to] = min(found.get(to, new), new)
        states = found
    last = inserted(dict(states))
    return min(last[s] for s in ("", "a") if s in last)


def test_block_tables_against_whole_strings():
    table = conversation_repair.tables()
    rng = random.Random(2)
    cases = [s for n in range(4) for s in itertools.product(range(9), repeat=n)]
    cases += [[rng.choice([0, 1, 2, 3, 2, 3, 4, 5, 6, 7, 8]) for _ in range(rng.randrange(50))] for _ in range(1500)]
    for symbols in cases:
        rows = [("suao"[(s - 1) % 4], "", "", s == 0, s > 4) for s in symbols]
        assert conversation_repair.plan(table, bytes(symbols)) == plain_repair(rows)[:2]


def plain_summary(rows):
    """The contract's columns of one conversation's rows (turn, role, text), already in order."""
    seen, told = set(), []
    for turn, role, text in rows:
        solid = SOLID.findall(text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        told.append((role[:1], role, text, fault in ("blank", "duplicate"), fault == "truncated", fault))
    turns = {t for t, _, _ in rows if t is not None}
    cost, audit, lines = plain_repair([t[:5] for t in told])
    pairs = [a[0] + b[0] for a, b in zip(told, told[1:])]
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        *[sum(t[5] == f for t in told) for f in ("blank", "duplicate", "truncated")],
        sum(p not in ("su", "ua", "au") for p in pairs),
        cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def in_order(rows):
    def key(row):
        turn, role, text = row
        return (turn is not None, turn or 0, role, hashlib.sha256(text.encode()).digest())

    return sorted(rows, key=key)


def plain_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        name = ":".join(" " if x is None else str(x) for x in (conv, turn))
        fault = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        mine = out.setdefault(conv, [])
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            mine += [(turn, "user" if fault == 4 else role, text)] * (1 + (fault == 3))
    return out


def check(got, rows):
    want = {conv: plain_summary(in_order(mine)) for conv, mine in plain_damage(rows).items()}
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r.conv_id], (r, want[r.conv_id])


def test_op12_against_whole_strings(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    got = queries.QUERIES["op12_conversation_repair"](spark, SF).collect()
    check(got, [tuple(r) for r in rows])
    assert len({r.audit for r in got}) > 30


ODD = [
    (1, None, None, None), (1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 2, "assistant", "Yes!"), (1, 9, "tool", "so?"),
    (2, None, "user", "a."), (2, None, "user", "a."), (3, 4, "", "no end"), (3, 5, "user", "\t\n "), (3, 6, "user", "Ünï 🙂."),
    (None, 1, "system", "be kind."), (None, 2, "user", "x" * 200_000 + "."), (None, 3, "assistant", "b?"), (None, None, "bot", " "),
    (4, 1, "user", None), (5, 2**40, "user", "big."), (5, -3, "assistant", "small."),
]


def test_odd_rows(spark, tmp_path):
    rows = ODD + [(6, i, ("user", "assistant")[i % 2], f"turn {i}" + ".?!x"[i % 4]) for i in range(3000)]
    rows += [(7, i % 9, "user", "same.") for i in range(500)]
    frame = spark.createDataFrame(
        [(*r, 1, "x", 2.0) for r in rows], "conv_id long, turn long, role string, text string, pos int, conv string, kind double"
    )
    frame.repartition(13).write.parquet(str(tmp_path / "conversations.parquet"))
    check(queries.QUERIES["op12_conversation_repair"](spark, str(tmp_path)).collect(), rows)


def test_op12_against_sql(spark, tmp_path):
    """The checking SQL on the odd rows, too."""
    frame = spark.createDataFrame(ODD, "conv_id long, turn long, role string, text string")
    frame.write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.QUERIES["op12_conversation_repair"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    found = con.execute(queries.SQL["op12_conversation_repair"])
    names = [d[0] for d in found.description]
    assert sorted(map(repr, found.fetchall())) == sorted(repr(tuple(r)) for r in got.select(names).collect())


def test_rows_of_the_repair(spark):
    rows = [(1, 0, "assistant", "one."), (1, 1, "user", "two."), (2, 0, "user", " "), (3, 0, "system", "s."), (3, 1, "user", "u.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = conversation_repair.repair(frame)
    found = {}
    for r in sorted(got.rows.collect()):
        found.setdefault(r.conv, []).append((r.role, r.text, r.edit))
    by = {r.conv: (r.cost, r.audit) for r in got.summary.collect()}
    assert by == {1: (6, "IKKI"), 2: (4, "D"), 3: (3, "KKI")}
    assert found[3] == [("system", "s.", "K"), ("user", "u.", "K"), ("assistant", "", "I")] and 2 not in found
    none = conversation_repair.repair(frame.filter("false"))
    assert none.summary.count() == 0 and none.rows.count() == 0


def test_all_rows_dropped(spark, tmp_path):
    conv = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    frame = spark.createDataFrame([(conv, 0, "user", "a.")], "conv_id long, turn long, role string, text string")
    frame.write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.QUERIES["op12_conversation_repair"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
