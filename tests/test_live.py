"""Live tables against the batch jobs after every step, and what a batch costs."""

import random
from datetime import datetime, timedelta

from helpers import rows

from decisionlab.operators import crowd as K
from decisionlab.streaming import live as L

VOTE = "id string, user string, event_id long, label string, created_at timestamp, seq long"
OUTCOME = "event_id long, outcome string, decided_at timestamp"
START = datetime(2026, 1, 1)


def some_votes(n, first=0, seed=3, users=12):
    rng = random.Random(seed)
    out = []
    for i in range(first, first + n):
        user = "hot" if rng.random() < 0.35 else f"u{rng.randrange(users)}"
        event = 0 if rng.random() < 0.35 else rng.randrange(25)
        label = rng.choice(["APPROVE", "CRL"])
        out.append((f"v{i}", user, event, label, START + timedelta(minutes=rng.randrange(30_000)), i))
    return out


def some_outcomes(events, shift=0, day=1):
    return [(e, ["APPROVE", "CRL", "DELAYED"][(e + shift) % 3], START + timedelta(days=day * (e // 4))) for e in events]


class Inbox:
    """Folders in which votes and outcomes land, and all that has landed so far."""

    def __init__(self, spark, root):
        self.spark, self.root = spark, root
        self.votes, self.outcomes = [], {}
        for name, kind in (("v", VOTE), ("o", OUTCOME)):
            spark.createDataFrame([], kind).write.parquet(f"{root}/{name}")

    def land(self, votes=(), outcomes=()):
        for name, kind, data in (("v", VOTE, votes), ("o", OUTCOME, outcomes)):
            if data:
                self.spark.createDataFrame(data, kind).coalesce(1).write.mode("append").parquet(f"{self.root}/{name}")
        self.votes += votes
        self.outcomes |= {o[0]: o for o in outcomes}

    def tables(self, **options):
        read = self.spark.readStream
        return L.LiveTables(
            f"{self.root}/live", read.schema(VOTE).option("maxFilesPerTrigger", 2).parquet(f"{self.root}/v"),
            read.schema(OUTCOME).parquet(f"{self.root}/o"), groups=8, shards=2, partitions=2, files=4, **options,
        )

    def check(self, live):
        votes = self.spark.createDataFrame(self.votes, VOTE)
        current = K.current_votes(K.validate_predictions(votes)[0])
        outcomes = self.spark.createDataFrame(list(self.outcomes.values()), OUTCOME)
        want = K.sentiment(current)
        assert rows(live.sentiment(), *want.columns) == rows(want)
        board, got = K.leaderboard(current, outcomes), live.board()
        assert rows(got, *board.columns) == rows(board)
        streaks = {r.user: (r.current, r.best) for r in K.streaks(K.scored_votes(current, outcomes)).collect()}
        assert {r.user: (r.current, r.best) for r in got.collect()} == {
            r.user: streaks.get(r.user, (0, 0)) for r in board.collect()
        }


def test_live_tables_follow_the_batch_jobs(spark, tmp_path):
    """Changed and repeated votes, bad rows, outcomes before and after votes, and outcomes that are revised."""
    inbox, data = Inbox(spark, str(tmp_path)), some_votes(500)
    bad = [("bad", "u1", 3, "MAYBE", START, 999), ("bad", None, 3, "CRL", START, 998)]
    inbox.land(data[:150] + bad, some_outcomes(range(6)))
    inbox.tables(fold_every=2).advance()
    inbox.check(inbox.tables())
    inbox.land(data[100:300])
    inbox.land(data[250:420], some_outcomes(range(4, 18), shift=0))
    live = inbox.tables(fold_every=2)
    live.advance()
    inbox.check(live)
    # Other outcomes for some, on other days for most; and votes that come with them.
    inbox.land(data[420:], some_outcomes(range(2, 12), shift=1, day=2))
    live.advance()
    inbox.check(live)
    live.advance()
    inbox.check(live)
    assert len(list((tmp_path / "live" / "board").glob("batch=*"))) <= 3


def test_sentiment_alone_and_nothing_landed(spark, tmp_path):
    inbox = Inbox(spark, str(tmp_path))
    live = inbox.tables()
    live.advance("sentiment")
    assert live.sentiment().count() == 0 and live.board().count() == 0
    inbox.land(some_votes(60))
    live.advance("sentiment")
    want = K.sentiment(K.current_votes(spark.createDataFrame(inbox.votes, VOTE)))
    assert rows(live.sentiment(), *want.columns) == rows(want)


def cost(told):
    """Rows read and state rows written by every query."""
    read = {name: sum(p["numInputRows"] for p in progress) for name, progress in told.items()}
    written = {name: sum(o["numRowsUpdated"] for p in progress for o in p["stateOperators"]) for name, progress in told.items()}
    return read, written


def test_a_batch_costs_what_it_holds(spark, tmp_path):
    """Ten more votes and one more outcome cost the same on 300 stored votes and on 6,000."""
    spent = []
    for n in (300, 6000):
        inbox = Inbox(spark, str(tmp_path / str(n)))
        # One vote on each event but the last, on which four users have voted.
        votes = [(f"v{i}", f"u{i % 97}", i, "APPROVE", START + timedelta(hours=i % 600), i) for i in range(n)]
        votes += [(f"w{i}", f"u{i}", n, "CRL", START, n + i) for i in range(4)]
        inbox.land(votes, [(i, "CRL", START + timedelta(days=i % 50)) for i in range(0, n, 2)])
        inbox.tables().advance()
        more = [(f"x{i}", f"u{i % 97}", i, "CRL", START + timedelta(days=90), 10 * n + i) for i in range(10)]
        inbox.land(more, [(n, "CRL", START + timedelta(days=60))])
        read, written = cost(inbox.tables().advance())
        inbox.check(inbox.tables())
        assert read["votes"] == 10 and read["sentiment"] == 10 and read["outcomes"] == 1
        # Five changed votes on decided events, four votes on the event decided now.
        assert read["streaks"] == 9 and read["board"] == 10 + 9
        assert max(written.values()) <= 40
        spent.append(read)
    assert spent[0] == spent[1]


def test_state_is_called_by_blocks_that_stay_small():
    """A block for many rows, found again after any number of splits, and none that grows."""

    class Kept(dict):
        calls = 0

        def getValue(self, key):
            self.calls += 1
            return self.get(key)

        def updateValue(self, key, value):
            self.calls += 1
            self[key] = value

    class Size:
        kept = None

        def get(self):
            return self.kept

        def update(self, value):
            self.kept = value

    class Handle:
        def getMapState(self, *schemas):
            return Kept()

        def getValueState(self, *schemas):
            return Size()

    blocks, want = L.Blocks(Handle(), {"user": "string", "event": "bigint", "n": "bigint"}, 2), {}
    for n, size in enumerate((3, 5000, 1, 700, 20_000, 20_000)):
        names = [(f"u{i % 7}", i) for i in range(size)]
        before, blocks.kept.calls = len(want), 0
        for rows_, here in blocks.holding(names):
            for name in here:
                assert rows_.get(name, (None, None, None))[2] == want.get(name)
                rows_[name], want[name] = (*name, n), n
        assert blocks.kept.calls <= 6 * (before + size) / L.FILL + 10
    assert blocks.size.get()[1] == len(want) == 20_000
    assert max(len(c[0]) for c in blocks.kept.values()) <= 4 * L.FILL


def test_state_is_handed_over_as_few_values():
    """Spark goes through what it stores element by element: the first column alone, and no nested list."""

    class Kept(dict):
        def getValue(self, key):
            return self.get(key)

        def updateValue(self, key, value):
            self[key] = value

    class Size:
        kept = None

        def get(self):
            return self.kept

        def update(self, value):
            self.kept = value

    class Handle:
        def getMapState(self, *schemas):
            return Kept()

        def getValueState(self, *schemas):
            return Size()

    blocks = L.Blocks(Handle(), {"user": "string", "day": "bigint", "votes": "array<struct<a:bigint,right:boolean>>"}, 2)
    names = [(f"u{i}", i) for i in range(1000)]
    for n in (1, 2):
        for stored, here in blocks.holding(names):
            for name in here:
                assert stored.get(name, (*name, []))[2] == [(i, None) for i in range(n - 1)]
                stored[name] = (*name, [(i, None) for i in range(n)])
    elements = sum(len(v) for value in blocks.kept.values() for v in value if isinstance(v, list))
    assert elements == len(names)


def test_nulls_and_large_numbers_pass_the_state(spark, tmp_path):
    """Votes without a time or number come before all others; whole numbers stay whole beside them."""
    inbox, large = Inbox(spark, str(tmp_path)), (1 << 60) + 1
    inbox.land([("a", "u", 1, "CRL", None, None), ("b", "u", 2, "CRL", None, large), ("c", "v", 1, "CRL", START, large)],
               [(1, "CRL", START), (2, "CRL", START + timedelta(hours=1))])
    inbox.tables().advance()
    inbox.land([("d", "u", 1, "APPROVE", None, 5), ("e", "u", 2, "APPROVE", None, large + 1), ("f", "v", 1, "APPROVE", START, large - 1)])
    inbox.tables().advance()
    told = spark.read.parquet(f"{tmp_path}/live/votes").select("user", "event_id", "label", "old_label", "seq", "old_seq", "turn")
    micros = int(START.timestamp()) * 10**6
    assert sorted(map(tuple, told.collect()), key=repr) == sorted([
        ("u", 1, "CRL", None, None, None, 1), ("u", 2, "CRL", None, large, None, 1), ("v", 1, "CRL", None, large, None, 1),
        ("u", 1, "APPROVE", "CRL", 5, None, 2), ("u", 2, "APPROVE", "CRL", large + 1, large, 2),
    ], key=repr)
    assert {r.created for r in spark.read.parquet(f"{tmp_path}/live/votes").collect()} == {None, micros}
    assert rows(inbox.tables().board(), "user", "correct", "current", "best") == [("u", 0, 0, 0), ("v", 1, 1, 1)]


def test_a_join_keeps_one_store_a_partition(spark, tmp_path):
    """Both sides of the join of votes and outcomes share a store, so a batch commits one and not four."""
    inbox = Inbox(spark, str(tmp_path))
    inbox.land(some_votes(40), some_outcomes(range(6)))
    inbox.tables().advance("board")
    stores = [p.name for p in (tmp_path / "live" / "scores-state" / "state" / "0" / "0").iterdir() if p.is_dir()]
    assert not [n for n in stores if n.startswith(("left-", "right-"))]
