"""Live counts and streaks that are kept by deltas, whatever was stored before.

Votes and outcomes become streams of changes: what counted before and what counts now. Everything
else is a sum over changes. Sentiment sums the votes' changes per event. Scores are a stream-stream
join of both changes on the event, whose state is the index from an event to its voters: an
outcome reads the votes on its event alone, a vote the outcome of its own. The board sums scores per user, and
streaks are kept per user and day of decision, so that a changed vote or a late outcome counts
one day again.

State lives in Spark's state store (RocksDB), keyed in small blocks, so a batch costs what it holds and not what was
stored, and a call to the store serves a block of rows. Streams of changes go through Spark's file sink, which makes them exactly once. Live tables
get the new rows of the keys a batch touches, the newest of each key counting.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from zlib import crc32

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from decisionlab.functions import columns as C
from decisionlab.session import numbered_folders
from decisionlab.streaming.votes import FOLD_EVERY, accepted_votes, read_snapshot, run_batches, write_snapshot

# State is grouped by the hash of its key: as many groups however many keys, and none of them hot. A
# cluster wants some for each core; like the number of shuffle partitions it is fixed by the first run.
GROUPS = 256
# Tasks over which the voters of one event are dealt in the join; every outcome is sent to each.
SHARDS = 16
# Rows of state in a block, on average.
FILL = 256
DAY = 86_400_000_000
# Stands for the time of a decision without one: before all others.
EARLIEST = -(1 << 62)
# Stands for the time or number of a vote without one: before all others.
UNKNOWN = -(1 << 63)
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # A batch stores what it changed instead of a whole snapshot.
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Else every row that is put is looked up first, for a count of all rows that nothing reads.
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    # One store for both sides of a join, in column families, instead of four.
    "spark.sql.streaming.join.stateFormatVersion": "3",
}

# The state code travels with its query, so workers need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@contextmanager
def state_store(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which keyed state needs.

    `partitions` is the number of their state's partitions (the session's shuffle partitions), fixed by the first run.
    """
    settings = dict(SETTINGS)
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def _hashed(n: int, *keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def _block(h: int, n: int) -> int:
    """The one of `n` blocks for a hash, by linear hashing."""
    top = 1 << (n.bit_length() - 1)
    block = h & (2 * top - 1)
    return block if block < n else block - top


def _column(frame: pd.DataFrame, name: str) -> list:
    """The values of a column, None where its mark of `_marked` says so."""
    values, mark = frame[name].tolist(), f"no_{name}"
    if mark not in frame or not frame[mark].any():
        return values
    return [None if no else v for v, no in zip(values, frame[mark].tolist())]


def _tuples(frame: pd.DataFrame, names: list[str]) -> Iterator[tuple]:
    return zip(*[_column(frame, n) for n in names])


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    columns = zip(*rows) if rows else [()] * len(names)
    return pd.DataFrame({n: pd.Series(list(c), dtype=object) for n, c in zip(names, columns)})


def _marked(rows: DataFrame, names: list[str]) -> DataFrame:
    """Whole numbers without nulls, which pandas would turn into floats, and where they were."""
    whole = [n for n in names if isinstance(rows.schema[n].dataType, T.IntegralType)]
    marks = [F.col(n).isNull().alias(f"no_{n}") for n in whole]
    zero = {n: F.coalesce(n, F.lit(0).cast(rows.schema[n].dataType)) for n in whole}
    return rows.select("*", *marks).withColumns(zero) if whole else rows


class Blocks:
    """Rows of state by key in blocks of about `FILL`: a call to the state store costs much more than a row.

    Blocks are split as rows come (linear hashing), so that none grows with what is stored. The first column is
    a list, the others are one value: Spark goes through lists element by element, nested ones as well.
    """

    def __init__(self, handle: StatefulProcessorHandle, columns: dict[str, str], width: int):
        self.width, self.columns = width, len(columns)
        name, kind = next(iter(columns.items()))
        self.kept = handle.getMapState("blocks", "block bigint", f"{name} array<{kind}>, others binary")
        self.size = handle.getValueState("size", "blocks bigint, rows bigint")

    def _read(self, block: int) -> dict[tuple, tuple]:
        stored = self.kept.getValue((block,))
        if stored is None:
            return {}
        first, others = stored
        return {r[: self.width]: r for r in zip(first, *pickle.loads(others))}

    def _write(self, block: int, rows: dict[tuple, tuple]) -> None:
        first, *others = [list(c) for c in zip(*rows.values())] if rows else [[]] * self.columns
        self.kept.updateValue((block,), (first, pickle.dumps(others, 5)))

    def _hash(self, name: tuple) -> int:
        return crc32(repr(name).encode())

    def _split(self, n: int, more: int) -> None:
        """Go from `n` blocks to more; those that new blocks take rows from are written again."""
        taken = set()
        for block in range(n, more):
            while block >= n:
                block -= 1 << (block.bit_length() - 1)
            taken.add(block)
        for block in taken:
            parts: dict[int, dict[tuple, tuple]] = {block: {}}
            for name, row in self._read(block).items():
                parts.setdefault(_block(self._hash(name), more), {})[name] = row
            for part, rows in parts.items():
                self._write(part, rows)

    def holding(self, names: Iterable[tuple]) -> Iterator[tuple[dict[tuple, tuple], list[tuple]]]:
        """Block by block, its rows and which of the keys lie in it; rows set in between are stored."""
        names, stored = list(names), self.size.get()
        n, count = (1, 0) if stored is None else tuple(stored)
        more = max(n, -(-(count + len(names)) // FILL))
        if more > n and count:
            self._split(n, more)
        places: dict[int, list[tuple]] = {}
        for name in names:
            places.setdefault(_block(self._hash(name), more), []).append(name)
        total = count
        for block, here in places.items():
            rows = self._read(block) if count else {}
            before = dict(rows)
            yield rows, here
            if rows != before:
                self._write(block, rows)
                total += len(rows) - len(before)
        if (more, total) != (n, count):
            self.size.update((more, total))


class Newest(StatefulProcessor):
    """The row that counts for each key, by `order`; puts out the one before and the one now.

    `turn` numbers the changes of a key.
    """

    def __init__(self, kind: T.StructType, keys: list[str], order: list[str], late: bool):
        self.keys, self.late = keys, late
        self.values = [n for n in kind.names if n not in [*keys, "group"]]
        self.ordered = [self.values.index(n) for n in order]
        self.columns = {n: kind[n].dataType.simpleString() for n in [*keys, *self.values]} | {"turn": "bigint"}
        self.names = [*keys, *self.values, *[f"old_{n}" for n in self.values], "turn"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = Blocks(handle, self.columns, len(self.keys))

    def place(self, value: tuple) -> tuple:
        """Sorts by `order`, nulls first."""
        return tuple((value[i] is not None, value[i]) for i in self.ordered)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest: dict[tuple, tuple] = {}
        for frame in rows:
            for name, value in zip(_tuples(frame, self.keys), _tuples(frame, self.values)):
                if name not in newest or self.place(newest[name]) < self.place(value):
                    newest[name] = value
        width, out = len(self.keys), []
        none = (None,) * len(self.values)
        for stored, names in self.kept.holding(newest):
            for name in names:
                value = newest[name]
                if name in stored:
                    *before, turn = stored[name][width:]
                    before = tuple(before)
                    if before == value or not (self.late or self.place(before) < self.place(value)):
                        continue
                else:
                    before, turn = none, 0
                stored[name] = (*name, *value, turn + 1)
                out.append((*name, *value, *before, turn + 1))
        yield _frame(out, self.names)

    def close(self) -> None:
        pass


def _changes(rows: DataFrame, keys: list[str], order: list[str], late: bool, groups: int) -> DataFrame:
    kind = rows.schema
    processor = Newest(kind, keys, order, late)
    named = [n for n in processor.names if n != "turn"]
    out = T.StructType([T.StructField(n, kind[n.removeprefix("old_")].dataType) for n in named])
    out = out.add("turn", T.LongType())
    grouped = _marked(rows, processor.values).withColumn("group", _hashed(groups, *keys)).groupBy("group")
    return grouped.transformWithStateInPandas(processor, out, "Append", "None")


def vote_rows(votes: DataFrame) -> DataFrame:
    return accepted_votes(votes).select(
        "user", "event_id", "label", F.unix_micros("created_at").alias("created"), F.col("seq").cast("long").alias("seq")
    )


def vote_changes(votes: DataFrame, groups: int = GROUPS) -> DataFrame:
    """What valid votes of a stream change: `label` counts now, `old_label` did (null: a first vote).

    The newest vote of a user on an event counts, by time and number. Repeats and older votes change nothing.
    """
    return _changes(vote_rows(votes), ["user", "event_id"], ["created", "seq"], False, groups)


def outcome_changes(outcomes: DataFrame, groups: int = GROUPS) -> DataFrame:
    """What outcomes of a stream (`event_id`, `outcome`, `decided_at`) change, as `old_...` and new.

    The last outcome of an event counts; within a batch the latest decided.
    """
    decided = F.coalesce(F.unix_micros(F.col("decided_at").cast("timestamp")), F.lit(EARLIEST))
    known = outcomes.filter(F.col("event_id").isNotNull() & F.col("outcome").isNotNull())
    rows = known.select("event_id", "outcome", decided.alias("decided"))
    return _changes(rows, ["event_id"], ["decided", "outcome"], True, groups)


def append(stream: DataFrame, path: str, checkpoint: str, partitions: int | None = None) -> list[dict]:
    """Append all that a stream yields to a folder, exactly once; the progress of each batch."""
    with state_store(stream.sparkSession, partitions):
        query = (
            stream.writeStream.format("parquet")
            .option("path", path)
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    return [p for p in query.recentProgress if p["numInputRows"]]


def appended(spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int = 1000) -> DataFrame:
    """The rows of `append` as a stream; `like` is what was appended."""
    stream = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger)
    return stream.parquet(path)


def score_changes(votes: DataFrame, outcomes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Streams of both changes, joined on the event: `sign` 1 adds a score, -1 takes it back.

    An outcome that replaces another takes that one's scores back. The changes of a vote add up: what its label
    scores less what the label before scored.
    """
    rulings = F.array(
        F.struct(F.lit(1).alias("sign"), "outcome", "decided"),
        F.struct(F.lit(-1).alias("sign"), F.col("old_outcome").alias("outcome"), F.col("old_decided").alias("decided")),
    )
    ruled = outcomes.select("event_id", "turn", F.explode(rulings).alias("_r")).filter("_r.outcome IS NOT NULL")
    each = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    ruled = ruled.select("event_id", "turn", "_r.*", each.alias("shard"))
    voted = votes.drop("turn").withColumn("shard", _hashed(shards, "user"))
    return voted.join(ruled, ["event_id", "shard"]).select(
        "user", "event_id", "old_label", "label", "created", "seq", "outcome", "decided", "turn", "sign"
    )


def _is(name: str, label: str) -> Column:
    return F.coalesce(F.col(name) == label, F.lit(False)).cast("long")


def sentiment_totals(votes: DataFrame) -> DataFrame:
    """Votes, approvals, rejections and approval share per event, as `crowd.sentiment` counts them."""
    total = F.sum(F.col("old_label").isNull().cast("long"))
    yes = F.sum(_is("label", "APPROVE") - _is("old_label", "APPROVE"))
    no = F.sum(_is("label", "CRL") - _is("old_label", "CRL"))
    return votes.groupBy("event_id").agg(
        total.alias("total_votes"), yes.alias("approve_votes"), no.alias("crl_votes"),
        C.ratio_pct(yes, total).alias("approve_pct"),
    )


def board_totals(votes: DataFrame, scores: DataFrame) -> DataFrame:
    """The board of every user, as `crowd.leaderboard` counts it, from both streams of changes."""
    first = F.col("old_label").isNull().cast("long")
    none = F.lit(0).cast("long")
    right = F.coalesce((F.col("label") == F.col("outcome")).cast("long"), none)
    was_right = F.coalesce((F.col("old_label") == F.col("outcome")).cast("long"), none)
    rows = votes.select("user", first.alias("votes"), none.alias("scored"), none.alias("right")).unionByName(
        scores.select(
            "user", none.alias("votes"), (F.col("sign") * first).alias("scored"),
            (F.col("sign") * (right - was_right)).alias("right"),
        )
    )
    scored, correct = F.sum("scored"), F.sum("right")
    return rows.groupBy("user").agg(
        F.sum("votes").alias("total_predictions"),
        scored.alias("scored_predictions"),
        correct.alias("correct"),
        C.ratio_pct(correct, scored).alias("accuracy_pct"),
        (correct * 10).alias("points"),
    )


class DayStreaks(StatefulProcessor):
    """Users' votes on the events decided on one day, and what their runs look like from outside."""

    change = ["turn", "sign", "created", "seq", "decided", "event_id", "right"]

    def __init__(self, kind: T.StructType):
        self.columns = {"user": kind["user"].dataType.simpleString(), "day": "bigint", "votes": "array"}
        self.names = ["user", "day", "n", "lead", "tail", "best"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.days = Blocks(handle, self.columns, 2)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        touched: dict[tuple, list] = {}
        for frame in rows:
            for name, change in zip(_tuples(frame, ["user", "day"]), _tuples(frame, self.change)):
                touched.setdefault(name, []).append(change)
        out = []
        for stored, names in self.days.holding(touched):
            for name in names:
                before = stored[name][2] if name in stored else []
                listed = self.changed(before, touched[name])
                stored[name] = (*name, listed)
                run = lead = best = 0
                for n, vote in enumerate(listed, 1):
                    run = run + 1 if vote[2] else 0
                    best = max(best, run)
                    lead = n if run == n else lead
                out.append((*name, len(listed), lead, run, best))
        yield _frame(out, self.names)

    def changed(self, before: list, changes: list) -> list[tuple]:
        """The votes of a day after some changes, in the order of their runs."""
        votes = {v[1]: v for v in before}
        # By outcome, what one takes back before what it gives, and then by vote.
        for turn, sign, created, seq, decided, event_id, right in sorted(changes, key=lambda c: c[:4]):
            stored = votes.get(event_id)
            if stored is not None and stored[3:] > (turn, created, seq):
                continue
            if sign > 0:
                votes[event_id] = (decided, event_id, right, turn, created, seq)
            elif stored is not None and stored[3] < turn:
                del votes[event_id]
        return sorted(votes.values(), key=lambda v: v[:2])

    def close(self) -> None:
        pass


def day_streaks(scores: DataFrame, groups: int = GROUPS) -> DataFrame:
    """Per user and day of decision that changes touch: scored votes, and the runs of right ones.

    Of `n` votes the first `lead` and the last `tail` are right, and the longest run is `best`. A change reads the
    votes of its user on its day alone.
    """
    rows = scores.select(
        "user", "event_id", F.floor(F.col("decided") / DAY).alias("day"), "decided",
        (F.col("label") == F.col("outcome")).alias("right"), "turn",
        *[F.coalesce(c, F.lit(UNKNOWN)).alias(c) for c in ("created", "seq")], "sign",
    )
    out = T.StructType().add("user", rows.schema["user"].dataType).add("day", T.LongType())
    for name in ("n", "lead", "tail", "best"):
        out = out.add(name, T.LongType())
    rows = rows.withColumn("group", _hashed(groups, "user", "day"))
    return rows.groupBy("group").transformWithStateInPandas(DayStreaks(rows.schema), out, "Update", "None")


def user_streaks(days: DataFrame) -> DataFrame:
    """Current and best run per user, as `crowd.streaks`, from the days of `day_streaks`.

    A user has one short row a day; runs that cross days are joined where both days touch.
    """
    listed = F.array_sort(F.collect_list(F.struct("day", "n", "lead", "tail", "best")))
    start = F.struct(F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("best"))

    def add(state: Column, d: Column) -> Column:
        run = F.when(d["tail"] == d["n"], state["run"] + d["n"]).otherwise(d["tail"])
        best = F.greatest(state["best"], d["best"], state["run"] + d["lead"])
        return F.struct(run.alias("run"), best.alias("best"))

    folded = F.aggregate("_days", start, add)
    runs = days.filter("n > 0").groupBy("user").agg(listed.alias("_days")).select("user", folded.alias("_s"))
    return runs.select("user", F.col("_s.run").alias("current"), F.col("_s.best").alias("best"))


def with_streaks(board: DataFrame, days: DataFrame) -> DataFrame:
    """The board with every user's current and best run; 0 where nothing is scored."""
    zero = F.lit(0).cast("long")
    joined = board.join(user_streaks(days), "user", "left")
    return joined.withColumns({c: F.coalesce(c, zero) for c in ("current", "best")})


def keep(
    totals: DataFrame, keys: list[str], out: str, checkpoint: str, fold_every: int = FOLD_EVERY,
    partitions: int | None = None,
) -> list[dict]:
    """Write the new rows of the keys that each batch touches, to be read with `read_snapshot`.

    Returns the progress of each batch. Rows hold totals, not deltas, so a batch that runs again does no harm.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        write_snapshot(batch, out, keys, fold_every)

    with state_store(totals.sparkSession, partitions):
        return run_batches(totals, on_batch, checkpoint, "update")


class LiveTables:
    """Sentiment, board and streaks of streams of votes and outcomes, in folders below `root`.

    `advance` brings them up to what has landed; it can be called again and again, also in another session, with
    the same `groups`, `shards` and `partitions`. `files` is the number of files of changes that a batch of a table takes.
    """

    def __init__(
        self, root: str, votes: DataFrame, outcomes: DataFrame | None = None, *, groups: int = GROUPS,
        shards: int = SHARDS, partitions: int | None = None, files: int = 1000, fold_every: int = FOLD_EVERY,
    ):
        self.root, self.spark, self.files, self.fold_every = root, votes.sparkSession, files, fold_every
        self.votes = vote_changes(votes, groups)
        self.outcomes = None if outcomes is None else outcome_changes(outcomes, groups)
        self.groups, self.shards, self.partitions = groups, shards, partitions

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _append(self, name: str, stream: DataFrame) -> tuple[DataFrame, list[dict]]:
        """The stream's rows as a stream of its own, once what has landed is stored."""
        progress = append(stream, self._path(name), self._path(f"{name}-state"), self.partitions)
        return appended(self.spark, self._path(name), stream, self.files), progress

    def _keep(self, name: str, totals: DataFrame, keys: list[str]) -> list[dict]:
        state = self._path(f"{name}-state")
        return keep(totals, keys, self._path(name), state, self.fold_every, self.partitions)

    def advance(self, *tables: str) -> dict[str, list[dict]]:
        """Bring `sentiment` or `board` or (unnamed) both up to date; the progress of every query."""
        told: dict[str, list[dict]] = {}
        votes, told["votes"] = self._append("votes", self.votes)
        if not tables or "sentiment" in tables:
            told["sentiment"] = self._keep("sentiment", sentiment_totals(votes), ["event_id"])
        if self.outcomes is not None and (not tables or "board" in tables):
            outcomes, told["outcomes"] = self._append("outcomes", self.outcomes)
            changes = score_changes(votes, outcomes, self.shards)
            scores, told["scores"] = self._append("scores", changes)
            told["board"] = self._keep("board", board_totals(votes, scores), ["user"])
            told["streaks"] = self._keep("streaks", day_streaks(scores, self.groups), ["user", "day"])
        return told

    def _read(self, name: str, totals: DataFrame, keys: list[str]) -> DataFrame:
        if not numbered_folders(self.spark, self._path(name), "batch"):
            return self.spark.createDataFrame([], totals.schema)
        return read_snapshot(self.spark, self._path(name), keys)

    def sentiment(self) -> DataFrame:
        return self._read("sentiment", sentiment_totals(self.votes), ["event_id"])

    def board(self) -> DataFrame:
        """The board with every user's streaks."""
        scores = score_changes(self.votes, self.outcomes, self.shards)
        board = self._read("board", board_totals(self.votes, scores), ["user"])
        return with_streaks(board, self._read("streaks", day_streaks(scores, self.groups), ["user", "day"]))
