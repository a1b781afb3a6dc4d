"""Cheapest repairs of broken conversations, by block tables in the manner of the Four Russians."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decisionlab.session import cut_lineage

SPACE = r"\x20\x09-\x0D"
# Costs of the edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
# What has been said so far: nothing, a system turn, a user's turn, an assistant's (each one
# after another, a system turn only first). A conversation may end in the first and the last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 20
ENDS = (0, NEVER, NEVER, 0)
# Costs to go after the last row: a system turn alone needs two more, a user's one.
AT_END = (0, 2 * INSERT, INSERT, 0)
# Symbols of the rows: one that must go, then by role (s, u, a, other), whole and truncated.
ROLES = "sua"
GONE = 0
SYMBOLS = 9
# Rows in a block: a table has SYMBOLS ** BLOCK columns.
BLOCK = 4
# Rows whose symbols are gathered at once.
CHUNK_BITS = 16


def insertions(state: int) -> list[tuple[str, int, int]]:
    """Inserted turns as (edits, cost, state): none, one or two; more never help."""
    out = [("", 0, state)]
    for _ in range(2):
        edits, cost, at = out[-1]
        out.append((edits + "I", cost + INSERT, ASSISTANT if at == USER else USER))
    return out


def consume(state: int, symbol: int) -> list[tuple[str, int, int]]:
    """What can be done with a row in a state: (edit, cost, next state)."""
    out = [("D", DELETE, state)]
    if symbol == GONE:
        return out
    role, cut = (symbol - 1) % 4, CUT * (symbol > 4)
    turn = ASSISTANT if state == USER else USER
    out.append(("R", REROLE + cut, turn))
    if (role, state) == (0, NOTHING):
        out.append(("K", cut, SYSTEM))
    elif (role == 1 and turn == USER) or (role == 2 and turn == ASSISTANT):
        out.append(("K", cut, turn))
    return out


def choices(state: int, symbol: int) -> list[tuple[str, int, int]]:
    return [
        (edits + edit, cost + more, after)
        for edits, cost, at in insertions(state)
        for edit, more, after in consume(at, symbol)
    ]


@dataclass
class Tables:
    """Costs to go of the four states, less their least, are a vector; few ever occur.

    `step[symbol][v]` is the vector before a row when `v` follows it, and what was taken off;
    `block_step`, `block_cost` hold the same for all `BLOCK` rows (the first one leading). `path[symbol][v][state]`
    are the best edits at the row, least in ASCII order among equals, with the next state.
    """

    vectors: list[tuple[int, ...]]
    step: list[list[tuple[int, int]]]
    path: list[list[list[tuple[str, int]]]]
    last: list[tuple[str, int]]
    block_step: np.ndarray
    block_cost: np.ndarray


def least(options: list[tuple[str, int, int]], after: tuple[int, ...]) -> tuple[int, str, int]:
    """The cheapest option; among equally cheap ones that with the least edits.

    No option's edits begin another one's: each ends in an edit of the row, none of which is an insertion.
    """
    return min((cost + after[to], edits, to) for edits, cost, to in options)


def tables() -> Tables:
    vectors, place = [AT_END], {AT_END: 0}
    step: list[list[tuple[int, int]]] = [[] for _ in range(SYMBOLS)]
    path: list[list[list[tuple[str, int]]]] = [[] for _ in range(SYMBOLS)]
    for v in vectors:
        for symbol in range(SYMBOLS):
            best = [least(choices(state, symbol), v) for state in range(4)]
            low = min(b[0] for b in best)
            before = tuple(min(b[0] - low, NEVER) for b in best)
            if before not in place:
                place[before] = len(vectors)
                vectors.append(before)
            step[symbol].append((place[before], low))
            path[symbol].append([(edits, to) for _, edits, to in best])
    last = [least(insertions(state), ENDS)[1:] for state in range(4)]
    one = np.array(step, np.int32)
    block_step, block_cost = one[:, :, 0], one[:, :, 1]
    for _ in range(BLOCK - 1):
        # A row in front of all blocks so far.
        after = block_step
        block_step = np.concatenate([one[s, :, 0][after] for s in range(SYMBOLS)])
        block_cost = np.concatenate([block_cost + one[s, :, 1][after] for s in range(SYMBOLS)])
    return Tables(vectors, step, path, last, block_step.astype(np.uint8), block_cost.astype(np.uint8))


def plan(table: Tables, symbols: bytes) -> tuple[int, str]:
    """Least cost of a conversation and its edits, from the rows' symbols.

    Costs to go are looked up block by block from the end; only the vectors between blocks are
    kept. Then each block is expanded backwards and its rows' edits are followed forwards, so that
    among equally cheap ones the first edit is always the least in ASCII order.
    """
    n = len(symbols)
    whole = n // BLOCK
    codes = np.frombuffer(symbols, np.uint8)[: whole * BLOCK].reshape(whole, BLOCK).astype(np.int64)
    codes = (codes @ SYMBOLS ** np.arange(BLOCK - 1, -1, -1)).tolist()
    v, cost = 0, 0
    for s in reversed(symbols[whole * BLOCK :]):
        v, more = table.step[s][v]
        cost += more
    between = [v] * (whole + 1)
    for i in range(whole - 1, -1, -1):
        cost += int(table.block_cost[codes[i], v])
        v = int(table.block_step[codes[i], v])
        between[i] = v
    cost += table.vectors[v][NOTHING]
    edits, state = [], NOTHING
    for i in range(whole + 1):
        block = symbols[i * BLOCK : (i + 1) * BLOCK]
        v = between[i + 1] if i < whole else 0
        after = []
        for s in reversed(block):
            after.append(v)
            v = table.step[s][v][0]
        for s, v in zip(block, reversed(after)):
            some, state = table.path[s][v][state]
            edits.append(some)
    edits.append(table.last[state][0])
    return cost, "".join(edits)


def follow(state: int, edit: str, role: str) -> int:
    """The state after an edit other than a deletion; `role` is that of a row that is kept."""
    if edit == "K" and role == "s":
        return SYSTEM
    return ASSISTANT if state == USER else USER


def order(turn: str, role: str) -> list[Column]:
    """How a conversation's rows are read: by turn, nulls first; those of one turn by role and text."""
    return [F.col(turn).asc_nulls_first(), F.col(role), F.col("_digest")]


def prepared(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The four columns with null roles and texts as one space, and a digest of the text."""
    words = F.coalesce(F.col(text).cast("string"), F.lit(" "))
    return rows.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"), words.alias("text"),
    ).withColumn("_digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def faults(rows: DataFrame) -> DataFrame:
    """Per row of `prepared`: `conv`, `pos` (rising in reading order), `turn` and a letter for its kind.

    Letters A to P stand for role (s, u, a, other) and first fault (none, blank, duplicate, truncated). Rows
    are dealt to tasks by ranges of their order, equal ones at random, so no conversation has to fit
    one task; a repeat is found by the least position of its role and text.
    """
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    body = F.regexp_replace("text", f"[{SPACE}]+$", "")
    final = F.substring(body, -1, 1)
    slim = rows.select(
        "conv", "turn", "role", "_digest", kind.alias("kind"),
        (body == "").alias("blank"), (~final.isin(".", "!", "?")).alias("cut"),
        F.monotonically_increasing_id().alias("_row"),
    )
    by = ["conv", *order("turn", "role"), "_row"]
    ranged = slim.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = cut_lineage(ranged.drop("_row").withColumn("pos", F.monotonically_increasing_id()))
    firsts = placed.groupBy("conv", "role", "_digest").agg(F.min("pos").alias("pos"))
    told = placed.drop("_digest", "role").join(firsts.select("pos", F.lit(True).alias("first")), "pos", "left")
    fault = F.when(F.col("blank"), 1).when(F.col("first").isNull(), 2).when(F.col("cut"), 3).otherwise(0)
    return told.select("conv", "pos", "turn", F.char(65 + F.col("kind") * 4 + fault).alias("letter"))


def symbols_of(letters: str) -> bytes:
    out = bytearray()
    for code in letters.encode():
        kind, fault = divmod(code - 65, 4)
        out.append(GONE if fault in (1, 2) else 1 + kind + 4 * (fault == 3))
    return bytes(out)


PLAN = "conv {kind}, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def plans(told: DataFrame) -> DataFrame:
    """Per conversation: counts of faults, illegal neighbours, cost and edits (`audit`).

    The rows' letters are gathered in blocks of 65,536 rows and those per conversation: one
    byte a row, as many as the audit has.
    """
    table = tables()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for letters in batch.column("letters").to_pylist():
                fault = np.frombuffer(letters.encode(), np.uint8).astype(int) - 65
                kind, fault = fault // 4, fault % 4
                pair = kind[:-1] * 4 + kind[1:]
                legal = np.isin(pair, [0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1])
                counts = np.bincount(fault, minlength=4)[1:].tolist()
                out.append((*counts, int((~legal).sum()), *plan(table, symbols_of(letters))))
            columns = list(zip(*out)) if out else [()] * 6
            kinds = [pa.int64()] * 5 + [pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                ["conv", "blank", "duplicate", "truncated", "illegal", "cost", "audit"],
            )

    def joined(rows: DataFrame, keys: list[str], place: str) -> DataFrame:
        """Letters of a group in the order of `place`."""
        listed = F.array_sort(F.collect_list(F.struct(F.col(place), F.col("letter"))))
        text = F.array_join(F.transform(listed, lambda x: x["letter"]), "")
        return rows.groupBy(*keys).agg(text.alias("letter"))

    chunk = F.shiftright("pos", CHUNK_BITS).alias("chunk")
    parts = joined(told.select("conv", "pos", "letter", chunk), ["conv", "chunk"], "pos")
    lines = joined(parts, ["conv"], "chunk").withColumnRenamed("letter", "letters")
    kind = told.schema["conv"].dataType.simpleString()
    return lines.mapInArrow(run, PLAN.format(kind=kind))


def gaps(told: DataFrame) -> DataFrame:
    """Per conversation: turns missing between the first and the last (`gaps`)."""
    turns = told.filter("turn IS NOT NULL").select("conv", "turn").distinct()
    missing = F.max("turn") - F.min("turn") + 1 - F.count("*")
    return turns.groupBy("conv").agg(missing.cast("long").alias("gaps"))


def edited(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """The repaired conversations, row by row: `conv`, `place`, `role`, `text`, `edit`.

    Rows of a conversation meet in one task as a sorted stream behind their edits; the task holds those and
    one batch of rows. Each conversation is followed by a row with a null `place`.
    """
    kind = rows.schema["conv"].dataType.simpleString()
    turn = rows.schema["turn"].dataType.simpleString()
    head = planned.select(
        "conv", F.lit(0).alias("rank"), F.lit(None).cast(turn).alias("turn"), F.lit("").alias("role"),
        F.lit(None).cast("binary").alias("_digest"), F.col("audit").alias("text"),
    )
    body = rows.select("conv", F.lit(1).alias("rank"), "turn", "role", "_digest", "text")
    stream = head.unionByName(body).repartition("conv")
    stream = stream.sortWithinPartitions("conv", "rank", *order("turn", "role"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, edits, at, state, place = None, None, 0, NOTHING, 0
        out: list[tuple] = []

        def take(role: str | None, text: str) -> None:
            """The edits up to and with that of the row, or all that are left after the last row."""
            nonlocal at, state, place
            while at < len(edits):
                edit = edits[at]
                if edit != "I" and role is None:
                    break
                at += 1
                if edit != "D":
                    state = follow(state, edit, (role or "")[:1])
                    given = ("user", "assistant")[state == ASSISTANT]
                    out.append((conv, place, role if edit == "K" else given, "" if edit == "I" else text, edit))
                    place += 1
                if edit != "I":
                    return

        def close() -> None:
            take(None, "")
            out.append((conv, None, None, None, None))

        def flush(kind: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [()] * 5
            kinds = [kind, pa.int64(), pa.string(), pa.string(), pa.string()]
            batch = pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["conv", "place", "role", "text", "edit"]
            )
            out.clear()
            return batch

        last = None
        for batch in batches:
            last = batch.column("conv").type
            columns = [batch.column(c).to_pylist() for c in ("conv", "rank", "role", "text")]
            for key, rank, role, text in zip(*columns):
                if rank == 0:
                    if edits is not None:
                        close()
                    conv, edits, at, state, place = key, text, 0, NOTHING, 0
                else:
                    take(role, text)
            yield flush(last)
        if edits is not None:
            close()
            yield flush(last)

    return stream.mapInArrow(run, f"conv {kind}, place long, role string, text string, edit string")


def digests(repaired: DataFrame) -> DataFrame:
    """SHA-256 of every conversation's `role:text` lines, as hex, from the stream of `edited`.

    One hash has to read its conversation from end to end; the task holds its state alone.
    """
    kind = repaired.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = hashlib.sha256()
        for batch in batches:
            keys, found = [], []
            columns = [batch.column(c).to_pylist() for c in ("conv", "place", "role", "text")]
            for conv, place, role, text in zip(*columns):
                if place is None:
                    keys.append(conv)
                    found.append(state.hexdigest())
                    state = hashlib.sha256()
                else:
                    state.update(("\n" if place else "").encode() + f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, batch.column("conv").type), pa.array(found, pa.string())], ["conv", "sha256"]
            )

    return repaired.mapInArrow(run, f"conv {kind}, sha256 string")


@dataclass
class Repair:
    """`summary`: a row per conversation. `rows`: the repaired turns, in order of `place`."""

    summary: DataFrame
    rows: DataFrame


def repair(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> Repair:
    """The cheapest edits after which every conversation is `(system? (user assistant)+)?`.

    Rows are read by turn, nulls first, rows of one turn by role and digest of the text; null roles and texts
    count as one space, and null conversations are one. A row's first fault counts: blank (only white
    space), duplicate (role and text seen earlier), truncated (last other character not one of `.!?`).
    Roles count by their initial. Edits: keep (0), give the role of a user or an assistant (3), delete (4; a
    must for blank and duplicate rows), insert an empty turn of a user or an assistant (3);
    truncated rows that stay cost 3 more. Among equally cheap repairs the one whose edits' initials are least
    in ASCII order is chosen.

    `summary` has `conv`, `gaps`, `blank`, `duplicate`, `truncated`, `illegal` (neighbours other than
    system-user, user-assistant, assistant-user), `cost`, `audit` (the edits' initials) and `sha256` of the
    repaired `role:text` lines; `rows` has `conv`, `place`, `role`, `text` and `edit`. Other columns are not read;
    an empty table gives empty results.
    """
    named = prepared(rows, conv, turn, role, text)
    told = cut_lineage(faults(named))
    planned = cut_lineage(plans(told))
    repaired = edited(named, planned)
    hashed = digests(repaired)
    missing = gaps(told)
    summary = planned.join(missing, planned["conv"].eqNullSafe(missing["conv"]), "left").drop(missing["conv"])
    summary = summary.join(hashed, planned["conv"].eqNullSafe(hashed["conv"])).drop(hashed["conv"])
    zero = F.lit(0).cast("long")
    return Repair(
        summary.withColumn("gaps", F.coalesce("gaps", zero)),
        repaired.filter("place IS NOT NULL"),
    )
