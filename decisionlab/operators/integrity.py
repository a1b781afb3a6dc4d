"""Tamper evidence and data quality: digests, seals, hash chains, audits and diffs.

Hashing is sequential, so long runs of lines are hashed in blocks of bounded size, and the
block hashes are hashed the same way until one is left. The block length is part of the
definition, which is the same for any number of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decisionlab.functions import columns as C
from decisionlab.operators.ordered import number_rows, running
from decisionlab.session import cut_lineage

DIGEST_BLOCK = 1000
CHAIN_BLOCK = 256


def canonical_ledger(ledger: DataFrame, *keep: str) -> DataFrame:
    """Each ledger row as `ticker|date|outcome|score|correct`, beside the columns to keep."""
    fields = [
        F.col("ticker"),
        F.col("date").cast("string"),
        F.col("outcome"),
        C.number_text("score"),
        F.col("correct").cast("string"),
    ]
    text = [F.coalesce(f, F.lit("null")) for f in fields]
    return ledger.select("seq", *keep, F.concat_ws("|", *text).alias("line"))


def write_canonical(ledger: DataFrame, path: str) -> None:
    """Append the canonical lines to a text folder, in ledger order within each file."""
    lines = canonical_ledger(ledger).repartitionByRange("seq").sortWithinPartitions("seq")
    lines.select("line").write.mode("append").text(path)


def ledger_digest(lines: DataFrame, block: int = DIGEST_BLOCK) -> DataFrame:
    """A tree hash of the lines in `seq` order.

    Level 1 hashes each `block` lines, joined by newlines, behind the word `lines`; every
    further level does so with the hashes of the level below, behind the word `hashes`, until
    one hash is left (of no lines, the empty text). The digest is the hash of `ledger`, the number of
    lines and that hash, so it is never the plain hash of the text. `ledger_tree` keeps the levels
    of a growing ledger, ending at the same digest.
    """
    level = cut_lineage(number_rows(lines.select("seq", "line"), ["seq"], "n"))
    count = level.count()
    total, word = count, "lines"
    while word == "lines" or count > 1:
        count = -(-count // block)
        level, word = _hash_blocks(level, block, word), "hashes"
    top = F.coalesce(F.max("line"), F.lit(""))
    text = F.concat(F.lit(f"ledger\n{total}\n"), top)
    return level.agg(C.sha256(text).alias("digest"))


def _hash_blocks(level: DataFrame, block: int, word: str) -> DataFrame:
    """One (n, line) per block of lines; a block never holds more than `block`."""
    rows = F.array_sort(F.collect_list(F.struct("n", "line")))
    text = F.array_join(F.transform(rows, lambda r: r["line"]), "\n")
    number = F.floor((F.col("n") - 1) / block) + 1
    hashed = C.sha256(F.concat(F.lit(f"{word}\n"), text))
    return level.groupBy(number.alias("b")).agg(hashed.alias("line")).select(
        F.col("b").alias("n"), "line"
    )


def verify_seals(records: DataFrame) -> DataFrame:
    """Whether the hash of each record's own text equals the hash stored with it."""
    found = C.sha256("record_text")
    return records.withColumn("found_hash", found).withColumn(
        "sealed", found == F.col("stored_hash")
    )


def build_chain(df: DataFrame, key: str, block: int = CHAIN_BLOCK) -> DataFrame:
    """Chain the lines of each key in `seq` order: h(i) = sha256(h(i-1) + line(i)).

    Every `block` lines, numbered in the output, a new chain starts from nothing, so a busy key
    is hashed by many tasks; `chain_heads` binds the chains of a key together.
    """
    numbered = running(
        df.select(key, "seq", "line"), [key], ["seq"], sums={"n": F.lit(1).cast("long")}
    )
    rows = F.array_sort(F.collect_list(F.struct("n", "seq", "line")))
    blocks = numbered.groupBy(key, F.floor((F.col("n") - 1) / block).alias("block")).agg(
        rows.alias("rows")
    )
    hashes = blocks.withColumn("hashes", _chain(F.transform("rows", lambda r: r["line"])))
    return (
        hashes.select(key, "block", F.explode(F.arrays_zip("rows", "hashes")).alias("r"))
        .select(key, "block", "r.rows.n", "r.rows.seq", "r.rows.line", F.col("r.hashes").alias("hash"))
    )


def _chain(lines: Column) -> Column:
    def add(done: Column, line: Column) -> Column:
        before = F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(""))
        return F.concat(done, F.array(C.sha256(F.concat(before, line))))

    return F.aggregate(lines, F.array().cast("array<string>"), add)


def chain_heads(chain: DataFrame, key: str, block: int = CHAIN_BLOCK) -> DataFrame:
    """The head hash of each key.

    The last hashes of a key's chains are the lines of the next level, chained in blocks of the
    same length; there is at least one such level, and levels follow until one hash is left.
    """
    ends = chain.groupBy(key, "block").agg(F.max_by("hash", "n").alias("line"))
    # One row per chain; written once, since the depth is read from it first.
    level = cut_lineage(ends)
    left = (level.agg(F.max("block")).first()[0] or 0) + 1
    first = True
    while first or left > 1:
        rows = F.array_sort(F.collect_list(F.struct("block", "line")))
        joined = level.groupBy(key, F.floor(F.col("block") / block).alias("up")).agg(
            rows.alias("rows"), F.max(F.max("block")).over(Window.partitionBy(key)).alias("last")
        )
        end = F.element_at(_chain(F.transform("rows", lambda r: r["line"])), -1)
        if not first:
            # Keys that are down to one hash are done.
            end = F.when(F.col("last") == 0, F.col("rows")[0]["line"]).otherwise(end)
        level = joined.select(key, F.col("up").alias("block"), end.alias("line"))
        left, first = -(-left // block), False
    return level.select(key, F.col("line").alias("head"))


def verify_chain(records: DataFrame, key: str) -> DataFrame:
    """Whether each record names the hash of the record before it; the first names none."""
    before = running(
        records, [key], ["ts", "id"],
        lasts={"_before": F.struct(F.col("hash").alias("h"))},
        include_current=False,
    )
    expected = F.col("_before")["h"]
    return before.withColumn("expected_hash", expected).withColumn(
        "intact", F.col("prior_hash").eqNullSafe(expected)
    ).drop("_before")


def link_records(records: DataFrame) -> DataFrame:
    """Each record with the record it supersedes: ROOT, LINKED, or BROKEN when none has the hash."""
    none = F.lit(None).cast(records.schema["id"].dataType)
    # Records without a predecessor stay out of the join, where they would share one key.
    roots = records.filter(F.col("prior_hash").isNull()).select(
        "id", none.alias("prior_id"), F.lit("ROOT").alias("link")
    )
    known = records.select(F.col("id").alias("prior_id"), F.col("hash").alias("prior_hash"))
    linked = records.filter(F.col("prior_hash").isNotNull()).join(known, "prior_hash", "left")
    return roots.unionByName(
        linked.select(
            "id",
            "prior_id",
            F.when(F.col("prior_id").isNotNull(), "LINKED").otherwise("BROKEN").alias("link"),
        )
    )


def audit(events: DataFrame, ledger: DataFrame, rates: DataFrame) -> DataFrame:
    """Data-quality findings as (rule, key).

    Events need stored and recomputed score fields; the ledger its recorded tier and action.
    """
    rated = events.join(
        rates.select("area", F.lit(True).alias("_known")).distinct(), "area", "left"
    )
    event_rules = {
        "tier differs from stored probability": F.col("stored_tier") != C.tier("stored_prob"),
        "weekend flag differs from date": F.col("weekend") != C.is_weekend("event_date"),
        "stored adjustment differs from signals": (
            F.abs(F.col("stored_total_adj") - F.col("total_adj")) > 0.0001
        ),
        "area without rate": F.col("_known").isNull(),
    }
    ledger_rules = {
        "ledger tier differs from score": F.col("tier") != C.tier(F.col("score") / 100),
        "ledger action differs from tier": (
            (F.col("action") == "AVOID") != (C.action("tier") == "AVOID")
        ),
    }
    repeated = events.groupBy("event_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # First per outcome, so that a busy entity is small before its outcomes are counted.
    outcomes = ledger.groupBy("ticker", "drug", "outcome").agg(F.count(F.lit(1)).alias("n"))
    conflicts = outcomes.groupBy("ticker", "drug").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return (
        _findings(rated, event_rules, F.col("event_id"))
        .unionByName(_findings(ledger, ledger_rules, F.col("seq")))
        .unionByName(repeated.select(
            F.lit("duplicate event").alias("rule"), F.col("event_id").cast("string").alias("key")
        ))
        .unionByName(conflicts.select(
            F.lit("conflicting outcomes").alias("rule"),
            F.concat_ws("|", "ticker", "drug").alias("key"),
        ))
    )


def _findings(df: DataFrame, rules: dict[str, Column], key: Column) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(test, F.lit(rule)) for rule, test in rules.items()]))
    return df.select(F.explode(found).alias("rule"), key.cast("string").alias("key"))


def ledger_diff(old: DataFrame, new: DataFrame, key: str = "seq") -> DataFrame:
    """Rows added, removed or changed between two ledger snapshots."""

    def hashed(df: DataFrame, name: str) -> DataFrame:
        row = F.to_json(F.struct(*[c for c in sorted(df.columns) if c != key]))
        return df.select(key, C.sha256(row).alias(name))

    both = hashed(old, "old_hash").join(hashed(new, "new_hash"), key, "full_outer")
    change = (
        F.when(F.col("old_hash").isNull(), "added")
        .when(F.col("new_hash").isNull(), "removed")
        .when(F.col("old_hash") != F.col("new_hash"), "changed")
    )
    return both.select(key, change.alias("change")).filter(F.col("change").isNotNull())


def diff_summary(diff: DataFrame) -> DataFrame:
    """Counts per change, and whether the ledger was more than appended to."""
    counts = {c: F.count_if(F.col("change") == c) for c in ("added", "removed", "changed")}
    return diff.agg(
        *[expr.alias(name) for name, expr in counts.items()],
        ((counts["removed"] + counts["changed"]) > 0).alias("violated"),
    )
