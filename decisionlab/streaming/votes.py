"""Vote streams: ingest, vote trend, and tables that streams rewrite key by key.

Every stream reads files as they land. Votes are written per batch number, so a batch that runs
again after a failure replaces what it wrote; live tables (`live`) get the rows a batch touched, the newest of
each key counting. Every few batches both are folded into one, and what was folded is dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from decisionlab.functions import columns as C
from decisionlab.operators import crowd
from decisionlab.operators.ordered import latest_by
from decisionlab.session import drop_folder, numbered_folders
from decisionlab.sources import votes_table


def accepted_votes(stream: DataFrame) -> DataFrame:
    """The valid votes of a stream (`id`, `user`, `event_id`, `label`, `created_at`, `seq`)."""
    return stream.withColumn("created_at", F.col("created_at").cast("timestamp")).filter(
        crowd.vote_reason().isNull()
    )


def votes_once(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The valid votes, each id once, for sinks that only append.

    The upserting streams below do without it: they fold repeats map-side and a repeat of a
    stored vote changes nothing, so many copies of one vote never meet in one task.
    """
    timed = accepted_votes(stream).withWatermark("created_at", delay)
    return timed.dropDuplicatesWithinWatermark(["id"])


def run_batches(
    stream: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> list[dict]:
    """Feed all that has landed to `on_batch`, one micro-batch after the other; their progress."""

    def guarded(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            if not batch.isEmpty():
                on_batch(batch, batch_id)
        finally:
            batch.unpersist()

    query = (
        stream.writeStream.foreachBatch(guarded)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return [p for p in query.recentProgress if p["numInputRows"]]


# Batches after which a stream folds its tables.
FOLD_EVERY = 16


def _store(
    batch: DataFrame, table: str, batch_id: int, columns: T.StructType, by: str, fold_every: int
) -> None:
    """Fold the finished batches when it is time, then upsert this one."""
    if batch_id and batch_id % fold_every == 0:
        votes_table.compact(batch.sparkSession, table, columns, batch_id - 1, by)
    votes_table.upsert_predictions(batch, table, batch_id, by)


def ingest_votes(
    stream: DataFrame, table: str, checkpoint: str, fold_every: int = FOLD_EVERY
) -> None:
    """Validate the votes of a stream and upsert the last one per user and event."""
    columns = accepted_votes(stream).schema

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        _store(batch, table, batch_id, columns, "event_id", fold_every)

    run_batches(accepted_votes(stream), on_batch, checkpoint)


def write_snapshot(
    rows: DataFrame, path: str, keys: list[str], fold_every: int = FOLD_EVERY
) -> None:
    """Add rows that replace the older ones of their keys; fold when there are many folders.

    A batch that runs again adds the same rows again. Folding writes one more folder with the
    newest row of every key and then drops the others, so it can be broken off anywhere.
    """
    spark = rows.sparkSession
    done = numbered_folders(spark, path, "batch")
    number = done[-1] + 1 if done else 0
    rows.write.parquet(f"{path}/batch={number}")
    done.append(number)
    if len(done) > fold_every:
        read_snapshot(spark, path, keys).write.parquet(f"{path}/batch={number + 1}")
        for old in done:
            drop_folder(spark, f"{path}/batch={old}")


def read_snapshot(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest row per key of a table that is rewritten key by key."""
    rows = spark.read.parquet(path)
    return latest_by(rows, keys, ["batch"]).drop("batch")


def vote_trend(stream: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Valid votes, each counted once, and their approval share per event and tumbling window.

    Rows later than `delay` are dropped.
    """
    n, yes = F.count(F.lit(1)), F.count_if(F.col("label") == "APPROVE")
    return (
        votes_once(stream, delay)
        .groupBy("event_id", F.window("created_at", width).alias("w"))
        .agg(n.alias("votes"), C.ratio_pct(yes, n).alias("approve_pct"))
        .select("event_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"),
                "votes", "approve_pct")
    )


def write_trend(trend: DataFrame, path: str, checkpoint: str) -> None:
    """Append each window once it is complete."""
    query = (
        trend.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def fresh_stream(stream: DataFrame, out: str, checkpoint: str, key: str = "ticker") -> None:
    """Keep the newest value per key (`ts`, `value`); read it with `read_fresh`."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        newest = latest_by(batch.select(key, "ts", "value"), [key], ["ts", "value"])
        write_snapshot(newest, out, [key])

    run_batches(stream, on_batch, checkpoint)


def read_fresh(spark: SparkSession, out: str) -> DataFrame:
    """The values kept by `fresh_stream`, for `fresh_values` to choose from."""
    return spark.read.parquet(out).drop("batch")
