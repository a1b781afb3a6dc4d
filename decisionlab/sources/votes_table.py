"""The table of votes a stream keeps: one row per user and event, last write wins.

Each batch is written once, under its own number, into folders by bucket of one column, so
writing costs what the batch holds and running a batch again replaces it. The current rows
are the last per key, combined map-side on read; `compact` folds old batches into a base.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from decisionlab.operators.crowd import current_votes
from decisionlab.session import drop_folder, numbered_folders

BUCKETS = 64
COLUMNS = ["user", "event_id", "label", "created_at", "seq"]


def _bucket(by: str, buckets: int):
    return F.pmod(F.xxhash64(by), F.lit(buckets)).cast("int")


def upsert_predictions(
    batch: DataFrame, table: str, batch_id: int, by: str = "event_id", buckets: int = BUCKETS
) -> None:
    """Store the batch's last vote per user and event."""
    rows = current_votes(batch.select(COLUMNS))
    _write(rows, f"{table}/log/batch={batch_id}", by, buckets)


def _write(rows: DataFrame, path: str, by: str, buckets: int) -> None:
    """Write by bucket; the rebalance gathers small buckets and splits a large one."""
    placed = rows.withColumn("bucket", _bucket(by, buckets)).hint("rebalance", "bucket")
    placed.write.mode("overwrite").partitionBy("bucket").parquet(path)


def _read(spark: SparkSession, path: str, columns: T.StructType) -> DataFrame | None:
    try:
        return spark.read.schema(columns).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _last_base(spark: SparkSession, table: str) -> int | None:
    done = _read(spark, f"{table}/done", T.StructType([T.StructField("batch", T.LongType())]))
    return None if done is None else done.agg(F.max("batch")).first()[0]


def read_votes(
    spark: SparkSession,
    table: str,
    columns: T.StructType,
    buckets: list[int] | None = None,
    before: int | None = None,
) -> DataFrame:
    """The current votes, of the given buckets only if named; `columns` types the table."""
    fields = [columns[c] for c in COLUMNS]
    parts = [T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())]
    full = T.StructType(fields + parts)
    log = _read(spark, f"{table}/log", full)
    base_id = _last_base(spark, table)
    out = spark.createDataFrame([], full) if log is None else log
    if before is not None:
        out = out.filter(F.col("batch") < before)
    if base_id is not None:
        base = _read(spark, f"{table}/base", full).filter(F.col("batch") == base_id)
        out = out.filter(F.col("batch") > base_id).unionByName(base)
    if buckets is not None:
        out = out.filter(F.col("bucket").isin(buckets))
    return current_votes(out.select(COLUMNS))


def touched_buckets(batch: DataFrame, by: str = "event_id", buckets: int = BUCKETS) -> list[int]:
    """The buckets a batch writes to: never more than there are buckets."""
    return [r[0] for r in batch.select(_bucket(by, buckets).alias("b")).distinct().collect()]


def compact(
    spark: SparkSession,
    table: str,
    columns: T.StructType,
    through: int,
    by: str = "event_id",
    buckets: int = BUCKETS,
) -> None:
    """Fold all batches up to `through` into a base; readers use it once it is marked done.

    What is folded is dropped after that, so the table holds one base and the batches since.
    """
    rows = read_votes(spark, table, columns, before=through + 1)
    _write(rows, f"{table}/base/batch={through}", by, buckets)
    spark.range(through, through + 1).withColumnRenamed("id", "batch").write.mode("append").parquet(
        f"{table}/done"
    )
    for batch in numbered_folders(spark, f"{table}/log", "batch"):
        if batch <= through:
            drop_folder(spark, f"{table}/log/batch={batch}")
    for batch in numbered_folders(spark, f"{table}/base", "batch"):
        if batch < through:
            drop_folder(spark, f"{table}/base/batch={batch}")
