"""Session settings and the shared folder used for checkpoints and state tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Bytes of rows that a Python worker is handed at a time when a table is written; a larger row goes alone.
BATCH = 2 << 20


def get_session(app: str = "decisionlab", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are planned for; `conf` overrides any of them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # A split of a hot join key is worth one more shuffle after the join.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.ui.enabled": "false",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by `spark.checkpoint.dir`."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    context = spark.sparkContext
    path = context.getCheckpointDir()
    if path:
        return path
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="decisionlab-")
    context.setCheckpointDir(path)
    return path


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder inside the shared folder, grouped by application for later removal."""
    root = shared_dir(spark).rstrip("/")
    return f"{root}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def numbered_folders(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers n of the folders `name=n` below a path, wherever Spark can reach it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(folder)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{name}="))


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder whose rows have been written elsewhere."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop_intermediates(spark: SparkSession) -> None:
    """Delete what this application's jobs wrote to the shared folder; call it when they are done."""
    drop_folder(spark, f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}")


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """Queries run inside see another value of one of the session's settings."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def no_shuffles_left(spark: SparkSession):
    """Queries run inside delete the files of their shuffles when they end."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def small_batches(spark: SparkSession):
    """Queries run inside hand Python small batches; Spark's default holds 64 MB on both sides of every task."""
    return setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


def cut_lineage(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    The rows survive the loss of executors, and later steps read only the columns they need. Nothing
    reads the write's shuffles again, so their files are deleted with it and not at some later garbage collection.
    With a `path` of its own the table can be dropped when it is not read again.
    """
    path = path or new_dir(df.sparkSession, "cut")
    with no_shuffles_left(df.sparkSession), small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
