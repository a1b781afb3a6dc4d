"""Decision events, their signals and the weight tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decisionlab import schema


def read_events(
    spark: SparkSession, path: str, fmt: str = "parquet", multi_line: bool = False
) -> DataFrame:
    """Decision events in date order, read with the fixed schema.

    JSON input is one object per line; `multi_line` takes files that hold one array of
    objects each (such files cannot be split, so keep them small).
    """
    reader = spark.read.schema(schema.EVENT).option("multiLine", multi_line)
    return sort_by_date(reader.format(fmt).load(path))


def sort_by_date(events: DataFrame) -> DataFrame:
    """Events in date order, the id breaking ties."""
    return events.orderBy("event_date", "event_id")


def explode_signals(events: DataFrame, signals: str = "signals") -> DataFrame:
    """One row per signal of an event, with its place in the stored order.

    `signals` is a map of name to weight, or an array of names.
    """
    kind = events.schema[signals].dataType.typeName()
    if kind == "map":
        return events.select(
            "event_id", F.posexplode(F.map_entries(signals)).alias("pos", "entry")
        ).select(
            "event_id",
            "pos",
            F.col("entry.key").alias("signal"),
            F.col("entry.value").cast(schema.WEIGHT).alias("recorded_weight"),
        )
    return events.select("event_id", F.posexplode(signals).alias("pos", "signal"))


def load_weights(base: DataFrame, overrides: DataFrame, version: str | None = None) -> DataFrame:
    """A weight version that inherits `base` and sets the rows of `overrides` on top."""
    kept = base.join(overrides, "signal", "left_anti").select(base.columns)
    merged = kept.unionByName(overrides)
    return merged.withColumn("version", F.lit(version)) if version else merged


def distinct_signals(events: DataFrame, signals: str = "signals") -> DataFrame:
    """Every signal name in use."""
    return explode_signals(events, signals).select("signal").distinct()
