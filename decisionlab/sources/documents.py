"""Sealed record files, the event universe and the calendar feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decisionlab import schema
from decisionlab.functions import columns as C


def read_sealed(spark: SparkSession, path: str) -> DataFrame:
    """Sealed records, one JSON document per file, with the text their hash covers."""
    return parse_sealed(spark.read.text(path, wholetext=True).withColumnRenamed("value", "text"))


def parse_sealed(documents: DataFrame) -> DataFrame:
    """Parse `text` into the record, its hashes, its time and the record's own text.

    The hash of the record before stands under either of two names.

    The record's text is cut from the document and moved two spaces left, since writing the
    parsed record again would not give the same bytes.
    """
    body = F.regexp_extract(
        "text", r'(?s)\n  "record": (\{.*?\n  \}),?\n(?:  "integrity"|\})', 1
    )
    return (
        documents.withColumn("_s", F.from_json("text", schema.SEALED))
        .withColumn("record_text", F.regexp_replace(body, r"\n  ", "\n"))
        .withColumn("record", F.col("_s.record"))
        .withColumn("stored_hash", F.col("_s.integrity.hash"))
        .withColumn(
            "prior_hash", F.coalesce("record.prior_record_hash", "record.prior_verification_hash")
        )
        .withColumn("ts", F.col("record.timestamp_utc").try_cast("timestamp"))
        .drop("_s")
    )


def signal_checks(sealed: DataFrame) -> DataFrame:
    """The signal validation map of each record in long form."""
    return sealed.select(
        F.col("record.catalyst_id").alias("record_id"),
        F.explode(F.map_entries("record.signal_validation")).alias("_e"),
    ).select(
        "record_id",
        F.col("_e.key").alias("signal"),
        F.col("_e.value.weight").alias("weight"),
        F.col("_e.value.fda_rationale_match").alias("fda_rationale_match"),
    )


def read_universe(rows: DataFrame) -> DataFrame:
    """Universe rows (`ticker`, `scheduled`, `actual` texts) with one row per ticker.

    The date texts are kept as they are; the normalised spans are added.
    """
    return (
        rows.withColumn("ticker", F.explode(F.split("ticker", "/")))
        .withColumn("ticker", F.trim("ticker"))
        .withColumn("scheduled_span", C.partial_date("scheduled"))
        .withColumn("actual_span", C.partial_date("actual"))
    )


def calendar_text(events: DataFrame, producer: str = "decisionlab") -> DataFrame:
    """One iCalendar text per event. Needs `prob` and `tier`."""
    day = F.date_format("event_date", "yyyyMMdd")
    score = F.format_string("%.1f", C.percent("prob"))
    title = F.concat_ws("", "type", F.lit(": "), "ticker", F.lit(" — "), "drug")
    about = F.concat_ws(
        "",
        "type", F.lit(" for "), "drug", F.lit(" ("), "company", F.lit(")\\nIndication: "),
        "indication", F.lit("\\nScore: "), score, F.lit("% ("),
        F.replace(F.col("tier"), F.lit("_"), F.lit(" ")), F.lit(")\\nTA: "), "area",
    )
    lines = [
        F.lit("BEGIN:VCALENDAR"),
        F.lit("VERSION:2.0"),
        F.lit(f"PRODID:-//{producer}//EN"),
        F.lit("BEGIN:VEVENT"),
        F.concat(F.lit("DTSTART;VALUE=DATE:"), day),
        F.concat(F.lit("DTEND;VALUE=DATE:"), day),
        F.concat(F.lit("SUMMARY:"), title),
        F.concat(F.lit("DESCRIPTION:"), about),
        F.lit("END:VEVENT"),
        F.lit("END:VCALENDAR"),
    ]
    return events.select("event_id", "event_date", F.concat_ws("\r\n", *lines).alias("text"))


def export_calendar(events: DataFrame, path: str, producer: str = "decisionlab") -> None:
    """Write the calendar texts, one folder per month."""
    month = F.date_format("event_date", "yyyy-MM").alias("month")
    texts = calendar_text(events, producer).select("text", month)
    texts.write.mode("overwrite").partitionBy("month").text(path)
