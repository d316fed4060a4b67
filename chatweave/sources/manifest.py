"""The event log: JSON lines with free keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatweave.functions.naming import relative_path
from chatweave.operators.runs import stamp
from chatweave.sources.lines import plain_folder, read_lines


def parse_manifest(lines: DataFrame) -> DataFrame:
    """manifest(run_id, seq, type, event_ts, file, stage, elapsed_seconds, payload) from
    (run_id, line_no, line).

    Lines that are not JSON are left out. Keys outside the envelope stay readable in ``payload``,
    the whole line.
    """
    event = F.col("_event")
    return (
        lines.withColumn("_event", F.try_parse_json("line"))
        .where(event.isNotNull())
        .select(
            "run_id",
            F.col("line_no").alias("seq"),
            F.try_variant_get(event, "$.type", "string").alias("type"),
            F.try_variant_get(event, "$.event_ts", "timestamp").alias("event_ts"),
            F.try_variant_get(event, "$.file", "string").alias("file"),
            F.try_variant_get(event, "$.stage", "string").alias("stage"),
            F.try_variant_get(event, "$.elapsed_seconds", "double").alias("elapsed_seconds"),
            F.col("line").alias("payload"),
        )
    )


def read_manifest(spark: SparkSession, folder: str, glob: str = "*.jsonl") -> DataFrame:
    """All log files below a folder; ``run_id`` is a log's path below it and ``seq`` its line number."""
    lines = read_lines(spark, folder, glob)
    return parse_manifest(lines.withColumn("run_id", relative_path(F.col("path"), plain_folder(folder))))


def append_events(events: DataFrame, folder: str) -> None:
    """Append events (run_id, seq, type, any more columns) as JSON lines; those without a time get one.

    A line holds its run and its place in the run, so it does not matter how many files and
    appends a run is spread over.
    """
    missing = {"run_id", "seq", "type"} - set(events.columns)
    if missing:
        raise ValueError(f"events without {sorted(missing)}")
    stamp(events).write.mode("append").json(folder)


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """The log that ``append_events`` wrote, with the columns of ``parse_manifest``."""
    lines = spark.read.text(folder).select(
        F.get_json_object("value", "$.run_id").alias("run_id"),
        F.get_json_object("value", "$.seq").cast("long").alias("line_no"),
        F.col("value").alias("line"),
    )
    return parse_manifest(lines)
