"""Append-only monthly output: a later run adds only what the earlier ones did not write.

The marker of a (chat, month) is the last row written for it. It is looked up among the new
messages by (ts, source_line), where equal messages count as the last of them, and only messages
after it are appended. Rows already written are never changed.

Markers are a small table of their own, one row per (chat, month, batch), so the history is not
read again. A batch writes its own folders and its own markers and starts from the markers of earlier
batches: repeating a batch that was cut off gives the same rows once.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatweave.functions import fixed_values as fv
from chatweave.operators.markdown import bullet
from chatweave.operators.parse import ENRICHMENT_TYPE, MEDIA_TYPE
from chatweave.plans.session import store
from chatweave.sources.changes import ChangeTable

MONTH_SCHEMA = (
    "chat_id string, batch bigint, msg_idx bigint, ts string, sender string, type string, text string, "
    f"media {MEDIA_TYPE}, enrichment {ENRICHMENT_TYPE}, source_line string, sender_id string, month string"
)
MARKER_SCHEMA = "chat_id string, batch bigint, msg_idx bigint, ts string, source_line string, month string"


def last_markers(written: DataFrame) -> DataFrame:
    """(chat_id, month, ts, source_line) of the last row written, by (batch, msg_idx); torn lines name no chat and do not count."""
    return (
        written.where("chat_id IS NOT NULL").groupBy("chat_id", "month")
        .agg(F.max_by(F.struct("ts", "source_line"), F.struct("batch", "msg_idx")).alias("m"))
        .select("chat_id", "month", "m.ts", "m.source_line")
    )


def _match_key(ts: Column) -> Column:
    # Only messages with an unreadable date have no ts; their header text is the whole marker.
    return F.coalesce(ts, F.lit(""))


def locate_markers(messages: DataFrame, markers: DataFrame) -> DataFrame:
    """(chat_id, month, marker_idx): where each marker is in ``messages``; null when it is not there.

    A marker without a header line is never found.
    """
    positions = (
        messages.where(F.col("source_line") != "")
        .groupBy("chat_id", _match_key(F.col("ts")).alias("ts"), "source_line")
        .agg(F.max("msg_idx").alias("marker_idx"))
    )
    wanted = markers.withColumn("ts", _match_key(F.col("ts")))
    return wanted.join(positions, ["chat_id", "ts", "source_line"], "left").select(
        "chat_id", "month", "marker_idx"
    )


def after_markers(messages: DataFrame, located: DataFrame) -> DataFrame:
    """Messages not written yet: those after their month's marker, or all of a month without one."""
    joined = messages.join(located, ["chat_id", "month"], "left")
    return joined.where(F.col("marker_idx").isNull() | (F.col("msg_idx") > F.col("marker_idx"))).drop("marker_idx")


def missing_marker_events(located: DataFrame) -> DataFrame:
    return located.where(F.col("marker_idx").isNull()).select(
        "chat_id", F.lit("by_month_marker_missing").alias("type"), "month"
    )


def marker_table(spark: SparkSession, out_dir: str) -> ChangeTable:
    """Last row written per (chat, month); a version is a batch."""
    return ChangeTable(
        spark, f"{out_dir.rstrip('/')}/by-month-markers", "chat_id string, month string", "msg_idx bigint, ts string, source_line string", 4
    )


def rebuild_markers(spark: SparkSession, out_dir: str, batch: int) -> bool:
    """Markers from the written rows themselves, for output whose marker table is lost; False if there is no output.

    The only step that reads the history. They are stored as those of the batch before ``batch``.
    """
    try:
        written = spark.read.schema(MARKER_SCHEMA).json(f"{out_dir.rstrip('/')}/by-month")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    last = last_markers(written.where(F.col("batch") < batch))
    marker_table(spark, out_dir).append(last.withColumn("msg_idx", F.lit(-1).cast("long")), batch - 1)
    return True


def append_months(
    messages: DataFrame, out_dir: str, batch: int, markdown_chars: int = fv.MARKDOWN_CLIP_CHARS
) -> DataFrame | None:
    """Append new messages to ``out_dir/by-month/month=YYYY-MM/batch=N``; returns missing-marker events.

    ``batch`` (1 or more) must grow from run to run; the same batch again replaces what it wrote.
    Rows are laid out by (month, chat, message) ranges, which keeps files even when one chat or
    month is very large.
    """
    spark = messages.sparkSession
    folder = f"{out_dir.rstrip('/')}/by-month"
    markers = marker_table(spark, out_dir)
    events = None
    new = messages
    if markers.exists() or rebuild_markers(spark, out_dir, batch):
        located = store(locate_markers(messages, markers.read(below=batch).select("chat_id", "month", "ts", "source_line")))
        new = after_markers(messages, located)
        events = missing_marker_events(located)
    rows = (
        new.withColumn("batch", F.lit(batch).cast("long"))
        .withColumn("md", bullet(markdown_chars))
        .select(
            "month", "batch", "chat_id", "msg_idx", "ts", "sender", "type", "text", "media", "enrichment",
            "source_line", "sender_id", "md",
        )
    )
    (
        rows.repartitionByRange("month", "chat_id", "msg_idx")
        .sortWithinPartitions("month", "chat_id", "msg_idx")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("ignoreNullFields", "false")
        .partitionBy("month", "batch")
        .json(folder)
    )
    last = rows.groupBy("chat_id", "month").agg(F.max_by(F.struct("msg_idx", "ts", "source_line"), "msg_idx").alias("m"))
    markers.append(last.select("chat_id", "month", "m.*"), batch)
    markers.compact_if_long(batch - 1)
    return events


def month_markdown(spark: SparkSession, out_dir: str) -> DataFrame:
    """(chat_id, month, batch, msg_idx, md): the monthly Markdown; a month's first line has its heading."""
    rows = spark.read.schema("chat_id string, batch bigint, msg_idx bigint, md string, month string").json(
        f"{out_dir.rstrip('/')}/by-month"
    )
    first = rows.groupBy("chat_id", "month").agg(F.min(F.struct("batch", "msg_idx")).alias("_first"))
    joined = rows.join(first, ["chat_id", "month"], "left")
    is_first = (F.col("_first.batch") == F.col("batch")) & (F.col("_first.msg_idx") == F.col("msg_idx"))
    heading = F.when(is_first, F.concat(F.lit("# "), F.col("month"), F.lit("\n")))
    return joined.select("chat_id", "month", "batch", "msg_idx", F.concat_ws("\n", heading, "md").alias("md"))
