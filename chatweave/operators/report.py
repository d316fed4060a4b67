"""Per-chat summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatweave.operators.blocks import densely


def participants(messages: DataFrame) -> DataFrame:
    """(chat_id, sender, n_messages): the participant list as rows, for chats of any size."""
    return (
        messages.where(F.col("sender") != "")
        .groupBy("chat_id", "sender")
        .agg(F.count(F.lit(1)).alias("n_messages"))
    )


def chat_summary(messages: DataFrame) -> DataFrame:
    """One row per chat: n_messages, first_ts, last_ts, n_participants. No list is made."""
    per_sender = messages.groupBy("chat_id", "sender").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("ts", "ts_utc").alias("first_ts"),
        F.max_by("ts", "ts_utc").alias("last_ts"),
        F.min("ts_utc").alias("_min"),
        F.max("ts_utc").alias("_max"),
    )
    return per_sender.groupBy("chat_id").agg(
        F.sum("n").alias("n_messages"),
        F.min_by("first_ts", "_min").alias("first_ts"),
        F.max_by("last_ts", "_max").alias("last_ts"),
        F.count_if(F.col("sender") != "").alias("n_participants"),
    )


def chat_report(messages: DataFrame) -> DataFrame:
    """``chat_summary`` with ``participants`` (sorted raw names) as a column, for chats whose names fit into a row."""
    names = participants(messages).groupBy("chat_id").agg(F.sort_array(F.collect_list("sender")).alias("participants"))
    empty = F.array().cast("array<string>")
    return (
        chat_summary(messages).drop("n_participants").join(names, "chat_id", "left")
        .withColumn("participants", F.coalesce("participants", empty))
    )


def months(messages: DataFrame) -> DataFrame:
    """Distinct (chat_id, month) with the number of messages."""
    return messages.groupBy("chat_id", "month").agg(F.count(F.lit(1)).alias("n_messages"))


def _names(names: list[str] | None) -> Column:
    return F.lit(", ".join(names) if names else "(none)")


@dataclass(frozen=True)
class ReportHeader:
    """What a report says besides the facts of its chat. ``counters`` are columns of the summary."""

    chat_file: Column
    export_folder: Column
    out_dir: str
    resume: bool
    tz: str
    outputs: dict[str, str]
    counters: list[str]
    workers: dict[str, int] | None = None
    me: list[str] | None = None
    them: list[str] | None = None
    title: str = "# Chat Report"


def _around_names(header: ReportHeader) -> tuple[Column, Column]:
    """The report before and after the names of participants."""
    dates = F.when(
        F.col("first_ts").isNotNull(),
        F.concat(F.lit("- Date range: `"), "first_ts", F.lit("` → `"), "last_ts", F.lit("`")),
    )
    tz = [F.lit(f"- TZ: `{header.tz}`"), F.lit(f"- Workers: `{header.workers}`\n")] if header.workers else [F.lit(f"- TZ: `{header.tz}`\n")]
    before = [
        F.lit(header.title + "\n"),
        F.concat(F.lit("- Chat file: `"), header.chat_file, F.lit("`")),
        F.concat(F.lit("- Export folder: `"), header.export_folder, F.lit("`")),
        F.lit(f"- Output folder: `{header.out_dir}`"),
        F.lit(f"- Resume: `{header.resume}`"),
        *tz,
        dates,
        F.lit("- Participants detected: "),
    ]
    after = [
        F.lit(""),
        F.concat(F.lit("- ME mapping: "), _names(header.me)),
        F.concat(F.lit("- THEM mapping: "), _names(header.them), F.lit("\n")),
        F.lit("## Outputs\n"),
        *[F.lit(f"- {k}: `{v}`") for k, v in header.outputs.items()],
        F.lit("\n## Summary\n"),
        *[F.concat(F.lit(f"- {c}: "), F.col(c).cast("string")) for c in sorted(header.counters)],
    ]
    return F.concat_ws("\n", *before), F.concat_ws("\n", *after)


def report_text(report: DataFrame, **header) -> DataFrame:
    """(chat_id, report) of ``chat_report`` rows, the report as Markdown; ``header`` as in ``ReportHeader``."""
    before, after = _around_names(ReportHeader(**header))
    people = F.when(F.size("participants") > 0, F.array_join("participants", ", ")).otherwise("(none)")
    return report.select("chat_id", F.concat(before, people, after).alias("report"))


def report_rows(summary: DataFrame, people: DataFrame, **header) -> DataFrame:
    """Writer rows (``operators.parts.WRITER_COLUMNS``) of the same reports: a chat's names are rows, in order.

    ``summary``: ``chat_summary`` rows with the counters; ``people``: ``participants`` rows. They come
    together only while files are written.
    """
    before, after = _around_names(ReportHeader(**header))
    zero = F.lit(0).cast("long")
    heads = summary.select(
        "chat_id", zero.alias("msg_idx"), F.lit(-1).cast("long").alias("part"), before.alias("open"),
        F.concat(after, F.lit("\n")).alias("close"), F.lit(True).alias("takes_text"),
        F.when(F.col("n_participants") == 0, "(none)").alias("text"),
    )
    none = F.lit(None).cast("string")
    names = densely(people, ["chat_id"], "sender", "part").select(
        "chat_id", zero.alias("msg_idx"), F.col("part").cast("long").alias("part"), none.alias("open"), none.alias("close"),
        F.lit(None).cast("boolean").alias("takes_text"), F.concat(F.when(F.col("part") > 0, ", ").otherwise(""), F.col("sender")).alias("text"),
    )
    return heads.unionByName(names)
