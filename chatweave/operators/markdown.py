"""Messages as Markdown lines, with month headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatweave.functions import fixed_values as fv
from chatweave.functions.text import blank_to_null, clip, strip
from chatweave.functions.times import display_time
from chatweave.operators.blocks import BLOCK_ROWS, densely, previous_value


def display_name(sender: Column, sender_id: Column) -> Column:
    """'ME (Name)' or 'THEM (Name)'; otherwise the raw name; SYSTEM for null or empty."""
    who = F.when(sender != "", sender).otherwise(F.lit(fv.SYSTEM_NAME))
    sid = F.coalesce(F.when(sender_id != "", sender_id), who)
    mapped = sid.isin("ME", "THEM") & (who != fv.SYSTEM_NAME)
    return F.when(mapped, F.concat(sid, F.lit(" ("), who, F.lit(")"))).otherwise(who)


def bullet(max_chars: int = fv.MARKDOWN_CLIP_CHARS) -> Column:
    """Markdown of one message: a bullet, and sub-bullets for its transcript and OCR text."""
    head = F.concat(F.lit("- **"), F.coalesce(display_time(F.col("ts_local"), F.col("ts")), F.lit("None")), F.lit("** — "))
    who = F.concat(F.lit("**"), display_name(F.col("sender"), F.col("sender_id")), F.lit("**: "))
    text = strip(F.coalesce("text", F.lit("")))
    files = F.array_join(F.filter(F.col("media.file"), lambda f: f != ""), ", ")

    def sub_bullet(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"  - {label}: "), clip(blank_to_null(value), max_chars))

    with_media = F.concat_ws(
        "\n",
        F.concat(head, who, F.lit("*"), F.col("type"), F.lit("* ("), files, F.lit(")")),
        F.when(blank_to_null(F.col("enrichment.transcript_text")).isNotNull(), sub_bullet("Transcript", F.col("enrichment.transcript_text"))),
        F.when(blank_to_null(F.col("enrichment.ocr_text")).isNotNull(), sub_bullet("OCR", F.col("enrichment.ocr_text"))),
    )
    return (
        F.when(F.col("type") == "text", F.concat(head, who, text))
        .when(F.col("type") == "system", F.concat(head, F.lit("*(system)*: "), text))
        .otherwise(with_media)
    )


def with_month_headings(messages: DataFrame, block_rows: int = BLOCK_ROWS, sparse: bool = False) -> DataFrame:
    """Add ``new_month``: the month differs from that of the message before. It may come back.

    ``sparse``: the numbers of messages have gaps (parsed ones have none), so they are numbered anew first.
    """
    numbered, order = messages, "msg_idx"
    if sparse:
        numbered, order = densely(messages, ["chat_id"], "msg_idx", "_place"), "_place"
    return (
        previous_value(numbered, ["chat_id"], order, "month", "_previous", block_rows)
        .withColumn("new_month", ~F.col("month").eqNullSafe(F.col("_previous")))
        .drop("_previous", "_place")
    )


def transcript_lines(messages: DataFrame, max_chars: int = fv.MARKDOWN_CLIP_CHARS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(chat_id, msg_idx, md): the transcript, to be written in order of msg_idx.

    The first message of a chat carries the title and the first of a month its heading.
    """
    title = F.when(F.col("msg_idx") == 0, F.lit(fv.TRANSCRIPT_TITLE + "\n"))
    heading = F.when(F.col("new_month"), F.concat(F.lit("\n## "), F.col("month"), F.lit("\n")))
    return with_month_headings(messages, block_rows).select(
        "chat_id", "msg_idx", F.concat_ws("\n", title, heading, bullet(max_chars)).alias("md")
    )
