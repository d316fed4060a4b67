"""Messages as rows of bounded size: a header row and rows of up to ``PART_LINES`` continuation lines.

A message of any length is spread over the blocks of its chat and never put together; rows of one
message are in order by ``part``. ``sources.chatfiles`` writes them in that order as a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatweave.functions import fixed_values as fv
from chatweave.functions.text import sender_to_id
from chatweave.functions.times import resolve_offset
from chatweave.operators.blocks import BLOCK, BLOCK_ROWS, with_block
from chatweave.operators.dialect import block_formats, is_header
from chatweave.operators.markdown import bullet, with_month_headings
from chatweave.operators.parse import MESSAGE_COLUMNS, type_messages

PART_LINES = 1024
PART_COLUMNS = (*MESSAGE_COLUMNS, "part")


def line_parts(lines: DataFrame, blocks: DataFrame, block_rows: int = BLOCK_ROWS, part_lines: int = PART_LINES) -> DataFrame:
    """(chat_id, msg_idx, part, style, date_order, source_line, lines): the header of a message, then its lines.

    ``part`` is the number of the first line of a row; ``source_line`` is null but in headers. Lines
    before the first header are dropped. Rows are made where the lines of their block are.
    """
    in_block = (
        Window.partitionBy("chat_id", BLOCK)
        .orderBy("line_no")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    numbered = lines.select("chat_id", "line_no", "line").where(F.col("line_no").isNotNull())
    placed = with_block(numbered, "line_no", block_rows).join(
        blocks.select("chat_id", BLOCK, "style", "date_order", "headers_before"), ["chat_id", BLOCK]
    )
    part = F.when(F.col("_starts"), F.lit(-1)).otherwise(F.expr(f"line_no div {int(part_lines)}"))
    text = F.sort_array(F.collect_list(F.when(~F.col("_starts"), F.struct("line_no", "line"))))
    return (
        placed.withColumn("_starts", is_header(F.col("style"), F.col("line")))
        .withColumn("msg_idx", F.col("headers_before") + F.count_if("_starts").over(in_block) - 1)
        .where("msg_idx >= 0")
        .groupBy("chat_id", BLOCK, "msg_idx", part.alias("_part"), "style", "date_order")
        .agg(F.min("line_no").alias("part"), F.max(F.when(F.col("_starts"), F.col("line"))).alias("source_line"), text.alias("_lines"))
        .select(
            "chat_id", "msg_idx", "part", "style", "date_order", "source_line",
            F.when(F.size("_lines") > 0, F.array_join("_lines.line", "\n")).alias("lines"),
        )
    )


def parse_parts(
    lines: DataFrame,
    *,
    tz_offset: str = "auto",
    style: str = "auto",
    date_order: str = "auto",
    me: list[str] | None = None,
    them: list[str] | None = None,
    sample_lines: int | None = fv.DETECTION_SAMPLE_LINES,
    overrides: DataFrame | None = None,
    block_rows: int = BLOCK_ROWS,
    part_lines: int = PART_LINES,
) -> DataFrame:
    """``PART_COLUMNS`` of all chats in ``lines(chat_id, line_no, line)``.

    A header row has all that ``parse_messages`` gives but the continuation lines; the rows that follow
    have these as ``text`` and nothing else. The text of a message is the texts of its rows that are
    not null, joined by line breaks.
    """
    blocks = block_formats(lines, style, date_order, sample_lines, block_rows, overrides)
    parts = line_parts(lines, blocks, block_rows, part_lines).withColumn("tail", F.lit(None).cast("string"))
    typed = type_messages(parts, resolve_offset(tz_offset)).withColumn("sender_id", sender_to_id(F.col("sender"), me, them))
    head = F.col("source_line").isNotNull()
    own = ("chat_id", "msg_idx", "text")
    columns = [F.col(c) if c in own else F.when(head, F.col(c)).alias(c) for c in MESSAGE_COLUMNS]
    return typed.withColumn("text", F.when(head, F.col("text")).otherwise(F.col("lines"))).select(*columns, "part")


def whole_messages(parts: DataFrame) -> DataFrame:
    """Messages (``MESSAGE_COLUMNS``) from their parts, for those that fit into a row."""
    texts = F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("part", "text"))))
    rest = [c for c in MESSAGE_COLUMNS if c not in ("chat_id", "msg_idx", "text")]
    grouped = parts.groupBy("chat_id", "msg_idx").agg(
        F.max_by(F.struct(*rest), F.when(F.col("source_line").isNotNull(), F.col("part"))).alias("_head"), texts.alias("_texts")
    )
    text = F.when(F.size("_texts") > 0, F.array_join("_texts.text", "\n")).alias("text")
    return grouped.select("chat_id", "msg_idx", text, "_head.*").select(*MESSAGE_COLUMNS)


# --- rows for the writer ----------------------------------------------------------------------

#: ``open`` and ``close``: what is written before and after a message's text, null but in headers.
WRITER_COLUMNS = ("chat_id", "msg_idx", "part", "open", "close", "takes_text", "text")


def json_rows(parts: DataFrame) -> DataFrame:
    """``WRITER_COLUMNS`` of ``parts`` (or of whole messages): one JSON object a message, nulls kept."""
    keep = {"ignoreNullFields": "false"}
    opened = F.to_json(F.struct("chat_id", "msg_idx", "ts", "sender", "type"), keep)
    closed = F.to_json(F.struct("media", "enrichment", "source_line", "sender_id"), keep)
    head = F.col("source_line").isNotNull()
    return _with_part(parts).withColumns({"_open": opened, "_close": closed}).select(
        "chat_id", "msg_idx", "part",
        F.when(head, F.concat(F.expr("left(_open, length(_open) - 1)"), F.lit(',"text":'))).alias("open"),
        F.when(head, F.concat(F.lit(","), F.expr("substring(_close, 2)"), F.lit("\n"))).alias("close"),
        F.when(head, F.lit(True)).alias("takes_text"), "text",
    )


def markdown_rows(parts: DataFrame, max_chars: int = fv.MARKDOWN_CLIP_CHARS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``WRITER_COLUMNS`` of ``parts`` (or of whole messages): title, month headings and bullets."""
    parts = _with_part(parts)
    head = F.col("source_line").isNotNull()
    title = F.when(F.col("msg_idx") == 0, F.lit(fv.TRANSCRIPT_TITLE + "\n"))
    heading = F.when(F.col("new_month"), F.concat(F.lit("\n## "), F.col("month"), F.lit("\n")))
    heads = with_month_headings(parts.where(head), block_rows).withColumn("_text", F.col("text")).withColumn("text", F.lit(""))
    opened = heads.select(
        "chat_id", "msg_idx", "part", F.concat_ws("\n", title, heading, bullet(max_chars)).alias("open"), F.lit("\n").alias("close"),
        F.col("type").isin("text", "system").alias("takes_text"), F.col("_text").alias("text"),
    )
    empty = F.lit(None).cast("string")
    return opened.unionByName(
        parts.where(~head).select(
            "chat_id", "msg_idx", "part", empty.alias("open"), empty.alias("close"), F.lit(None).cast("boolean").alias("takes_text"), "text"
        )
    )


def _with_part(messages: DataFrame) -> DataFrame:
    return messages if "part" in messages.columns else messages.withColumn("part", F.lit(0).cast("long"))
