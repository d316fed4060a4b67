"""Lines to messages.

A header line starts a message and the lines up to the next header continue it. Lines are
shuffled once, by (chat, block of line numbers), so a chat of any size is spread over tasks.
A message is put together inside its block; the lines at the start of a block that belong to
a message from an earlier block are joined on, at most one such piece per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatweave.functions import fixed_values as fv
from chatweave.functions.naming import guess_kind
from chatweave.functions.text import bind, sender_to_id, strip
from chatweave.functions.times import iso_text, resolve_offset, with_timestamp
from chatweave.operators.blocks import BLOCK, BLOCK_ROWS, with_block
from chatweave.operators.dialect import block_formats, is_header

META_TYPE = "struct<size_bytes:bigint,sha256:string,duration_seconds:double,width:int,height:int>"
MEDIA_TYPE = f"array<struct<file:string,kind:string,converted_file:string,meta:{META_TYPE}>>"
ENRICHMENT_TYPE = (
    "struct<ocr_text_file:string,ocr_text:string,transcript_file:string,transcript_text:string>"
)
MESSAGE_COLUMNS = (
    "chat_id",
    "msg_idx",
    "ts",
    "ts_local",
    "ts_utc",
    "month",
    "sender",
    "sender_id",
    "type",
    "text",
    "media",
    "enrichment",
    "source_line",
    "_parse_error",
)


def assemble(lines: DataFrame, blocks: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(chat_id, msg_idx, style, date_order, source_line, tail), tail being the joined
    continuation lines or null if there are none. Lines before the first header are dropped."""
    in_block = (
        Window.partitionBy("chat_id", BLOCK)
        .orderBy("line_no")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # Both uses below name the same columns and filters of lines and blocks, needed or not: then
    # their shuffles are equal and Spark makes each of them once.
    block_columns = ["style", "date_order", "first_header", "headers_before", "open_block"]
    numbered = lines.select("chat_id", "line_no", "line").where(F.col("line_no").isNotNull())
    placed = with_block(numbered, "line_no", block_rows).join(
        blocks.select("chat_id", BLOCK, *block_columns), ["chat_id", BLOCK]
    )
    # Messages that start in the block, with their lines in the block.
    own = (
        placed.where(F.col("line_no") >= F.col("first_header"))
        .withColumn("_starts", is_header(F.col("style"), F.col("line")))
        .withColumn("msg_idx", F.col("headers_before") + F.count_if("_starts").over(in_block) - 1)
        .groupBy("chat_id", BLOCK, "msg_idx", *block_columns)
        .agg(
            F.max(F.when(F.col("_starts"), F.col("line"))).alias("source_line"),
            _in_order(F.when(~F.col("_starts"), F.struct("line_no", "line"))).alias("_rest"),
        )
    )
    # Lines before a block's first header belong to the last message of an earlier block.
    carried = (
        placed.where(
            F.col("open_block").isNotNull()
            & (F.col("first_header").isNull() | (F.col("line_no") < F.col("first_header")))
        )
        .groupBy("chat_id", BLOCK, *block_columns)
        .agg(_in_order(F.struct("line_no", "line")).alias("_lines"))
        .groupBy("chat_id", F.col("open_block").alias(BLOCK))
        .agg(
            (F.max("headers_before") - 1).alias("_open_idx"),
            _in_order(F.struct(F.col(BLOCK).alias("b"), F.array_join("_lines.line", "\n").alias("line"))).alias("_more"),
        )
    )
    joined = own.join(carried, ["chat_id", BLOCK], "left").withColumn(
        "_more", F.when(F.col("_open_idx") == F.col("msg_idx"), F.col("_more.line"))
    )
    parts = F.concat("_rest.line", F.coalesce("_more", F.array().cast("array<string>")))
    return joined.withColumn("_parts", parts).select(
        "chat_id",
        "msg_idx",
        "style",
        "date_order",
        "source_line",
        F.when(F.size("_parts") > 0, F.array_join("_parts", "\n")).alias("tail"),
    )


def _in_order(line: Column) -> Column:
    """Structs of a group, nulls left out, in the order of their first field."""
    return F.sort_array(F.collect_list(line))


def attachment_file(body: Column) -> Column:
    """File named by an attachment body, or null."""
    # Few bodies end or start like an attachment; only those are matched. The file group cannot
    # match nothing, so an empty extract means no match.
    suffix = F.when(F.endswith(body, F.lit(")")), F.regexp_extract(body, fv.ATTACHED_SUFFIX, 1))
    tag = F.when(F.startswith(body, F.lit("<")), F.regexp_extract(body, fv.ATTACHED_TAG, 1))
    return strip(F.coalesce(F.nullif(suffix, F.lit("")), F.nullif(tag, F.lit(""))))


def type_messages(assembled: DataFrame, offset: str) -> DataFrame:
    """Split headers into their parts and give every message its type, text and media."""
    style, header = F.col("style"), F.col("source_line")

    def part(group: int) -> Column:
        return (
            F.when(style == "pt", F.regexp_extract(header, fv.PT_HEADER, group))
            .when(style == "ios", F.regexp_extract(header, fv.IOS_HEADER, group))
            .otherwise(F.regexp_extract(header, fv.ANDROID_HEADER, group))
        )

    has_sender = F.col("_name") != ""  # the sender group cannot match nothing
    df = (
        assembled.withColumns({"_stamp": part(fv.HEADER_STAMP), "_rest": part(fv.HEADER_REST)})
        .withColumn("_name", F.regexp_extract("_rest", fv.SENDER, 1))
        .withColumn("sender", F.when(has_sender, strip(F.col("_name"))))
        .withColumn("_body", F.when(has_sender, F.regexp_extract("_rest", fv.SENDER, 2)).otherwise(F.col("_rest")))
        .withColumn("_file", attachment_file(F.col("_body")))
        # Few messages have a file. Bound, its kind stays out of the compiled row loop, which must
        # not outgrow 8000 bytes of code, or the JVM interprets it.
        .withColumn("_kind", F.when(F.col("_file").isNotNull(), bind(F.col("_file"), guess_kind)))
    )
    df = with_timestamp(df, "_stamp", "style", "date_order", "ts_local")
    own_text = F.when(F.col("_file").isNull(), F.col("_body"))
    text = F.when(own_text.isNull() & F.col("tail").isNull(), F.lit(None).cast("string")).otherwise(
        F.concat_ws("\n", own_text, F.col("tail"))
    )
    media = F.when(
        F.col("_file").isNotNull(),
        F.array(
            F.struct(
                F.col("_file").alias("file"),
                F.col("_kind").alias("kind"),
                F.lit(None).cast("string").alias("converted_file"),
                F.lit(None).cast(META_TYPE).alias("meta"),
            )
        ),
    ).otherwise(F.array().cast(MEDIA_TYPE))
    return (
        df.withColumn("ts", iso_text(F.col("ts_local"), offset))
        .withColumn("ts_utc", F.col("ts").cast("timestamp"))
        .withColumn("month", F.coalesce(F.left("ts", F.lit(7)), F.lit(fv.UNKNOWN_MONTH)))
        .withColumn(
            "type",
            F.coalesce("_kind", F.when(has_sender, F.lit("text")).otherwise(F.lit("system"))),
        )
        .withColumn("text", text)
        .withColumn("media", media)
        .withColumn("enrichment", F.lit(None).cast(ENRICHMENT_TYPE))
        .withColumn(
            "_parse_error",
            F.when(F.col("ts_local").isNull(), F.concat(F.lit("bad date or time: "), F.col("source_line"))),
        )
    )


def parse_messages(
    lines: DataFrame,
    *,
    tz_offset: str = "auto",
    style: str = "auto",
    date_order: str = "auto",
    me: list[str] | None = None,
    them: list[str] | None = None,
    mode: str = "PERMISSIVE",
    sample_lines: int | None = fv.DETECTION_SAMPLE_LINES,
    overrides: DataFrame | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Messages of all chats in ``lines(chat_id, line_no, line)``.

    ``sample_lines``: first lines of a chat that decide its style and date order, None for all.
    ``overrides`` (chat_id, style, date_order) sets both for single chats.
    ``mode``: PERMISSIVE keeps a message whose date or time is not real, with ``ts`` null and
    ``_parse_error`` set; FAILFAST fails the job on the first one.
    """
    blocks = block_formats(lines, style, date_order, sample_lines, block_rows, overrides)
    typed = type_messages(assemble(lines, blocks, block_rows), resolve_offset(tz_offset))
    if mode.upper() == "FAILFAST":
        # A filter, so that it runs whichever columns are read.
        error = F.col("_parse_error")
        typed = typed.where(F.when(error.isNull(), F.lit(True)).otherwise(F.raise_error(error).cast("boolean")))
    return typed.withColumn("sender_id", sender_to_id(F.col("sender"), me, them)).select(*MESSAGE_COLUMNS)
