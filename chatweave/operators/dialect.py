"""Which header style and date order each chat uses.

All evidence is counts, so one partially aggregated pass over the lines is enough, however
large a chat is. The pass keeps one row per (chat, block of lines), because message assembly
needs the header counts per block as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatweave.functions import fixed_values as fv
from chatweave.functions.times import int_or_null
from chatweave.operators.blocks import BLOCK, BLOCK_ROWS, with_block

_HEADERS = {"pt": fv.PT_HEADER, "android": fv.ANDROID_HEADER, "ios": fv.IOS_HEADER}


def is_header(style: Column, line: Column) -> Column:
    return (
        F.when(style == "pt", line.rlike(fv.PT_HEADER))
        .when(style == "ios", line.rlike(fv.IOS_HEADER))
        .otherwise(line.rlike(fv.ANDROID_HEADER))
    )


def in_sample(sample_lines: int | None) -> Column:
    """Lines that vote on style and date order; None: all of them."""
    return F.lit(True) if sample_lines is None else F.col("line_no") < sample_lines


def header_evidence(
    lines: DataFrame,
    sample_lines: int | None = fv.DETECTION_SAMPLE_LINES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per (chat_id, block): headers of each style, and the votes of the sampled lines.

    A line of style pt also has the android shape. It needs no exclusion here: pt wins as soon
    as one such line is sampled, and when none is, the two android counts are the same. The ios
    shape excludes the other two. So one set of votes serves detection and forced styles.
    """
    df = with_block(lines, "line_no", block_rows)
    sampled = in_sample(sample_lines)
    for style, pattern in _HEADERS.items():
        df = df.withColumn(f"_{style}", F.col("line").rlike(pattern))
    aggs = []
    for style in fv.STYLES:
        aggs.append(F.count_if(F.col(f"_{style}")).alias(f"headers_{style}"))
        aggs.append(F.min(F.when(F.col(f"_{style}"), F.col("line_no"))).alias(f"first_{style}"))
        aggs.append(F.count_if(F.col(f"_{style}") & sampled).alias(f"seen_{style}"))
    for style in ("android", "ios"):
        # Only sampled headers reach the two extractions.
        voter = F.when(F.col(f"_{style}") & sampled, F.col("line"))
        numbers = F.split(F.regexp_extract(voter, _HEADERS[style], fv.HEADER_DATE), "/")
        a, b = (int_or_null(F.get(numbers, F.lit(i))) for i in (0, 1))
        packed = F.lower(F.regexp_replace(F.regexp_extract(voter, _HEADERS[style], fv.HEADER_TIME), r"(?U)[\s.]", ""))
        aggs += [
            F.count_if((a > 12) & (b <= 12)).alias(f"dmy_{style}"),
            F.count_if((b > 12) & (a <= 12)).alias(f"mdy_{style}"),
            F.count_if(packed.endswith("am") | packed.endswith("pm")).alias(f"ampm_{style}"),
        ]
    return df.groupBy("chat_id", BLOCK).agg(*aggs)


EVIDENCE = tuple(f"seen_{s}" for s in fv.STYLES) + tuple(
    f"{vote}_{s}" for s in ("android", "ios") for vote in ("dmy", "mdy", "ampm")
)


def _voted_order(style: str) -> Column:
    dmy, mdy, ampm = (F.col(f"{v}_{style}") for v in ("dmy", "mdy", "ampm"))
    by_vote = F.when(dmy >= mdy, "dmy").otherwise("mdy")
    by_clock = F.when(ampm > 0, "mdy").otherwise("dmy")
    return F.when((dmy > 0) | (mdy > 0), by_vote).otherwise(by_clock)


def with_overrides(chats: DataFrame, overrides: DataFrame | None) -> DataFrame:
    """Add what ``overrides`` (chat_id, style, date_order) say on each chat.

    Null, "auto" and unknown names leave the choice to the other settings. Of several rows of a
    chat the first name in alphabetical order counts.
    """
    if overrides is None:
        return chats

    def named(column: str, names: tuple[str, ...]) -> Column:
        name = F.lower(F.trim(F.col(column)))
        return F.min(F.when(name.isin(*names), name))

    per_chat = overrides.groupBy("chat_id").agg(
        named("style", tuple(fv.STYLES)).alias("_style"), named("date_order", tuple(fv.DATE_ORDERS)).alias("_order")
    )
    return chats.join(per_chat, "chat_id", "left")


def resolve_style(evidence: DataFrame, style: str = "auto", date_order: str = "auto") -> DataFrame:
    """Add ``style`` and ``date_order`` to rows that hold a chat's summed EVIDENCE columns.

    What ``with_overrides`` added comes before the two arguments, and these before the votes.
    """
    overridden = "_style" in evidence.columns
    style, date_order = (style or "auto").lower(), (date_order or "auto").lower()
    if style in fv.STYLES:
        chosen: Column = F.lit(style)
    else:
        chosen = (
            F.when(F.col("seen_pt") > 0, "pt")
            .when((F.col("seen_ios") > 0) & (F.col("seen_ios") >= F.col("seen_android")), "ios")
            .otherwise("android")
        )
    if date_order in fv.DATE_ORDERS:
        order: Column = F.lit(date_order)
    else:
        order = F.when(F.col("style") == "ios", _voted_order("ios")).otherwise(_voted_order("android"))
    if overridden:
        chosen, order = F.coalesce("_style", chosen), F.coalesce("_order", order)
    return evidence.withColumn("style", chosen).withColumn(
        "date_order", F.when(F.col("style") == "pt", "dmy").otherwise(order)
    )


def chat_formats(
    lines: DataFrame,
    style: str = "auto",
    date_order: str = "auto",
    sample_lines: int | None = fv.DETECTION_SAMPLE_LINES,
    overrides: DataFrame | None = None,
) -> DataFrame:
    """(chat_id, style, date_order), one row per chat that has lines.

    The filter keeps the sample only, but every chat has a line 0, so no chat is lost.
    """
    sample = lines.where(in_sample(sample_lines))
    votes = (
        header_evidence(sample, sample_lines)
        .groupBy("chat_id")
        .agg(*[F.sum(c).alias(c) for c in EVIDENCE])
    )
    return resolve_style(with_overrides(votes, overrides), style, date_order).select("chat_id", "style", "date_order")


def block_formats(
    lines: DataFrame,
    style: str = "auto",
    date_order: str = "auto",
    sample_lines: int | None = fv.DETECTION_SAMPLE_LINES,
    block_rows: int = BLOCK_ROWS,
    overrides: DataFrame | None = None,
) -> DataFrame:
    """Per (chat_id, block): the chat's style and order, and where its messages are.

    ``headers_before`` counts the headers of earlier blocks, ``first_header`` is the block's first
    header line (null if it has none), and ``open_block`` is the last earlier block with a header:
    lines before ``first_header`` continue the last message of that block.
    """
    chat = Window.partitionBy("chat_id")
    earlier = chat.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    blocks = header_evidence(lines, sample_lines, block_rows)
    own = [c for c in blocks.columns if c not in EVIDENCE]
    summed = blocks.select(*own, *[F.sum(c).over(chat).alias(c) for c in EVIDENCE])
    return (
        resolve_style(with_overrides(summed, overrides), style, date_order)
        .withColumns({"_headers": _of_style("headers"), "first_header": _of_style("first")})
        .select(
            "chat_id",
            BLOCK,
            "style",
            "date_order",
            "first_header",
            F.coalesce(F.sum("_headers").over(earlier), F.lit(0)).alias("headers_before"),
            F.max(F.when(F.col("_headers") > 0, F.col(BLOCK))).over(earlier).alias("open_block"),
        )
    )


def _of_style(measure: str) -> Column:
    """The ``measure`` column of the chat's style."""
    return F.expr(
        f"CASE style WHEN 'pt' THEN {measure}_pt WHEN 'ios' THEN {measure}_ios ELSE {measure}_android END"
    )


def count_messages(lines: DataFrame, style: str = "auto", date_order: str = "auto") -> DataFrame:
    """(chat_id, n_messages): headers of the chat's style, without assembling messages."""
    totals = (
        header_evidence(lines)
        .groupBy("chat_id")
        .agg(
            *[F.sum(c).alias(c) for c in EVIDENCE],
            *[F.sum(f"headers_{s}").alias(f"headers_{s}") for s in fv.STYLES],
        )
    )
    return resolve_style(totals, style, date_order).select(
        "chat_id",
        _of_style("headers").alias("n_messages"),
    )
