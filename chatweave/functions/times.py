"""Header dates and times to timestamps."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatweave.functions import fixed_values as fv
from chatweave.functions.text import strip


def resolve_offset(tz_offset: str | None) -> str:
    """'+HH:MM' or '-HH:MM'; ``auto`` is this machine's offset now, fixed when the job is built."""
    if not tz_offset or tz_offset.lower() == "auto":
        text = datetime.now(timezone.utc).astimezone().strftime("%z")
        return f"{text[:3]}:{text[3:5]}"
    if not re.fullmatch(r"[+-]\d{2}:\d{2}", tz_offset):
        raise ValueError(f"tz_offset must be 'auto' or like '+02:00', not {tz_offset!r}")
    return tz_offset


def int_or_null(col: Column) -> Column:
    return col.try_cast("int")


def with_timestamp(df: DataFrame, stamp: str, style: str, date_order: str, out: str) -> DataFrame:
    """Add TIMESTAMP_NTZ ``out`` of a header's date and time, to the minute; null when they are not
    real. Patterns only check the clock, the parts are cut out by position.

    Portuguese times name the part of the day: morning words turn 12 into 0, afternoon and night
    words add 12 to hours below 12, so '12:30 da noite' stays at 12.
    """
    pt = F.col(style) == "pt"
    clock = F.expr(f"substring(`{stamp}`, instr(`{stamp}`, ',') + 1)")
    df = (
        df.withColumns({"_date": F.split(F.substring_index(stamp, ",", 1), "/"), "_clock": strip(clock)})
        # '9:05 p. m.' is 9:05pm; '9:41 da manhã' is 9:41damanhã.
        .withColumn("_packed", F.lower(F.translate("_clock", fv.SPACES + ".", "")))
        .withColumn("_12h", ~pt & F.endswith("_packed", F.lit("m")) & F.col("_packed").rlike(fv.TIME_12H))
        .withColumn("_known", pt | F.col("_12h") | F.col("_clock").rlike(fv.TIME_24H))
        .withColumn("_hm", F.when(F.col("_known"), F.split("_packed", ":")))
        .withColumn("_mm", F.get("_hm", F.lit(1)))
        .withColumns(
            {
                "_a": int_or_null(F.get("_date", F.lit(0))),
                "_b": int_or_null(F.get("_date", F.lit(1))),
                "_year": int_or_null(F.get("_date", F.lit(2))),
                "_hour": int_or_null(F.get("_hm", F.lit(0))),
                "_minute": int_or_null(F.left("_mm", F.lit(2))),
                "_period": F.when(pt, F.substring("_mm", 5, 3)).when(F.col("_12h"), F.right("_packed", F.lit(2))),
            }
        )
    )
    hour, mdy = F.col("_hour"), F.col(date_order) == "mdy"
    hour = (
        F.when(F.col("_period").isin("am", "mad", "man") & (hour == 12), F.lit(0))
        .when(F.col("_period").isin("pm", "tar", "noi") & (hour < 12), hour + 12)
        .otherwise(hour)
    )
    made = F.try_make_timestamp_ntz(
        F.when(F.col("_year") < 100, F.col("_year") + 2000).otherwise(F.col("_year")),
        F.when(mdy, F.col("_a")).otherwise(F.col("_b")),
        F.when(mdy, F.col("_b")).otherwise(F.col("_a")),
        hour,
        F.col("_minute"),
        F.lit(0).cast("decimal(16,6)"),
    )
    return df.withColumn(out, made).drop(
        "_date", "_clock", "_packed", "_12h", "_known", "_hm", "_mm", "_a", "_b", "_year", "_hour", "_minute", "_period"
    )


def iso_text(ts_local: Column, offset: str) -> Column:
    return F.concat(F.date_format(ts_local, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(offset))


def display_time(ts_local: Column, ts: Column) -> Column:
    return F.coalesce(F.date_format(ts_local, "yyyy-MM-dd HH:mm"), ts)
