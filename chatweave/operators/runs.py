"""Questions about runs, answered from the event log ``manifest``.

Every measure is a count, sum or maximum, so one partially aggregated pass per question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatweave.functions import fixed_values as fv

MANIFEST_SCHEMA = (
    "run_id string, seq bigint, type string, event_ts timestamp, file string, stage string, "
    "elapsed_seconds double, payload string"
)


def stamp(events: DataFrame) -> DataFrame:
    """Give events without a time the current one; times already there stay."""
    if "event_ts" not in events.columns:
        return events.withColumn("event_ts", F.current_timestamp())
    return events.withColumn("event_ts", F.coalesce("event_ts", F.current_timestamp()))


def run_counters(manifest: DataFrame) -> DataFrame:
    """One row per run with every named counter. Attempted retries have no event of their own."""
    counts = [F.count_if(F.col("type") == t).alias(name) for name, t in fv.COUNTER_EVENTS.items()]
    return (
        manifest.groupBy("run_id")
        .agg(*counts)
        .withColumn(
            "audio_transcript_retry_attempted",
            F.col("audio_transcript_retry_succeeded") + F.col("audio_transcript_retry_failed"),
        )
    )


def stage_seconds(manifest: DataFrame) -> DataFrame:
    """(run_id, stage, seconds), to three digits."""
    return (
        manifest.where(F.col("elapsed_seconds").isNotNull() & F.col("stage").isNotNull())
        .groupBy("run_id", "stage")
        .agg(F.round(F.sum("elapsed_seconds"), 3).alias("seconds"))
    )


def open_runs(manifest: DataFrame) -> DataFrame:
    """(run_id, last_start, last_end, last_seq) of logs whose last start has no end after it."""

    def last(kind: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("type") == kind, F.col("seq"))), F.lit(-1))

    return (
        manifest.groupBy("run_id")
        .agg(last("run_start").alias("last_start"), last("run_end").alias("last_end"), F.max("seq").alias("last_seq"))
        .where(F.col("last_start") > F.col("last_end"))
    )


def closing_events(manifest: DataFrame, reason: str) -> DataFrame:
    """The two rows that close each open run, numbered on from its last event: ready for ``append_events``."""
    empty = F.lit(None).cast("string")
    stopped = F.struct(
        F.lit("run_stopped").alias("type"), F.lit(reason).alias("reason"), empty.alias("status"),
        F.lit(None).cast("double").alias("elapsed_seconds"),
    )
    ended = F.struct(
        F.lit("run_end").alias("type"), empty.alias("reason"), F.lit("stopped").alias("status"),
        F.lit(0.0).alias("elapsed_seconds"),
    )
    closing = open_runs(manifest).select("run_id", "last_seq", F.posexplode(F.array(stopped, ended)).alias("_pos", "_event"))
    return closing.select("run_id", (F.col("last_seq") + 1 + F.col("_pos")).alias("seq"), "_event.*")


def effective_progress(total: Column, media_done: Column, remaining: Column) -> tuple[Column, Column]:
    """(done, percent). Work still queued belongs to files counted as done, so it is taken off."""
    done = F.greatest(F.least(media_done, total), F.lit(0)) - F.greatest(remaining, F.lit(0))
    done = F.when(total <= 0, F.lit(0)).otherwise(F.greatest(done, F.lit(0)))
    percent = F.when(total <= 0, F.lit(100.0)).otherwise(done / total * 100.0)
    return done, percent
