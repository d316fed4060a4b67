"""Second tries for flagged transcripts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatweave.functions import fixed_values as fv


def retry_candidates(assessed: DataFrame, keys: Sequence[str], seq: str, quality: str = "quality") -> DataFrame:
    """One row per key with a flagged transcript: the first flagged one by ``seq`` counts.

    Columns: keys, ``before_issues``, ``before_tokens`` and every other column of that row. The
    minimum is taken before the shuffle, so a key with many rows is no problem. Sound transcripts
    are left out inside the aggregate: a filter would be moved down and compute quality twice.
    """
    others = [c for c in assessed.columns if c not in (*keys, quality)]
    return (
        assessed.groupBy(*keys)
        .agg(
            F.min_by(
                F.struct(*others, F.col(quality).alias("_q")), F.when(~F.col(f"{quality}.ok"), F.col(seq))
            ).alias("_first")
        )
        .where(F.col("_first").isNotNull())
        .select(
            *keys,
            *[F.col(f"_first.{c}").alias(c) for c in others],
            F.col("_first._q.issues").alias("before_issues"),
            F.greatest(F.col("_first._q.metrics.token_count"), F.lit(0)).alias("before_tokens"),
        )
    )


def decide_retry(candidates: DataFrame, retried: DataFrame, keys: Sequence[str], quality: str = "quality") -> DataFrame:
    """Whether a retry replaces the first transcript.

    ``retried``: keys, ``retry_text``, its quality struct and ``error`` (null when the model gave a
    text). Added: ``replaced``, ``reason`` (null when replaced) and ``still_flagged``, which does
    not depend on replacement. Candidates without a retry row drop out: none was attempted.
    """
    after = F.col(quality)
    fewer = F.size(after["issues"]) < F.size("before_issues")
    long_enough = after["metrics"]["token_count"] >= fv.RETRY_TOKENS_MIN
    failed = F.col("error").isNotNull()
    joined = candidates.join(retried, list(keys)).withColumn(
        "replaced", F.coalesce(~failed & (after["ok"] | (fewer & long_enough)), F.lit(False))
    )
    return joined.withColumn(
        "reason",
        F.when(failed, F.col("error"))
        .when(F.col("replaced"), None)
        .when(fewer & ~long_enough, "quality_improved_but_too_short")
        .otherwise("quality_not_improved"),
    ).withColumn("still_flagged", F.coalesce(~failed & ~after["ok"], F.lit(False)))
