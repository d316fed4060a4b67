"""Which media files need work, and what work."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatweave.functions import fixed_values as fv
from chatweave.operators.blocks import densely, ranked
from chatweave.operators.enrich import find_text_artifacts, matched_files, referenced_files


@dataclass(frozen=True)
class MediaOptions:
    transcribe: bool = True
    convert_audio: str = "none"  # none | mp3 | wav; only used while transcribing
    ocr: bool = True
    resume: bool = True


def work_list(messages: DataFrame) -> DataFrame:
    """Distinct (chat_id, file, kind) of audio and image files, by raw name."""
    return referenced_files(messages).drop("n")


def sorted_work(work: DataFrame) -> DataFrame:
    """``work`` with ``place``: 0, 1, 2, ... by name among the files of a kind in a chat, of any number."""
    return densely(work, ["chat_id", "kind"], "file", "place")


def missing_files(work: DataFrame, listing: DataFrame) -> DataFrame:
    """Files that messages refer to and the export does not have. Names are compared as they are."""
    return work.join(listing.select("chat_id", "file"), ["chat_id", "file"], "left_anti")


def without_artifact(work: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Files still to be done: no artifact under any of their stems."""
    done = find_text_artifacts(work, artifacts).select("chat_id", "file", "kind")
    return work.join(done, ["chat_id", "file", "kind"], "left_anti")


def with_artifact(work: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Files already done, with the stem the artifact was found under."""
    return find_text_artifacts(work, artifacts).select("chat_id", "file", "kind", "stem")


def media_plan(
    work: DataFrame,
    listing: DataFrame,
    artifacts: DataFrame,
    converted: DataFrame,
    options: MediaOptions = MediaOptions(),
) -> DataFrame:
    """One row per file: ``present``, ``stem`` of the artifact found, and the action per output.

    ``text_action``: missing | skip | recheck | create | null (nothing to do).
    ``wav_action``: skip | create | create_if_flagged | null. ``mp3_action``: skip | create | null.
    """
    narrow = artifacts.select("chat_id", "kind", "stem", "rel_path")
    df = matched_files(work, narrow, converted, listing).withColumn("stem", F.col("found.stem"))
    audio = F.col("kind") == "audio"
    done = F.col("stem").isNotNull() & F.lit(options.resume)
    active = F.when(audio, F.lit(options.transcribe)).otherwise(F.lit(options.ocr))
    text_action = (
        F.when(~F.col("present"), "missing")
        .when(~active, None)
        .when(done & audio, "recheck")
        .when(done, "skip")
        .otherwise("create")
    )
    convert = options.convert_audio if options.transcribe else "none"
    works_on_audio = F.col("present") & audio
    wav_wanted = F.lit(convert == "wav") | (F.lit(options.transcribe) & ~done)
    wav_action = (
        F.when(~works_on_audio, None)
        .when(wav_wanted & F.col("has_wav"), "skip")
        .when(wav_wanted, "create")
        .when(F.lit(options.transcribe) & ~F.col("has_wav"), "create_if_flagged")
    )
    mp3_action = F.when(
        works_on_audio & F.lit(convert == "mp3"),
        F.when(F.col("has_mp3") & F.lit(options.resume), "skip").otherwise("create"),
    )
    return df.select(
        "chat_id",
        "file",
        "kind",
        "present",
        "stem",
        text_action.alias("text_action"),
        wav_action.alias("wav_action"),
        mp3_action.alias("mp3_action"),
    )


def plan_events(plan: DataFrame) -> DataFrame:
    """Log rows that a media plan already settles: missing and skipped items."""
    rows = F.array(
        F.when(F.col("text_action") == "missing", "missing_file"),
        F.when(F.col("wav_action") == "skip", "audio_wav_skipped"),
        F.when(F.col("mp3_action") == "skip", "audio_mp3_skipped"),
        F.when(F.col("text_action") == "recheck", "audio_transcript_skipped"),
        F.when(F.col("text_action") == "skip", "image_ocr_skipped"),
    )
    return plan.select("chat_id", F.explode(F.array_compact(rows)).alias("type"), "file", "kind")


def likely_text(images: DataFrame, mode: str = "likely-text", edge_threshold: float = fv.OCR_EDGE_THRESHOLD) -> DataFrame:
    """Add ``keep``: the image is worth OCR. ``edge_hist`` holds pixel counts per edge strength.

    The weighted mean strength decides. No histogram (the image could not be read) keeps the
    image, and so does every mode but ``likely-text``.
    """
    if mode != "likely-text":
        return images.withColumn("keep", F.lit(True))
    zero = F.lit(0).cast("long")
    total = F.aggregate("edge_hist", zero, lambda acc, x: acc + x)
    weighted = F.aggregate(
        F.transform("edge_hist", lambda x, i: x * i), zero, lambda acc, x: acc + x
    )
    mean = weighted / F.when(total == 0, F.lit(1)).otherwise(total)
    return images.withColumn("keep", F.coalesce(mean >= edge_threshold, F.lit(True)))


def cap_per_chat(work: DataFrame, cap: int, order: str = "file") -> DataFrame:
    """Add ``ocr_action``: the first ``cap`` files of a chat by name are ``create``, the rest
    ``deferred``; 0 is no cap. Chats of any size are ranked in ranges.

    A null name comes first and takes a place like any other; files without a chat are one chat's.
    """
    if cap <= 0:
        return work.withColumn("ocr_action", F.lit("create"))
    action = F.when(F.col("_rank") <= cap, "create").otherwise("deferred")
    return ranked(work, ["chat_id"], order, "_rank").withColumn("ocr_action", action).drop("_rank")
