"""Audio clips as rows: validity, cutting into chunks, joining chunk texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatweave.functions import fixed_values as fv
from chatweave.functions.text import strip
from chatweave.operators.blocks import densely


def check_audio(audio_info: DataFrame) -> DataFrame:
    """Add ``reject_reason`` to (channels, rate, sampwidth, ...); null for clips a model can take."""
    return audio_info.withColumn(
        "reject_reason",
        F.when(F.col("channels") != fv.AUDIO_CHANNELS, F.lit("not mono"))
        .when(F.col("rate") != fv.AUDIO_RATE, F.lit("wrong sample rate"))
        .when(F.col("sampwidth") != fv.AUDIO_SAMPLE_BYTES, F.lit("not 16-bit")),
    )


def chunk_plan(
    clips: DataFrame,
    chunk_seconds: int = fv.AUDIO_CHUNK_SECONDS,
    rate: int = fv.AUDIO_RATE,
    frames: str = "nframes",
) -> DataFrame:
    """One row per chunk: ``chunk_idx``, ``start``, ``length`` in frames; the last may be short.

    A chunk length of zero or less means the whole clip in one chunk. A clip without frames has
    no chunks. One long clip becomes many rows, which a later shuffle spreads over tasks.
    """
    total = F.col(frames).cast("long")
    if chunk_seconds <= 0:
        return clips.where(total > 0).select(
            "*", F.lit(0).alias("chunk_idx"), F.lit(0).cast("long").alias("start"), total.alias("length")
        )
    size = F.lit(chunk_seconds * rate).cast("long")
    last = F.floor((total - 1) / size).cast("int")
    return (
        clips.where(total > 0)
        .select("*", F.explode(F.sequence(F.lit(0), last)).alias("chunk_idx"))
        .withColumn("start", F.col("chunk_idx") * size)
        .withColumn("length", F.least(size, total - F.col("start")))
    )


def join_chunks(chunks: DataFrame, keys: list[str], idx: str = "chunk_idx", text: str = "text") -> DataFrame:
    """Texts of a clip's chunks in order, stripped, empty ones left out, joined by a space."""
    part = F.col("_part")
    return (
        chunks.withColumn("_part", strip(F.col(text)))
        .groupBy(*keys)
        .agg(
            F.sort_array(F.collect_list(F.when(part != "", F.struct(F.col(idx).alias("i"), part.alias("t"))))).alias("_parts")
        )
        .select(*keys, F.array_join(F.col("_parts.t"), " ").alias(text))
    )


def clip_rows(chunks: DataFrame, key: str, idx: str = "chunk_idx", text: str = "text") -> DataFrame:
    """Writer rows (``operators.parts.WRITER_COLUMNS``) of ``join_chunks``: a clip of any length, its chunks as ordered rows.

    ``key`` takes the place of the chat: ``sources.chatfiles`` then writes one line per clip and its index.
    """
    spoken = chunks.select(F.col(key).alias("chat_id"), F.col(idx).alias("_idx"), strip(F.col(text)).alias("_text")).where("_text <> ''")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("string")
    heads = chunks.select(F.col(key).alias("chat_id")).distinct().select(
        "chat_id", zero.alias("msg_idx"), F.lit(-1).cast("long").alias("part"), F.lit("").alias("open"), F.lit("\n").alias("close"),
        F.lit(True).alias("takes_text"), none.alias("text"),
    )
    parts = densely(spoken, ["chat_id"], "_idx", "part").select(
        "chat_id", zero.alias("msg_idx"), F.col("part").cast("long").alias("part"), none.alias("open"), none.alias("close"),
        F.lit(None).cast("boolean").alias("takes_text"), F.concat(F.when(F.col("part") > 0, " ").otherwise(""), F.col("_text")).alias("text"),
    )
    return heads.unionByName(parts)
