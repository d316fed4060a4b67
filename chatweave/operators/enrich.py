"""Attach transcripts, OCR text and converted audio to the messages that refer to a file.

All that is known of a file is found in two shuffles: by stem, where the distinct files meet artifacts
and converted audio, and by file, where they meet the listing of the export. One join then brings
the result to the messages. A file that is posted very often, or the many messages without one, make
partitions that Spark's adaptive joins split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatweave.functions.naming import candidate_stems
from chatweave.operators.parse import ENRICHMENT_TYPE, MEDIA_TYPE

ARTIFACT_OF = {"audio": "transcript", "image": "ocr"}
CONVERTED_EXTENSIONS = ("mp3", "wav")  # best first


def referenced_files(messages: DataFrame) -> DataFrame:
    """(chat_id, file, kind, n): distinct audio and image files with how often they are posted."""
    return (
        messages.select("chat_id", F.explode_outer("media").alias("m"))
        .where(F.col("m.kind").isin(*ARTIFACT_OF))
        .groupBy("chat_id", F.col("m.file").alias("file"), F.col("m.kind").alias("kind"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def stem_lookups(files: DataFrame) -> DataFrame:
    """One row per (file, candidate stem); ``rank`` 0 is the primary stem."""
    return files.select(
        "chat_id", "file", "kind", F.posexplode(candidate_stems(F.col("file"))).alias("rank", "stem")
    )


def matched_files(
    files: DataFrame, artifacts: DataFrame | None = None, converted: DataFrame | None = None, listing: DataFrame | None = None
) -> DataFrame:
    """(chat_id, file, kind, found, converted_file, has_mp3, has_wav, present), one row per file.

    ``files`` (chat_id, file, kind), distinct. ``artifacts`` (chat_id, kind, stem, rel_path[, text]), unique
    per (chat_id, kind, stem); ``found`` is the struct (stem, rel_path[, text]) of the file's best one: primary
    stem first, path and text of the same artifact, so an unreadable one (text null) still wins.
    ``converted`` (chat_id, stem, ext, rel_path): mp3 before wav, then the primary stem. ``listing``
    (chat_id, file). Rows without a chat match nothing.
    """
    text = [c for c in ("text",) if artifacts is None or c in artifacts.columns]
    found_type = f"struct<stem:string,rel_path:string{',text:string' * len(text)}>"
    rows = [stem_lookups(files)]
    if artifacts is not None:
        what = F.struct("stem", "rel_path", *text)
        rows.append(artifacts.select("chat_id", "stem", *[F.when(F.col("kind") == k, what).alias(k) for k in ARTIFACT_OF.values()]))
    if converted is not None:
        rows.append(converted.select("chat_id", "stem", *[F.when(F.col("ext") == e, F.col("rel_path")).alias(e) for e in CONVERTED_EXTENSIONS]))
    both = rows[0]
    for more in rows[1:]:
        both = both.unionByName(more, allowMissingColumns=True)
    for name, kind in (*((k, found_type) for k in ARTIFACT_OF.values()), *((e, "string") for e in CONVERTED_EXTENSIONS)):
        if name not in both.columns:
            both = both.withColumn(name, F.lit(None).cast(kind))
    here = Window.partitionBy("chat_id", "stem")
    known = F.col("chat_id").isNotNull()
    facts = {n: F.when(known, F.max(n).over(here)) for n in (*ARTIFACT_OF.values(), *CONVERTED_EXTENSIONS)}
    met = both.select("chat_id", "file", "kind", "rank", *[c.alias(n) for n, c in facts.items()]).where("rank IS NOT NULL")
    audio = F.col("kind") == "audio"
    found = F.when(audio, F.col(ARTIFACT_OF["audio"])).otherwise(F.col(ARTIFACT_OF["image"]))
    # The best converted file is the first by extension, then by stem.
    best = F.filter(
        F.array(*[F.when(audio, F.struct(F.lit(i).alias("by"), F.col("rank"), F.col(e).alias("path"))) for i, e in enumerate(CONVERTED_EXTENSIONS)]),
        lambda c: c["path"].isNotNull(),
    )
    by_file = met.select(
        "chat_id", "file", "kind", "rank", found.alias("found"), F.array_min(best).alias("best"),
        *[(audio & F.col(e).isNotNull()).alias(f"has_{e}") for e in CONVERTED_EXTENSIONS], F.lit(False).alias("present"),
    )
    if listing is not None:
        there = listing.where("chat_id IS NOT NULL").select("chat_id", "file", F.lit(True).alias("present"))
        by_file = by_file.unionByName(there, allowMissingColumns=True)
    return (
        by_file.groupBy("chat_id", "file")
        .agg(
            F.max("kind").alias("kind"),
            F.min_by("found", F.when(F.col("found").isNotNull(), F.col("rank"))).alias("found"),
            F.min("best")["path"].alias("converted_file"),
            *[F.coalesce(F.bool_or(f"has_{e}"), F.lit(False)).alias(f"has_{e}") for e in CONVERTED_EXTENSIONS],
            F.bool_or("present").alias("present"),
        )
        .where("kind IS NOT NULL")
    )


def find_text_artifacts(files: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(chat_id, file, kind, stem, rel_path, text) of the best artifact of each file that has one."""
    return matched_files(files, artifacts).where("found IS NOT NULL").select("chat_id", "file", "kind", "found.*")


def find_converted(files: DataFrame, converted: DataFrame) -> DataFrame:
    """(chat_id, file, converted_file): mp3 before wav, then the primary stem before the legacy one."""
    return matched_files(files, None, converted).where("converted_file IS NOT NULL").select("chat_id", "file", "converted_file")


def _attached(file: Column, kind: Column, converted: Column, meta: Column) -> Column:
    return F.struct(
        file.alias("file"), kind.alias("kind"), converted.alias("converted_file"), meta.alias("meta")
    )


def enrich_messages(
    messages: DataFrame,
    artifacts: DataFrame,
    converted: DataFrame | None = None,
    many_files: bool = False,
) -> DataFrame:
    """Messages with ``media.converted_file`` and ``enrichment`` filled.

    ``messages`` are read more than once here, so pass stored ones rather than a long plan.

    ``many_files``: messages may refer to several files (parsed ones have one at most). Then rows
    are regrouped by message, and the last file that has an artifact fills the enrichment.
    """
    columns = messages.columns
    keys = ["chat_id", "_file"]
    resolved = matched_files(referenced_files(messages).drop("n"), artifacts, converted).select(
        "chat_id", F.col("file").alias("_file"), F.col("found").alias("_artifact"), F.col("converted_file").alias("_converted")
    )

    if many_files:
        rows = messages.select("*", F.posexplode_outer("media").alias("_pos", "_ref"))
    else:
        rows = messages.withColumn("_ref", F.get("media", F.lit(0)))
    looked_up = F.col("_ref.kind").isin(*ARTIFACT_OF)
    rows = rows.withColumn("_file", F.when(looked_up, F.col("_ref.file"))).withColumn(
        "_kind", F.when(looked_up, F.col("_ref.kind"))
    )
    joined = rows.join(resolved, keys, "left")

    audio = F.col("_kind") == "audio"
    path, text = F.col("_artifact.rel_path"), F.col("_artifact.text")
    fields = {
        "ocr_text_file": F.when(~audio, path),
        "ocr_text": F.when(~audio, text),
        "transcript_file": F.when(audio, path),
        "transcript_text": F.when(audio, text),
    }
    ref = F.when(
        F.col("_ref").isNotNull(),
        _attached(
            F.col("_ref.file"), F.col("_ref.kind"),
            F.coalesce("_converted", "_ref.converted_file"), F.col("_ref.meta"),
        ),
    )
    if many_files:
        rest = [c for c in columns if c not in ("chat_id", "msg_idx", "media", "enrichment")]
        joined = (
            joined.withColumn("_new", ref)
            .groupBy("chat_id", "msg_idx")
            .agg(
                *[F.first(c).alias(c) for c in rest],
                F.array_compact(F.sort_array(F.collect_list(F.struct("_pos", "_new")))["_new"]).alias("media"),
                *[F.max_by(v, F.when(v.isNotNull(), F.col("_pos"))).alias(k) for k, v in fields.items()],
            )
        )
        fields = {k: F.col(k) for k in fields}
    else:
        # A message has one file here; further entries of the list, if any, stay as they are.
        joined = joined.withColumn(
            "media",
            F.when(F.col("_ref").isNull(), F.col("media")).otherwise(
                F.concat(F.array(ref), F.slice("media", F.lit(2), F.size("media")))
            ),
        )
    enrichment = F.struct(*[v.alias(k) for k, v in fields.items()])
    has_artifact = fields["ocr_text_file"].isNotNull() | fields["transcript_file"].isNotNull()
    return (
        joined.withColumn("enrichment", F.when(has_artifact, enrichment).cast(ENRICHMENT_TYPE))
        .withColumn("media", F.col("media").cast(MEDIA_TYPE))
        .select(*columns)
    )
