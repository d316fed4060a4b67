"""Artifacts of earlier runs, and the media files of exports, as keyed tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatweave.functions.naming import relative_path
from chatweave.functions.text import strip
from chatweave.sources.chats import list_exports
from chatweave.sources.lines import list_files, open_system, plain_folder, spread, whole_texts

_FOLDER_KIND = {"transcripts": "transcript", "ocr": "ocr"}
_HASH_BYTES = 1 << 20


def media_listing(spark: SparkSession, folder: str, roots: DataFrame) -> DataFrame:
    """(chat_id, file, size_bytes): files of each export, named relative to its root."""
    files = list_exports(spark, folder).join(roots, "export")
    return files.select(
        F.col("export").alias("chat_id"),
        F.when(F.col("root") == "", F.col("path")).otherwise(relative_path(F.col("path"), F.col("root"))).alias("file"),
        F.col("length").alias("size_bytes"),
        ((F.col("root") == "") | F.startswith("path", F.concat("root", F.lit("/")))).alias("_inside"),
    ).where("_inside").drop("_inside")


def _sha256(path: str) -> str:
    system, inner = open_system(path)
    digest = hashlib.sha256()
    with system.open_input_file(inner) as f:
        while part := f.read(_HASH_BYTES):
            digest.update(part)
    return digest.hexdigest()


def media_meta(spark: SparkSession, folder: str, with_hash: bool = False) -> DataFrame:
    """(path, size_bytes, sha256). Contents are only read when hashes are asked for."""
    files = list_files(spark, folder).withColumnRenamed("length", "size_bytes")
    if not with_hash:
        return files.withColumn("sha256", F.lit(None).cast("string"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(sha256=[_sha256(p) for p in batch["path"]])

    return spread(files, "path").mapInPandas(run, "path string, size_bytes long, sha256 string")


def read_text_artifacts(spark: SparkSession, out_dir: str) -> DataFrame:
    """text_artifacts(chat_id, kind, stem, rel_path, text) from ``out_dir/<chat>/{transcripts,ocr}/*.txt``.

    A file that cannot be read keeps its row, with null text.
    """
    rel = relative_path(F.col("path"), plain_folder(out_dir))
    pattern = r"^(.*)/(transcripts|ocr)/([^/]*)\.txt$"
    folder = F.regexp_extract("_rel", pattern, 2)
    kind = F.when(folder == "transcripts", _FOLDER_KIND["transcripts"]).otherwise(_FOLDER_KIND["ocr"])
    files = list_files(spark, out_dir, "*.txt").where(rel.rlike(pattern))
    return whole_texts(files).withColumn("_rel", rel).select(
        F.regexp_extract("_rel", pattern, 1).alias("chat_id"),
        kind.alias("kind"),
        F.regexp_extract("_rel", pattern, 3).alias("stem"),
        F.concat(folder, F.lit("/"), F.regexp_extract("_rel", pattern, 3), F.lit(".txt")).alias("rel_path"),
        strip(F.col("text")).alias("text"),
    )


def read_converted(spark: SparkSession, out_dir: str) -> DataFrame:
    """converted(chat_id, stem, ext, rel_path) from ``out_dir/<chat>/converted/*.{mp3,wav}``."""
    pattern = r"^(.*)/converted/([^/]*)\.(mp3|wav)$"
    return (
        list_files(spark, out_dir)
        .withColumn("_rel", relative_path(F.col("path"), plain_folder(out_dir)))
        .where(F.col("_rel").rlike(pattern))
        .select(
            F.regexp_extract("_rel", pattern, 1).alias("chat_id"),
            F.regexp_extract("_rel", pattern, 2).alias("stem"),
            F.regexp_extract("_rel", pattern, 3).alias("ext"),
            F.regexp_replace("_rel", r"^.*/converted/", "converted/").alias("rel_path"),
        )
    )
