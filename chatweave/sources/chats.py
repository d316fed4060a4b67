"""Chat text files as numbered lines, one chat per export folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatweave.functions.naming import relative_path
from chatweave.sources.exports import chat_files, export_roots
from chatweave.sources.lines import SPLIT_BYTES, list_files, plain_folder, read_lines


def list_exports(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(export, path, length): each sub-folder of ``folder`` is an export, paths are below it."""
    rel = relative_path(F.col("path"), plain_folder(folder))
    return (
        list_files(spark, folder, glob)
        .withColumn("_rel", rel)
        .where(F.contains("_rel", F.lit("/")))
        .select(
            F.regexp_extract("_rel", r"^([^/]+)/", 1).alias("export"),
            F.regexp_replace("_rel", r"^[^/]+/", "").alias("path"),
            "length",
        )
    )


def choose_chats(spark: SparkSession, folder: str) -> DataFrame:
    """(export, root, chat_path) for every export below ``folder``."""
    texts = list_exports(spark, folder, "*.txt")
    return chat_files(texts, export_roots(texts))


def read_chat_lines(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """chat_lines(chat_id, path, line_no, line) of the chat file of every export; chat_id is the
    export's folder name. Other files are not opened."""
    folder = plain_folder(folder)
    chosen = (
        choose_chats(spark, folder)
        .where(F.col("chat_path").isNotNull())
        .select(F.concat_ws("/", F.lit(folder), "export", "chat_path").alias("path"))
    )
    lines = read_lines(spark, folder, "*.txt", split_bytes, chosen)
    export = F.regexp_extract(relative_path(F.col("path"), folder), r"^([^/]+)/", 1)
    return lines.select(export.alias("chat_id"), "path", "line_no", "line")
