"""Which folder of an export is its root, and which text file is the chat.

Both are minima over a group, taken before the shuffle, so an export with very many files
does not meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatweave.functions import fixed_values as fv


def parent(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit(""))


def name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def _name_score(file_name: Column) -> Column:
    low = F.lower(file_name)
    weak = F.lit(False)
    for word in fv.EXPORT_NAME_WEAK:
        weak = weak | F.contains(low, F.lit(word))
    strong = F.contains(low, F.lit(fv.EXPORT_NAME_STRONG))
    return F.when(strong, fv.EXPORT_NAME_STRONG_SCORE).otherwise(0) + F.when(
        weak, fv.EXPORT_NAME_WEAK_SCORE
    ).otherwise(0)


def export_roots(files: DataFrame) -> DataFrame:
    """(export, root) from ``files(export, path, length)``, paths relative to the export.

    A text file at the top makes the top ('') the root. Otherwise it is the folder of the best
    text file: name score, then size, then path. Without any text file it is the top as well.
    """
    is_txt = F.col("path").endswith(".txt")
    at_top = is_txt & ~F.contains("path", F.lit("/"))
    rank = F.struct(-_name_score(name(F.col("path"))), -F.col("length"), F.col("path"))
    return files.groupBy("export").agg(
        F.when(F.coalesce(F.bool_or(at_top), F.lit(False)), F.lit(""))
        .otherwise(F.coalesce(F.min_by(parent(F.col("path")), F.when(is_txt, rank)), F.lit("")))
        .alias("root")
    )


def chat_files(files: DataFrame, roots: DataFrame) -> DataFrame:
    """(export, root, chat_path): the chat text file in each root; null path if there is none.

    A name with both 'whatsapp' and 'chat' comes first, then the first by name.
    """
    low = F.lower(name(F.col("path")))
    lacks_both = ~(F.contains(low, F.lit(fv.EXPORT_NAME_STRONG)) & F.contains(low, F.lit(fv.EXPORT_NAME_WEAK[0])))
    best = (
        files.where(F.col("path").endswith(".txt"))
        .groupBy("export", parent(F.col("path")).alias("root"))
        .agg(F.min_by("path", F.struct(lacks_both, F.col("path"))).alias("chat_path"))
    )
    return roots.join(best, ["export", "root"], "left")


def exports_without_chat(chosen: DataFrame) -> DataFrame:
    return chosen.where(F.col("chat_path").isNull()).select(
        "export", F.lit("no .txt chat export found").alias("reason")
    )
