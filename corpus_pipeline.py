"""Corpus pipeline: toxicity, line dedup, near-dedup, source mixing and packing, one after the other.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. ``run`` writes
every result as Parquet to the shared checkpoint folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatweave.llm import line_dedup, minhash, mixing, packing, toxicity
from chatweave.llm.common import may_be_among, store, table, texts_of
from chatweave.llm.queries import tokenizer_path
from chatweave.plans.queries import Query


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (score below 0.7)."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs; those of which nothing is left go. ``n_chars`` follows the text."""
    cut = line_dedup.without_copies(docs)
    gone = (F.col("n_deleted") > 0) & (F.col("n_deleted") == F.col("n_lines"))
    chars = F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.where(~gone).withColumn("n_chars", chars).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group; of rows that share an id, those with the text that was judged go with it."""
    judged = minhash.judged(docs).where("NOT kept")
    dropped = store(judged.select(F.col("doc_id").alias("dropped_id"), F.col("text_md5").alias("dropped_md5")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    number = F.col("row.doc_id").cast("long")
    marked = rows.withColumn("maybe", number.isNotNull() & may_be_among(number, dropped.select("dropped_id")))
    same = (number == F.col("dropped_id")) & (F.md5(F.coalesce("row.text", F.lit(""))) == F.col("dropped_md5"))
    kept = marked.where("NOT maybe").unionByName(marked.where("maybe").join(dropped, same, "left_anti"))
    return kept.select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes of it: none, one or more."""
    return mixing.copied(docs).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences and offsets."""
    return packing.pack(texts_of(docs), tokenizer_path())


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("near-dedup", without_near_duplicates),
    ("source mixing", mixed),
    ("packing", packed),
]

#: The first stage is a trained classifier, which SQL cannot state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERY = Query(run, ORACLE_SQL)
