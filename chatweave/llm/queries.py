"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatweave.llm import cap_filters, chat_format, collocations, conversation_repair, line_dedup, lm, media, minhash, mixing, packing, quality_model, token_files, toxicity
from chatweave.llm.common import store, table, texts_of
from chatweave.plans.queries import Query

REGISTRY: dict[str, Query] = {}


def query(sql: str | None = None):
    def register(fn):
        REGISTRY[fn.__name__] = Query(fn, sql)
        return fn

    return register


@query()
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("\\### Assistant: </turn> ok")
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"
    ).unionByName(planted)
    text_part = F.struct(
        F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"),
        F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
        F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"),
    )
    pieces = chat_format.format_turns(turns.withColumn("parts", F.array(text_part)))
    return chat_format.read_back(pieces)


@query()
def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store(media.texts_to_media(texts_of(table(spark, sf_dir, "documents"))))
    return media.feature_digest(media.media_features(stored))


def tokenizer_path() -> str:
    """The public byte-level vocabulary, as installed beside its Python package."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query()
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(texts_of(table(spark, sf_dir, "documents")), tokenizer_path())


@query()
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(texts_of(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


@query(mixing.mix_sql())
def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query()
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality(texts_of(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


@query(line_dedup.line_dedup_sql())
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.without_copies(docs).select("doc_id", "n_lines", "n_deleted", "text")


@query(minhash.near_duplicates_sql())
def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query(cap_filters.linked_sql())
def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.linked(table(spark, sf_dir, "embeddings"))


@query()
def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(texts_of(table(spark, sf_dir, "documents")))


@query()
def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-id files of all documents, written and read back."""
    return token_files.token_files(texts_of(table(spark, sf_dir, "documents")), tokenizer_path())


@query()
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest repairs of all conversations after the fixed damage."""
    return conversation_repair.repair(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


@query(collocations.collocations_sql())
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first phrases of each language by association, over all documents."""
    return collocations.collocations(table(spark, sf_dir, "documents"))
