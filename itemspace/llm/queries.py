"""The llm queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemspace.llm import (
    chat, decontam, hard_negatives, licenses, line_dedup, lm_score, merkle, near_dup, packing, quality_classifier, quality_rules,
    toxicity, vector_dups,
)
from itemspace.llm.sql import SQL
from itemspace.sources.fixtures import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if k in QUERIES}


@query
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.report(decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")))


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its recurring lines cut, and their numbers."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = line_dedup.dedup_lines(docs)
    return cut.select("doc_id", "text", F.col("_dropped").alias("dropped_lines"),
                      F.size("_dropped").cast("long").alias("n_dropped"))


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return packing.pack_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
        ranks=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row is a ``message`` event at its turn; the template trial rows
    of conversation -1 come beside the table's."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    log = rows.unionByName(extra).select(
        "conv_id", F.col("turn").alias("seq"), F.monotonically_increasing_id().alias("msg_id"),
        F.lit("message").alias("kind"), "role", "text")
    return chat.digest(chat.format_chats(log))


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"))


@query
def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class (the least doc_id of the class)."""
    found = near_dup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("_id").alias("doc_id"), "class_id", F.col("first").alias("representative"))


@query
def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores rounded, as sums of floating-point logs differ in the last digits."""
    found = lm_score.score(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_backoff", F.round("log_score", 3).alias("log_score"),
                        F.round("word_score", 6).alias("word_score"))


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the ids divisible by 50; where 7 divides the id the label moves on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), "embedding")
    return hard_negatives.mine(hard_negatives.integer_rows(rows), F.col("vec_id") % 50 == 0)


@query
def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dups.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, subroot, root and proof, checked against tampered copies."""
    return merkle.audit(table(spark, sf_dir, "documents"))
