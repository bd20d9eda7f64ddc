"""The training-corpus pipeline: quality, line dedup, near-dedup,
decontamination, packing.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir),
works on all documents that its predecessor kept and returns a DataFrame, which
is written as Parquet and read as the next stage's docs.  All but the last
return the columns of documents.

Cases, in every stage: a null text counts as empty; documents without words or lines are
left alone by line dedup and decontamination; rows that share an id are judged each by
its own text; rows with a null id take part; further columns, whatever their names,
pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemspace.llm import decontam, line_dedup, near_dup, packing, quality_classifier
from itemspace.llm.runtime import stored
from itemspace.sources.fixtures import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of label 1 stay.  The verdict is
    one on a text, so a row is matched by its id (null too) and its text's hash."""
    scored = quality_classifier.scored(docs, table(spark, sf_dir, "labels"))
    rejected = (scored.where("predicted = 0").select(F.col("doc_id").alias("rejected_id"), F.col("text_hash").alias("rejected_hash"))
                .distinct())
    # the row travels as one column, so that its names clash with nothing
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"),
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    kept = rows.join(rejected, F.col("id").eqNullSafe(F.col("rejected_id")) & (F.col("hash") == F.col("rejected_hash")), "left_anti")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go; a document that had lines and has none left goes too."""
    cut = line_dedup.dedup_lines(docs)
    return cut.where((F.size("_dropped") == 0) | F.col("text").rlike("[^\\s]")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays."""
    return near_dup.dedup(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; a document that was nothing else goes."""
    found = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), remove=True)
    return found.where((F.size("_spans") == 0) | F.col("text").rlike("[^\\s]")).select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and place there."""
    import public_tokenizers
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"),
                                  ranks=public_tokenizers.path("byte_bpe_50k.tiktoken"),
                                  pattern=public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("best-fit packing", sequences),
]

# A discriminant, sketches and a tokenizer are beyond SQL: tests/llm holds the
# stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, "stage")
    return docs
