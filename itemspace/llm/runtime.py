"""Shared helpers of the llm operators: Arrow batch size, executor code,
intermediate tables in the shared folder, and the label hold-out rule."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itemspace.session import checkpoint_dir, ship_package

ARROW_BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession, batch_bytes: int = ARROW_BATCH_BYTES) -> None:
    """Make the package importable in workers and bound Arrow batches by bytes
    (a batch of 10,000 very long texts would not fit a worker)."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))


def lean(run):
    """``run`` over Arrow batches, giving free Arrow memory back at the task's end:
    idle workers stay alive beside the JVM."""
    def wrapped(batches):
        import pyarrow as pa
        yield from run(batches)
        pa.default_memory_pool().release_unused()
    return wrapped


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet under spark.checkpoint.dir and read it back:
    one computation, no lineage, and it survives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (null id: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null text: empty); other columns, whatever
    their names, play no part."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
