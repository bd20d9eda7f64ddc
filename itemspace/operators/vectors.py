"""Subject vectors: answer x item-embedding pooling, shifting, row norms.

Vectors are ``array<double>`` columns.  Every per-dimension reduction is a
set of plain aggregates (partial aggregation before the shuffle), so a hot
group costs one partial row per task, never a collected list.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from itemspace.functions.vector import array_norm, elementwise_agg
from itemspace.operators.pooling import Codebook, pooled
from itemspace.session import ship_package

_AGGS = {"max": F.max, "sum": F.sum, "mean": F.avg, "min": F.min}


def vector_dims(df: DataFrame, col: str = "v") -> int:
    """Dimension of a vector column (one small job on a small table)."""
    return int(df.select(F.max(F.size(col))).first()[0])


def embed_subjects(responses: DataFrame, item_vectors: DataFrame, how: str = "max",
                   n_items: int | None = None, subject: str = "subject") -> DataFrame:
    """v[d] = AGG over a subject's items of answer * e[item][d].

    ``responses(subject, item_id, answer)`` holds one row per (subject, item);
    ``item_vectors(item_id, e)`` is the codebook side: items x dims numbers, which are sent to
    the tasks (as a broadcast join would).  Rows stay narrow until they are pooled: they are dealt and
    sorted by subject, and a task pools one batch of them at a time, so that its memory
    holds no vectors of other subjects.
    With ``n_items`` only subjects that answered every item are kept.
    """
    spark = responses.sparkSession
    ship_package(spark)
    book = item_vectors.select("item_id", F.col("e").cast("array<double>").alias("e")).toArrow()
    places = spark.createDataFrame(pa.table({"item_id": book.column("item_id"), "_at": pa.array(np.arange(len(book)), pa.int32())}))
    j = responses.join(places, "item_id").select(subject, "_at", F.col("answer").cast("double").alias("_a"))
    held = spark.sparkContext.broadcast(Codebook.of(book.column("e").combine_chunks()))
    schema = StructType([j.schema[subject], StructField("_n", LongType()), StructField("v", ArrayType(DoubleType()))])
    out = (j.repartition(F.col(subject)).sortWithinPartitions(subject, "_at")
           .mapInArrow(pooled(held, how), schema))
    if n_items is not None:
        out = out.where(F.col("_n") == n_items)
    return out.drop("_n")


def shift_nonnegative(vectors: DataFrame, col: str = "v") -> DataFrame:
    """Add |global min| of all entries (a scalar subquery; deterministic,
    unlike a per-batch minimum)."""
    shift = vectors.agg(F.abs(F.min(F.array_min(col)))).scalar()
    # the subquery is bound to a column first: it may not sit inside a lambda
    return (vectors.withColumn("_shift", shift)
            .withColumn(col, F.transform(col, lambda x: x + F.col("_shift"))).drop("_shift"))


def shift_nonnegative_by(vectors: DataFrame, shift: float, col: str = "v") -> DataFrame:
    return vectors.withColumn(col, F.transform(col, lambda x: x + F.lit(float(shift))))


def normalize_rows(vectors: DataFrame, p: int = 2, col: str = "v") -> DataFrame:
    """Row-wise L1/L2 normalisation; an all-zero row stays zero.  The norm is
    computed once per row into its own column (not once per element)."""
    return (vectors.withColumn("_norm", array_norm(col, p))
            .withColumn(col, F.when(F.col("_norm") > 0, F.transform(col, lambda x: x / F.col("_norm")))
                        .otherwise(F.col(col)))
            .drop("_norm"))


def explode_dims(vectors: DataFrame, key: str = "subject", col: str = "v") -> DataFrame:
    """Long form (key, dim_name 'V_0001'..., d, value)."""
    return (vectors.select(key, F.posexplode(col).alias("d", "value"))
            .select(key, F.format_string("V_%04d", F.col("d") + 1).alias("dim_name"),
                    F.col("d").cast("int").alias("d"), "value"))


def pool_groups(vectors: DataFrame, group: str, how: str = "max", col: str = "v",
                dims: int | None = None) -> DataFrame:
    """Element-wise pooling of all vectors of a group (max-pool of the
    window embeddings of one sentence)."""
    dims = dims or vector_dims(vectors, col)
    return vectors.groupBy(group).agg(elementwise_agg(col, dims, _AGGS[how]).alias(col))


def vector_norm_checks(vectors: DataFrame, p: int = 2, col: str = "v", tol: float = 1e-5) -> DataFrame:
    """validate_vectors: rows off unit norm, constant rows, global range."""
    n = array_norm(col, p)
    return vectors.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.abs(n - 1) > tol).cast("long").alias("off_unit_norm"),
        F.count_if(F.array_max(col) == F.array_min(col)).cast("long").alias("constant_rows"),
        F.min(F.array_min(col)).alias("min_value"),
        F.max(F.array_max(col)).alias("max_value"))


def dim_summary(vectors: DataFrame, col: str = "v", digits: int = 6, dims: int | None = None) -> DataFrame:
    """Per-dimension count / mean / max of a vector table: one aggregate per
    position (partial aggregation, one row per task before the shuffle);
    only the final single row is exploded to one row per dimension."""
    dims = dims or vector_dims(vectors, col)
    c = F.col(col)
    agg = vectors.agg(F.array(*[F.count(c[i]) for i in range(dims)]).alias("n"),
                      F.array(*[F.avg(c[i]) for i in range(dims)]).alias("mean"),
                      F.array(*[F.max(c[i]) for i in range(dims)]).alias("max"))
    z = agg.select(F.posexplode(F.arrays_zip("n", "mean", "max")).alias("d", "z"))
    return z.select(F.col("d").cast("int").alias("d"), F.col("z.n").alias("n"),
                    F.round("z.mean", digits).alias("mean"), F.round("z.max", digits).alias("max"))


def to_long(vectors: DataFrame, key: str = "subject", col: str = "v", digits: int | None = 6) -> DataFrame:
    """(key, d, value) rows, rounded for order-insensitive comparison."""
    x: Column = F.col("x") if digits is None else F.round("x", digits)
    # the outer form avoids the inferred size(v) > 0 filter, which would be
    # pushed below the projections and re-evaluate the whole vector pipeline
    return (vectors.select(key, F.posexplode_outer(col).alias("d", "x")).where(F.col("d").isNotNull())
            .select(key, F.col("d").cast("int").alias("d"), x.alias("value")))


def wide_to_vectors(wide: DataFrame, item_cols: list[str], key: str = "subject") -> DataFrame:
    """Answer columns in codebook order -> array<double> (feat_raw mode)."""
    return wide.select(key, F.array(*[F.col(c).cast("double") for c in item_cols]).alias("v"))
