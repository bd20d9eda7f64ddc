"""Subscale scoring, totals, reverse keying and small global transforms.

Scoring maps (item -> scale, scale -> factor) are codebook-sized and joined;
per-subject sums are ordinary aggregates with partial aggregation before the
shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def score_subscales(responses: DataFrame, scale_map: DataFrame, how: str = "sum",
                    key: str = "subject", scale: str = "scale") -> DataFrame:
    """(subject, scale, score): sum or mean of a subject's answers per scale."""
    agg = F.sum if how == "sum" else F.avg
    j = responses.join(scale_map.select("item_id", scale), "item_id")
    out = j.groupBy(key, scale).agg(agg(F.col("answer").cast("double")).alias("score"))
    return out


def score_two_level(responses: DataFrame, scale_map: DataFrame, factor_map: DataFrame,
                    key: str = "subject") -> DataFrame:
    """First scale sums, then (possibly overlapping) factor sums of scales.
    The second map is many-to-many: one scale may feed several factors."""
    first = score_subscales(responses, scale_map, "sum", key)
    return (first.join(factor_map.select("scale", "factor"), "scale")
            .groupBy(key, "factor").agg(F.sum("score").alias("score")))


def scores_wide(scores: DataFrame, scales: Sequence, key: str = "subject", scale: str = "scale",
                prefix: str = "s") -> DataFrame:
    """Pivot (subject, scale, score) to one column per scale (explicit list)."""
    wide = scores.groupBy(key).pivot(scale, list(scales)).agg(F.first("score"))
    return wide.withColumnsRenamed({str(s): f"{prefix}{s}" for s in scales})


def score_total(responses: DataFrame, key: str = "subject") -> DataFrame:
    return responses.groupBy(key).agg(F.sum(F.col("answer").cast("double")).alias("total"))


def select_precomputed_scores(df: DataFrame, score_cols: Sequence[str], key: str = "subject") -> DataFrame:
    return df.select(key, *score_cols)


def reverse_score(responses: DataFrame, negative_items: DataFrame, lo: int, hi: int) -> DataFrame:
    """answer -> lo + hi - answer for negatively keyed items (off by default in
    the pipelines: the original study kept it disabled)."""
    neg = negative_items.select("item_id").distinct().withColumn("_neg", F.lit(True))
    return (responses.join(neg, "item_id", "left")
            .withColumn("answer", F.when(F.col("_neg"), F.lit(lo + hi) - F.col("answer"))
                        .otherwise(F.col("answer")))
            .drop("_neg"))


def project_unit_circle(df: DataFrame, col: str = "total") -> DataFrame:
    """A 1-D feature x becomes (cos t, sin t) with cos t = x / (max/2) - 1;
    max is a global scalar subquery."""
    mx = df.agg(F.max(col)).scalar()
    c = F.col(col) / (mx / 2) - 1
    return (df.withColumn("_c", c)
            .withColumn("circle_x", F.cos(F.acos("_c")))
            .withColumn("circle_y", F.sin(F.acos("_c"))).drop("_c"))


def shift_positive(responses: DataFrame, col: str = "answer") -> DataFrame:
    """Add 1 to every answer when the global minimum is 0."""
    mn = responses.agg(F.min(col)).scalar()
    return (responses.withColumn("_mn", mn)
            .withColumn(col, F.when(F.col("_mn") == 0, F.col(col) + 1).otherwise(F.col(col)))
            .drop("_mn"))


def run_shape(vectors: DataFrame, col: str = "v") -> DataFrame:
    return vectors.agg(F.count("*").alias("n_subjects"), F.max(F.size(col)).alias("n_dims"))
