"""Flagship: 7-item survey -> complete subjects -> max-pooled answer x item
embedding -> global non-negative shift -> L2 rows -> per-dimension summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from itemspace.operators import vectors as V
from itemspace.sources import fixtures as fx


def subject_embeddings(spark: SparkSession, sf_dir: str, how: str = "max", norm: int = 2) -> DataFrame:
    resp = fx.responses(spark, sf_dir)
    iv = fx.item_vectors(spark, sf_dir)
    emb = V.embed_subjects(resp, iv, how=how, n_items=fx.N_ITEMS_F1)
    return V.normalize_rows(V.shift_nonnegative(emb), p=norm)


def survey_embedding_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.dim_summary(subject_embeddings(spark, sf_dir), dims=64)
