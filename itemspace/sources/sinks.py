"""Sinks: run metrics, predictions, pairwise tables, failures, projector
exports.  Result tables are partitioned by (dataset, run_id) so a reader
prunes to the runs it needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_run_metrics(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).partitionBy("dataset", "run_id").parquet(path)


def write_predictions(df: DataFrame, path: str, mode: str = "append") -> None:
    # no repartition by run: one run may hold a large share of all rows, and
    # funnelling it into one task would serialise the write; rows are only
    # sorted inside each task so every task keeps one open file per partition
    (df.sortWithinPartitions("dataset", "run_id", "k")
     .write.mode(mode).partitionBy("dataset", "run_id").parquet(path))


def write_pairwise(df: DataFrame, path: str, sort_by: str = "perf_randindex_mean", fmt: str = "parquet") -> None:
    """Pair summaries sorted by descending mean margin (a global sort; the
    table has one row per pair)."""
    df.orderBy(F.desc(sort_by), "run_a", "run_b").write.mode("overwrite").format(fmt).save(path)


def write_failures(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def export_subject_projector(vectors: DataFrame, predictions_wide: DataFrame, runs: DataFrame,
                             path: str, key: str = "subject", fmt: str = "parquet") -> None:
    """Vectors with per-K predictions and the run parameters, joined by the
    subject id (never by row order)."""
    out = vectors.join(predictions_wide, key).join(runs, "run_id")
    if fmt == "csv":
        out = out.withColumn("v", F.array_join(F.col("v").cast("array<string>"), "\t"))
        out.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
    else:
        out.write.mode("overwrite").parquet(path)


def export_item_projector(item_vectors: DataFrame, run: DataFrame, path: str) -> None:
    """Item vectors with the parameters of every run in ``run`` (a parameter
    table): items x runs rows."""
    item_vectors.join(run, F.lit(True)).write.mode("overwrite").parquet(path)
