"""Parameter grids of survey runs: build the grid table, mark cells that
the dimension rule skips, run each remaining cell as Spark jobs on shared
cached inputs, and collect predictions, run metrics and a failure table.

The loop over cells runs on the driver (each cell submits its own jobs,
several cells at a time; a restarted driver of the durable form goes on where it was); inputs shared by several cells (vectors of one (mode, norm)) are built once
and persisted for the whole grid.
"""

from __future__ import annotations

import functools
import itertools
import threading
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemspace.operators import cluster as K
from itemspace.operators import metrics as M
from itemspace.operators import reduce as RDX
from itemspace.operators.vectors import vector_dims
from itemspace.session import materialize, persist

GRID_COLS = ["dataset", "mode", "norm", "cluster_method", "dimred_method", "n_components"]


def param_grid(spark: SparkSession, options: dict[str, Sequence]) -> DataFrame:
    """Cartesian product of the option lists (a parameter table, built from
    the small lists on the driver) with a content-derived run_id."""
    keys = list(options)
    rows = [dict(zip(keys, combo)) for combo in itertools.product(*[options[k] for k in keys])]
    df = spark.createDataFrame(rows, ", ".join(
        f"{k} {'int' if k == 'n_components' else 'string'}" for k in keys))
    return df.withColumn("run_id", F.sha2(F.to_json(F.struct(*sorted(keys))), 256))


def reduce_vectors(vec: DataFrame, method: str, n: int, key: str, dims: int) -> DataFrame:
    """(key, v) with ``n`` dimensions by the named reducer."""
    if method == "pca":
        return RDX.pca(vec, n, key, dims=dims)[0]
    if method == "nmf":
        return RDX.nmf(vec, n, key)[0].withColumnRenamed("w", "v")
    if method == "dictionary_learning":
        return RDX.dictionary_learning(vec, n, key=key)[0].withColumnRenamed("code", "v")
    if method == "graph_embedding":
        near = RDX.umap_neighbours(vec.count())
        graph = RDX.fuzzy_graph(RDX.knn_graph(vec, near - 1, key), near)
        return RDX.graph_embedding(graph, n).withColumnRenamed("node", key)
    raise ValueError(f"no reducer is called {method!r}")


def cluster_vectors(vec: DataFrame, method: str, ks: Sequence[int], key: str, n_init: int, rounds: int) -> DataFrame:
    """(key, k, prediction) of every K by the named method."""
    if method == "kmeans":
        parts = [K.kmeans_best(vec, ks, n_init, rounds, key)]
    elif method == "bisectingkmeans":
        parts = [K.bisecting_kmeans(vec, k, n_init, key=key, rounds=rounds)[0] for k in ks]
    elif method in ("spectral", "spectralcosine"):
        parts = [K.spectral_clustering(vec, ks, key=key, n_init=n_init, rounds=rounds,
                                       affinity="cosine" if method.endswith("cosine") else "rbf")]
    else:
        raise ValueError(f"no cluster method is called {method!r}")
    return functools.reduce(DataFrame.unionByName, [p.select(key, "k", "prediction") for p in parts])


class _Inputs:
    """Vectors of every (dataset, mode, norm), built once and persisted for the whole grid."""

    def __init__(self, build_vectors: Callable[[dict], DataFrame]):
        self.build, self.held, self.lock = build_vectors, {}, threading.Lock()

    def of(self, cell: dict) -> DataFrame:
        key = (cell.get("dataset"), cell["mode"], cell["norm"])
        with self.lock:
            if key not in self.held:
                self.held[key] = persist(self.build(cell))
            return self.held[key]

    def close(self) -> None:
        for v in self.held.values():
            v.unpersist()


def run_cell(cell: dict, inputs: _Inputs, ks: Sequence[int], rounds: int, key: str,
             n_init: int) -> tuple[DataFrame | None, DataFrame | None, tuple]:
    """(predictions, metrics, status row) of one cell.  A cell whose reducer target is not below
    the input dimension is 'skipped'; an exception marks it 'failed' with its reason."""
    t0 = time.time()
    try:
        vec = inputs.of(cell)
        dims = vector_dims(vec)
        nc = cell.get("n_components")
        method = cell.get("dimred_method") or "pca"
        rule = RDX.dimred_rule(nc, dims, method)
        if rule == "skipped":
            return None, None, (cell["run_id"], "skipped",
                                f"{method} to {nc} of {dims} dimensions would repeat the unreduced cell", 0.0, None)
        if rule == "reduce":
            vec, dims = materialize(reduce_vectors(vec, method, nc, key, dims)), nc
        a = materialize(cluster_vectors(vec, cell.get("cluster_method") or "kmeans", ks, key, n_init, rounds))
        data = M.labelled_blocks(vec, a, key)
        st = M.cluster_stats(data.rows(), ["k"], dims=dims)
        # spectral clusters have no inertia of their own
        cost = F.lit(None).cast("double") if "spectral" in (cell.get("cluster_method") or "") else F.sum("sse")
        m = (M.davies_bouldin(st, ["k"]).join(M.calinski_harabasz(st, ["k"]), "k")
             .join(M.silhouette_of(vec.sparkSession, data), "k").join(st.groupBy("k").agg(cost.alias("inertia")), "k"))
        return (a.select(F.lit(cell["run_id"]).alias("run_id"), "k", key, "prediction"),
                m.withColumn("run_id", F.lit(cell["run_id"])).withColumn("df_shape_ndim", F.lit(dims)),
                (cell["run_id"], "ok", None, time.time() - t0, dims))
    except Exception as e:  # noqa: BLE001 - the grid records the failure and goes on
        return None, None, (cell["run_id"], "failed", f"{type(e).__name__}: {e}", time.time() - t0, None)


STATUS = "run_id string, status string, reason string, seconds double, n_dims int"


def run_grid(spark: SparkSession, grid: DataFrame, build_vectors: Callable[[dict], DataFrame],
             ks: Sequence[int], rounds: int = 300, key: str = "subject",
             n_init: int = 10, workers: int = 4) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Run every cell, ``workers`` at a time; returns (predictions, run_metrics, status).
    k-means takes the best of ``n_init`` starts, each until its centres rest or
    ``rounds`` are over."""
    cells = [r.asDict() for r in grid.orderBy("run_id").collect()]  # the parameter table, not data
    inputs = _Inputs(build_vectors)
    preds, mets, status = [], [], []
    # cells know nothing of each other: one's small jobs fill the cores that another's leave
    with ThreadPoolExecutor(max_workers=workers) as pool:
        run = inheritable_thread_target(spark)(run_cell)
        for pred, met, row in pool.map(lambda c: run(c, inputs, ks, rounds, key, n_init), cells):
            status.append(row)
            if pred is not None:
                preds.append(pred)
                mets.append(met)
    inputs.close()
    empty_p = spark.createDataFrame([], f"run_id string, k int, {key} long, prediction int")
    pred = functools.reduce(DataFrame.unionByName, preds) if preds else empty_p
    return (pred, functools.reduce(DataFrame.unionByName, mets) if mets else None,
            spark.createDataFrame(status, STATUS))


METRICS = ("k int, davies_bouldin_score double, calinski_harabasz_score double, silhouette_score double, "
           "inertia double, df_shape_ndim int, run_id string")


def _status(spark: SparkSession, folder: str) -> DataFrame:
    try:
        return spark.read.schema(STATUS).parquet(f"{folder}/status")
    except AnalysisException:                         # no cell has finished yet
        return spark.createDataFrame([], STATUS)


def run_grid_durable(spark: SparkSession, grid: DataFrame, build_vectors: Callable[[dict], DataFrame], ks: Sequence[int],
                     folder: str, rounds: int = 300, key: str = "subject", n_init: int = 10,
                     workers: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``run_grid`` that a restarted driver takes up where it was: ``folder`` (shared) gets each
    cell's predictions and metrics and then its status row, a partition per run, overwritten
    if written twice.  Cells whose status is 'ok' or 'skipped' are not run again; failed ones
    are.  ``workers`` cells run at a time, each in its own scheduler pool.  Returns (predictions,
    run_metrics, status) of the grid's cells as read back."""
    names = grid.select("run_id")
    over = _status(spark, folder).where(F.col("status").isin("ok", "skipped")).select("run_id")
    cells = [r.asDict() for r in grid.join(over, "run_id", "left_anti").orderBy("run_id").collect()]
    inputs = _Inputs(build_vectors)

    def work(cell: dict) -> None:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", cell["run_id"])
        pred, met, row = run_cell(cell, inputs, ks, rounds, key, n_init)
        at = f"run_id={cell['run_id']}"
        if pred is not None:
            pred.drop("run_id").write.mode("overwrite").parquet(f"{folder}/predictions/{at}")
            met.drop("run_id").write.mode("overwrite").parquet(f"{folder}/metrics/{at}")
        spark.createDataFrame([row], STATUS).drop("run_id").coalesce(1).write.mode("overwrite").parquet(f"{folder}/status/{at}")

    try:
        with ThreadPoolExecutor(max_workers=workers) as pool:
            for job in [pool.submit(inheritable_thread_target(spark)(work), c) for c in cells]:
                job.result()
    finally:
        inputs.close()

    def back(what: str, schema: str) -> DataFrame:
        try:
            return spark.read.schema(schema).parquet(f"{folder}/{what}").join(names, "run_id", "left_semi")
        except AnalysisException:                     # every cell was skipped or failed
            return spark.createDataFrame([], schema)
    return (back("predictions", f"k int, {key} long, prediction int, run_id string"), back("metrics", METRICS),
            _status(spark, folder).join(names, "run_id", "left_semi"))
