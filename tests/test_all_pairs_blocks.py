"""All pairs by blocks: rows are not shuffled once for every pair of blocks.  Restarts of
k-means run several at a time."""

import time

import numpy as np
import pytest

from itemspace.operators import cluster, metrics, reduce


def _rows(spark, n=300, d=6, offset=0.0):
    x = np.random.default_rng(5).standard_normal((n, d)) + offset
    x[7] = x[3]                                       # copies
    return x, spark.createDataFrame([(i, x[i].tolist()) for i in range(n)], "subject long, v array<double>").repartition(3)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("metric,offset", [("cosine", 0.0), ("euclidean", 0.0), ("euclidean", 1e4)])
def test_knn_equals_brute_force_in_many_blocks_and_spans(spark, monkeypatch, metric, offset):
    from itemspace.operators import blocks
    x, df = _rows(spark, offset=offset)
    k = 5
    real = blocks.block_pairs
    monkeypatch.setattr(reduce, "block_pairs", lambda rows, n, size: real(rows, n, size, span_rows=64))
    got = reduce.knn_graph(df, k, metric=metric, block_rows=16)
    assert "CartesianProduct" in _plan(got) and "FlatMapCoGroups" not in _plan(got)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T if metric == "cosine" else np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    d = np.round(d, 9)
    np.fill_diagonal(d, np.inf)
    rows = got.collect()
    assert len(rows) == k * len(x)
    for r in rows:
        assert abs(r.dist - np.sort(d[r.src])[r.rank - 1]) < 1e-8
        assert abs(r.dist - d[r.src, r.dst]) < 1e-8


def test_silhouette_of_groups_and_spans(spark, monkeypatch):
    from itemspace.operators import blocks
    x, df = _rows(spark)
    lab = np.random.default_rng(1).integers(0, 3, len(x))
    labels = spark.createDataFrame([(i, 3, int(lab[i])) for i in range(len(x))], "subject long, k int, prediction int")
    want = metrics.silhouette(df, labels).first().silhouette_score
    real = blocks.block_pairs
    monkeypatch.setattr(metrics, "block_pairs", lambda rows, n, size: real(rows, n, size, span_rows=64))
    out = metrics.silhouette(df, labels, block_rows=16)
    assert "CartesianProduct" in _plan(out) and "FlatMapCoGroups" not in _plan(out)
    assert abs(out.first().silhouette_score - want) < 1e-9



def test_restarts_run_together_and_hold_their_own_vectors(spark, monkeypatch):
    from pyspark.ml.clustering import KMeans
    _, df = _rows(spark, 60)
    at_work, most, held = [], [], []
    real = KMeans.fit

    def fit(self, data):
        at_work.append(1)
        most.append(len(at_work))
        held.append(data.storageLevel.useMemory)
        time.sleep(0.3)
        try:
            return real(self, data)
        finally:
            at_work.pop()
    monkeypatch.setattr(KMeans, "fit", fit)
    pred, cost = cluster.kmeans_restarts(df, 3, n_init=4)
    assert max(most) > 1 and len(most) == 4 and not any(held)
    monkeypatch.undo()
    alone = [cluster.kmeans_restarts(df, 3, n_init=1, seed=42 + i)[1] for i in range(4)]
    assert abs(cost - min(alone)) < 1e-9 and pred.count() == 60


def test_assignment_does_not_shuffle_rows_whatever_the_arrow_setting(spark):
    from itemspace.operators import cluster
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, rng.random(4).tolist()) for i in range(40)], "subject long, v array<double>")
    was = spark.conf.get("spark.sql.execution.arrow.pyspark.enabled")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "false")
    try:
        out = cluster.assign_clusters(df, {2: [[0.0] * 4, [1.0] * 4], 3: [[0.0] * 4, [0.5] * 4, [1.0] * 4]})
        assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
        assert out.count() == 80
    finally:
        spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", was)


def test_labelled_blocks_deal_vectors_once(spark):
    rng = np.random.default_rng(6)
    n = 90
    df = spark.createDataFrame([(i, r, rng.random(3).tolist()) for r in (0, 1) for i in range(n)],
                               "subject long, run int, v array<double>")
    labels = spark.createDataFrame([(i, r, k, (i + r) % k) for r in (0, 1) for i in range(n) for k in (2, 3)],
                                   "subject long, run int, k int, prediction int")
    data = metrics.labelled_blocks(df, labels, block_rows=16, group="run")
    assert [(g, rows) for g, rows, _, _ in data.parts] == [(0, n), (1, n)]
    got = sorted((r.run, r.k, r.prediction, tuple(r.v)) for r in data.rows().collect())
    want = sorted((r.run, r.k, r.prediction, tuple(r.v)) for r in labels.join(df, ["subject", "run"]).collect())
    assert got == want
    a = {(r.run, r.k): r.silhouette_score for r in metrics.silhouette_of(spark, data).collect()}
    for run in (0, 1):
        one = metrics.silhouette(df.where(f"run = {run}").select("subject", "v"), labels.where(f"run = {run}").drop("run"))
        for r in one.collect():
            assert abs(a[(run, r.k)] - r.silhouette_score) < 1e-12
