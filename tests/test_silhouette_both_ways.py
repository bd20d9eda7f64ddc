"""Of two blocks that serve each other only one pair is made, beyond a span of rows."""

import numpy as np

from itemspace.operators import blocks, metrics
from tests.test_vectors_cluster_metrics import _sk_silhouette


def test_a_pair_of_blocks_meets_once(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((150, 5))
    x[20] = x[30]
    lab = [rng.integers(0, 3, 150), rng.integers(0, 4, 150)]
    lab[1][7] = 9                                     # a cluster of one row
    vec = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "subject long, v array<double>")
    labels = spark.createDataFrame([(i, 3 + j, int(lab[j][i])) for i in range(150) for j in (0, 1)],
                                   "subject long, k int, prediction int")
    monkeypatch.setattr(metrics, "ONE_WAY_ROWS", 100)
    monkeypatch.setattr(metrics, "BOTH_WAYS_ROWS", 64)
    monkeypatch.setattr(metrics, "STRIP_ROWS", 7)
    data = metrics.labelled_blocks(vec, labels, block_rows=16)
    (_, n, _, held), = data.parts
    many = held.count()
    assert metrics._met_once(blocks.block_pairs(held, n, 16, 64)).count() == many * (many + 1) // 2
    out = metrics.silhouette_of(spark, data)
    assert "CartesianProduct" in out._jdf.queryExecution().executedPlan().toString()
    got = {r.k: r.silhouette_score for r in out.collect()}
    for j in (0, 1):
        assert abs(got[3 + j] - _sk_silhouette(x, lab[j])) < 1e-9


def test_repeated_keys_meet_once(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i % 60, rng.random(3).tolist()) for i in range(80)]
    vec = spark.createDataFrame(rows, "subject long, v array<double>")
    labels = spark.createDataFrame([(i, 2, None if i == 5 else i % 2) for i in range(60)], "subject long, k int, prediction int")
    want = metrics.silhouette(vec, labels, block_rows=8).first().silhouette_score
    monkeypatch.setattr(metrics, "ONE_WAY_ROWS", 10)
    assert abs(metrics.silhouette(vec, labels, block_rows=8).first().silhouette_score - want) < 1e-12
