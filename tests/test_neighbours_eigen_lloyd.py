"""Approximate neighbours, eigenvectors, k-means|| seeds and bounded Lloyd rounds."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from itemspace.operators import cluster as K
from itemspace.operators import eigen, lloyd, neighbours, reduce, seeding


def frame(spark, x):
    return spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "subject long, v array<double>")


# ----------------------------------------------------------------- neighbours
def test_runs_cut_by_key_and_size():
    rows = [(0, i) for i in range(3)] + [(1, i) for i in range(11)] + [(2, 0)] + [(3, i) for i in range(5)]
    t = pa.table({"k": [r[0] for r in rows], "i": [r[1] for r in rows]})
    for size in (1, 2, 7, 100):
        got = [list(zip(*p.to_pydict().values())) for p in neighbours.runs(iter(t.to_batches(max_chunksize=size)), ["k"], 4)]
        assert [r for p in got for r in p] == rows
        assert [len(p) for p in got] == [3, 4, 4, 3, 1, 4, 1]
        assert all(len({k for k, _ in p}) == 1 for p in got)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_exact_neighbours_are_those_of_the_graph(spark, metric):
    x = np.random.default_rng(0).standard_normal((150, 6)).round(1)
    v = frame(spark, x)
    some = v.where("subject % 7 = 0")
    got = neighbours.exact_neighbours(some, v, 5, metric=metric, block_rows=40)
    want = reduce.knn_graph(v, 5, metric=metric, block_rows=64).where("src % 7 = 0")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_small_tables_are_exact(spark):
    v = frame(spark, np.random.default_rng(1).standard_normal((120, 5)))
    got = neighbours.approx_knn_graph(v, 6)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, reduce.knn_graph(v, 6).collect()))
    assert neighbours.approx_knn_graph(v.where("subject < 0"), 6).collect() == []


@pytest.mark.parametrize("kind", ["noise", "clusters", "copies"])
def test_recall_of_the_descent(spark, kind):
    rng = np.random.default_rng(2)
    if kind == "noise":
        x = rng.standard_normal((3000, 32))
    else:
        x = rng.standard_normal((40, 32))[rng.integers(0, 40, 3000)] + 0.3 * rng.standard_normal((3000, 32))
    if kind == "copies":
        x[:1000] = x[0]                               # one vector holds a third of all rows
    v = frame(spark, x)
    exact = neighbours.exact_neighbours(v.where("subject % 50 = 0"), v, 10)
    graph = neighbours.approx_knn_graph(v, 10, trees=4, leaf_rows=64).cache()
    assert graph.groupBy("src").count().where("count <> 10").count() == 0
    assert graph.select("src").distinct().count() == 3000
    if kind == "copies":                              # any copies are right: compare distances
        a = exact.groupBy("src").max("dist").collect()
        b = dict(graph.groupBy("src").max("dist").collect())
        assert np.mean([b[s] <= d + 1e-9 for s, d in a]) >= 0.9
    else:
        assert neighbours.neighbour_recall(graph, exact).first().recall >= 0.9
    graph.unpersist()


# ---------------------------------------------------------------- eigenvectors
def edges_of(spark, w):
    i, j = np.nonzero(w)
    return spark.createDataFrame([(int(a), int(b), float(w[a, b])) for a, b in zip(i, j)], "src long, dst long, w double")


def test_eigenvectors_of_a_random_matrix(spark):
    rng = np.random.default_rng(3)
    w = np.where(rng.random((60, 60)) < 0.3, rng.standard_normal((60, 60)), 0)
    w = w + w.T
    got = eigen.top_eigenvectors(edges_of(spark, w), 3, tol=1e-7)
    e, u = np.linalg.eigh(w)
    assert got.converged and (got.residuals <= 1e-7).all()
    assert np.allclose(got.values, e[::-1][:3], atol=1e-8)
    x = np.array([r.u for r in got.vectors.orderBy("node").collect()])
    assert np.allclose(x.T @ x, np.eye(3), atol=1e-8)
    assert np.linalg.norm(w @ x - x * got.values, axis=0).max() <= 1e-6
    assert np.allclose(np.abs(np.sum(u[:, ::-1][:, :3] * x, axis=0)), 1, atol=1e-6)


def test_more_vectors_than_rows_and_round_limit(spark):
    w = np.array([[2.0, 1.0, 0], [1.0, 2.0, 0], [0, 0, 5.0]])
    got = eigen.top_eigenvectors(edges_of(spark, w), 9)
    assert np.allclose(got.values, [5, 3, 1]) and got.converged
    rng = np.random.default_rng(4)
    w = rng.random((80, 80))
    short = eigen.top_eigenvectors(edges_of(spark, w + w.T), 4, tol=1e-12, rounds=1)
    assert not short.converged and short.rounds == 1


def rings(n, rng):
    t = rng.random(2 * n) * 2 * np.pi
    r = np.where(np.arange(2 * n) < n, 1.0, 3.0) + 0.05 * rng.standard_normal(2 * n)
    return np.stack([r * np.cos(t), r * np.sin(t)], axis=1)


def test_rings_are_told_apart_as_by_a_dense_solve(spark):
    x = rings(150, np.random.default_rng(5))
    v = frame(spark, x)
    basis, found = K.spectral_basis(v, 2, gamma=1.0, neighbours=12)
    assert found.converged and found.residuals.max() <= 1e-6
    # the same graph, dense
    edges = reduce.rbf_affinity(neighbours.approx_knn_graph(v, 12, metric="euclidean"), 1.0).collect()
    w = np.zeros((300, 300))
    for e in edges:
        w[e.src, e.dst] = e.w
    d = 1 / np.sqrt(w.sum(1))
    values, u = np.linalg.eigh(w * np.outer(d, d))
    assert np.allclose(found.values, values[::-1][:2], atol=1e-8)
    dense = u[:, -2:] * d[:, None]
    got = np.array([r.v for r in basis.orderBy("subject").collect()])
    # the two leading values are equal, so the span is what both have in common
    assert np.allclose(got, dense @ np.linalg.lstsq(dense, got, rcond=None)[0], atol=1e-5)
    label = np.array([r.prediction for r in K.spectral_clustering(v, [2], neighbours=12, n_init=4).orderBy("subject").collect()])
    assert (label[:150] == label[0]).all() and (label[150:] == 1 - label[0]).all()


def test_graph_embedding_warns_when_cut_short(spark):
    w = np.random.default_rng(6).random((50, 50))
    with pytest.warns(eigen.NotConverged):
        reduce.graph_embedding(edges_of(spark, w + w.T), 3, iters=1, tol=1e-12)


def test_fits_come_to_rest(spark):
    x = np.random.default_rng(7).random((80, 6))
    v = frame(spark, x)
    w, h, err = reduce.nmf(v, 3)
    with pytest.warns(eigen.NotConverged):
        _, _, longer = reduce.nmf(v, 3, iters=60, tol=0.0)
    assert err <= longer * 1.01
    with pytest.warns(eigen.NotConverged):
        reduce.nmf(v, 3, iters=5)
    with pytest.warns(eigen.NotConverged):
        reduce.dictionary_learning(v, 4, iters=2)

    def cost(codes, d):
        c = np.array([r.code for r in codes.orderBy("subject").collect()])
        return 0.5 * ((x - c @ d) ** 2).sum() + 0.05 * np.abs(c).sum()
    rested = cost(*reduce.dictionary_learning(v, 4, alpha=0.05))
    with pytest.warns(eigen.NotConverged):
        longer = cost(*reduce.dictionary_learning(v, 4, alpha=0.05, iters=12, tol=0.0))
    assert rested <= longer * 1.01


# ---------------------------------------------------------------- seeds, Lloyd
def unit(seed, *key):
    return int(hashlib.md5(":".join(map(str, (seed, *key))).encode()).hexdigest()[:8], 16)


def test_draws_by_md5(spark):
    x = np.random.default_rng(8).standard_normal((200, 4))
    got = seeding.draws(frame(spark, x), 3, 2, rounds=2)
    for s, found in enumerate(got):
        first = min(range(200), key=lambda i: (unit(42 + s, i), i))
        want, picked = [(0, first)], [first]
        for r in (1, 2):
            d2 = ((x[:, None] - x[picked][None]) ** 2).sum(2).min(1)
            new = [i for i in range(200) if unit(42 + s, r, i) / 2 ** 32 * d2.sum() < 6 * d2[i]]
            want += [(r, i) for i in new]
            picked += new
        assert [(r, i) for r, i, _ in found] == want


def test_seeds_of_few_distinct_rows(spark):
    v = frame(spark, np.array([[0.0, 0], [0, 0], [0, 0], [5, 5], [5, 5]]))
    seeds = seeding.parallel_seeds(v, [2, 4], starts=3)
    assert all({tuple(c) for c in seeds[(s, 2)]} == {(0, 0), (5, 5)} for s in range(3))
    assert all(len(seeds[(s, 4)]) == 4 for s in range(3))
    with pytest.raises(ValueError):
        seeding.parallel_seeds(v, [6])


def test_seeds_find_separate_blobs(spark):
    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(c, 0.1, (60, 2)) for c in ((0, 0), (9, 0), (0, 9), (9, 9), (20, 20))])
    a = K.kmeans_best(frame(spark, x), [5], n_init=3)
    label = np.array([r.prediction for r in a.orderBy("subject").collect()]).reshape(5, 60)
    assert (label == label[:, :1]).all() and len(set(label[:, 0])) == 5


@pytest.mark.parametrize("rounds", [0, 1, 12])
def test_bounded_rounds_give_the_labels_of_plain_ones(spark, rounds):
    rng = np.random.default_rng(10)
    x = rng.standard_normal((12, 8))[rng.integers(0, 12, 600)] * 3 + rng.standard_normal((600, 8))
    v = frame(spark, x)
    init = {k: K.initial_centres(v, [k])[(0, k)] for k in (2, 5, 9)}
    got, centres, done = lloyd.bounded_lloyd(v, init, rounds, checkpoint_every=3)
    plain, want = K.lloyd_sweep(v, [2, 5, 9], rounds, init=init)
    rows = sorted(map(tuple, got.select("k", "subject", "prediction").collect()))
    assert rows == sorted(map(tuple, plain.select("k", "subject", "prediction").collect()))
    assert all(np.allclose(centres[k], want[k]) for k in init)
    assert len(done) == rounds + 1 and done[0].compared == done[0].plain
    if rounds == 12:
        assert sum(r.compared for r in done) < 0.7 * sum(r.plain for r in done)


def test_bounded_rounds_stop_at_rest(spark):
    rng = np.random.default_rng(11)
    x = np.vstack([rng.normal(c, 0.2, (40, 2)) for c in (0, 5, 10)])
    v = frame(spark, x)
    init = {3: [x[0].tolist(), x[41].tolist(), x[82].tolist()]}
    _, _, done = lloyd.bounded_lloyd(v, init, 50, tol=0.0)
    assert len(done) < 10 and done[-1].compared < done[-1].plain / 10
