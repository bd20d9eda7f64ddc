"""Eigenvectors by cells, introductions by buckets, Lloyd rounds on packed rows."""

import numpy as np
import pyarrow as pa
import pytest

from itemspace.operators import cluster as K
from itemspace.operators import eigen, lloyd, neighbours
from itemspace.plans import grid


def test_eigenvectors_over_many_blocks_and_cells(spark, monkeypatch):
    monkeypatch.setattr(eigen, "LEAST_ROWS", 8)
    monkeypatch.setattr(eigen, "MOST_ROWS", 8)
    monkeypatch.setattr(eigen, "CELL_EDGES", 5)
    monkeypatch.setattr(eigen, "HELD_BLOCKS", 2)
    rng = np.random.default_rng(1)
    w = np.where(rng.random((50, 50)) < 0.4, rng.random((50, 50)), 0)
    w = w + w.T
    i, j = np.nonzero(w)
    edges = spark.createDataFrame([(f"n{a:02d}", f"n{b:02d}", float(w[a, b])) for a, b in zip(i, j)], "src string, dst string, w double")
    got = eigen.top_eigenvectors(edges, 2, tol=1e-8)
    e, u = np.linalg.eigh(w)
    assert got.converged and np.allclose(got.values, e[::-1][:2], atol=1e-8)
    x = np.array([r.u for r in got.vectors.orderBy("node").collect()])
    assert np.allclose(np.abs((u[:, ::-1][:, :2] * x).sum(0)), 1, atol=1e-6)


def test_a_product_shuffles_no_entries(spark):
    edges = spark.range(400).selectExpr("id div 20 as src", "id % 20 as dst", "1.0D as w").where("src <> dst")
    placed = eigen._placed(edges.select(edges.src.alias("node")).distinct(), 20)
    cells = eigen._cells(edges, placed)
    parts = eigen._product_parts(cells, eigen._started(placed, 2, 1), "x")
    assert cells.count() and parts.count()
    plan = parts._jdf.queryExecution().executedPlan().toString()
    held = plan[plan.rindex("InMemoryTableScan") - 200:plan.rindex("InMemoryTableScan")]
    assert "Exchange" not in held.split("InMemoryRelation")[0].replace("BroadcastExchange", "")
    cells.unpersist()


@pytest.mark.parametrize("held", [50, 4_000_000])
def test_introductions_of_a_bucket(monkeypatch, held):
    monkeypatch.setattr(neighbours, "COMPACT_EDGES", held)
    rng = np.random.default_rng(2)
    ids = rng.permutation(40).astype(np.int64)
    x, last = rng.standard_normal((40, 3)), np.full(40, 1.5)
    centre = np.repeat(np.arange(12), 10).astype(np.int64)
    key = np.concatenate([rng.permutation(42)[:10] for _ in range(12)]).astype(np.int64)    # 40 and 41 have no row
    fresh = rng.random(120) < 0.4
    met = pa.table({"centre": centre, "key": key, "fresh": fresh, "_h": rng.permutation(120)})
    known = pa.table({"id": ids, "x": pa.array(list(map(list, x))), "last": last})
    got = neighbours._introduced("euclidean", 3)(met, known).to_pydict()
    want: dict = {}
    at = {k: i for i, k in enumerate(ids.tolist())}
    for c in range(12):
        here = [(k, f) for k, f, cc in zip(key.tolist(), fresh, centre) if cc == c and k in at]
        for a, fa in here:
            for b, fb in here:
                d = round(float(np.linalg.norm(x[at[a]] - x[at[b]])), 10)
                if a != b and (fa or fb) and d < 1.5:
                    want.setdefault(a, set()).add((d, b))
    assert sorted(zip(got["src"], np.round(got["dist"], 10), got["dst"])) == sorted(
        (a, d, b) for a, near in want.items() for d, b in sorted(near)[:3])


def test_nearest_centres_as_by_differences():
    rng = np.random.default_rng(3)
    x = np.round(rng.standard_normal((300, 4)), 1) + 1e6                   # far from zero, with ties
    x[5, 1] = np.nan
    parts = [x[10:13], np.vstack([x[20], x[20], x[30]]), x[40:41]]
    for label, v in zip(lloyd._nearest(x, parts), parts):
        assert (label == lloyd.squared(x, v).argmin(axis=1)).all()


def test_packed_rounds_by_group(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((90, 3))
    v = spark.createDataFrame([(i, x[i].tolist(), i % 2) for i in range(90)], "subject long, v array<double>, run int")
    start = {(0, 2): x[[0, 2]], (1, 2): x[[1, 3]], (1, 3): x[[5, 7, 9]]}
    got = lloyd.updated(lloyd.packed(v, "v", "run"), {c: y.tolist() for c, y in start.items()})
    for (g, k), c in start.items():
        mine = x[g::2]
        label = lloyd.squared(mine, c).argmin(axis=1)
        assert np.allclose(got[(g, k)], [mine[label == j].mean(axis=0) for j in range(k)])


def test_best_start_only_is_assigned(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(c, 0.1, (30, 2)) for c in (0, 5, 9)])
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "subject long, v array<double>")
    a = K.kmeans_best(v, [2, 3], n_init=4)
    assert a.groupBy("k").count().orderBy("k").collect() == [(2, 90), (3, 90)]
    _, centres, cost = K.kmeans_multi_start(v, 3, n_init=4, rounds=50, tol=0.0)
    assert np.isclose(cost, lloyd.squared(x, np.array(centres)).min(axis=1).sum())


def test_grid_runs_cells_at_a_time(spark, monkeypatch):
    import threading
    both = threading.Barrier(2, timeout=60)

    def cell(cell, *_):
        both.wait()                                    # returns only while another cell runs
        return None, None, (cell["run_id"], "skipped", "", 0.0, None)
    monkeypatch.setattr(grid, "run_cell", cell)
    cells = grid.param_grid(spark, {"mode": ["a", "b"], "norm": ["l2"]})
    _, _, status = grid.run_grid(spark, cells, None, [2], workers=2)
    assert [r.run_id for r in status.collect()] == sorted(r.run_id for r in cells.collect())
