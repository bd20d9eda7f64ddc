"""A grid that is stopped and goes on."""

import os
import tempfile

import numpy as np
import pytest

from itemspace.plans.grid import param_grid, run_grid, run_grid_durable

OPTIONS = {"dataset": ["d"], "mode": ["a", "b", "bad"], "norm": ["l2"], "cluster_method": ["kmeans"], "dimred_method": ["pca"],
           "n_components": [None]}


class Killed(BaseException):
    """As if the driver had died: nothing catches it."""


def builder(spark, built, die_at=None, mend=False):
    x = np.random.default_rng(0).standard_normal((40, 3))

    def build(cell):
        if cell["mode"] == die_at:
            raise Killed
        if cell["mode"] == "bad" and not mend:
            raise ValueError("no such vectors")
        built.append(cell["mode"])
        shift = {"a": 0.0, "b": 5.0, "bad": 9.0}[cell["mode"]]
        return spark.createDataFrame([(i, [float(v) + shift for v in r]) for i, r in enumerate(x)], "subject long, v array<double>")
    return build


def test_a_stopped_run_goes_on(spark):
    folder = os.path.join(tempfile.mkdtemp(prefix="itemspace-grid-", dir="/tmp"), "grid")
    grid = param_grid(spark, OPTIONS)
    order = [r["mode"] for r in grid.orderBy("run_id").collect()]
    good = [m for m in order if m != "bad"]
    args = dict(ks=[2, 3], folder=folder, n_init=2, workers=1)
    first, second, third = [], [], []
    with pytest.raises(Killed):
        run_grid_durable(spark, grid, builder(spark, first, die_at=good[1]), **args)
    assert first == good[:1]
    pred, met, status = run_grid_durable(spark, grid, builder(spark, second), **args)
    assert second == good[1:]                         # the finished cell is not redone
    said = {r.run_id: r.status for r in status.collect()}
    assert sorted(said.values()) == ["failed", "ok", "ok"]
    want, _, _ = run_grid(spark, grid.where("mode <> 'bad'"), builder(spark, []), [2, 3], n_init=2)
    assert sorted(map(tuple, pred.select("run_id", "k", "subject", "prediction").collect())) == sorted(map(tuple, want.collect()))
    assert met.count() == 4 and met.where("silhouette_score is null or inertia is null").count() == 0
    _, _, status = run_grid_durable(spark, grid, builder(spark, third, mend=True), **args)
    assert third == ["bad"] and status.where("status = 'ok'").count() == 3


def test_cells_at_a_time(spark):
    folder = os.path.join(tempfile.mkdtemp(prefix="itemspace-grid-", dir="/tmp"), "grid")
    pred, _, status = run_grid_durable(spark, param_grid(spark, OPTIONS), builder(spark, []), [2], folder, n_init=1, workers=3)
    assert pred.groupBy("run_id").count().count() == 2 and status.count() == 3
