"""PCA without a d x d matrix."""

import numpy as np
import pytest

from itemspace.operators import eigen, reduce
from itemspace.operators.wide_pca import tree_qr, wide_pca


def frame(spark, x):
    return spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "subject long, v array<double>")


def test_agrees_with_the_covariance_form_on_64_dims(spark):
    x = np.random.default_rng(0).standard_normal((400, 64)) + 3
    v = frame(spark, x)
    got = wide_pca(v, 3)
    want, evr = reduce.pca(v, 3, dims=64)
    a = np.array([r.v for r in got.projected.orderBy("subject").collect()])
    b = np.array([r.v for r in want.orderBy("subject").collect()])
    assert np.abs(a - b).max() <= 1e-6 and abs(got.explained - evr) <= 1e-9
    assert np.allclose(got.singular, np.linalg.svd(x - x.mean(0), compute_uv=False)[:3])


def test_twenty_thousand_dims(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 4)) * [9, 6, 4, 2] @ rng.standard_normal((4, 20_000)) + 0.05 * rng.standard_normal((60, 20_000))
    got = wide_pca(frame(spark, x).repartition(4), 4)
    _, s, w = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(got.singular, s[:4], rtol=1e-9) and got.passes < 10
    assert np.allclose(np.abs((got.components * w[:4]).sum(axis=1)), 1, atol=1e-6)


def test_tree_qr_over_many_parts(spark):
    x = np.random.default_rng(2).standard_normal((300, 5))
    r = tree_qr(frame(spark, x).repartition(40), 5, lambda a: a)
    assert np.allclose(r.T @ r, x.T @ x)


def test_low_rank_few_rows_and_limit(spark):
    x = np.outer(np.arange(6.0), [1.0, 2.0, 2.0])
    got = wide_pca(frame(spark, x), 2)
    assert np.allclose(got.singular, np.linalg.svd(x - x.mean(0), compute_uv=False)[:2], atol=1e-9)
    assert abs(got.explained - 1) < 1e-12
    with pytest.warns(eigen.NotConverged):
        wide_pca(frame(spark, np.random.default_rng(3).standard_normal((50, 40))), 2, oversample=0, passes=1)
