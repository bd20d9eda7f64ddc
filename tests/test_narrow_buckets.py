"""Buckets of introductions hold few centres, and vectors in half the bytes where that loses nothing."""

import numpy as np
import pyarrow as pa

from itemspace.operators import lloyd, neighbours


def _batch(x):
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(x))), lloyd.lists(x)], names=["key", "x"])


def test_narrowed_vectors_lose_nothing():
    rng = np.random.default_rng(1)
    short = rng.standard_normal((20, 6)).astype(np.float32).astype(np.float64)
    long = rng.standard_normal((20, 6))
    long[3] = 1e300
    for x, size in ((short, 4), (long, 8), (np.vstack([short, long]), 8)):
        got, = neighbours._narrowed(iter([_batch(x)]))
        table = pa.Table.from_batches([got])
        assert (neighbours._vectors(table).astype(np.float64) == x).all()
        assert neighbours._vectors(table).itemsize == size
    got, = neighbours._narrowed(iter([_batch(short)]))
    assert sum(len(v) for v in got.column("x").to_pylist()) == short.size * 4


def test_a_bucket_names_a_bounded_part_of_a_large_table():
    # 96 members a centre: a bucket of 32,768 centres would name nearly all of 615,384 rows
    n, members = 615_384, 96
    centres = -(-n // neighbours._buckets(n))
    assert n * -np.expm1(-centres * members / n) < 0.75 * n


def test_narrow_and_wide_vectors_introduce_the_same():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((50, 5)).astype(np.float32).astype(np.float64)
    c, k = np.divmod(np.arange(600), 12)
    met = pa.table({"centre": c, "key": (c * 7 + k * 5) % 50, "fresh": k % 3 == 0, "_h": np.arange(600)})
    b, = neighbours._narrowed(iter([_batch(x)]))
    last = pa.array(np.full(50, np.inf))
    narrow = pa.table({"id": b.column("key"), "x": b.column("x"), "single": b.column("single"), "last": last})
    wide = pa.table({"id": b.column("key"), "x": lloyd.lists(x), "last": last})
    found = [neighbours._introduced("cosine", 4)(met, of) for of in (narrow, wide)]
    assert found[0].equals(found[1]) and found[0].num_rows > 50


def test_lloyd_sums_of_all_configurations(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((2500, 4))
    x[5] = x[6]
    centres = {(0, 2): x[:2].tolist(), (0, 3): x[[9, 9, 12]].tolist(), (0, 7): x[20:24].tolist()}
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>")
    got = lloyd.updated(lloyd.packed(df, "v"), centres)
    for c, v in centres.items():
        label = lloyd.squared(x, np.array(v)).argmin(axis=1)
        for j in range(len(v)):
            want = x[label == j].mean(axis=0) if (label == j).any() else np.array(v[j])
            assert np.allclose(got[c][j], want, atol=1e-12)
