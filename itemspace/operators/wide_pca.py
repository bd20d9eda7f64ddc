"""PCA of wide vectors: no d x d matrix anywhere.

The range finder is a block Krylov iteration on X^T X from a random start: a pass over the
rows multiplies the newest block (d x b, b = k + ``oversample``) and adds up d x b
numbers per task; the driver keeps the blocks so far, orthonormal, and takes the
best directions of their span (Rayleigh-Ritz).  It stops when the residual of the k
wanted directions is at most ``tol`` of the largest eigenvalue.  A tree QR (every
task's triangular factor, factors combined in groups until one is left) of the rows'
coordinates then gives their singular values without squaring them.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemspace.operators.eigen import NotConverged
from itemspace.operators.lloyd import SUMS, lists, matrix
from itemspace.operators.vectors import vector_dims
from itemspace.session import persist, ship_package

COMBINED_AT_ONCE = 16


class WidePca(NamedTuple):
    """``projected`` (key, v), components (k x d, the largest loading of each positive), the
    centred rows' singular values, the share of variance, residual and passes."""
    projected: DataFrame
    components: np.ndarray
    singular: np.ndarray
    explained: float
    residual: float
    passes: int


def _added(rows: DataFrame, size: int, part) -> np.ndarray:
    """Sum over all batches of ``part`` (matrix of rows), a vector of ``size``; one partial
    vector per task."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x = part(matrix(b.column("v")).astype(np.float64))
                total = x if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["i", "s"])
    out = np.zeros(size)
    for r in rows.select("v").mapInArrow(fn, SUMS).groupBy("i").agg(F.sum("s").alias("s")).toLocalIterator():
        out[r["i"]] = r["s"]
    return out


def _factor(blocks: Iterator[np.ndarray], width: int) -> np.ndarray:
    r = np.zeros((0, width))
    for b in blocks:
        r = np.linalg.qr(np.vstack([r, b]), mode="r")
    return r


def tree_qr(rows: DataFrame, width: int, fn_rows) -> np.ndarray:
    """Triangular factor of the tall matrix ``fn_rows`` (matrix of rows) over all rows."""
    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = _factor((fn_rows(matrix(b.column("v")).astype(np.float64)) for b in batches if b.num_rows), width)
        if len(r):
            yield pa.RecordBatch.from_arrays([lists(r.reshape(1, -1))], names=["r"])

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = _factor((matrix(b.column("r").slice(i, 1)).reshape(-1, width) for b in batches for i in range(b.num_rows)), width)
        if len(r):
            yield pa.RecordBatch.from_arrays([lists(r.reshape(1, -1))], names=["r"])
    factors = rows.select("v").mapInArrow(leaf, "r array<double>")
    parts = factors.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // COMBINED_AT_ONCE)
        factors = factors.repartition(parts).mapInArrow(combined, "r array<double>")
    found = [np.array(r["r"]).reshape(-1, width) for r in factors.collect()]      # one
    return _factor(iter(found), width)


def wide_pca(vectors: DataFrame, k: int, key: str = "subject", col: str = "v", dims: int | None = None,
             oversample: int = 6, passes: int = 30, tol: float = 1e-9, seed: int = 42) -> WidePca:
    """The k leading principal directions and the centred rows' coordinates in them.  The
    driver holds at most ``passes`` blocks of (k + ``oversample``) x d."""
    ship_package(vectors.sparkSession)
    dims = dims or vector_dims(vectors, col)
    rows = persist(vectors.select(F.col(key).alias("key"), F.col(col).alias("v")))
    n = rows.count()
    first = _added(rows, dims + 1, lambda x: np.append(x.sum(axis=0), (x * x).sum()))
    mean, total = first[:-1] / max(n, 1), first[-1] - first[:-1] @ first[:-1] / max(n, 1)
    k = min(k, dims)
    width = min(k + oversample, dims)

    def product(block: np.ndarray) -> np.ndarray:
        z = _added(rows, dims * block.shape[1], lambda x: (x.T @ (x @ block)).ravel()).reshape(dims, -1)
        return z - n * np.outer(mean, mean @ block)

    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, width)))[0]
    basis, images = np.zeros((dims, 0)), np.zeros((dims, 0))
    residual, done = np.inf, 0
    while done < passes and block.shape[1]:
        done += 1
        image = product(block)
        basis, images = np.hstack([basis, block]), np.hstack([images, image])
        h = basis.T @ images
        values, u = np.linalg.eigh((h + h.T) / 2)
        u, values = u[:, ::-1][:, :k], values[::-1][:k]
        away = images @ u - (basis @ u) * values
        residual = float(np.linalg.norm(away, axis=0).max() / max(values[0], 1e-300))
        if residual <= tol or basis.shape[1] >= dims:
            break
        # the image's part outside the span, orthogonalised twice
        for _ in range(2):
            image = image - basis @ (basis.T @ image)
        q, r = np.linalg.qr(image)
        block = q[:, np.abs(np.diag(r)) > 1e-12 * max(np.abs(r).max(), 1e-300)]
        block = block - basis @ (basis.T @ block)
        block = np.linalg.qr(block)[0] if block.shape[1] else block
    if residual > tol and basis.shape[1] < dims and block.shape[1]:
        warnings.warn(f"wide_pca: residual {residual:.1e} above {tol:.1e} after {done} passes", NotConverged, stacklevel=2)
    frame = basis @ u
    factor = tree_qr(rows, k, lambda x: (x - mean) @ frame)
    singular = np.linalg.svd(factor, compute_uv=False) if len(factor) else np.zeros(0)
    frame = frame * np.where(frame[np.abs(frame).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("v")).astype(np.float64)
                yield pa.RecordBatch.from_arrays([b.column("key"), lists((x - mean) @ frame)], names=["key", "v"])
    kind = vectors.schema[key].dataType.simpleString()
    out = (vectors.select(F.col(key).alias("key"), F.col(col).alias("v")).mapInArrow(project, f"key {kind}, v array<double>")
           .withColumnsRenamed({"key": key, "v": col}))
    rows.unpersist()
    return WidePca(out, frame.T, singular, float((singular ** 2).sum() / total) if total > 0 else 0.0, residual, done)
