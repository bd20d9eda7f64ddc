"""All pairs of rows by blocks, without a shuffle of the rows for every pair of blocks.

Rows are packed into blocks (one table row of at most about ``block_rows`` rows, their
vectors as one binary matrix) and kept in the shared checkpoint folder.  A block pair
comes from a cross join of that table with itself (a nested loop over partitions: the
left side one block a task, the right side spans of about ``SPAN_ROWS`` rows), which reads
the blocks and shuffles nothing.  A task meets its left block with one span and
emits what it made of them once, so what is shuffled is n x (n / SPAN_ROWS) partial results.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemspace.session import materialize, ship_package

SPAN_ROWS = 131_072
_BLOCK = "key array<long>, x binary, labels array<int>"


class Block(NamedTuple):
    """``key`` as an array (``null``: where it is null), ``x`` (rows, dims), ``labels`` (rows, K;
    ``unlabelled``: where they are null)."""
    key: np.ndarray
    null: np.ndarray
    x: np.ndarray
    labels: np.ndarray
    unlabelled: np.ndarray


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _packed(block_rows: int):
    def block(rows: pa.Table) -> pa.RecordBatch:
        n = rows.num_rows
        x = _matrix(rows.column("v").combine_chunks(), n).astype(np.float64)
        ends = pa.array([0, n], type=pa.int32())
        labels = rows.column("labels").combine_chunks().flatten()
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(ends, rows.column("key").combine_chunks()), pa.array([x.tobytes()], type=pa.binary()),
             pa.ListArray.from_arrays(pa.array([0, len(labels)], type=pa.int32()), labels)], names=["key", "x", "labels"])

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            while n >= 2 * block_rows:                # a little more than a block stays one
                rows = pa.Table.from_batches(held)
                key, cut = rows.column("key"), block_rows
                while cut < n and key[cut].is_valid and key[cut].equals(key[cut - 1]):
                    cut += 1                          # rows of one key that lie together stay together
                if cut == n:
                    break
                yield block(rows.slice(0, cut))
                held, n = rows.slice(cut).to_batches(), n - cut
        if n:
            yield block(pa.Table.from_batches(held))
    return fn


def block_count(n: int, block_rows: int = 2048) -> int:
    return max(1, math.ceil(n / block_rows))


def packed_blocks(rows: DataFrame, block_rows: int = 2048, keep: Callable[[DataFrame], DataFrame] = materialize) -> DataFrame:
    """``rows`` (key long, v array<double>, labels array<int>) packed into blocks where they lie
    (a block of its own for every partition at least), kept in the shared checkpoint folder, or as ``keep`` does."""
    ship_package(rows.sparkSession)
    return keep(rows.select("key", "v", "labels").mapInArrow(_packed(block_rows), _BLOCK))


def unpacked(blocks: DataFrame) -> DataFrame:
    """(v array<double>, labels array<int>) of every row of the blocks."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                n = len(b.column("key")[i].values)
                x, labels = np.frombuffer(b.column("x")[i].as_buffer(), dtype=np.float64), b.column("labels")[i].values

                def lists(flat: pa.Array) -> pa.Array:
                    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (len(flat) // n)), flat)
                yield pa.RecordBatch.from_arrays([lists(pa.array(x)), lists(labels)], names=["v", "labels"])
    # blocks stream through a task: no more tasks than run at once
    few = blocks.coalesce(blocks.sparkSession.sparkContext.defaultParallelism)
    return few.mapInArrow(fn, "v array<double>, labels array<int>")


def block_pairs(rows: DataFrame, n: int, block_rows: int = 2048, span_rows: int = SPAN_ROWS) -> DataFrame:
    """Every pair of blocks of ``rows`` (key long, v array<double>, labels array<int>), n of them:
    a table for ``met``.  Rows that are blocks already (``packed_blocks``) are taken as they are."""
    blocks = rows if "x" in rows.columns else packed_blocks(rows.repartition(block_count(n, block_rows)), block_rows)
    left = blocks.select(*[F.col(c).alias(f"l{c}") for c in ("key", "x", "labels")])
    right = blocks.coalesce(max(1, math.ceil(n / span_rows))).select(
        *[F.col(c).alias(f"r{c}") for c in ("key", "x", "labels")])
    return left.crossJoin(right.hint("shuffle_replicate_nl"))


def _block(batch: pa.RecordBatch, side: str, i: int) -> Block:
    def values(name: str) -> pa.Array:
        return batch.column(side + name).slice(i, 1).flatten()
    key = values("key")
    n = len(key)
    x = np.frombuffer(batch.column(side + "x")[i].as_buffer(), dtype=np.float64).reshape(n, -1)
    labels = values("labels")
    return Block(key.fill_null(0).to_numpy(zero_copy_only=False), key.is_null().to_numpy(zero_copy_only=False), x,
                 labels.fill_null(0).to_numpy(zero_copy_only=False).reshape(n, -1),
                 labels.is_null().to_numpy(zero_copy_only=False).reshape(n, -1))


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, bool, Block]]:
    """(left block, whether it is a new one, right block) of a task's rows."""
    was, left = None, None
    for batch in batches:
        for i in range(batch.num_rows):
            name = batch.column("lkey").slice(i, 1).flatten(), batch.column("lx")[i].as_buffer()
            new = was is None or not (name[0].equals(was[0]) and name[1].equals(was[1]))
            if new:
                was, left = name, _block(batch, "l", i)
            yield left, new, _block(batch, "r", i)


def same_key(left: Block, right: Block) -> tuple[np.ndarray, np.ndarray] | None:
    """Places (i, j) where both keys are equal (a null key equals none), or None."""
    shared = np.isin(right.key, left.key) & ~right.null
    if not shared.any():
        return None
    j = np.flatnonzero(shared)
    i, at = np.nonzero((left.key[:, None] == right.key[j][None, :]) & ~left.null[:, None])
    return i, j[at]
