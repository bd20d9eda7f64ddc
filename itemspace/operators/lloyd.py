"""Lloyd rounds in NumPy over Arrow batches: sums of the centres' rows, and rounds
that carry distance bounds so that settled rows are not compared again.

A configuration is a (group, id) pair with its own centres; all of them share a
pass.  Every task adds its rows up and emits K x (d + 1) numbers per configuration,
never a row per coordinate.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemspace.session import materialize, persist, ship_package

SUMS = "i int, s double"
# bounds are widened by so much of themselves, against rounding
SLACK = 1e-9
# stands for a null group, which has no centres
NO_GROUP = -(1 << 31)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def lists(x: np.ndarray) -> pa.Array:
    ends = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(x).ravel()))


# rows compared at once: they stay in a core's cache
STRIP_ROWS = 1024


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances (rows, centres), difference by difference."""
    out = np.empty((len(x), len(centres)))
    for s in range(0, len(x), STRIP_ROWS):
        strip = x[s:s + STRIP_ROWS]
        for j, c in enumerate(centres):
            d = strip - c
            out[s:s + STRIP_ROWS, j] = np.multiply(d, d, out=d).sum(axis=1)
    return out


class Centres:
    """Centres of several configurations and their places in one flat vector."""

    def __init__(self, centres: dict):
        self.of = {c: np.asarray(v, dtype=np.float64) for c, v in centres.items()}
        self.start, at = {}, 0
        for c, v in self.of.items():
            self.start[c] = at
            at += v.shape[0] * (v.shape[1] + 1)
        self.size = at

    def part(self, total: np.ndarray, c) -> np.ndarray:
        """The sums of configuration c in ``total``, with the counts in the last column."""
        k, d = self.of[c].shape
        return total[self.start[c]:self.start[c] + k * (d + 1)].reshape(k, d + 1)

    def add(self, total: np.ndarray, c, x: np.ndarray, label: np.ndarray) -> None:
        """Add the rows' sums and counts of configuration c to ``total``."""
        k, d = self.of[c].shape
        part = self.part(total, c)
        part[:, d] += np.bincount(label, minlength=k)
        if np.isfinite(x).all():
            part[:, :d] += (label[:, None] == np.arange(k)).T.astype(np.float64) @ x
            return
        for j in range(k):                            # a product would carry what is no number to every centre
            part[j, :d] += x[label == j].sum(axis=0)

    def moved(self, sums: DataFrame) -> dict:
        """Means by the summed parts; a centre without rows stays."""
        total = np.zeros(self.size)
        for r in sums.groupBy("i").agg(F.sum("s").alias("s")).collect():
            total[r["i"]] = r["s"]
        out = {}
        for c, v in self.of.items():
            k, d = v.shape
            part = total[self.start[c]:self.start[c] + k * (d + 1)].reshape(k, d + 1)
            n = part[:, d:]
            out[c] = np.where(n > 0, part[:, :d] / np.maximum(n, 1), v)
        return out


def _emitted(total: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    if total is not None:
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["i", "s"])


def packed(vectors: DataFrame, col: str, group: str | None = None) -> DataFrame:
    """(g, n, x): the rows of a group by batches, as binary matrices, so that a round moves
    them into NumPy without touching their entries."""
    ship_package(vectors.sparkSession)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, g = matrix(b.column("v")).astype(np.float64), b.column("g").fill_null(NO_GROUP).to_numpy()
            for of in np.unique(g):
                rows = x[g == of]
                yield pa.RecordBatch.from_arrays([pa.array([of], type=pa.int32()), pa.array([len(rows)], type=pa.int32()),
                                                  pa.array([rows.tobytes()], type=pa.binary())], names=["g", "n", "x"])

    g = F.col(group).cast("int") if group else F.lit(0)
    return vectors.select(F.col(col).alias("v"), g.alias("g")).mapInArrow(fn, "g int, n int, x binary")


def _near(x: np.ndarray, parts: list[np.ndarray], starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(centres, rows): which centre of each configuration is a row's nearest, as by ``squared``.  One product gives
    all distances, and a row whose two nearest centres it cannot tell apart is compared difference by difference."""
    every = np.vstack(parts)
    own, theirs = (x * x).sum(axis=1), (every * every).sum(axis=1)
    d = own[None, :] - 2 * (every @ x.T) + theirs[:, None]
    margin = 8 * (x.shape[1] + 16) * np.finfo(np.float64).eps * (own + theirs.max())
    near = d <= np.repeat(np.minimum.reduceat(d, starts, axis=0) + margin, sizes, axis=0)
    doubt = np.add.reduceat(near, starts, axis=0, dtype=np.int32) != 1     # also where a distance is no number
    for i in np.flatnonzero(doubt.any(axis=1)):
        at = np.flatnonzero(doubt[i])
        near[starts[i]:starts[i] + sizes[i], at] = squared(x[at], parts[i]).argmin(axis=1) == np.arange(sizes[i])[:, None]
    return near


def _places(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(v) for v in parts])
    return np.cumsum(sizes) - sizes, sizes


def _nearest(x: np.ndarray, parts: list[np.ndarray]) -> list[np.ndarray]:
    """Labels of each configuration."""
    starts, sizes = _places(parts)
    near = _near(x, parts, starts, sizes)
    return [near[i:i + k].argmax(axis=0) for i, k in zip(starts, sizes)]


def _add_nearest(held: Centres, total: np.ndarray, mine: list, x: np.ndarray) -> None:
    """Add rows to the sums of their nearest centre of each configuration of ``mine``."""
    parts = [held.of[c] for c in mine]
    starts, sizes = _places(parts)
    for s in range(0, len(x), STRIP_ROWS):
        rows = x[s:s + STRIP_ROWS]
        if not np.isfinite(rows).all():
            for c, label in zip(mine, _nearest(rows, parts)):
                held.add(total, c, rows, label)
            continue
        near = _near(rows, parts, starts, sizes)
        sums = near.astype(np.float64) @ rows
        for c, i, k in zip(mine, starts, sizes):
            part = held.part(total, c)
            part[:, :-1] += sums[i:i + k]
            part[:, -1] += near[i:i + k].sum(axis=1)


def updated(rows: DataFrame, centres: dict) -> dict:
    """One Lloyd update: rows (those of ``packed``) to their nearest centre (lowest id on ties),
    centres to the means.  ``centres`` maps (group, id) to lists of centres."""
    held = Centres(centres)
    of: dict = {}
    for c in held.of:
        of.setdefault(c[0], []).append(c)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for i in range(b.num_rows):
                total = np.zeros(held.size) if total is None else total
                mine = of.get(b.column("g")[i].as_py(), [])
                if mine:
                    x = np.frombuffer(b.column("x")[i].as_buffer()).reshape(b.column("n")[i].as_py(), -1)
                    _add_nearest(held, total, mine, x)
        yield from _emitted(total)

    return {c: v.tolist() for c, v in held.moved(rows.mapInArrow(fn, SUMS)).items()}


# ------------------------------------------------------------------- bounds
class Round(NamedTuple):
    """Distances that a round computed, and those that a plain one would have."""
    compared: int
    plain: int


def _first_bounds(held: Centres):
    """Labels and bounds from a full comparison."""
    def state(x: np.ndarray, _old):
        label, upper, lower = [], [], []
        n = 0
        for v in held.of.values():
            d = np.sqrt(squared(x, v))
            best = d.argmin(axis=1)
            rows = np.arange(len(x))
            label.append(best)
            upper.append(d[rows, best])
            d[rows, best] = np.inf
            lower.append(d.min(axis=1))
            n += d.size
        return np.stack(label, axis=1), np.stack(upper, axis=1), np.stack(lower, axis=1), n
    return state


def _next_bounds(held: Centres, before: dict):
    """Labels and bounds after the centres moved: a row whose nearest centre is
    certain by its bounds is not compared; one whose bound is only stale costs
    one distance."""
    step = {c: np.sqrt(((v - before[c]) ** 2).sum(axis=1)) for c, v in held.of.items()}
    gap = {}
    for c, v in held.of.items():
        d = np.sqrt(squared(v, v))
        np.fill_diagonal(d, np.inf)
        gap[c] = d.min(axis=1) / 2

    def state(x: np.ndarray, old):
        label, upper, lower = (a.copy() for a in old)
        n = 0
        for i, (c, v) in enumerate(held.of.items()):
            own = label[:, i]
            upper[:, i] = (upper[:, i] + step[c][own]) * (1 + SLACK)
            lower[:, i] = (lower[:, i] - step[c].max()) * (1 - SLACK)
            safe = np.maximum(gap[c][own] * (1 - SLACK), lower[:, i])
            doubt = np.flatnonzero(upper[:, i] >= safe)
            upper[doubt, i] = np.sqrt(((x[doubt] - v[own[doubt]]) ** 2).sum(axis=1))
            n += len(doubt)
            doubt = doubt[upper[doubt, i] * (1 + SLACK) >= safe[doubt]]
            if len(doubt):
                d = np.sqrt(squared(x[doubt], v))
                n += d.size
                best = d.argmin(axis=1)
                rows = np.arange(len(doubt))
                label[doubt, i] = best
                upper[doubt, i] = d[rows, best]
                d[rows, best] = np.inf
                lower[doubt, i] = d.min(axis=1)
        return label, upper, lower, n
    return state


def _carried(step):
    """Rows with their labels and bounds of this round."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            old = None
            if "label" in b.schema.names:
                old = tuple(matrix(b.column(c)) for c in ("label", "upper", "lower"))
            label, upper, lower, n = step(matrix(b.column("v")).astype(np.float64), old)
            compared = np.zeros(b.num_rows, dtype=np.int64)
            compared[0] = n                           # the batch's count, on one of its rows
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), b.column("v"), lists(label.astype(np.int32)), lists(upper), lists(lower), pa.array(compared)],
                names=["key", "v", "label", "upper", "lower", "compared"])
    return fn


def _state_sums(state: DataFrame, held: Centres) -> DataFrame:
    """Sums of the centres' rows, and in the last place the distances computed."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                total = np.zeros(held.size + 1) if total is None else total
                x, label = matrix(b.column("v")).astype(np.float64), matrix(b.column("label"))
                for i, c in enumerate(held.of):
                    held.add(total[:-1], c, x, label[:, i])
                total[-1] += b.column("compared").to_numpy().sum()
        yield from _emitted(total)
    return state.select("v", "label", "compared").mapInArrow(fn, SUMS)


def bounded_lloyd(vectors: DataFrame, init: dict, rounds: int, key: str = "subject", col: str = "v",
                  tol: float | None = None, checkpoint_every: int = 8) -> tuple[DataFrame, dict, list[Round]]:
    """k-means from given centres ({id: centres}) with the labels of ``lloyd_sweep``: each row
    keeps, per configuration, an upper bound of the distance to its centre and a lower
    bound of that to any other, moved along with the centres.  With ``tol`` rounds
    end once no centre moves further.  Returns (assignments (key, k, prediction, sqdist),
    centres, what each pass computed)."""
    ship_package(vectors.sparkSession)
    kind = vectors.schema[key].dataType.simpleString()
    schema = (f"key {kind}, v array<double>, label array<int>, upper array<double>, lower array<double>, compared long")
    base = persist(vectors.select(F.col(key).alias("key"), F.col(col).cast("array<double>").alias("v")))
    held = Centres(init)
    plain = base.count() * sum(len(v) for v in held.of.values())
    state = persist(base.mapInArrow(_carried(_first_bounds(held)), schema))
    before: list[DataFrame] = [base]
    done: list[Round] = []
    for r in range(rounds + 1):
        sums = persist(_state_sums(state, held).groupBy("i").agg(F.sum("s").alias("s")))
        last = sums.where(F.col("i") == held.size).select("s").first()
        done.append(Round(int(last[0]) if last else 0, plain))
        if r == rounds:
            sums.unpersist()
            break
        was, now = held.of, held.moved(sums.where(F.col("i") < held.size))
        sums.unpersist()
        still = tol is not None and max(np.sqrt(((now[c] - was[c]) ** 2).sum(axis=1)).max() for c in now) <= tol
        held = Centres(now)
        fresh = state.drop("compared").mapInArrow(_carried(_next_bounds(held, was)), schema)
        cut = (r + 1) % checkpoint_every == 0
        fresh = materialize(fresh) if cut else persist(fresh)
        before.append(state)
        if cut:
            for old in before:
                old.unpersist()
            before = []
        state = fresh
        if still:
            rounds = r + 1                            # one more pass gives the labels
            last = _state_sums(state, held).where(F.col("i") == held.size).agg(F.sum("s")).first()
            done.append(Round(int(last[0] or 0), plain))
            break
    ids = F.array(*[F.lit(int(c)) for c in held.of])
    cf = {c: v.tolist() for c, v in held.of.items()}
    out = materialize(_with_distances(state.select("key", "v", F.explode(F.arrays_zip(ids.alias("k"), F.col("label"))).alias("z"))
                                      .select("key", "v", "z.k", F.col("z.label").alias("prediction")), held, kind)
                      .withColumnRenamed("key", key))
    for old in [*before, state]:
        old.unpersist()
    return out, cf, done


def _with_distances(rows: DataFrame, held: Centres, kind: str) -> DataFrame:
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, k, p = matrix(b.column("v")), b.column("k").to_numpy(), b.column("prediction").to_numpy()
                d = np.zeros(b.num_rows)
                for c, v in held.of.items():
                    mine = k == c
                    d[mine] = ((x[mine] - v[p[mine]]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("k"), b.column("prediction"), pa.array(d)],
                                                 names=["key", "k", "prediction", "sqdist"])
    return rows.mapInArrow(fn, f"key {kind}, k int, prediction int, sqdist double")
