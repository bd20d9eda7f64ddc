"""Answer x item vectors pooled per subject in NumPy, over rows sorted by subject: a task
holds one batch and the subject that goes on in the next."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 8192                                          # rows multiplied at a time


class Codebook(NamedTuple):
    """Item vectors, padded to one length: values, places that hold a number, sizes (-1: null)."""
    x: np.ndarray
    known: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, e: pa.ListArray) -> Codebook:
        size = pc.fill_null(pc.list_value_length(e), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        x = np.zeros((len(e), max(0, size.max(initial=0))))
        known = np.zeros(x.shape, dtype=bool)
        for i in np.flatnonzero(size > 0):
            known[i, :size[i]] = e[i].values.is_valid().to_numpy(zero_copy_only=False)
            x[i, :size[i]] = e[i].values.fill_null(0.0).to_numpy(zero_copy_only=False)
        return cls(x, known, size)


class State(NamedTuple):
    """Of each subject: answers, size, and by position how many numbers, how many that are no
    NaN, and what was pooled of them."""
    n: np.ndarray
    size: np.ndarray
    count: np.ndarray
    whole: np.ndarray
    value: np.ndarray


# what joins two pooled values, and the value that changes nothing
_JOIN = {"sum": (np.add, 0.0), "mean": (np.add, 0.0), "max": (np.maximum, -np.inf), "min": (np.minimum, np.inf)}


def _state(book: Codebook, at: np.ndarray, a: np.ndarray, answered: np.ndarray, start: np.ndarray, how: str) -> State:
    """The state of the subjects whose rows begin at ``start``."""
    join, nothing = _JOIN[how]
    with np.errstate(invalid="ignore", over="ignore"):
        x = book.x[at] * a[:, None]
        known = book.known[at] & answered[:, None]
        whole = known & ~np.isnan(x)
        # NaN is the greatest of all: only the least passes it over
        x = np.where(whole if how == "min" else known, x, nothing)
        return State(np.add.reduceat(answered.astype(np.int64), start), np.maximum.reduceat(book.size[at], start),
                     np.add.reduceat(known.astype(np.int64), start), np.add.reduceat(whole.astype(np.int64), start),
                     join.reduceat(x, start))


def _joined(a: State, b: State, how: str) -> State:
    with np.errstate(invalid="ignore", over="ignore"):
        return State(a.n + b.n, np.maximum(a.size, b.size), a.count + b.count, a.whole + b.whole, _JOIN[how][0](a.value, b.value))


def _vectors(s: State, how: str) -> pa.Array:
    with np.errstate(invalid="ignore", divide="ignore"):
        v = s.value / s.count if how == "mean" else s.value
    if how == "min":
        v = np.where((s.whole == 0) & (s.count > 0), np.nan, v)
    if not v.shape[1]:
        return pa.array([None if z < 0 else [] for z in s.size], pa.list_(pa.float64()))
    inside = np.arange(v.shape[1])[None, :] < s.size[:, None]
    flat = pa.array(v[inside], mask=(s.count == 0)[inside])
    ends = np.concatenate([[0], np.cumsum(np.maximum(s.size, 0))]).astype(np.int32)
    # a null first end of a list makes it null
    return pa.ListArray.from_arrays(pa.array(ends, mask=np.append(s.size < 0, False)), flat)


def _starts(key: pa.Array) -> np.ndarray:
    """Places where another subject begins; null is one subject."""
    if len(key) == 1:
        return np.zeros(1, dtype=np.int64)
    null = key.is_null().to_numpy(zero_copy_only=False)
    other = pc.fill_null(pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)), False).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(other | (null[1:] != null[:-1])) + 1])


def pooled(book, how: str):
    """Rows (subject, place in the codebook, answer), sorted by subject, to (subject, answers, vector).
    ``book``: a broadcast ``Codebook``."""
    if how not in _JOIN:
        raise KeyError(how)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None                                   # (key, state) of the subject that may go on
        names = ["", "_n", "v"]

        def batch(keys: pa.Array, s: State) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([keys, pa.array(s.n), _vectors(s, how)], names=names)

        for whole in batches:
            names[0] = whole.schema.names[0]
            for lo in range(0, whole.num_rows, PIECE):
                b = whole.slice(lo, PIECE)
                answer = b.column(2)
                start = _starts(b.column(0))
                s = _state(book.value, b.column(1).to_numpy(), answer.fill_null(0.0).to_numpy(),
                           answer.is_valid().to_numpy(zero_copy_only=False), start, how)
                keys = b.column(0).take(pa.array(start))
                if held is not None:
                    if len(_starts(pa.concat_arrays([held[0], keys.slice(0, 1)]))) == 1:
                        first = _joined(held[1], State(*[x[:1] for x in s]), how)
                        s = State(*[np.concatenate([f, x[1:]]) for f, x in zip(first, s)])
                    else:
                        yield batch(*held)
                if len(keys) > 1:
                    yield batch(keys.slice(0, len(keys) - 1), State(*[x[:-1] for x in s]))
                held = keys.slice(len(keys) - 1), State(*[x[-1:].copy() for x in s])
        if held is not None:
            yield batch(*held)
    return fn
