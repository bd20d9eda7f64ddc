"""Words of Arrow text columns as NumPy arrays.

A word is a maximal run of digits, ASCII letters (lower-cased) and non-ASCII
characters, i.e. ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z
lower-cased.  On UTF-8 that is a rule on single bytes, so words are found and
hashed to 64 bits over whole columns without a Python loop per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20

_FOLD = np.zeros(256, dtype=np.uint8)
_FOLD[0x30:0x3A] = np.arange(0x30, 0x3A)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


class Words(NamedTuple):
    """Words of rows [first, last): ``counts`` per row, and per word its hash
    and its byte range in its row's text."""
    first: int
    last: int
    counts: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def counter(n: int, salt: int = 0) -> np.ndarray:
    """n pseudo-random odd multipliers."""
    step = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(step + np.uint64(salt)) | np.uint64(1)


_POWERS = counter(256)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = counter(2 * n)
    return _POWERS


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (len + 1) and bytes of a string column; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    _, off, data = column.buffers()
    if not len(column):
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return offsets.astype(np.int64), raw


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def words(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Words]:
    offsets, raw = buffers(column)
    for i, j in chunks(offsets, limit):
        yield _words(raw, offsets, i, j)


def _words(raw: np.ndarray, offsets: np.ndarray, i: int, j: int) -> Words:
    base = offsets[i]
    folded = _FOLD[raw[base:offsets[j]]]
    inside = folded != 0
    n = len(folded)
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets[i:j + 1] - base] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | cut[1:n]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | cut[1:n]
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(stop) + 1
    counts = np.diff(np.searchsorted(starts, offsets[i:j + 1] - base))
    if len(starts):
        lens = ends - starts
        firsts = np.cumsum(lens) - lens
        place = np.arange(lens.sum()) - np.repeat(firsts, lens)
        terms = (folded[inside].astype(np.uint64) + np.uint64(1)) * _powers(int(lens.max()))[place]
        hashes = mix(np.add.reduceat(terms, firsts) + lens.astype(np.uint64))
    else:
        hashes = np.zeros(0, dtype=np.uint64)
    shift = np.repeat(offsets[i:j] - base, counts)
    return Words(i, j, counts, hashes, starts - shift, ends - shift)


def hash_words(text: str | None) -> np.ndarray:
    """Hashes of one text's words."""
    found = [w.hashes for w in words(pa.array([text or ""], type=pa.string()))]
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)
