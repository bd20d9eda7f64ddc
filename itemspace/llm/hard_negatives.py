"""Hard-negative mining over an inverted multi-index, with exact results.

A vector's two halves are quantised by two codebooks, and a cell holds the rows
of one codeword pair.  For an anchor, a half's score with any row of codeword c is
at most q.c + |q| r, where r is the largest distance of such a row from c: the sum of
both halves bounds every score in the cell.  A heap walks the cells by falling
bound (the multi-sequence order), and a search stops once no cell to come can
change its answer, so results are those of a full scan.

1. ``integer_rows``: components floor(256 x), one row per id.
2. ``codebooks``: Lloyd rounds per half on at most SAMPLE_ROWS rows (those of least
   hash); every row is indexed.
3. Rows are dealt in shards of about SHARD_ROWS by hash, anchors in blocks of
   ANCHOR_ROWS; each shard meets each block in one task, which builds the shard's
   index with its own radii and searches it.
4. Positives: the first of the same label, per shard and then overall.
5. Negatives: one window of scores per positive, all windows of an anchor in
   one walk; cells wholly above all windows are passed without scoring.

The anchors are the stated query set; nothing else is compared in pairs.

Defined cases: rows with a null id or label, a null or empty vector, a null or
non-finite component, or a component of 65,536 or more in size (whose products
might not fit a long) take no part.  Of rows that share an id the least
(label, vector) stands, so repeated rows count once.  Vectors of different lengths
have no score with each other.  Ties go to the smaller id.  An empty table, an
anchor without positives, and a positive without negatives have no rows.  Columns
other than the three named play no part.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemspace.llm.runtime import prepare, stored

SCALE = 256
LARGEST = 65_536
CODEWORDS = 16
LLOYD_ROUNDS = 8
SAMPLE_ROWS = 4_096
SHARD_ROWS = 16_384
ANCHOR_ROWS = 16_384
SCORED_AT_FIRST = 512

Codebook = tuple[np.ndarray, np.ndarray]


# ---------------------------------------------------------------- one shard
class MultiIndex:
    """Rows of one shard by cell."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, book: Codebook):
        self.half = vectors.shape[1] // 2
        self.book = book
        parts = vectors[:, :self.half], vectors[:, self.half:]
        codes, self.radii = [], []
        for x, c in zip(parts, book):
            code = nearest(x, c)
            radius = np.zeros(len(c))
            np.maximum.at(radius, code, np.sqrt(((x - c[code]) ** 2).sum(axis=1)))
            codes.append(code)
            self.radii.append(radius)
        cell = codes[0] * len(book[1]) + codes[1]
        order = np.argsort(cell, kind="stable")
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        self.starts = np.searchsorted(cell[order], np.arange(len(book[0]) * len(book[1]) + 1))
        self.largest = float(np.abs(vectors).max(initial=0))
        self.narrow = self.vectors.astype(np.float32)
        self.numbers = np.arange(len(self.ids))

    def walk(self, q: np.ndarray) -> Iterator[tuple[float, float, int, int]]:
        """(upper bound, lower bound, first, last) of the cells by falling upper
        bound; empty cells are passed over."""
        tops, lows, order = [], [], []
        for x, c, r in zip((q[:self.half], q[self.half:]), self.book, self.radii):
            middle, reach = c @ x, math.sqrt(float(x @ x)) * r
            by = np.argsort(-(middle + reach), kind="stable")
            tops.append((middle + reach)[by].tolist())
            lows.append((middle - reach)[by].tolist())
            order.append(by.tolist())
        wide = len(self.book[1])
        heap = [(-(tops[0][0] + tops[1][0]), 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            # each (i, j) is reached once: from the left, or down the first column
            if j + 1 < wide:
                heapq.heappush(heap, (-(tops[0][i] + tops[1][j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(tops[0]):
                heapq.heappush(heap, (-(tops[0][i + 1] + tops[1][0]), i + 1, 0))
            cell = order[0][i] * wide + order[1][j]
            first, last = self.starts[cell], self.starts[cell + 1]
            if first < last:
                slack = 1e-6 + 1e-9 * abs(bound)       # of the bound's own rounding
                yield -bound + slack, lows[0][i] + lows[1][j] - slack, first, last

    def scores(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Exact inner products, in the narrowest type that holds every partial sum."""
        largest = self.largest * float(np.abs(q).max(initial=0)) * max(len(q), 1)
        if largest < 2 ** 24:
            return self.narrow.take(at, axis=0) @ q.astype(np.float32)
        if largest < 2 ** 53:
            return self.vectors.take(at, axis=0) @ q
        return self.vectors.take(at, axis=0).astype(np.int64) @ q.astype(np.int64)

    def _gathered(self, q: np.ndarray, pass_over=None) -> Iterator[tuple[float, np.ndarray]]:
        """(bound of what is still to come, row numbers to score), in batches of
        whole cells that double in size."""
        held: list[np.ndarray] = []
        n, most = 0, SCORED_AT_FIRST
        cells = self.walk(q)
        ahead = next(cells, None)
        while ahead is not None:
            _, low, first, last = ahead
            ahead = next(cells, None)
            if not (pass_over and pass_over(low)):
                held.append(self.numbers[first:last])
                n += last - first
            if n >= most or ahead is None:
                yield ahead[0] if ahead else -math.inf, np.concatenate(held) if held else self.numbers[:0]
                held, n, most = [], 0, 2 * most

    def best(self, q: np.ndarray, keep: int, wanted) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the first ``keep`` rows that ``wanted`` (of row
        numbers) admits."""
        return self.windows(q, np.array([-(2 ** 62)]), np.array([2 ** 62]), keep, wanted)[0]

    def windows(self, q: np.ndarray, low: np.ndarray, high: np.ndarray, keep: int,
                wanted) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per window the first ``keep`` wanted rows with low <= score <= high."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(low)
        floor = low.copy()                             # what a row has to reach to count
        open_ = [w for w in range(len(low)) if low[w] <= high[w]]
        if not open_:
            return found
        ceiling = high[open_].max()
        for to_come, at in self._gathered(q, lambda least: least > ceiling):
            scores = self.scores(q, at)
            near = np.flatnonzero((scores >= floor[open_].min()) & (scores <= high[open_].max()))
            near = near[wanted(at[near])]
            if len(near):
                ids, scores = self.ids[at[near]], scores[near].astype(np.int64)
                for w in open_:
                    inside = (scores >= floor[w]) & (scores <= high[w])
                    if inside.any():
                        found[w] = first_of(np.append(found[w][0], ids[inside]),
                                            np.append(found[w][1], scores[inside]), keep)
                        if len(found[w][0]) == keep:
                            floor[w] = found[w][1][-1]
            # certified: nothing to come reaches the window, or its last place
            open_ = [w for w in open_ if to_come >= floor[w]]
            if not open_:
                break
        return found


def first_of(ids: np.ndarray, scores: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:keep]
    return ids[order], scores[order]


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


def codebook(x: np.ndarray, codewords: int = CODEWORDS, rounds: int = LLOYD_ROUNDS) -> np.ndarray:
    """Codewords of the rows ``x`` (any choice gives the same results)."""
    centres = np.unique(x, axis=0)
    centres = centres[np.linspace(0, len(centres) - 1, min(codewords, len(centres))).astype(int)]
    for _ in range(rounds):
        code = nearest(x, centres)
        centres = np.array([x[code == c].mean(axis=0) if (code == c).any() else centres[c] for c in range(len(centres))])
    return centres


# -------------------------------------------------------------- all shards
def integer_rows(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label",
                 vector_col: str = "embedding") -> DataFrame:
    """vec_id, label, dims and v (floor(256 x)) of the rows that take part."""
    e = F.col(f"`{vector_col}`")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= LARGEST))
    able = F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull() & (F.size(e) > 0) & ~bad
    v = F.transform(e, lambda x: F.floor(x.cast("double") * SCALE).cast("int"))
    rows = vectors.where(able).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"),
                                      F.col(f"`{label_col}`").cast("long").alias("label"), v.alias("v"))
    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r"))
    return one.select("vec_id", "r.label", F.size("r.v").alias("dims"), "r.v")


def codebooks(rows: DataFrame, sample: int = SAMPLE_ROWS) -> dict[int, Codebook]:
    """Two codebooks per vector length, from the ``sample`` rows of least hash."""
    taken = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("dims", "v").collect()
    by: dict[int, list] = {}
    for r in taken:
        by.setdefault(r["dims"], []).append(r["v"])
    books = {}
    for d, vs in by.items():
        x = np.array(vs, dtype=np.float64)
        books[d] = codebook(x[:, :d // 2]), codebook(x[:, d // 2:])
    return books


def _book(books: dict[int, Codebook], dims: int) -> Codebook:
    """A length that the sample has not met gets one codeword, the origin."""
    return books.get(dims) or (np.zeros((1, dims // 2)), np.zeros((1, dims - dims // 2)))


def _searched(books: dict[int, Codebook], search):
    """``search`` (index, anchor) for the anchors of a block on a shard; ``rest`` names
    what else an anchor brings."""
    def run(shard: pd.DataFrame, anchors: pd.DataFrame, rest: list[str]) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(shard) and len(anchors):            # an empty side has no columns
            vectors = np.stack(shard["v"].to_numpy()).astype(np.float64)
            index = MultiIndex(shard["vec_id"].to_numpy(), shard["label"].to_numpy(), vectors,
                               _book(books, vectors.shape[1]))
            for a, label, v, *more in anchors[["anchor_vec_id", "anchor_label", "anchor_v", *rest]].itertuples(index=False):
                out += search(index, a, label, np.asarray(v, dtype=np.float64), *more)
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(
            {"anchor_id": [], "positive_id": [], "positive_score": [], "vec_id": [], "score": []}, dtype="int64")
    return run


FOUND = "anchor_id long, positive_id long, positive_score long, vec_id long, score long"


def _frame(anchor: int, positive: int, positive_score: int, ids: np.ndarray, scores: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"anchor_id": np.int64(anchor), "positive_id": np.int64(positive),
                         "positive_score": np.int64(positive_score), "vec_id": ids, "score": scores})


def _met(index: DataFrame, shards: int, anchors: DataFrame, blocks: int, fn) -> DataFrame:
    """Every shard with every block of anchors of its vector length."""
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # names of their own: a co-group of a table with itself loses the columns they share
    right = (anchors.select(*[F.col(c).alias(f"anchor_{c}") for c in anchors.columns])
             .withColumn("block", F.pmod(F.xxhash64(F.lit(1), "anchor_vec_id"), F.lit(blocks)).cast("int"))
             .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))
    rest = [f"anchor_{c}" for c in anchors.columns if c not in ("vec_id", "label", "v", "dims")]

    def run(shard: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        return fn(shard, some, rest)
    return (left.groupBy("dims", "shard", "block").cogroup(right.groupBy("anchor_dims", "shard", "block"))
            .applyInPandas(run, FOUND))


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3,
         low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score
    for the ``rows`` of ``integer_rows``; a negative's score lies between ``low`` and
    ``high`` hundredths of its positive's."""
    prepare(rows.sparkSession)
    rows = stored(rows, "integers")
    books = codebooks(rows)
    n = rows.count()
    shards = max(1, math.ceil(n / SHARD_ROWS))
    index = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    anchors = rows.where(is_anchor)
    blocks = max(1, math.ceil(anchors.count() / ANCHOR_ROWS))

    def closest(index: MultiIndex, a: int, label: int, q: np.ndarray) -> list[pd.DataFrame]:
        ids, scores = index.best(q, positives, lambda at: (index.labels[at] == label) & (index.ids[at] != a))
        return [_frame(a, 0, 0, ids, scores)] if len(ids) else []

    best = _met(index, shards, anchors, blocks, _searched(books, closest))
    first = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    top = best.withColumn("r", F.row_number().over(first)).where(F.col("r") <= positives)
    # at most ``positives`` of an anchor
    wanted = top.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("p"))
    asked = stored(anchors.join(wanted, F.col("vec_id") == F.col("anchor_id")).select(
        "vec_id", "label", "dims", "v", F.col("p.vec_id").alias("pid"), F.col("p.score").alias("pscore")), "anchors")

    def within(index: MultiIndex, a: int, label: int, q: np.ndarray, pid: np.ndarray, pscore: np.ndarray):
        pscore = np.asarray(pscore, dtype=np.int64)
        lows, highs = [-(-low * int(s) // 100) for s in pscore], [high * int(s) // 100 for s in pscore]
        found = index.windows(q, np.array(lows), np.array(highs), negatives, lambda at: index.labels[at] != label)
        return [_frame(a, p, s, *f) for p, s, f in zip(pid, pscore, found) if len(f[0])]

    seen = _met(index, shards, asked, blocks, _searched(books, within))
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id")
    return seen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
