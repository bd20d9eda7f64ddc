"""Quality classifier: regularised quadratic discriminant.

Statistics of every whole text (shares of byte classes, word and line lengths,
repetition) are transformed to be nearly normal.  Per class, counts, sums and
cross products are added up over all labelled training rows in Spark, and only
those few hundred numbers reach the driver.  A class covariance is shrunk
towards the pooled one and that towards a multiple of the identity; its
Cholesky factor is computed once and broadcast.  The score comes from the
difference of the two Mahalanobis log densities.

Cases: null and empty texts have the statistics of no words and get a score
too; a null id has no label; several labels of one id count as their rounded
mean (a half counts as 1); null labels are left out; repeated rows are scored
each; with one class missing the score is the share of label 1, with no labels
0.5; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemspace.llm.runtime import id_bucket, narrow, prepare, stored
from itemspace.llm.words import buffers, mix, words

SHRINK_TO_POOLED = 0.2
SHRINK_TO_IDENTITY = 0.02

# Byte classes.
_KINDS = np.zeros(256, dtype=np.uint8)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789",
                             b" \t\x0b\x0c\r", b"\n", b".,;:", b"!?", b"#*$%&|<>"), start=1):
    _KINDS[list(_chars)] = _k
_KINDS[0x80:] = 9
N_KINDS = 10

NAMES = ("length", "upper", "digit", "space", "line_end", "stop", "shout", "symbol", "wide", "other", "word_length",
         "distinct", "again", "pair_again", "line_length", "line_again")


def _repeats(keys: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Per owner, how many keys equal an earlier one of the same owner."""
    order = np.argsort(mix(keys + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), kind="stable")
    k, o = keys[order], owner[order]
    same = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
    return np.bincount(o[1:][same], minlength=n)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of transformed statistics per text."""
    offsets, raw = buffers(column)
    out = np.zeros((len(column), len(NAMES)))
    for w in words(column):
        i, j, n = w.first, w.last, w.last - w.first
        data = raw[offsets[i]:offsets[j]]
        sizes = np.diff(offsets[i:j + 1])
        row = np.repeat(np.arange(n), sizes)
        kinds = np.bincount(row * N_KINDS + _KINDS[data], minlength=n * N_KINDS).reshape(n, N_KINDS)
        owner = np.repeat(np.arange(n), w.counts)
        follows = owner[1:] == owner[:-1]
        pairs = mix(w.hashes[:-1] * np.uint64(31) + w.hashes[1:])[follows] if len(owner) else w.hashes
        again = np.bincount(owner[1:][follows & (w.hashes[1:] == w.hashes[:-1])], minlength=n) if len(owner) \
            else np.zeros(n)
        pair_again = _repeats(pairs, owner[1:][follows], n) if len(owner) else np.zeros(n)
        word_again = _repeats(w.hashes, owner, n)
        lines, line_owner = _line_hashes(w, data, offsets[i:j + 1] - offsets[i])
        line_again = _repeats(lines, line_owner, n)
        n_lines = np.bincount(line_owner, minlength=n)
        chars = np.maximum(sizes, 1)[:, None]
        n_words = np.maximum(w.counts, 1)
        share = np.sqrt(kinds / chars)
        lens = np.bincount(owner, weights=(w.ends - w.starts).astype(float), minlength=n)
        out[i:j] = np.column_stack([
            np.log1p(w.counts), share[:, 2], share[:, 3], share[:, 4], share[:, 5], share[:, 6], share[:, 7],
            share[:, 8], share[:, 9], share[:, 0], np.log1p(lens / n_words),
            # the share of distinct words falls with length, so per log length
            np.log1p(w.counts - word_again) / np.log1p(n_words), np.sqrt(again / n_words),
            np.sqrt(pair_again / n_words), np.log1p(w.counts / np.maximum(n_lines, 1)),
            np.sqrt(line_again / np.maximum(n_lines, 1))])
    return out


def _line_hashes(w, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and owner of each line with words."""
    if not len(w.hashes):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    owner = np.repeat(np.arange(len(w.counts)), w.counts)
    ends = np.flatnonzero(data == 0x0A)
    line = np.searchsorted(ends, w.starts + offsets[owner])
    first = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (owner[1:] != owner[:-1])]))
    place = np.arange(len(line)) - np.repeat(first, np.diff(np.append(first, len(line))))
    return mix(np.add.reduceat(mix(w.hashes + place.astype(np.uint64)), first)), owner[first]


class Discriminant(NamedTuple):
    """Per class (0, 1): mean, inverse Cholesky factor, log determinant and
    log prior; or a constant score."""
    means: np.ndarray
    factors: np.ndarray
    logs: np.ndarray
    constant: float | None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        density = [self.logs[c] - 0.5 * np.square((x - self.means[c]) @ self.factors[c].T).sum(axis=1)
                   for c in (0, 1)]
        # Per statistic, so that sure scores still differ.
        z = np.clip((density[1] - density[0]) / x.shape[1], -500, 500)
        return 1 / (1 + np.exp(-z))


def fit(count: np.ndarray, total: np.ndarray, cross: np.ndarray, to_pooled: float = SHRINK_TO_POOLED,
        to_identity: float = SHRINK_TO_IDENTITY) -> Discriminant:
    """From per-class counts (2), sums (2, p) and cross products (2, p, p)."""
    if min(count) < 1:
        share = count[1] / count.sum() if count.sum() else 0.5
        return Discriminant(total, cross, count, float(share))
    p = total.shape[1]
    means = total / count[:, None]
    scatter = cross - count[:, None, None] * means[:, :, None] * means[:, None, :]
    pooled = scatter.sum(axis=0) / count.sum()
    factors, logs = [], []
    for c in (0, 1):
        cov = (1 - to_pooled) * scatter[c] / count[c] + to_pooled * pooled
        cov = (1 - to_identity) * cov + to_identity * (np.trace(cov) / p + 1e-9) * np.eye(p)
        low = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(low))
        logs.append(np.log(count[c] / count.sum()) - np.log(np.diag(low)).sum())
    return Discriminant(means, np.stack(factors), np.array(logs), None)


def training_sums(featured: DataFrame, labels: DataFrame) -> DataFrame:
    """label, position and sum over all rows of (1, x, x x') flattened."""
    p = len(NAMES)

    def sums(batches):
        for batch in batches:
            y = batch.column("label").to_numpy(zero_copy_only=False)
            x = np.array(batch.column("x").flatten()).reshape(-1, p)
            for c in (0, 1):
                z = x[y == c]
                flat = np.concatenate([[len(z)], z.sum(axis=0), (z.T @ z).ravel()])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(flat), c), type=pa.int32()), pa.array(np.arange(len(flat)), type=pa.int32()),
                     pa.array(flat)], names=["label", "pos", "v"])

    return (featured.join(labels, "doc_id").select("label", "x")
            .mapInArrow(sums, "label int, pos int, v double").groupBy("label", "pos").agg(F.sum("v").alias("v")))


def single_labels(labels: DataFrame, column: str) -> DataFrame:
    return (labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id")
            .agg((F.avg(column) >= 0.5).cast("int").alias("label")))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held: int = 1,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for every document, learnt from the
    labelled documents outside the held-out fold (crc32 of the id)."""
    return scored(docs, labels, label, folds, held, id_col, text_col).drop("text_hash")


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held: int = 1,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``classify`` with text_hash, the hash of the text (null: empty) that the score is of."""
    spark = docs.sparkSession
    prepare(spark)
    source = narrow(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def features(batches):
        for batch in batches:
            x = statistics(batch.column("text"))
            bounds = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"),
                 pa.ListArray.from_arrays(pa.array(bounds), pa.array(x.ravel()))], names=["doc_id", "text_hash", "x"])

    featured = stored(source.mapInArrow(features, f"doc_id {kind}, text_hash long, x array<double>"), "quality")
    known = single_labels(labels.withColumn("_y", F.col(label)), "_y").where(id_bucket(F.col("doc_id"), folds) != held)
    p = len(NAMES)
    flat = np.zeros((2, 1 + p + p * p))
    for r in training_sums(featured, known).collect():   # 2 (1 + p + p^2) rows at most
        flat[r.label, r.pos] = r.v
    model = spark.sparkContext.broadcast(
        fit(flat[:, 0], flat[:, 1:1 + p], flat[:, 1 + p:].reshape(2, p, p)))

    def scores(batches):
        for batch in batches:
            s = model.value.score(np.array(batch.column("x").flatten()).reshape(-1, p))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(s)],
                                             names=["doc_id", "text_hash", "score"])

    return featured.mapInArrow(scores, f"doc_id {kind}, text_hash long, score double").select(
        "doc_id", "text_hash", F.coalesce(id_bucket(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
