"""Toxicity: two class-conditional Kneser-Ney bigram models.

A toxic and an ordinary model are counted on a bounded sample of labelled
documents (``sample`` per class, by hash of the id; copies of a text count once).
Both orders use continuation counts: a bigram counts the distinct words before it
and a word those before it, so passages that are copied weigh no more than once.
Bigrams are discounted and back off to the class's words, these to a backoff that
both classes share: what the two have in common, and a uniform part.  ``SHARED`` of
every probability comes from there, which smooths expressions that are rare or only
by chance more frequent in one class, and leaves those of one class alone.

The score compares the two log-likelihoods per word, through a logistic curve fitted
on a part of the sample that was not counted.  Bigrams with one continuation
are not kept one by one: their mass goes to the backoff weight of their context.
What is broadcast is bounded by the sample.

Cases: null and empty texts have a log-likelihood difference of 0; null ids and
labels, repeated labels and repeated rows as in the quality classifier; with one
class missing the score is the share of label 1, with no labels 0.5; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemspace.llm.quality_classifier import single_labels
from itemspace.llm.runtime import id_bucket, narrow, prepare
from itemspace.llm.words import Words, mix, words

SAMPLE = 4000            # labelled documents per class
CALIBRATION = 4          # one in so many of them sets the logistic curve
DISCOUNT = 0.75
SHARED = 0.99            # part of every probability that both classes share
UNIFORM = 0.1            # part of the shared backoff spread over all words
CONTEXT = 30_000.0       # added to a context's count: bigrams of rare contexts weigh little
START = np.uint64(1)     # stands before a text's first word


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * np.uint64(0x9E3779B97F4A7C15) + second)


def contexts(w: Words) -> np.ndarray:
    """The word before each word."""
    before = np.empty_like(w.hashes)
    before[1:] = w.hashes[:-1]
    begins = np.cumsum(w.counts) - w.counts
    before[begins[w.counts > 0]] = START
    return before


class Models(NamedTuple):
    """Tables for both classes (axis 0: ordinary, toxic)."""
    vocabulary: np.ndarray    # sorted word hashes
    backoff: np.ndarray       # (2, words + 1) weight of the lower order after a word; last: unknown
    lower: np.ndarray         # (2, words + 1) lower-order probability of a word; last: unknown
    shared: np.ndarray        # (words + 1) probability shared by the classes
    pairs: np.ndarray         # sorted bigram hashes
    higher: np.ndarray        # (2, pairs + 1) discounted bigram probability; last: 0
    slope: float
    shift: float

    def differences(self, column: pa.Array) -> np.ndarray:
        """Toxic minus ordinary log-likelihood, per word."""
        out = np.zeros(len(column))
        for w in words(column):
            if not len(w.hashes):
                continue
            before = contexts(w)
            word, context = _find(self.vocabulary, w.hashes), _find(self.vocabulary, before)
            pair = _find(self.pairs, pair_hash(before, w.hashes))
            own = self.higher[:, pair] + self.backoff[:, context] * self.lower[:, word]
            p = SHARED * self.shared[word] + (1 - SHARED) * own
            total = np.add.reduceat(np.append(np.log(p[1] / p[0]), 0),
                                    np.minimum(np.cumsum(w.counts) - w.counts, len(w.hashes)))
            out[w.first:w.last] = np.where(w.counts > 0, total / np.maximum(w.counts, 1), 0)
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        z = np.clip(self.slope * self.differences(column) + self.shift, -500, 500)
        return 1 / (1 + np.exp(-z))


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key, or len(table)."""
    if not len(table):
        return np.zeros(len(keys), dtype=np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, len(table))


def estimate(first: np.ndarray, second: np.ndarray, label: np.ndarray, count: np.ndarray,
             discount: float = DISCOUNT) -> Models:
    """Kneser-Ney tables from distinct (label, first, second) with their
    continuation counts."""
    vocabulary = np.unique(np.concatenate([first, second]))
    n = len(vocabulary)
    a, b = np.searchsorted(vocabulary, first), np.searchsorted(vocabulary, second)
    before = [np.bincount(b[label == c], minlength=n).astype(float) for c in (0, 1)]
    size = [max(x.sum(), 1.0) for x in before]      # a class may have no words
    common = np.minimum(before[0] / size[0], before[1] / size[1])
    shared = np.full(n + 1, UNIFORM / (n + 1))
    if common.sum():
        shared[:n] += (1 - UNIFORM) * common / common.sum()
    keys = pair_hash(first, second)
    often = count >= 2
    pairs = np.unique(keys[often])
    backoff, lower = np.ones((2, n + 1)), np.zeros((2, n + 1))
    higher = np.zeros((2, len(pairs) + 1))
    for c in (0, 1):
        own = label == c
        part = np.append(np.maximum(before[c] - discount, 0), 0) / size[c]
        lower[c] = part + (1 - part.sum()) * shared
        kept = own & often
        seen = np.bincount(a[own], weights=count[own], minlength=n)
        p = (count[kept] - discount) / (seen[a[kept]] + CONTEXT)
        higher[c, np.searchsorted(pairs, keys[kept])] = p
        backoff[c, :n] = 1 - np.bincount(a[kept], weights=p, minlength=n)
    return Models(vocabulary, backoff, lower, shared, pairs, higher, 1.0, 0.0)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift by Newton steps."""
    scale = x.std() or 1.0
    design = np.column_stack([x / scale, np.ones(len(x))])
    beta = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + ridge * np.eye(2),
                               design.T @ (y - p) - ridge * beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def bigram_counts(sampled: DataFrame) -> DataFrame:
    """label, first, second, n: the distinct words before each bigram, over the
    sampled texts (label, text)."""
    def seen(batches):
        for batch in batches:
            y = batch.column("label").to_numpy(zero_copy_only=False)
            for w in words(batch.column("text")):
                if not len(w.hashes):
                    continue
                owner = np.repeat(y[w.first:w.last], w.counts)
                first = contexts(w)
                before = np.where(first == START, np.uint64(0), np.append(np.uint64(0), first[:-1]))
                key = pair_hash(pair_hash(before, first), w.hashes) ^ owner.astype(np.uint64)
                at = np.unique(key, return_index=True)[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(owner[at].astype(np.int32)), *(pa.array(x[at].view(np.int64))
                                                             for x in (before, first, w.hashes))],
                    names=["label", "before", "first", "second"])

    return (sampled.mapInArrow(seen, "label int, before long, first long, second long")
            .groupBy("label", "first", "second").agg(F.count_distinct("before").alias("n")))


def sample_ids(labels: DataFrame, sample: int) -> DataFrame:
    """At most ``sample`` ids per class, by hash."""
    def take(c: int) -> DataFrame:
        return labels.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return take(0).unionAll(take(1))


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held: int = 0,
             sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for every document, learnt from
    labelled documents outside the held-out fold (crc32 of the id)."""
    spark = docs.sparkSession
    prepare(spark)
    source = narrow(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    known = single_labels(labels.withColumn("_y", F.col(label)), "_y").where(id_bucket(F.col("doc_id"), folds) != held)
    # At most 2 * sample ids: broadcast, so that texts are not shuffled.
    chosen = (source.join(F.broadcast(sample_ids(known, sample)), "doc_id")
              .withColumn("copy", F.xxhash64("text")).dropDuplicates(["label", "copy"])
              .select("label", "text", (F.pmod(F.xxhash64("copy", F.lit(7)), F.lit(CALIBRATION)) == 0).alias("curve"))
              .persist())
    n = {r.label: r["count"] for r in chosen.where("not curve").groupBy("label").count().collect()}
    if len(n) < 2:
        share = float(sum(k * v for k, v in n.items()) / sum(n.values())) if n else 0.5
        scored = source.select("doc_id", F.lit(share).alias("score"))
    else:
        table = bigram_counts(chosen.where("not curve")).toArrow()
        as_hash = lambda c: table.column(c).to_numpy().view(np.uint64)
        models = estimate(as_hash("first"), as_hash("second"), table.column("label").to_numpy(),
                          table.column("n").to_numpy())
        held_back = chosen.where("curve").select("label", "text").toArrow().combine_chunks()
        x = np.concatenate([models.differences(b.column("text")) for b in held_back.to_batches()] or [np.zeros(0)])
        y = held_back.column("label").to_numpy()
        if len(set(y.tolist())) == 2:
            slope, shift = logistic(x, y)
            # From the sample's shares of the classes to those of all labelled documents.
            share = known.agg(F.avg("label")).first()[0]
            shift += float(np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean())))
            models = models._replace(slope=slope, shift=shift)
        shared = spark.sparkContext.broadcast(models)

        def scores(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(shared.value.score(batch.column("text")))],
                    names=["doc_id", "score"])

        scored = source.mapInArrow(scores, f"doc_id {kind}, score double")
    chosen.unpersist()
    return scored.select(
        "doc_id", F.coalesce(id_bucket(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
