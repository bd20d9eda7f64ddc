"""Stupid-backoff language-model scores of every document, with bigram and
unigram counts over the whole corpus.

    s(w | v) = c(v w) / c(v)          if c(v w) >= 2
             = 0.4 c(w) / N           otherwise
    s(w)     = c(w) / N               for a text's first word

The exploded bigrams are dealt by the hash of their second word: a row holds the
occurrences of one word in one Arrow batch (the word before and the document), so
a word's rows meet in one place, where its bigrams and itself are counted and the
occurrences scored.  Frequent words, counted first (at most 2^16 - 1, so their table
is broadcast), are named by rank, and the rows of each are split over as many keys as
it has shares of N / 2^16.  What an occurrence is still owed, the count of a rare
word before it, is joined on relationally.  All parts are summed per document.

``docs`` has to be a deterministic scan (a table): documents are numbered twice.

Cases: null and empty texts have no words, a score of 0 and no score per word;
null ids, repeated ids and repeated rows are documents each and count each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemspace.llm.runtime import narrow, prepare, stored
from itemspace.llm.words import mix, words

ALPHA = 0.4
MIN_COUNT = 2
HOT_BITS = 16
HOT = (1 << HOT_BITS) - 1     # most frequent words kept; the rank HOT means "no word before"
BATCH_BYTES = 16 << 20        # a larger batch names a word less often
CHUNK = 2 << 20               # occurrences scored at once

RARE = np.dtype([("word", "<u8"), ("doc", "<u2")])


class Frequent(NamedTuple):
    """Frequent words by hash, their counts, and the keys that share each."""
    words: np.ndarray
    counts: np.ndarray
    shares: np.ndarray
    keys: np.ndarray        # sorted
    owners: np.ndarray      # rank of each key's word
    total: int

    @staticmethod
    def make(found: np.ndarray, counts: np.ndarray, total: int) -> "Frequent":
        order = np.argsort(found)
        found, counts = found[order], counts[order]
        shares = np.maximum(1, -(-counts * (HOT + 1) // max(total, 1)))
        owner = np.repeat(np.arange(len(found)), shares)
        salt = np.arange(len(owner)) - np.repeat(np.cumsum(shares) - shares, shares)
        keys = salted(found[owner], salt)
        by_key = np.argsort(keys)
        return Frequent(found, counts, shares, keys[by_key], owner[by_key], total)

    def rank(self, hashes: np.ndarray) -> np.ndarray:
        """Rank of each word, -1 if it is not frequent."""
        return _lookup(self.words, hashes)


def _lookup(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def salted(word: np.ndarray, salt: np.ndarray) -> np.ndarray:
    return mix(word + (salt.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def frequent_words(source: DataFrame) -> Frequent:
    """Words with a large share of many batches, and their exact counts over all
    documents."""
    def candidates(batches):
        for batch in batches:
            hashes = np.concatenate([w.hashes for w in words(batch.column("text"))] or [np.zeros(0, np.uint64)])
            found, n = np.unique(hashes, return_counts=True)
            large = n * (HOT + 1) >= len(hashes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(found[large].view(np.int64), 0)), pa.array(np.append(n[large], len(hashes))),
                 pa.array(np.append(np.zeros(int(large.sum()), dtype=bool), True))], names=["word", "n", "all"])

    rough = stored(source.select("text").mapInArrow(candidates, "word long, n long, all boolean")
                   .groupBy("word", "all").agg(F.sum("n").alias("n")), "frequent")
    total = rough.where("all").agg(F.sum("n")).first()[0] or 0
    # A word that has its share overall has it in most batches.
    top = (rough.where(~F.col("all") & (F.col("n") * (2 * HOT) >= total)).orderBy(F.desc("n"), "word").limit(HOT)
           .select("word").toArrow())
    chosen = source.sparkSession.sparkContext.broadcast(np.sort(top.column("word").to_numpy().view(np.uint64)))

    def exact(batches):
        held = np.zeros(len(chosen.value) + 1, dtype=np.int64)
        for batch in batches:
            for w in words(batch.column("text")):
                held += np.bincount(_lookup(chosen.value, w.hashes) + 1, minlength=len(held))
        some = np.flatnonzero(held[1:])
        yield pa.RecordBatch.from_arrays([pa.array(chosen.value[some].view(np.int64)), pa.array(held[1:][some])],
                                         names=["word", "n"])

    counted = (source.select("text").mapInArrow(exact, "word long, n long").groupBy("word")
               .agg(F.sum("n").alias("n")).toArrow())
    return Frequent.make(counted.column("word").to_numpy().view(np.uint64), counted.column("n").to_numpy(), int(total))


def occurrence_rows(batch: pa.RecordBatch, hot: Frequent) -> pa.RecordBatch:
    """A row per word (or share of a frequent one): key, the batch's first
    document number, and its occurrences after frequent and after rare words."""
    base = batch.column("n")[0].as_py() if batch.num_rows else 0
    second, first, begins, doc = [], [], [], []
    for w in words(batch.column("text")):
        second.append(w.hashes)
        first.append(np.append(np.uint64(0), w.hashes[:-1])[:len(w.hashes)])
        starts = np.zeros(len(w.hashes), dtype=bool)
        starts[(np.cumsum(w.counts) - w.counts)[w.counts > 0]] = True
        begins.append(starts)
        doc.append(np.repeat(np.arange(w.first, w.last), w.counts))
    empty = np.zeros(0, dtype=np.uint64)
    second, first = np.concatenate(second or [empty]), np.concatenate(first or [empty])
    doc = np.concatenate(doc or [empty]).astype(np.int64)
    begins = np.concatenate(begins or [np.zeros(0, bool)])
    r1 = np.where(begins, HOT, hot.rank(first))
    r2 = hot.rank(second)
    key = second.copy()
    split = r2 >= 0
    key[split] = salted(second[split], (mix(first[split]) % hot.shares[r2[split]].astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    key, first, r1, doc = key[order], first[order], r1[order], doc[order]
    bounds = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    known = r1 >= 0
    cut = np.append(np.concatenate([[0], np.cumsum(known)])[bounds], known.sum())
    after_hot = ((r1[known].astype(np.uint32) << np.uint32(16)) | doc[known].astype(np.uint32)).astype("<u4")
    after_rare = np.empty(int((~known).sum()), dtype=RARE)
    after_rare["word"], after_rare["doc"] = first[~known], doc[~known]
    ends = np.append(bounds, len(key))
    return pa.RecordBatch.from_arrays(
        [pa.array(key[bounds].view(np.int64)), pa.array(np.full(len(bounds), base, dtype=np.int64)),
         _blobs(cut, after_hot), _blobs(ends - cut, after_rare)], names=["key", "base", "hot", "rare"])


def _blobs(bounds: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [
        None, pa.py_buffer((bounds * data.itemsize).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def _unblob(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All records of a binary column and how many each row has."""
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    size = np.dtype(dtype).itemsize
    raw = memoryview(data)[offsets[0]:offsets[-1]] if data is not None else b""
    return np.frombuffer(raw, dtype=dtype), np.diff(offsets) // size


def score_words(t: pa.Table, hot: Frequent) -> pa.RecordBatch:
    """Rows of whole keys -> parts: kind 0, a document's sums; kind 1, what a
    document owes to the count of a rare word; kind 2, a rare word's count."""
    t = t.combine_chunks()
    row_key = t.column("key").chunk(0).to_numpy().view(np.uint64)
    base = t.column("base").chunk(0).to_numpy()
    a, na = _unblob(t.column("hot").chunk(0), "<u4")
    b, nb = _unblob(t.column("rare").chunk(0), RARE)
    keys, group = np.unique(row_key, return_inverse=True)
    rows = np.arange(len(row_key))
    row = np.concatenate([np.repeat(rows, na), np.repeat(rows, nb)])
    r1 = np.concatenate([(a >> np.uint32(16)).astype(np.int64), np.full(len(b), -1)])
    begins = r1 == HOT
    before = np.concatenate([np.where(begins[:len(a)], 0, hot.words[np.minimum(r1[:len(a)], len(hot.words) - 1)]
                                      if len(hot.words) else 0).astype(np.uint64), b["word"]])
    doc = base[row] + np.concatenate([(a & np.uint32(0xFFFF)).astype(np.int64), b["doc"].astype(np.int64)])
    g = group[row]
    # Bigram counts: equal (group, word before); a text's first words are apart.
    pair = mix(mix(before + np.uint64(7)) + g.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + begins)
    order = np.argsort(pair)
    fresh = np.concatenate([[True], pair[order][1:] != pair[order][:-1]]) if len(pair) else np.zeros(0, bool)
    number = np.empty(len(pair), dtype=np.int64)
    number[order] = np.cumsum(fresh) - 1
    both = np.bincount(number)[number] if len(number) else number
    inside = np.bincount(g, minlength=len(keys))
    owner = _lookup(hot.keys, keys)
    owner = np.where(owner >= 0, hot.owners[np.maximum(owner, 0)] if len(hot.keys) else -1, -1)
    single = np.where(owner >= 0, hot.counts[np.maximum(owner, 0)] if len(hot.counts) else 0, inside)
    seen = (both >= MIN_COUNT) & ~begins
    known = seen & (r1 >= 0)
    value = np.log(single[g] / max(hot.total, 1)) + np.where(begins, 0, np.log(ALPHA))
    value[seen] = np.log(both[seen])
    value[known] -= np.log(hot.counts[r1[known]])
    docs, at = np.unique(doc, return_inverse=True)
    owed = seen & (r1 < 0)
    debt = mix(before[owed] + mix(doc[owed].astype(np.uint64)))
    _, first, times = np.unique(debt, return_index=True, return_counts=True)
    rare = np.flatnonzero((owner < 0) & (inside >= MIN_COUNT))
    kinds = np.repeat([0, 1, 2], [len(docs), len(first), len(rare)]).astype(np.int8)
    n0, none = len(docs), np.zeros
    return pa.RecordBatch.from_arrays([
        pa.array(kinds),
        pa.array(np.concatenate([docs, doc[owed][first], none(len(rare), np.int64)])),
        pa.array(np.concatenate([none(n0, np.uint64), before[owed][first], keys[rare]]).view(np.int64)),
        pa.array(np.concatenate([np.bincount(at, weights=value, minlength=n0), none(len(first) + len(rare))])),
        pa.array(np.concatenate([np.bincount(at, minlength=n0), times, inside[rare]]).astype(np.int64)),
        pa.array(np.concatenate([np.bincount(at, weights=~seen & ~begins, minlength=n0).astype(np.int64),
                                 none(len(first) + len(rare), np.int64)]))],
        names=["kind", "doc", "word", "value", "n", "backoffs"])


def _by_key(batches: Iterator[pa.RecordBatch], hot: Frequent) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; scores whole keys, many at a time."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes // 8
        if size >= CHUNK:
            t = pa.Table.from_batches(held).combine_chunks()
            key = t.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))      # the last key may go on
            if cut:
                yield score_words(t.slice(0, cut), hot)
            held = t.slice(cut).to_batches()
            size = sum(b.nbytes for b in held) // 8
    if held:
        yield score_words(pa.Table.from_batches(held), hot)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_backoff, log_score (sum of natural logs) and
    word_score (per word; null without words)."""
    spark = docs.sparkSession
    prepare(spark, BATCH_BYTES)
    source = narrow(docs, id_col, text_col)
    hot = spark.sparkContext.broadcast(frequent_words(source))
    numbered = source.withColumn("n", F.monotonically_increasing_id())
    rows = (numbered.select("n", "text")
            .mapInArrow(lambda it: (occurrence_rows(b.slice(k, 1 << 16), hot.value)     # documents have 16 bits
                                    for b in it for k in range(0, b.num_rows, 1 << 16)),
                        "key long, base long, hot binary, rare binary")
            .repartition("key").sortWithinPartitions("key"))
    parts = stored(rows.mapInArrow(
        lambda it: _by_key(it, hot.value), "kind byte, doc long, word long, value double, n long, backoffs long"),
        "lmparts")
    counts = parts.where("kind = 2").select("word", F.col("n").alias("count"))
    owed = (parts.where("kind = 1").select("doc", "word", "n").join(counts, "word")
            .select("doc", (-F.col("n") * F.log("count")).alias("value"), F.lit(0).cast("long").alias("n"),
                    F.lit(0).cast("long").alias("backoffs")))
    sums = (parts.where("kind = 0").select("doc", "value", "n", "backoffs").unionAll(owed)
            .groupBy("doc").agg(F.sum("value").alias("s"), F.sum("n").alias("words"), F.sum("backoffs").alias("backs")))
    return (numbered.select("doc_id", "n").join(sums, F.col("n") == F.col("doc"), "left")
            .select("doc_id", F.coalesce("words", F.lit(0)).alias("n_words"),
                    F.coalesce("backs", F.lit(0)).alias("n_backoff"),
                    F.coalesce("s", F.lit(0.0)).alias("log_score"),
                    F.when(F.col("words") > 0, F.col("s") / F.col("words")).alias("word_score")))
