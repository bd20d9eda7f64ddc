"""Decontamination against a dictionary of phrases."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from itemspace.llm import decontam as D
from itemspace.llm import queries
from itemspace.llm.words import hash_words
from tests.llm.conftest import SF, split_words


def brute(words, items, window=10):
    phrases = {}
    for name, w in items:
        size = min(window, len(w))
        for k in range(len(w) - size + 1):
            if size:
                phrases.setdefault(tuple(w[k:k + size]), set()).add(name)
    hit, found = set(), set()
    for size in {len(p) for p in phrases}:
        for k in range(len(words) - size + 1):
            names = phrases.get(tuple(words[k:k + size]))
            if names is not None:
                hit.update(range(k, k + size))
                found |= names
    return hit, found


def test_query_against_brute_force(spark, texts):
    items = [(str(r.item_id), split_words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r.doc_id: r for r in queries.QUERIES["op1_decontaminate"](spark, SF).collect()}
    assert set(got) == set(texts)
    for d, text in texts.items():
        words = split_words(text)
        hit, found = brute(words, items)
        r = got[d]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(words), len(hit), len(found), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


@pytest.mark.parametrize("seed", range(6))
def test_short_phrases_over_small_alphabet(seed):
    """Many overlapping hits, short items and small shards."""
    rnd = random.Random(seed)
    docs = [" ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 60))) for _ in range(30)] + [None, ""]
    items = [(str(k), " ".join(rnd.choice("abcd") for _ in range(rnd.choice([0, 1, 3, 5, 12, 20])))) for k in range(9)]
    phrases = D.Phrases([(n, hash_words(t)) for n, t in items], 4)
    old, D.SHARD_SYMBOLS = D.SHARD_SYMBOLS, 64
    try:
        counts, spans, found = D.find(pa.array(docs, type=pa.string()), phrases)
    finally:
        D.SHARD_SYMBOLS = old
    for k, text in enumerate(docs):
        words = split_words(text)
        hit, names = brute(words, [(n, split_words(t)) for n, t in items], 4)
        assert counts[k] == len(words)
        assert {w for a, b in spans[k].T for w in range(a, b)} == hit
        assert set(found[k]) == names


def test_index_counts_and_locates():
    rnd = np.random.default_rng(1)
    text = np.append(rnd.integers(0, 4, 500), 0)
    index = D.FmIndex(text)
    for phrase in ([1], [2, 1], [3, 3, 1], [1, 2, 3, 1]):
        want = [i for i in range(len(text) - len(phrase)) if text[i:i + len(phrase)].tolist() == phrase]
        number, low, high = index.count(np.array([phrase]))
        got = sorted(index.locate(np.arange(low[0], high[0])).tolist()) if len(number) else []
        assert got == want


def test_removal_leaves_no_phrase(spark):
    item = " ".join(f"w{i}" for i in range(12))
    left, right = " ".join(f"w{i}" for i in range(6)), " ".join(f"w{i}" for i in range(6, 12))
    docs = spark.createDataFrame([(1, f"Keep this. {item}! And that."), (2, f"{left} {item} {right}"), (3, "clean text")],
                                 "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r.doc_id: r for r in D.decontaminate(docs, bench, remove=True).collect()}
    assert got[1].text == "Keep this. \n! And that." and got[3].text == "clean text"
    # Cutting the item out joins its two halves, which go as well.
    assert split_words(got[2].text) == []
    assert [tuple(s) for s in got[1]._spans] == [(2, 14)] and got[3]._spans == []


def test_blocks_and_cases(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "the quick brown fox"), (2, None), (None, "lazy dog"), (1, "the quick brown fox"),
                                   (3, "")], "item_id long, text string")
    one = D.report(D.decontaminate(odd_docs, bench)).collect()
    many = D.report(D.decontaminate(odd_docs, bench, block_bytes=1)).collect()
    assert sorted(map(str, one)) == sorted(map(str, many)) and len(one) == odd_docs.count()
    first = [r for r in one if r.doc_id == 2][0]
    assert (first.n_hit, first.n_items) == (6, 1)
    assert all(r.n_words == 0 and not r.contaminated for r in one if r.doc_id == 3)
    assert D.report(D.decontaminate(no_docs, bench)).count() == 0
    assert not any(r.contaminated for r in D.report(D.decontaminate(odd_docs, bench.limit(0))).collect())
    assert D.decontaminate(odd_docs, bench).columns[:len(odd_docs.columns)] == odd_docs.columns


def test_removal_does_not_depend_on_blocks(spark):
    """A cut by one block joins a phrase of an earlier one; rows cut early share a batch with rows hit late."""
    first, second = (" ".join(f"{c}{i}" for i in range(12)) for c in "ab")
    joined = f"{' '.join(first.split()[:6])} {second} {' '.join(first.split()[6:])}"
    docs = spark.createDataFrame([(1, first), (2, second), (3, joined), (4, f"Kept. {first} kept"), (5, "clean"),
                                  (6, None)], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(1, first), (2, second)], "item_id long, text string").coalesce(1)
    one = D.decontaminate(docs, bench, remove=True).orderBy("doc_id").collect()
    many = D.decontaminate(docs, bench, remove=True, block_bytes=1).orderBy("doc_id").collect()
    assert one == many
    assert split_words(many[2].text) == [] and all(r._spans for r in many[:4])
