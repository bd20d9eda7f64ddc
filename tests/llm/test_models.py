"""Classifiers, packing, line dedup, near-dedup and scores against brute force."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from itemspace.llm import (
    graph, line_dedup, lm_score, near_dup, packing, quality_classifier, queries, toxicity, words,
)
from tests.llm.conftest import SF, split_words


# --- words ---------------------------------------------------------------

def test_words_of_columns(texts):
    odd = [None, "", "a", "A b", "é-É 日本", "x\x00y\x7fz", "1a2"] + list(texts.values())[:40]
    column = pa.array(odd, type=pa.string()).slice(1)
    got = defaultdict(list)
    for w in words.words(column, limit=5000):
        k = 0
        for row, n in zip(range(w.first, w.last), w.counts):
            raw = (odd[row + 1] or "").encode()
            got[row] = [raw[w.starts[i]:w.ends[i]].decode().translate(str.maketrans(
                "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for i in range(k, k + n)]
            k += n
    assert [got[k] for k in range(len(odd) - 1)] == [split_words(t) for t in odd[1:]]


def test_word_hashes_are_of_the_word_alone():
    a = words.hash_words("alpha Beta alpha")
    assert a[0] == a[2] != a[1] and a[1] == words.hash_words("x beta")[1]


# --- classifiers -----------------------------------------------------------

def test_discriminant_matches_density():
    rng = np.random.default_rng(0)
    x = [rng.normal(c, 1 + c, (200, 3)) for c in (0, 1)]
    n = np.array([200.0, 200.0])
    total = np.stack([v.sum(axis=0) for v in x])
    cross = np.stack([v.T @ v for v in x])
    model = quality_classifier.fit(n, total, cross, 0.0, 0.0)
    at = rng.normal(0, 1, (5, 3))

    def log_density(v, z):
        cov = np.cov(v.T, bias=True)
        d = z - v.mean(axis=0)
        return -0.5 * d @ np.linalg.inv(cov) @ d - 0.5 * np.log(np.linalg.det(cov))
    want = [1 / (1 + math.exp(-(log_density(x[1], z) - log_density(x[0], z)) / 3)) for z in at]
    assert np.allclose(model.score(at), want)


@pytest.mark.parametrize("name,label,folds,held", [("op4_quality_classifier", "quality", 3, 1),
                                                   ("op6_toxicity", "toxic", 5, 0)])
def test_classifier_contract(spark, name, label, folds, held):
    sf = SF.replace("0.001", "0.01")
    got = queries.QUERIES[name](spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    known = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held_rows = [r for r in got if r.held_out and r.doc_id in known]
    right = np.mean([r.predicted == known[r.doc_id] for r in held_rows])
    assert right > 0.93


@pytest.mark.parametrize("module,label", [(quality_classifier, "quality"), (toxicity, "toxic")])
def test_classifier_cases(spark, odd_docs, no_docs, odd_labels, module, label):
    got = module.classify(odd_docs, odd_labels, label).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert module.classify(no_docs, odd_labels, label).count() == 0
    assert {r.score for r in module.classify(odd_docs, odd_labels.limit(0), label).collect()} == {0.5}
    one = spark.createDataFrame([(2, 1, 1), (8, 1, 1), (9, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r.score for r in module.classify(odd_docs, one, label).collect()} == {1.0}


def test_kneser_ney_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    first, second = rng.integers(5, 9, 400).astype(np.uint64), rng.integers(5, 9, 400).astype(np.uint64)
    label = np.repeat([0, 1], 200)
    seen, counts = np.unique(np.stack([label.astype(np.uint64), first, second]), axis=1, return_counts=True)
    m = toxicity.estimate(seen[1], seen[2], seen[0].astype(int), counts)
    for c in (0, 1):
        assert np.isclose(m.lower[c].sum(), 1) and np.isclose(m.shared.sum(), 1)
        for k, v in enumerate(m.vocabulary):
            pair = toxicity._find(m.pairs, toxicity.pair_hash(np.full(len(m.vocabulary), v), m.vocabulary))
            own = m.higher[c, pair] + m.backoff[c, k] * m.lower[c, :-1]
            assert np.isclose(own.sum() + m.backoff[c, k] * m.lower[c, -1], 1)


# --- packing -------------------------------------------------------------

def test_packing_against_the_tokenizer(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in queries.QUERIES["op5_best_fit_packing"](spark, SF).collect():
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    total = 0
    for d, rows in pieces.items():
        ids = np.array(whole.encode(texts[d], add_special_tokens=False).ids + [0], dtype="<u4")
        at = 0
        for r in sorted(rows, key=lambda r: r.piece):
            assert r.start == at and zlib.crc32(ids[at:at + r.length].tobytes()) == r.ids_crc32
            assert r.piece == 0 or r.length == 2048
            at += r.length
        assert at == len(ids) and len(rows) == -(-at // 2048)
        total += at
    for rows in bins.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(bins) <= -(-total // 2048) * 1.01 + 1


def test_tokens_at_odd_spaces():
    import public_tokenizers
    t = packing.Tokens(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                       public_tokenizers.PATTERN)
    for s in ["", " ", "a b", "a  b", "a   b", "x \n y", " lead", "trail ", "trail  ", "\n \n", "a\n b", "a \nb",
              "a<|endoftext|>b", "don't 's 12 3", "a  b", "a   b", "tab\t x", "日本 語", "\r\n x", "é x"]:
        assert np.frombuffer(t.ids(s), "<u4").tolist() == t.whole.encode(s, add_special_tokens=False).ids, repr(s)


def test_best_fit_bins():
    bins = packing.OpenBins(10, 2)
    assert [bins.put(n) for n in (6, 7, 3, 4, 9, 9, 9)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (3, 0), (4, 0)]
    assert bins.closed == [True, True, False, False, True]     # of three equally full ones, one closed


def test_packing_levels_and_cases(spark, odd_docs, no_docs):
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack_documents(odd_docs, path, with_ids=True)
    seqs = {r.sequence_id: r.ids for r in packing.sequences(got).collect()}
    for r in got.collect():
        assert seqs[r.sequence_id][r.offset:r.offset + r.length] == r.ids
    assert got.where("doc_id = 3").first().ids == [0]
    assert packing.pack_documents(no_docs, path).count() == 0
    pieces = spark.range(3000).selectExpr("id as doc_id", "1 + (id * 7919) % 2048 as length")
    packed = packing.pack(pieces, shard_pieces=1000)     # several levels
    rows = defaultdict(list)
    for r in packed.collect():
        rows[r.sequence_id].append((r.offset, r.length))
    assert sum(map(len, rows.values())) == 3000
    for parts in rows.values():
        ends = [0]
        for offset, length in sorted(parts):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 2048
    least = -(-sum(x[1] for p in rows.values() for x in p) // 2048)
    assert len(rows) <= least * 1.02


# --- line dedup ------------------------------------------------------------

def test_lines_recur_across_documents(spark):
    lines = ["Order 17 was shipped to the north depot", "Order 23 was shipped to the north depot",
             "A line that stands only once in all of them", "short line"]
    docs = spark.createDataFrame([
        (1, f"{lines[0]}\n{lines[2]}\n{lines[3]}"), (2, f"Own words that nobody else has used\n{lines[1]}\n{lines[3]}"),
        (3, f"{lines[1]}\n{lines[1]}"), (4, "Order 17 was shipped to the south depot today by rail and by road"),
        (5, "Order 18 was shipped to the south depot today by sea and by road")], "doc_id long, text string")
    got = {r.doc_id: (r.text, r._dropped) for r in line_dedup.dedup_lines(docs).collect()}
    assert got[1] == (f"{lines[0]}\n{lines[2]}\n{lines[3]}", [])      # the first keeps its line
    assert got[2] == (f"Own words that nobody else has used\n{lines[3]}", [1])
    assert got[3] == ("", [0, 1])
    assert got[4][1] == [] and got[5] == ("", [0])                     # one segment differs


def dropped_by_tree(texts):
    """Brute force over all lines: {id: numbers of the lines that go}."""
    import re
    lines, held = [], defaultdict(lambda: defaultdict(set))
    for d, text in texts.items():
        for k, part in enumerate((text or "").split("\n")):
            t = split_words(part)
            n = len(t)
            if not n:
                continue
            if n < 5:
                keys = [("short", n, tuple(t))]
            else:
                plain = [x for x in t if not re.search("[0-9]", x)]
                if len(plain) >= 3 and 2 * len(plain) >= n:
                    t = ["<*>" if re.search("[0-9]", x) else x for x in t]
                keys = [("long", n, tuple(t))]
                for s in range(4) if n >= 8 else ():
                    rest = tuple(None if p * 4 // n == s else x for p, x in enumerate(t))
                    constant = sum(x not in (None, "<*>") for x in rest)
                    if constant >= 3 and 2 * constant >= n:
                        keys.append(("part", n, s, rest))
            for key in keys:
                held[key[:2] if key[0] == "short" else "long"][key].add(d)
                lines.append((d, k, key))
    total = {c: sum(map(len, g.values())) for c, g in held.items()}

    def recurs(key):
        c = key[:2] if key[0] == "short" else "long"
        n = len(held[c][key])
        others = (total[c] - n) / max(len(held[c]) - 1, 1)
        return n >= 2 and (key[0] != "short" or n >= 3 and n >= 10 * others)
    out = defaultdict(set)
    for d, k, key in lines:
        c = key[:2] if key[0] == "short" else "long"
        if recurs(key) and d != min(held[c][key]):
            out[d].add(k)
    return out


def test_dropped_lines_against_brute_force(spark, texts):
    """The query over its whole table."""
    want = dropped_by_tree(texts)
    got = queries.QUERIES["op2_line_dedup"](spark, SF).collect()
    assert {r.doc_id: set(r.dropped_lines) for r in got if r.n_dropped} == want
    for r in got:
        left = [x for k, x in enumerate(texts[r.doc_id].split("\n")) if k not in want.get(r.doc_id, ())]
        assert r.text == "\n".join(left)


def test_numbers_fields_and_short_lines(spark):
    log = "User {} logged in from the host berlin after three failed attempts"
    rows = [(1, "3 17 42 8 99"), (2, "5 60 1 7 2"), (3, "3 17 42 8 99"), (4, log.format("alice")), (5, log.format("bob"))]
    rows += [(10 + k, f"All rights reserved.\nOnce {k}") for k in range(40)]
    docs = spark.createDataFrame([(i, t, "kept", [7], 5) for i, t in rows],
                                 "doc_id long, text string, _h string, _dropped array<int>, row int")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert got[2].text == "5 60 1 7 2" and got[3].text == ""          # numbers recur only exactly
    assert got[4].text == log.format("alice") and got[5].text == ""   # a leading field
    assert got[10]._dropped == [] and all(got[10 + k].text == f"Once {k}" for k in range(1, 40))
    assert all(r._h == "kept" and r.row == 5 for r in got.values())


def test_line_cases(spark, odd_docs, no_docs):
    got = line_dedup.dedup_lines(odd_docs)
    assert got.columns == odd_docs.columns + ["_dropped"] and got.count() == odd_docs.count()
    prose = [(r.doc_id, len(r._dropped)) for r in got.collect() if r.text is not None and r.doc_id in (1, 2)]
    assert sorted(prose) == [(1, 0), (1, 0), (2, 2)]
    assert [len(r._dropped) for r in got.where("doc_id is null and size(_dropped) > 0").collect()] == [2]
    assert line_dedup.dedup_lines(no_docs).count() == 0


# --- near-dedup ------------------------------------------------------------

def shingle_set(text):
    w = split_words(text)
    return {tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()


def true_classes(texts):
    sets = {d: shingle_set(t) for d, t in texts.items()}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    holders = defaultdict(list)
    for d, s in sorted(sets.items()):
        for other, n in Counter(o for g in s for o in holders[g]).items():
            if n * 100 >= 80 * (len(s) + len(sets[other]) - n):
                a, b = find(d), find(other)
                parent[max(a, b)] = min(a, b)
        for g in s:
            holders[g].append(d)
    return {d: find(d) for d in sets}


def test_near_duplicates_against_brute_force(spark, texts):
    got = {r.doc_id: r.class_id for r in queries.QUERIES["op9_minhash_near_dedup"](spark, SF).collect()}
    assert got == true_classes(texts)


def test_group_of_near_copies(spark):
    """A chain and a cloud of variants, in blocks smaller than the bucket."""
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(120)]
    made = {}
    for k in range(60):
        t = list(base)
        for p in rng.choice(120, rng.integers(0, 4), replace=False):
            t[p] = f"x{k}_{p}"
        made[k] = " ".join(t)
    for k in range(12):
        made[100 + k] = " ".join(base[:60] + [f"y{j}" for j in range(k * 4, k * 4 + 60)])
    old, near_dup.BLOCK = near_dup.BLOCK, 8
    try:
        docs = spark.createDataFrame(list(made.items()), "doc_id long, text string")
        got = {r._id: r.class_id for r in near_dup.near_duplicates(docs).collect()}
    finally:
        near_dup.BLOCK = old
    assert got == true_classes(made)


def test_near_copies_of_unequal_counts(spark):
    """Texts that repeat a passage often: every pair of a bucket is decided by its sets."""
    rng = np.random.default_rng(6)
    made = {}
    for g in range(12):
        base = [f"g{g}w{k}" for k in range(160)]
        for k in range(6):
            t = list(base)
            for p in rng.choice(160, rng.integers(0, 5), replace=False):
                t[p] = f"x{g}_{k}_{p}"
            made[10 * g + k] = " ".join(t[:80] * (50 if k % 2 else 1) + t[80:])
    docs = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    bands = {r._id: set(r.bands) for r in near_dup.sketched(docs.selectExpr(
        "doc_id as _id", "xxhash64(text) as _text_hash", "text")).collect()}
    sets, label = {d: shingle_set(t) for d, t in made.items()}, {d: d for d in made}
    linked = []
    for a, b in ((a, b) for a in made for b in made if a < b and len(sets[a] & sets[b]) * 100 >= 80 * len(sets[a] | sets[b])):
        linked.append(bool(bands[a] & bands[b]))
        if linked[-1]:
            low, high = sorted((label[a], label[b]))
            label = {d: low if c == high else c for d, c in label.items()}
    assert np.mean(linked) >= 0.95                   # what the bands miss
    assert {r._id: r.class_id for r in near_dup.near_duplicates(docs).collect()} == label


def test_blocks_find_what_the_leader_misses(spark):
    """Pairs of texts alike in one bucket, which is split into small blocks."""
    import pyspark.sql.functions as F
    rng = np.random.default_rng(5)
    sketch = rng.integers(0, 2 ** 32, (40, near_dup.SLOTS), dtype=np.uint32)
    sketch[:, 8:12] = 7                              # band 2 is common to all, and the first
    sketch[1::2] = sketch[::2]
    sketch[1::2, :8] += 1
    shingles = [[100 * (k // 2) + j for j in range(20)] + [10_000 + k] for k in range(40)]
    nodes = spark.createDataFrame([(bytes([k]), bytearray(s.tobytes())) for k, s in enumerate(sketch)],
                                  "node binary, sketch binary")
    sets = spark.createDataFrame([(bytes([k]), x) for k, x in enumerate(shingles)], "node binary, shingles array<long>")
    members = nodes.select(F.lit(1).cast("long").alias("key"), F.lit(2).alias("band"), "node",
                           F.col("node").alias("label"))
    found = near_dup.links_apart(members, nodes, sets, 60, 80, block=7)
    assert sorted(tuple(sorted((r.a[0], r.b[0]))) for r in found.collect()) == [(k, k + 1) for k in range(0, 40, 2)]


def test_sketches_estimate_probability_jaccard():
    rng = np.random.default_rng(4)
    value = rng.integers(1, 2 ** 63, 300).astype(np.uint64)
    wa, wb = np.ones(300), np.ones(300)
    wa[:60], wb[240:] = 0, 0
    agree = []
    for salt in range(30):
        v = words.mix(value + np.uint64(salt))
        out = [near_dup.sketches(np.zeros((w > 0).sum(), np.int64), v[w > 0], w[w > 0], 1) for w in (wa, wb)]
        agree.append((out[0] == out[1]).mean())
    assert abs(np.mean(agree) - 180 / 300) < 0.03


def test_near_dup_cases(spark, odd_docs, no_docs):
    got = near_dup.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    prose = {(r._id, r.class_id, r.first) for r in got if r._id in (1, 2)}
    assert {c for _, c, _ in prose} == {1}
    kept = near_dup.dedup(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    # One row of the prose stays; texts without words all stay.
    assert ids[1] + ids[2] + sum(1 for r in kept.collect() if r.doc_id is None and r.text) == 1
    assert ids[3] == ids[4] == ids[5] == ids[6] == 1 and ids[9] == 2
    assert near_dup.near_duplicates(no_docs).count() == 0 and near_dup.dedup(no_docs).count() == 0


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (10, 11), (20, 21), (22, 21), (23, 22)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(links, "a int, b int")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 10: 10, 11: 10, 20: 20, 21: 20, 22: 20, 23: 20}
    assert graph.components(spark.createDataFrame([], "a int, b int")).count() == 0


# --- scores ----------------------------------------------------------------

@pytest.mark.parametrize("bits", [16, 3])
def test_scores_against_brute_force(spark, monkeypatch, bits):
    """With few frequent words most take the way of rare ones."""
    monkeypatch.setattr(lm_score, "HOT", (1 << bits) - 1)
    made = {k: t for k, t in enumerate(["the cat sat on the mat", "the cat ran", None, "", "the dog sat on the log",
                                        "cat cat cat", "the cat sat on the mat", "solitary"])}
    docs = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    w = {d: split_words(t) for d, t in made.items()}
    one = Counter(x for v in w.values() for x in v)
    two = Counter(p for v in w.values() for p in zip(v, v[1:]))
    n = sum(one.values())
    for r in lm_score.score(docs.coalesce(1)).collect():
        want, backs = 0.0, 0
        for k, x in enumerate(w[r.doc_id]):
            pair = (w[r.doc_id][k - 1], x)
            if k and two[pair] >= 2:
                want += math.log(two[pair] / one[pair[0]])
            else:
                want += math.log(one[x] / n) + (math.log(0.4) if k else 0)
                backs += k > 0
        assert math.isclose(r.log_score, want, abs_tol=1e-9) and r.n_backoff == backs and r.n_words == len(w[r.doc_id])


def test_score_cases(spark, odd_docs, no_docs):
    got = lm_score.score(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert all(r.word_score is None and r.log_score == 0 for r in got if r.n_words == 0)
    assert lm_score.score(no_docs).count() == 0
