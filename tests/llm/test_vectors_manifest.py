"""Operators 11 to 13 against brute force."""

import binascii
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from itemspace.llm import hard_negatives, merkle, skew, vector_dups
from itemspace.llm import queries as q
from tests.llm.conftest import SF


def as_text(rows):
    return sorted(repr(tuple(r)) for r in rows)


# ------------------------------------------------------------- hard negatives
def mined(rows, positives=5, negatives=3, low=50, high=95):
    """rows (id, label, integer vector)."""
    out = []
    for a, la, va in rows:
        if a % 50:
            continue
        near = [(r, l, sum(x * y for x, y in zip(va, v))) for r, l, v in rows if r != a and len(v) == len(va)]
        for p, _, ps in sorted((x for x in near if x[1] == la), key=lambda x: (-x[2], x[0]))[:positives]:
            fit = [x for x in near if x[1] != la and low * ps <= 100 * x[2] <= high * ps]
            for k, (n, _, ns) in enumerate(sorted(fit, key=lambda x: (-x[2], x[0]))[:negatives]):
                out.append((a, p, k + 1, n, ps, ns))
    return out


VECTORS = "vec_id long, embedding array<double>, label int, v int, dims string, shard int, score double, anchor_id int"


def vector_frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "d", 2, 0.5, 3) for r in rows], VECTORS)


@pytest.fixture(scope="module")
def odd_vectors():
    rng = np.random.default_rng(0)
    centre = rng.standard_normal((20, 7)) * 3
    rows = [(int(i), [float(x) for x in np.round(centre[i % 20] + rng.standard_normal(7) * 0.3, 1)], int(rng.integers(0, 3)))
            for i in range(-100, 500)]
    rows += [(5000 + i, [float(rng.integers(-2, 3))], i % 4) for i in range(200)]     # ties, one component
    rows += [(None, [1.0] * 7, 1), (9000, None, 1), (9050, [float("nan")] * 7, 1), (9100, [float("inf")] * 7, 1),
             (9150, [60000.0] * 7, 2), (9200, [65000.5] * 7, 2), (9201, [50000.0] * 7, 1), (9250, [], 1), (9300, [1.0] * 7, None),
             (9350, [1.0, None], 1), (9400, [1e9] * 7, 1), (100, centre[0].tolist(), 9), (100, centre[0].tolist(), 9)]
    return rows


@pytest.mark.parametrize("shard, block", [(8192, 16384), (60, 3)])
def test_mined_as_by_full_scan(spark, odd_vectors, monkeypatch, shard, block):
    monkeypatch.setattr(hard_negatives, "SHARD_ROWS", shard)
    monkeypatch.setattr(hard_negatives, "ANCHOR_ROWS", block)
    rows = hard_negatives.integer_rows(vector_frame(spark, odd_vectors))
    kept = [(r.vec_id, r.label, list(r.v)) for r in rows.collect()]
    assert len({r[0] for r in kept}) == len(kept)
    assert not {9000, 9050, 9100, 9250, 9300, 9350, 9400} & {r[0] for r in kept}
    got = hard_negatives.mine(rows, F.col("vec_id") % 50 == 0)
    assert as_text(got.collect()) == as_text(mined(kept))


def test_mined_of_nothing(spark):
    rows = hard_negatives.integer_rows(vector_frame(spark, []))
    assert hard_negatives.mine(rows, F.col("vec_id") % 50 == 0).collect() == []


def test_cells_walk_by_falling_bounds_and_stop_early():
    rng = np.random.default_rng(1)
    centre = rng.standard_normal((40, 16)) * 200
    x = np.round(centre[rng.integers(0, 40, 4000)] + rng.standard_normal((4000, 16)))
    book = hard_negatives.codebook(x[:, :8]), hard_negatives.codebook(x[:, 8:])
    index = hard_negatives.MultiIndex(np.arange(4000), np.zeros(4000, np.int64), x, book)
    cells = list(index.walk(x[0]))
    assert sum(c[3] - c[2] for c in cells) == 4000
    assert all(a[0] >= b[0] - 1e-3 for a, b in zip(cells, cells[1:]))
    scores = index.vectors @ x[0]
    for top, low, first, last in cells:
        assert low <= scores[first:last].min() and scores[first:last].max() <= top
    seen = []
    ids, found = index.best(x[0], 5, lambda at: (seen.append(len(at)), np.ones(len(at), bool))[1])
    assert sum(seen) < 4000
    want = sorted(zip(-scores, index.ids))[:5]
    assert [(-int(s), int(i)) for i, s in zip(ids, found)] == [(int(s), int(i)) for s, i in want]


# ------------------------------------------------------------- near-duplicates
def clustered(rows, threshold=0.98):
    able = [r[2] is not None and r[1] is not None and len(r[1]) > 0
            and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    parent, degree = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if able[i] and able[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                    degree[i] += 1
                    degree[j] += 1
                    parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return [(r[0], degree[i], least.get(find(i)), r[0] == least.get(find(i))) for i, r in enumerate(rows)]


@pytest.fixture(scope="module")
def copies():
    rng = np.random.default_rng(3)
    base = rng.standard_normal((30, 24))
    rows = []

    def add(v, label):
        rows.append((len(rows) * 3 + 1, v if v is None else [x if x is None else float(x) for x in v], label))
    for k in range(150):
        add(base[k % 30] + rng.standard_normal(24) * rng.choice([0.02, 0.1, 0.2]), k % 3)
    for _ in range(120):
        add(base[0] + rng.standard_normal(24) * 0.1, 0)          # one large group of near copies
    for _ in range(80):
        add(base[1], 1)                                         # and one of exact ones
    for k in range(5):
        add(base[2] * (k + 1), 2)                               # scaled: cosine 1
    for v in (None, [0.0] * 24, [float("nan")] + [1.0] * 23, [float("inf")] * 24, [None, 1.0], [1.0] * 3, [1.0] * 3, []):
        add(v, 1)
    add(base[1], None)
    rows += [(None, [1.0] * 3, 1), (1, [1.0] * 3, 1), (7, None, None), (None, None, 1), (7, None, None)]
    return rows


@pytest.mark.parametrize("block", [512, 16])
def test_links_and_components_of_all_pairs(spark, copies, block):
    # as eight table names clash with those that the operator uses
    df = spark.createDataFrame([(*r, 1, 2, "x", 3, 4.0) for r in copies],
                               "vec_id long, embedding array<double>, label int, node int, n int, e string, h0 int, first double")
    got = vector_dups.near_duplicates(df, block=block)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert as_text(got.collect()) == as_text(clustered(copies))


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vector_dups.near_duplicates(df).collect() == []


def test_recall_at_the_threshold():
    bits, tables = vector_dups.hash_plan(5000)
    rng = np.random.default_rng(8)
    a = rng.standard_normal((3000, 64))
    b = rng.standard_normal((3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = 0.98 * a + np.sqrt(1 - 0.98 ** 2) * b
    codes = [vector_dups.sign_codes(x, bits, tables) for x in (a, b)]
    assert (codes[0] == codes[1]).any(axis=1).mean() >= 0.998


def test_counted_join_deals_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST_HOT", 10)
    rows = spark.range(1000).select((F.col("id") % 3 * (F.col("id") % 2)).alias("k"), "id")
    known = rows.groupBy("k").agg(F.count("*").alias("n"))
    got = skew.join_counted(rows, known, ["k"], "n")
    assert as_text(got.select("id", "n").collect()) == as_text(rows.join(known, "k").select("id", "n").collect())


# ------------------------------------------------------------------- manifest
def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def proven(rows):
    """rows (doc_id, source, lang, n_chars, text)."""
    def leaf(r, n):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[1], r[2], n, r[4])))

    def tree(nodes):
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for p, i in zip(paths, at):
                p.append((i % 2, nodes[i ^ 1]) if i ^ 1 < len(nodes) else None)
            nodes, at = [sha("".join(nodes[k:k + 2])) for k in range(0, len(nodes), 2)], [i // 2 for i in at]
        return nodes[0], paths

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    for k in order:
        groups[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[3])))
    trees = {k: tree([leaf(r, r[3]) for r in groups[k]]) for k in order}
    root, crown = tree([trees[k][0] for k in order])
    out = []
    for k, beyond in zip(order, crown):
        for r, path in zip(groups[k], trees[k][1]):
            path = path + beyond
            bad = r[0] is not None and r[3] is not None and binascii.crc32(str(r[0]).encode()) % 7 == 0
            h = leaf(r, r[3] + bad if r[3] is not None else None)
            for s in path:
                h = sha(h) if s is None else sha(s[1] + h if s[0] else h + s[1])
            out.append((r[0], leaf(r, r[3]), trees[k][0], root, sha("".join(s[1] for s in path if s)), h, h == root))
    return out


@pytest.mark.parametrize("kept", [1, 2, 6])
def test_manifest_of_odd_rows(spark, kept):
    long_text = "wörter " * 50000
    rows = [(i, "s", "en", i * 3, f"text {i}") for i in range(70)]
    rows += [(i, None, "de", None, None) for i in range(-5, 4)] + [(i, "", "fr", 0, "") for i in range(17)]
    rows += [(1, "s", None, 1, "a"), (None, None, None, None, None), (None, "x", "en", 4, "b"), (None, "x", "en", 4, "b"),
             (3, "s", "en", 9, "text 3"), (3, "s", "en", 9, "text 3"), (8, "y", "日本", 5, long_text), (9, "y", "", 5, "z")]
    df = spark.createDataFrame([(*r, "k", 1, 2, "n", "i", "p") for r in rows],
                               "doc_id long, source string, lang string, n_chars long, text string, key string, pos int, "
                               "n int, node string, item string, part string").repartition(5)
    got = merkle.audit(df, kept=kept)
    assert as_text(got.collect()) == as_text(proven(rows))


def test_manifest_of_one_and_of_none(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    one = [(5, "s", "en", 3, "abc")]
    assert as_text(merkle.audit(spark.createDataFrame(one, schema)).collect()) == as_text(proven(one))
    assert merkle.audit(spark.createDataFrame([], schema)).collect() == []


def test_tampering_shows(spark):
    got = q.op13_merkle_manifest(spark, SF).collect()
    assert len({r.root for r in got}) == 1
    for r in got:
        bad = binascii.crc32(str(r.doc_id).encode()) % 7 == 0
        assert r.verified == (not bad) and (r.folded_root == r.root) == (not bad)
