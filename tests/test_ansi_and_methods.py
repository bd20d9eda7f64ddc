"""Edge values in the default (ANSI) session, exact ties, grid dispatch, and
methods without an SQL form."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from itemspace.functions.text import parse_mode
from itemspace.operators import clean, cluster, compare, encode, metrics, reduce, report, vectors
from itemspace.plans.grid import param_grid, run_grid
from itemspace.sources import readers
from itemspace.streaming.score_stream import score_batch, score_epoch


def table(spark, rows, schema="subject long, v array<double>"):
    return spark.createDataFrame(rows, schema)


def test_session_is_ansi(spark):
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


# --- one row, one label, constants -------------------------------------------

def test_silhouette_of_singletons(spark):
    vec = table(spark, [(0, [0.0]), (1, [0.1]), (2, [5.0])])
    lab = spark.createDataFrame([(0, 2, 0), (1, 2, 0), (2, 2, 1)], "subject long, k int, prediction int")
    got = metrics.silhouette(vec, lab).first().silhouette_score
    want = ((5.0 - 0.1) / 5.0 + (4.9 - 0.1) / 4.9 + 0) / 3
    assert math.isclose(got, want, rel_tol=1e-9)
    sq = metrics.silhouette_sq(lab.join(vec, "subject"), ["k"]).first().silhouette_sq
    assert 0 < sq < 1


def test_one_label_has_no_calinski_harabasz(spark):
    df = table(spark, [(0, [0.0], 0), (1, [1.0], 0)], "subject long, v array<double>, prediction int")
    assert metrics.calinski_harabasz(metrics.cluster_stats(df)).first().calinski_harabasz_score is None


def test_constant_and_zero_metrics(spark):
    flat = spark.createDataFrame([("m", "a", "b", 2.0), ("m", "b", "a", 2.0)],
                                 "metric string, run_row string, run_col string, value double")
    assert [r.value for r in report.minmax_matrix(flat).collect()] == [0.0, 0.0]
    runs = spark.createDataFrame([("a", 2, 0.0, 0.0, -1.0), ("b", 2, 0.0, 0.0, -1.0)],
                                 "run_id string, k int, davies_bouldin_score double, calinski_harabasz_score double, "
                                 "silhouette_score double")
    pairs = spark.createDataFrame([("a", "b")], "run_a string, run_b string")
    assert all(0 <= r.value <= 1 for r in report.relative_metric_share(runs, pairs, 2).collect())


# --- readers and text ------------------------------------------------------

def test_short_rows_of_codebooks(spark):
    docs = spark.createDataFrame([(1, "word\ncode rest of it\n")], "doc_id long, text string")
    assert [(r.code, r.sentence) for r in readers.codebook_lines(docs).collect()] == [
        ("word", ""), ("code", "rest of it"), ("", "")]
    html = "<tr><th>x</th></tr><tr><td>1</td></tr><tr><td>2</td><td>b</td><td>plain</td></tr>"
    page = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert [(r.code, r.sentence) for r in readers.codebook_html(page).collect()] == [("1", None), ("2", None)]
    assert readers.codebook_html(page, quoted=False).collect()[1].sentence == "plain"
    pipe = spark.createDataFrame([(1, "-----\n|a|b|\n-----")], "doc_id long, text string")
    r = readers.parse_pipe_table(pipe).first()
    assert (r.code, r.sentence, r["values"]) == ("a", "b", "")


def test_stitching(spark):
    docs = spark.createDataFrame([(1, "intro\nmore\n1. first\n tail\n\n2. second"), (2, "1. a"), (3, "")],
                                 "doc_id long, text string")
    got = [(r.doc_id, r.rec_no, r.sentence) for r in readers.stitch_numbered_lines(docs).orderBy("doc_id", "rec_no").collect()]
    assert got == [(1, 0, "intromore"), (1, 1, "first tail"), (1, 2, "second"), (2, 0, "a")]


def test_names_without_numbers(spark):
    wide = spark.createDataFrame([(1, 3, 4)], "subject long, q1 int, mood int")
    assert {r.item_id for r in clean.wide_to_long(wide, ["q1", "mood"]).collect()} == {1, None}
    modes = spark.createDataFrame([("llm_random_x",), ("llm_random_12_no_norm",)], "m string")
    assert [r.d for r in modes.select(parse_mode("m")[2].alias("d")).collect()] == [None, 12]


def test_texts_without_words_keep_their_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "  "), (3, None)], "i long, t string")
    got = {r.i: r.v for r in encode.encode_hashing(docs, "i", "t", 4).collect()}
    assert set(got) == {1, 2, 3} and got[2] == got[3] == [0.0] * 4

    def length(s):
        return np.array([[len(x)] for x in s], dtype=float)
    assert {r.i: r.v for r in encode.encode_sentences(docs, "i", "t", length, 1).collect()} == {1: [3.0], 2: [2.0], 3: [0.0]}


# --- vectors, matching, neighbours --------------------------------------------

@pytest.mark.parametrize("dims", [1, 64, 300])
def test_pooling_at_any_width(spark, dims):
    rng = np.random.default_rng(dims)
    e = rng.normal(size=(3, dims))
    answers = [(0, 0, 2), (0, 1, 3), (0, 2, 1), (1, 0, 5)]
    items = spark.createDataFrame([(i, e[i].tolist()) for i in range(3)], "item_id int, e array<double>")
    resp = spark.createDataFrame(answers, "subject long, item_id int, answer int")
    for how, fn in (("max", np.max), ("sum", np.sum), ("mean", np.mean)):
        got = {r.subject: r.v for r in vectors.embed_subjects(resp, items, how).collect()}
        for s in (0, 1):
            want = fn(np.stack([a * e[i] for q, i, a in answers if q == s]), axis=0)
            assert np.allclose(got[s], want)
    assert vectors.embed_subjects(resp, items, n_items=3).count() == 1


@pytest.mark.parametrize("m", [1, 2, 3, 4, 5, 6, 7])
def test_label_matching_is_the_first_best_permutation(m):
    rng = np.random.default_rng(m)
    for _ in range(25):
        C = rng.integers(0, 4, (m, m)).astype(float)        # many ties
        perm, total = compare._lex_best_assignment(C)
        best = max(itertools.permutations(range(m)), key=lambda p: (sum(C[i, j] for i, j in enumerate(p)), [-j for j in p]))
        assert tuple(perm) == best and total == sum(C[i, j] for i, j in enumerate(best))


def test_neighbour_ties_do_not_depend_on_order(spark):
    rows = [(k, [1.0, 1.0]) for k in range(60)]
    for order in (rows, rows[::-1], sorted(rows, key=lambda r: r[0] * 37 % 60)):
        got = reduce.knn_graph(table(spark, order).repartition(3), 3, block_rows=16).where("src in (0, 30)").collect()
        near = {s: [r.dst for r in sorted(got, key=lambda r: r["rank"]) if r.src == s] for s in (0, 30)}
        assert near == {0: [1, 2, 3], 30: [0, 1, 2]}


def test_graph_embedding_against_dense_eigenvectors(spark):
    """A nearly bipartite graph: its most negative eigenvalue must not win."""
    rng = np.random.default_rng(0)
    n = 12
    W = np.zeros((n, n))
    for a in range(n):
        for b in range(a + 1, n):
            W[a, b] = W[b, a] = (1.0 if (a + b) % 2 else 0.02) * (2.0 if a // 6 == b // 6 else 0.3) * rng.uniform(.8, 1.2)
    edges = spark.createDataFrame([(a, b, float(W[a, b])) for a in range(n) for b in range(n) if a != b],
                                  "src long, dst long, w double")
    got = {r.node: r.v[0] for r in reduce.graph_embedding(edges, 1, iters=60).collect()}
    d = W.sum(axis=1)
    value, vec = np.linalg.eigh(W / np.sqrt(np.outer(d, d)))
    second = vec[:, np.argsort(value)[-2]]
    x = np.array([got[k] for k in range(n)])
    assert abs(x @ second) / np.linalg.norm(x) > 0.99


# --- clustering ------------------------------------------------------------

def blobs(spark, centres, n=20, spread=0.05):
    rng = np.random.default_rng(1)
    rows, true = [], {}
    for c, m in enumerate(centres):
        for x in rng.normal(m, spread, (n, len(m))):
            true[len(rows)] = c
            rows.append((len(rows), x.tolist()))
    return table(spark, rows), true


def same_partition(pred, true):
    return len({(pred[k], true[k]) for k in true}) == len(set(true.values())) == len(set(pred.values()))


def test_clusterings_find_blobs(spark):
    vec, true = blobs(spark, [[0, 0, 1], [0, 1, 0], [1, 0, 0]])
    for out in (cluster.kmeans_best(vec, [3], 4), cluster.bisecting_kmeans(vec, 3, 2, rounds=5)[0],
                cluster.kmeans_restarts(vec, 3, 2)[0], cluster.spectral_clustering(vec, [3], 4.0, 40, n_init=3),
                cluster.spectral_clustering(vec, [3], landmarks=40, n_init=3, affinity="cosine")):
        assert same_partition({r.subject: r.prediction for r in out.collect()}, true)
    with pytest.raises(ValueError):
        cluster.spectral_clustering(vec, [2], affinity="none")


def test_grid_runs_what_the_cell_says(spark):
    """Two rings: k-means cuts them, spectral clustering with a narrow kernel
    would not; here the methods' predictions must differ, and unknown ones fail."""
    rng = np.random.default_rng(2)
    angle = rng.uniform(0, 2 * np.pi, 60)
    radius = np.repeat([1.0, 6.0], 30)
    vec = table(spark, [(k, [float(r * np.cos(a)), float(r * np.sin(a))]) for k, (a, r) in enumerate(zip(angle, radius))])
    cells = [param_grid(spark, {"dataset": ["d"], "mode": ["m"], "norm": ["l2"], "cluster_method": [c],
                                "dimred_method": [r], "n_components": [n]})
             for c, r, n in (("kmeans", "pca", None), ("spectral", "pca", None), ("nothing", "pca", None),
                             ("kmeans", "pca", 1), ("kmeans", "other", 1))]
    grid = cells[0]
    for c in cells[1:]:
        grid = grid.unionByName(c)
    pred, met, status = run_grid(spark, grid, lambda cell: vec, [2], n_init=2, rounds=20)
    by = {r.run_id: r for r in status.collect()}
    named = {(r.cluster_method, r.dimred_method, r.n_components): by[r.run_id] for r in grid.collect()}
    assert [named[k].status for k in (("kmeans", "pca", None), ("spectral", "pca", None), ("nothing", "pca", None),
                                      ("kmeans", "pca", 1), ("kmeans", "other", 1))] == ["ok", "ok", "failed", "ok", "failed"]
    assert "nothing" in named["nothing", "pca", None].reason and len(named["kmeans", "pca", None].run_id) == 64
    labels = {}
    for r in pred.collect():
        labels.setdefault(r.run_id, {})[r.subject] = r.prediction
    a, b = (labels[named[m, "pca", None].run_id] for m in ("kmeans", "spectral"))
    assert not same_partition(a, b)
    cost = {r.run_id: r.inertia for r in met.collect()}
    assert cost[named["spectral", "pca", None].run_id] is None and cost[named["kmeans", "pca", None].run_id] > 0


# --- streaming ---------------------------------------------------------------

def test_split_subject_and_replayed_batch(spark, tmp_path):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "item_id int, e array<double>")
    schema = "subject long, item_id int, answer int"
    batches = [spark.createDataFrame([(1, 1, 3), (2, 1, 1), (2, 2, 4), (3, 1, 9), (3, 2, 1)], schema),
               spark.createDataFrame([(1, 2, 2), (4, 1, 1)], schema)]
    sink, rest = str(tmp_path / "sink"), str(tmp_path / "rest")
    centres = [[1.0, 0.0], [0.0, 1.0]]
    rule = F.col("answer").between(1, 5)
    for epoch in (0, 1, 1):                                   # the last batch comes twice
        score_epoch(batches[epoch], epoch, sink, rest, items, 2, 0.0, centres, rule)
    got = {r.subject: r.prediction for r in spark.read.parquet(sink).collect()}
    whole = batches[0].union(batches[1]).where("subject in (1, 2)")
    assert got == {r.subject: r.prediction for r in score_batch(whole, items, 2, 0.0, centres).collect()}
    assert spark.read.parquet(sink).count() == 2
    assert [r.subject for r in spark.read.parquet(f"{rest}/epoch=1").collect()] == [4]
