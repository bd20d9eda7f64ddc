import itertools

import numpy as np
from pyspark.sql import functions as F

from itemspace.operators import compare as CP


def _ari(a, b):
    from math import comb
    n = len(a)
    ct = {}
    for x, y in zip(a, b):
        ct[(x, y)] = ct.get((x, y), 0) + 1
    sc = sum(comb(v, 2) for v in ct.values())
    ra = {}
    cb = {}
    for (x, y), v in ct.items():
        ra[x] = ra.get(x, 0) + v
        cb[y] = cb.get(y, 0) + v
    sa = sum(comb(v, 2) for v in ra.values())
    sb = sum(comb(v, 2) for v in cb.values())
    e = sa * sb / comb(n, 2)
    mx = (sa + sb) / 2
    return 1.0 if mx == e else (sc - e) / (mx - e)


def _preds(spark, runs):
    rows = [(r, 2, s, int(l)) for r, labs in runs.items() for s, l in enumerate(labs)]
    return spark.createDataFrame(rows, "run_id string, k int, subject long, prediction int")


def test_pair_contingency_and_ari(spark):
    rng = np.random.default_rng(3)
    runs = {"a": rng.integers(0, 3, 50), "b": rng.integers(0, 3, 50), "c": rng.integers(0, 2, 50)}
    cont = CP.pair_contingency(_preds(spark, runs))
    got = {(r.run_a, r.run_b): r.randindex for r in CP.adjusted_rand(cont).collect()}
    for x, y in itertools.combinations(sorted(runs), 2):
        assert abs(got[(x, y)] - _ari(list(runs[x]), list(runs[y]))) < 1e-12


def test_ari_invariances(spark):
    a = [0, 0, 1, 1, 2, 2, 2, 0]
    b = [2, 2, 0, 0, 1, 1, 1, 2]  # relabelling of a
    cont = CP.pair_contingency(_preds(spark, {"a": a, "b": b}))
    r = CP.adjusted_rand(cont).first()
    assert abs(r.randindex - 1.0) < 1e-12
    m = CP.match_labels(cont)
    assert m.first().matched == len(a)


def best_total(C):
    """Best assignment total, by dynamic programming over sets of used columns."""
    best = {0: 0.0}
    for row in C:
        step = {}
        for used, total in best.items():
            for c, x in enumerate(row):
                if not used >> c & 1:
                    step[used | 1 << c] = max(step.get(used | 1 << c, -1.0), total + x)
        best = step
    return best[(1 << len(C)) - 1]


def test_match_labels_lexicographic_tie_break():
    C = np.array([[1.0, 1.0], [1.0, 1.0]])
    perm, total = CP._lex_best_assignment(C)
    assert perm == [0, 1] and total == 2.0
    rng = np.random.default_rng(4)
    for m in (3, 5, 9, 10):
        C = rng.integers(0, 5, (m, m)).astype(float)
        perm, total = CP._lex_best_assignment(C)
        assert sorted(perm) == list(range(m))
        assert abs(total - best_total(C)) < 1e-9
        if m <= 6:
            best = max(sum(C[i, p[i]] for i in range(m)) for p in itertools.permutations(range(m)))
            assert abs(total - best) < 1e-9


def test_pairwise_scores_matched_not_below_raw(spark):
    rng = np.random.default_rng(5)
    runs = {"a": rng.integers(0, 3, 80), "b": rng.integers(0, 3, 80)}
    s = CP.pairwise_scores(_preds(spark, runs)).where(F.col("run_b") == "b").first()
    raw_acc = float(np.mean(runs["a"] == runs["b"]))
    assert s.f1 >= raw_acc - 1e-12
    assert -1.0 <= s.randindex_vs_randint <= 1.0


def test_subject_diff(spark):
    a = spark.createDataFrame([(1,), (2,), (3,)], "subject long")
    b = spark.createDataFrame([(2,), (3,), (4,), (5,)], "subject long")
    r = CP.subject_diff(a, b).first()
    assert (r.n_a, r.n_b, r.n_common, r.n_diff) == (3, 4, 2, 3)


def test_relative_metric_share_and_edges(spark):
    from itemspace.operators import report as RP
    rm = spark.createDataFrame(
        [("a", 3, 1.0, 10.0, 0.2, 0.5, 0.5, 0.5), ("b", 3, 2.0, 30.0, 0.6, 1.0, 0.0, 1.0)],
        "run_id string, k int, davies_bouldin_score double, calinski_harabasz_score double, "
        "silhouette_score double, COR_davies_bouldin_score double, COR_calinski_harabasz_score double, "
        "COR_silhouette_score double")
    pairs = spark.createDataFrame([("a", "b"), ("a", "randomGuess")], "run_a string, run_b string")
    sh = {(r.metric, r.run_row, r.run_col): r.value for r in RP.relative_metric_share(rm, pairs, 3).collect()}
    # best: db 2.0, ch 30.0, sil (0.6 + 1) / 2 = 0.8
    a, b = 1 - 1.0 / 2.0, 1 - 2.0 / 2.0
    assert abs(sh[("davies_bouldin_score", "a", "b")] - a / (a + b)) < 1e-12
    a, b = (0.2 + 1) / 2 / 0.8, (0.6 + 1) / 2 / 0.8
    assert abs(sh[("silhouette_score", "b", "a")] - b / (a + b)) < 1e-12
    assert all(r != "randomGuess" and c != "randomGuess" for _, r, c in sh)
    scores = spark.createDataFrame([("a", "b", 3, 0.2, 0.4), ("a", "c", 3, 0.0, 0.2)],
                                   "run_a string, run_b string, k int, perf_randindex_raw double, perf_f1_raw double")
    summ = spark.createDataFrame([("a", "b", 0.3, 0.1), ("a", "c", 0.1, 0.0)],
                                 "run_a string, run_b string, perf_f1_mean double, perf_randindex_mean double")
    e = {(r.src, r.dst): (r.weight, r.raw_weight) for r in RP.similarity_edges(summ, scores, 3).collect()}
    mi, mea = 0.1, 0.2  # per-K averages at K=3: 0.3 and 0.1
    w = (0.3 + 0.1) / 2
    assert abs(e[("a", "b")][0] - ((w - mi + 0.1) / (mea - mi + 0.1) + 2) ** 2) < 1e-12


def test_common_counts_of_ragged_runs(spark):
    rows = [(r, k, s, 0) for r, n in (("a", 10), ("b", 7), ("c", 3)) for s in range(n) for k in (2, 3)]
    rows += [("d", 2, s, 0) for s in range(100, 105)]
    p = spark.createDataFrame(rows, "run_id string, k int, subject long, prediction int").repartition(3)
    got = {(r.run_a, r.run_b): r.common for r in CP.common_counts(p).collect()}
    assert got == {("a", "b"): 7, ("a", "c"): 3, ("b", "c"): 3}
    assert CP.common_counts(p.limit(0)).collect() == []
