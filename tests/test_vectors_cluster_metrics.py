import numpy as np
from pyspark.sql import functions as F

from itemspace.operators import cluster as K
from itemspace.operators import metrics as M
from itemspace.operators import vectors as V


def _vec(spark, X, labels=None):
    rows = [(i, [float(x) for x in X[i]], int(labels[i]) if labels is not None else 0) for i in range(len(X))]
    return spark.createDataFrame(rows, "subject long, v array<double>, prediction int")


def test_embed_max_and_normalize(spark):
    resp = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (2, 1, 1)], "subject long, item_id int, answer int")
    iv = spark.createDataFrame([(1, [1.0, -1.0]), (2, [0.5, 3.0])], "item_id int, e array<double>")
    e = {r.subject: r.v for r in V.embed_subjects(resp, iv, "max").collect()}
    assert e[1] == [2.0, 3.0] and e[2] == [1.0, -1.0]
    assert {r.subject for r in V.embed_subjects(resp, iv, "max", n_items=2).collect()} == {1}
    n = V.normalize_rows(spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "subject long, v array<double>"))
    got = {r.subject: r.v for r in n.collect()}
    assert got[1] == [0.6, 0.8] and got[2] == [0.0, 0.0]


def test_shift_nonnegative_global(spark):
    df = spark.createDataFrame([(1, [-2.0, 1.0]), (2, [0.5, 3.0])], "subject long, v array<double>")
    got = {r.subject: r.v for r in V.shift_nonnegative(df).collect()}
    assert got[1] == [0.0, 3.0] and got[2] == [2.5, 5.0]


def _sk_silhouette(X, lab):
    n = len(X)
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    s = np.zeros(n)
    for i in range(n):
        own = lab == lab[i]
        if own.sum() <= 1:
            continue
        a = D[i, own].sum() / (own.sum() - 1)
        b = min(D[i, lab == c].mean() for c in set(lab) if c != lab[i])
        s[i] = (b - a) / max(a, b)
    return s.mean()


def test_exact_silhouette_matches_brute_force_blocked(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(60, 4))
    lab = rng.integers(0, 3, size=60)
    lab[0] = 3  # a singleton cluster
    df = _vec(spark, X, lab)
    labels = df.select("subject", F.lit(1).alias("k"), "prediction")
    for block in (7, 1000):  # many blocks and one block
        got = M.silhouette(df.select("subject", "v"), labels, block_rows=block).first().silhouette_score
        assert abs(got - _sk_silhouette(X, lab)) < 1e-9


def test_davies_bouldin_and_calinski(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(40, 3))
    lab = rng.integers(0, 3, size=40)
    st = M.cluster_stats(_vec(spark, X, lab))
    db = M.davies_bouldin(st).first()[0]
    ch = M.calinski_harabasz(st).first()[0]
    cents = np.array([X[lab == c].mean(0) for c in range(3)])
    S = np.array([np.linalg.norm(X[lab == c] - cents[c], axis=1).mean() for c in range(3)])
    R = [max((S[i] + S[j]) / np.linalg.norm(cents[i] - cents[j]) for j in range(3) if j != i) for i in range(3)]
    assert abs(db - np.mean(R)) < 1e-9
    m = X.mean(0)
    between = sum((lab == c).sum() * ((cents[c] - m) ** 2).sum() for c in range(3))
    within = sum(((X[lab == c] - cents[c]) ** 2).sum() for c in range(3))
    assert abs(ch - between * (40 - 3) / (within * 2)) < 1e-6


def test_lloyd_sweep_inertia_non_increasing_and_repartition_stable(spark):
    rng = np.random.default_rng(2)
    X = np.vstack([rng.normal(0, 1, (30, 2)), rng.normal(6, 1, (30, 2))])
    df = _vec(spark, X).select("subject", "v")
    costs = []
    for rounds in (0, 1, 3):
        a, _ = K.lloyd_sweep(df, [2], rounds, dims=2)
        costs.append(a.agg(F.sum("sqdist")).first()[0])
    assert costs[0] >= costs[1] >= costs[2]
    a1, _ = K.lloyd_sweep(df, [2, 3], 3, dims=2)
    a2, _ = K.lloyd_sweep(df.repartition(5), [2, 3], 3, dims=2)
    r1 = sorted(tuple(r) for r in a1.select("subject", "k", "prediction").collect())
    r2 = sorted(tuple(r) for r in a2.select("subject", "k", "prediction").collect())
    assert r1 == r2


def test_kendall_tau_b_with_ties(spark):
    df = spark.createDataFrame([(2, 1.0, 10.0), (3, 2.0, 8.0), (4, 2.0, 5.0)], "k int, m double, inertia double")
    tau = M.kendall_tau_b(df, "m", "inertia").first().tau
    # pairs: (1,2):(-,+)->-1 ; (1,3):-1 ; (2,3): tie in m -> 0 ; n0=3, tx=1, ty=0
    assert abs(tau - (-2 / np.sqrt(2 * 3))) < 1e-12


def test_pca_nmf_dictionary_properties(spark):
    from itemspace.operators import reduce as RDX
    rng = np.random.default_rng(7)
    X = rng.random((80, 6))
    df = _vec(spark, X).select("subject", "v")
    proj, evr = RDX.pca(df, 2, dims=6)
    P = np.array([r.v for r in proj.orderBy("subject").collect()])
    w = np.linalg.eigvalsh(np.cov(X.T))[::-1]
    assert abs(evr - w[:2].sum() / w.sum()) < 1e-9
    assert abs(P.var(0, ddof=1).sum() - w[:2].sum()) < 1e-9
    errs = []
    for it in (2, 10):
        W, H, err = RDX.nmf(df, 3, iters=it)
        assert (H >= 0).all() and min(min(r.w) for r in W.collect()) >= 0
        errs.append(err)
    assert errs[1] <= errs[0] + 1e-9
    codes, D = RDX.dictionary_learning(df, 4, alpha=0.05, iters=3)
    assert np.allclose(np.linalg.norm(D, axis=1)[np.linalg.norm(D, axis=1) > 0] <= 1 + 1e-9, True)
    C = np.array([r.code for r in codes.orderBy("subject").collect()])
    assert np.linalg.norm(X - C @ D) < np.linalg.norm(X)


def test_fuzzy_graph_symmetric_and_bounded(spark):
    from itemspace.operators import reduce as RDX
    rng = np.random.default_rng(8)
    df = _vec(spark, rng.normal(size=(50, 5))).select("subject", "v")
    knn = RDX.knn_graph(df, 9, metric="cosine", block_rows=16)
    assert knn.groupBy("src").count().agg(F.min("count"), F.max("count")).first() == (9, 9)
    g = {(r.src, r.dst): r.w for r in RDX.fuzzy_graph(knn, 10).collect()}
    assert all(0 < w <= 1 + 1e-12 for w in g.values())
    assert all(abs(g[(a, b)] - g[(b, a)]) < 1e-12 for (a, b) in g)
