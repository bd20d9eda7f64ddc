"""Clustering: deterministic Lloyd sweeps over several K at once, nearest-centre
assignment, inertia, MLlib k-means with restarts, biggest-inertia bisecting.

Only k x d centres ever reach the driver.  A Lloyd round is one pass over
the (cached) vectors for *all* K of a sweep, which adds every task's rows up in
NumPy (``lloyd.updated``).  The final assignment repeats each row once per K (a bounded
factor, the length of the K list) and joins it by K to that K's centres.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemspace.functions.hashing import det_uint32
from itemspace.functions.vector import array_sqdist
from itemspace.operators.eigen import Eigen, NotConverged, normalized_adjacency, top_eigenvectors
from itemspace.operators.lloyd import lists, matrix, packed, squared, updated
from itemspace.operators.neighbours import approx_knn_graph
from itemspace.operators.reduce import gram_stats, rbf_affinity
from itemspace.operators.seeding import parallel_seeds
from itemspace.operators.vectors import normalize_rows, vector_dims
from itemspace.session import materialize, persist, ship_package


def nearest(col: str = "v", centres: str = "centres"):
    """struct(dist, id) of the nearest centre; ties go to the lowest id."""
    return F.array_min(F.transform(
        centres, lambda c, j: F.struct(array_sqdist(col, c).alias("dist"), j.alias("id"))))


Centres = dict  # {(group, config): [[...], ...]} or {config: [[...], ...]}


def _norm_keys(centres: Centres) -> dict[tuple[int, int], list[list[float]]]:
    return {(k if isinstance(k, tuple) else (0, k)): v for k, v in centres.items()}


def _centres_frame(spark: SparkSession, centres: Centres) -> DataFrame:
    """One row per (group, configuration), as a local relation of known size whatever the
    session's Arrow setting, so that Spark broadcasts it and the rows are not shuffled.
    Size is bounded by groups x configurations."""
    c = _norm_keys(centres)
    return spark.createDataFrame(pa.table({
        "_g": pa.array([int(g) for g, _ in c], pa.int32()), "k": pa.array([int(k) for _, k in c], pa.int32()),
        "centres": pa.array([[[float(x) for x in row] for row in cs] for cs in c.values()], pa.list_(pa.list_(pa.float64())))}))


def assign_clusters(vectors: DataFrame, centres: Centres, col: str = "v", group: str | None = None) -> DataFrame:
    """Nearest centre for every (row, configuration): adds k, prediction,
    sqdist.  Each row is repeated once per configuration of its group and
    joined by (group, k) to the centres."""
    spark = vectors.sparkSession
    cf = _centres_frame(spark, centres)
    ks = sorted({k for _, k in _norm_keys(centres)})
    g = F.col(group).cast("int") if group else F.lit(0)
    out = (vectors.withColumn("_g", g).withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in ks])))
           .join(cf, ["_g", "k"])
           .withColumn("_near", nearest(col, "centres"))
           .withColumn("prediction", F.col("_near.id").cast("int"))
           .withColumn("sqdist", F.col("_near.dist"))
           .drop("_near", "centres", "_g"))
    return out


def assign_all(vectors: DataFrame, centres: Centres, col: str = "v", group: str | None = None) -> DataFrame:
    """Every row once, with ``near``: struct(dist, id) of its nearest centre for each configuration of
    its group, in their order, as by ``assign_clusters``.  All groups have the same configurations."""
    by = _norm_keys(centres)
    ks = sorted({k for _, k in by})
    cf = vectors.sparkSession.createDataFrame(pa.table({
        "_g": pa.array(sorted({int(g) for g, _ in by}), pa.int32()),
        "centres": pa.array([[[[float(x) for x in row] for row in by[(g, k)]] for k in ks] for g in sorted({g for g, _ in by})],
                            pa.list_(pa.list_(pa.list_(pa.float64()))))}))
    g = F.col(group).cast("int") if group else F.lit(0)
    return (vectors.withColumn("_g", g).join(cf, "_g")
            .withColumn("near", F.transform("centres", lambda of: nearest(col, of))).drop("centres", "_g"))


def initial_centres(vectors: DataFrame, ks: Sequence[int], key: str = "subject", col: str = "v",
                    seed: int = 42, group: str | None = None) -> Centres:
    """Centres of K are the K first rows by md5 rank (a top-k of max(K) rows,
    one TakeOrdered job per group)."""
    kmax = max(ks)
    groups = [r[0] for r in vectors.select(group).distinct().collect()] if group else [None]
    out = {}
    for gv in groups:
        part = vectors.where(F.col(group) == gv) if group else vectors
        first = (part.withColumn("_h", det_uint32(seed, key)).orderBy("_h", key).limit(kmax)
                 .select(col).collect())
        pts = [list(r[0]) for r in first]
        if len(pts) < kmax:
            raise ValueError(f"need at least {kmax} rows, got {len(pts)}")
        for k in ks:
            out[(int(gv) if group else 0, int(k))] = pts[:k]
    return out


def _moved(before: list[list[float]], after: list[list[float]]) -> float:
    """The furthest that any centre of a configuration has moved."""
    return max(math.dist(a, b) for a, b in zip(before, after))


def _rested(base: DataFrame, centres: Centres, rounds: int, col: str, group: str | None = None,
            tol: float | None = None) -> Centres:
    """Centres after ``rounds`` updates; with ``tol`` each configuration until it rests."""
    # a round costs every task its start: no more of them than run at once
    rows = persist(packed(base, col, group).coalesce(base.sparkSession.sparkContext.defaultParallelism))
    moving = centres
    for _ in range(rounds):
        now = updated(rows, moving)
        centres = {**centres, **now}
        # configurations at rest take no further part
        moving = {c: now[c] for c in now if tol is None or _moved(moving[c], now[c]) > tol}
        if not moving:
            break
    rows.unpersist()
    return centres


def _best_of(vectors: DataFrame, init: Centres, rounds: int, key: str, col: str, tol: float | None,
             wide: int) -> tuple[DataFrame, dict[int, list], dict[int, float]]:
    """Of the configurations of every K (id modulo ``wide``) the one of the lowest inertia (the first
    on ties), and only its assignments (key, k: the id, prediction, sqdist): with centres and inertia by id."""
    base = persist(vectors.select(key, col))
    centres = _rested(base, init, rounds, col, tol=tol)
    costs = {r["k"]: r["c"] for r in assign_clusters(base, centres, col).groupBy("k").agg(F.sum("sqdist").alias("c")).collect()}
    best = [min((c for c in costs if c % wide == k), key=lambda c: (costs[c], c)) for k in sorted({c % wide for c in costs})]
    a = materialize(assign_clusters(base, {c: centres[(0, c)] for c in best}, col).select(key, "k", "prediction", "sqdist"))
    base.unpersist()
    return a, {c: centres[(0, c)] for c in best}, {c: float(costs[c]) for c in best}


def lloyd_sweep(vectors: DataFrame, ks: Sequence[int], rounds: int = 5, key: str = "subject",
                col: str = "v", seed: int = 42, init: Centres | None = None,
                dims: int | None = None, checkpoint: bool = True,
                group: str | None = None, tol: float | None = None, wide: bool = False) -> tuple[DataFrame, Centres]:
    """Deterministic k-means for every K in ``ks``: md5-ranked initial
    centres, ``rounds`` Lloyd updates, then the final assignment.  With ``tol`` a
    configuration rests once none of its centres moves further than that.

    ``group`` runs independent sweeps for each value of an integer column in
    the same passes (e.g. several preprocessings of one survey); ``init`` may
    map (group, config id) -> centres (e.g. several starts of one K), the
    ``k`` column then carries the config id.  Returns (assignments(key,
    [group,] k, prediction, sqdist), centres).  The input is persisted during
    the sweep, each round is one job, and the result is checkpointed to the
    shared checkpoint folder.  With ``wide`` the vectors stay beside what they were assigned
    (``assign_all``: key, vector, [group,] near), computed when read: nothing is written.
    """
    cols = [key, col] + ([group] if group else [])
    base = persist(vectors.select(*cols))
    centres = _norm_keys(init) if init else initial_centres(base, ks, key, col, seed, group)
    centres = _rested(base, centres, rounds, col, group, tol)
    if wide:
        base.unpersist()
        return (assign_all(vectors.select(*cols), centres, col, group),
                centres if group else {k: v for (_, k), v in centres.items()})
    final = assign_clusters(base, centres, col, group).select(
        key, *([group] if group else []), "k", "prediction", "sqdist")
    if checkpoint:
        final = materialize(final)
        base.unpersist()
    if not group:
        centres = {k: v for (_, k), v in centres.items()}
    return final, centres


def kmeans_multi_start(vectors: DataFrame, k: int, n_init: int = 10, rounds: int = 5, key: str = "subject",
                       col: str = "v", seed: int = 42, dims: int | None = None,
                       checkpoint: bool = True, tol: float | None = None) -> tuple[DataFrame, list[list[float]], float]:
    """Best of ``n_init`` deterministic starts (k-means|| seeds of seed..seed+n_init-1),
    all drawn and run in the same passes; keeps the lowest inertia (first start
    on ties).  Returns (assignments(key, k, prediction, sqdist), centres, inertia)."""
    seeds = parallel_seeds(vectors, [k], n_init, key=key, col=col, seed=seed)
    init = {(0, i): seeds[(i, k)] for i in range(n_init)}
    a, centres, costs = _best_of(vectors, init, rounds, key, col, tol, 1)
    best = next(iter(centres))
    return a.withColumn("k", F.lit(k)), centres[best], costs[best]


def kmeans_best(vectors: DataFrame, ks: Sequence[int], n_init: int = 10, rounds: int = 300, key: str = "subject",
                col: str = "v", seed: int = 42, tol: float = 1e-3) -> DataFrame:
    """(key, k, prediction, sqdist): for every K the best of ``n_init`` k-means|| starts,
    each until its centres rest.  All K and starts share the same passes."""
    wide = max(ks) + 1
    seeds = parallel_seeds(vectors, ks, n_init, key=key, col=col, seed=seed)
    init = {(0, i * wide + k): c for (i, k), c in seeds.items()}
    a, _, _ = _best_of(vectors, init, rounds, key, col, tol, wide)
    return a.withColumn("k", (F.col("k") % wide).cast("int"))


def inertia(assignments: DataFrame) -> DataFrame:
    return assignments.groupBy("k").agg(F.sum("sqdist").alias("inertia"))


def check_label_count(predictions: DataFrame, group: Sequence[str] = ("k",)) -> DataFrame:
    """Labels used per K; flags runs with fewer labels than K."""
    return (predictions.groupBy(*group).agg(F.count_distinct("prediction").alias("n_labels"))
            .withColumn("fewer_than_k", F.col("n_labels") < F.col("k")))


# ------------------------------------------------------- MLlib-backed variants
STARTS_AT_ONCE = 4


def _to_ml(vectors: DataFrame, col: str):
    from pyspark.ml.functions import array_to_vector
    return vectors.withColumn("features", array_to_vector(col))


def kmeans_restarts(vectors: DataFrame, k: int, n_init: int = 10, seed: int = 42, col: str = "v",
                    key: str = "subject", max_iter: int = 300, tol: float = 1e-4) -> tuple[DataFrame, float]:
    """k-means++ (MLlib, distributed k-means||) with ``n_init`` seeded starts;
    keeps the start with the lowest training cost.  Returns (predictions,
    inertia)."""
    from pyspark.ml.clustering import KMeans
    data = persist(_to_ml(vectors.select(key, col), col))
    data.count()                                      # held before several starts read it
    features = data.select("features")                # not itself held: a fit then holds its vectors decoded, with norms

    def start(i: int):
        model = KMeans(k=k, seed=seed + i, maxIter=max_iter, tol=tol, featuresCol="features",
                       predictionCol="prediction").fit(features)
        return model, model.summary.trainingCost

    # starts know nothing of each other: a round of one fills the cores that another leaves
    with ThreadPoolExecutor(max_workers=min(STARTS_AT_ONCE, n_init)) as pool:
        run = inheritable_thread_target(vectors.sparkSession)
        fits = [job.result() for job in [pool.submit(run(start), i) for i in range(n_init)]]
    model, cost = min(fits, key=lambda f: f[1])       # the first start on ties
    pred = materialize(model.transform(data).select(key, F.lit(k).alias("k"), F.col("prediction").cast("int")))
    data.unpersist()
    return pred, float(cost)


def bisecting_kmeans(vectors: DataFrame, k: int, n_init: int = 10, seed: int = 42, col: str = "v",
                     key: str = "subject", rounds: int = 300, tol: float = 1e-4) -> tuple[DataFrame, float]:
    """Divisive clustering that always splits the leaf with the largest SSE
    (MLlib's BisectingKMeans splits by size instead).  Each split runs the
    ``n_init`` seeded 2-means starts together on the leaf's rows until their
    centres move no further than ``tol`` (``rounds`` is only a guard); the table
    of leaf ids is checkpointed after every split, so lineage stays short.
    Only leaf statistics reach the driver."""
    dims = vector_dims(vectors, col)
    data = materialize(vectors.select(key, col).withColumn("leaf", F.lit(0)))
    sse = {0: _sse(data.where(F.col("leaf") == 0), col, dims)}
    next_id = 1
    while len(sse) < k:
        target = max(sse, key=lambda lf: (sse[lf], -lf))
        part = data.where(F.col("leaf") == target).select(key, col)
        if part.count() < 2:
            break
        _a, c, _cost = kmeans_multi_start(part, 2, n_init, rounds, key, col, seed, dims, tol=tol)
        cf = _centres_frame(data.sparkSession, {2: c}).drop("_g")
        split = (data.withColumn("k", F.lit(2)).join(cf, "k")
                 .withColumn("_id", nearest(col, "centres")["id"])
                 .withColumn("leaf", F.when(F.col("leaf") == target,
                                            F.when(F.col("_id") == 0, F.lit(target)).otherwise(F.lit(next_id)))
                             .otherwise(F.col("leaf")))
                 .drop("k", "centres", "_id"))
        data = materialize(split)
        for lf in (target, next_id):
            sse[lf] = _sse(data.where(F.col("leaf") == lf), col, dims)
        next_id += 1
    total = float(sum(sse.values()))
    return data.select(key, F.lit(k).alias("k"), F.col("leaf").cast("int").alias("prediction")), total


def _sse(df: DataFrame, col: str, dims: int) -> float:
    r = df.agg(F.count("*").alias("n"),
               F.array(*[F.sum(F.col(col)[i]) for i in range(dims)]).alias("s"),
               F.sum(F.aggregate(col, F.lit(0.0), lambda a, x: a + x * x)).alias("q")).first()
    if not r["n"]:
        return 0.0
    return float(r["q"] - sum(x * x for x in r["s"]) / r["n"])


# ------------------------------------------------------------------- spectral
def spectral_basis(vectors: DataFrame, k: int, gamma: float = 1.0, neighbours: int = 15, key: str = "subject",
                   col: str = "v", affinity: str = "rbf", seed: int = 42, tol: float = 1e-6,
                   rounds: int = 500) -> tuple[DataFrame, Eigen]:
    """(key, v): k spectral coordinates of every row, and the eigenvectors they come
    from.  The affinity (exp(-gamma d^2), or the cosine with negative ones as 0) is kept on
    the edges of the nearest-neighbour graph of all rows, symmetrised by the maximum;
    coordinates are D^-1/2 times the leading eigenvectors of D^-1/2 W D^-1/2.  One
    basis serves every K up to k."""
    if affinity == "rbf":
        edges = rbf_affinity(approx_knn_graph(vectors, neighbours, key, col, "euclidean", seed=seed), gamma)
    elif affinity == "cosine":
        near = approx_knn_graph(vectors, neighbours, key, col, "cosine", seed=seed)
        e = near.select("src", "dst", F.greatest(F.lit(0.0), 1 - F.col("dist")).alias("w"))
        both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
        edges = both.groupBy("src", "dst").agg(F.max("w").alias("w"))
    else:
        raise ValueError(f"unknown affinity {affinity!r}")
    matrix, deg = normalized_adjacency(materialize(edges))
    found = top_eigenvectors(matrix, k, tol, rounds, seed=seed)
    if not found.converged:
        warnings.warn(f"spectral basis: residual {found.residuals.max():.1e} above {tol:.1e} after {found.rounds} rounds",
                      NotConverged, stacklevel=2)
    scale = F.when(F.col("deg") > 0, 1 / F.sqrt("deg")).otherwise(0.0)
    rows = (found.vectors.join(deg, "node").withColumn("_s", scale)
            .select(F.col("node").cast(vectors.schema[key].dataType).alias(key),
                    F.transform("u", lambda x: x * F.col("_s")).alias(col)))
    return materialize(rows), found


def spectral_clustering(vectors: DataFrame, ks: Sequence[int], gamma: float = 1.0, landmarks: int | None = None,
                        key: str = "subject", col: str = "v", n_init: int = 10, rounds: int = 300,
                        seed: int = 42, affinity: str = "rbf", neighbours: int = 15, tol: float = 1e-4) -> DataFrame:
    """Spectral clustering (RBF, or ``affinity='cosine'``: cosines, negative ones
    as 0): (key, k, prediction).  By default the basis is that of ``spectral_basis``,
    from all rows; with ``landmarks`` a Nystrom approximation on so many rows.
    Then k-means with ``n_init`` starts per K, each until its centres move no further
    than ``tol`` of the coordinates' size."""
    if landmarks is None:
        basis, _ = spectral_basis(vectors, max(ks), gamma, neighbours, key, col, affinity, seed)
    else:
        basis = _landmark_basis(vectors, max(ks), gamma, landmarks, key, col, seed, affinity)
    out = None
    for k in ks:
        ek = basis.select(key, F.slice(col, 1, k).alias(col))
        if landmarks is not None:
            ek = normalize_rows(ek, 2, col)
        size = ek.agg(F.sqrt(F.avg(F.aggregate(col, F.lit(0.0), lambda a, x: a + x * x)))).first()[0] or 0.0
        a, _c, _cost = kmeans_multi_start(ek, k, n_init, rounds, key, col, seed, dims=k, tol=tol * size)
        part = a.select(key, F.lit(k).alias("k"), "prediction")
        out = part if out is None else out.unionByName(part)
    return out


def _landmark_basis(vectors: DataFrame, k: int, gamma: float, landmarks: int, key: str, col: str, seed: int,
                    affinity: str) -> DataFrame:
    """Nystrom: m md5-ranked landmarks (m x d), affinities to them row by row
    (n x m, never n x n), degree-normalised rows F = C / sqrt(deg), and the top eigenvectors of
    the m x m Gram F^T F (summed per task, eigen-decomposed on the driver)."""
    ship_package(vectors.sparkSession)
    first = (vectors.withColumn("_h", det_uint32(seed, key)).orderBy("_h", key).limit(landmarks)
             .select(col).collect())
    at = np.array([list(r[0]) for r in first])
    if affinity not in ("rbf", "cosine"):
        raise ValueError(f"unknown affinity {affinity!r}")
    cosine = affinity == "cosine"
    if cosine:
        at = at / np.maximum(np.linalg.norm(at, axis=1, keepdims=True), 1e-300)

    def features(batches):
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("v")).astype(np.float64)
                if cosine:
                    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                    c = np.maximum(x @ at.T, 0.0)
                else:
                    c = np.exp(-gamma * squared(x, at))
                f = c / np.sqrt(np.maximum(c.sum(axis=1, keepdims=True), 1e-300))
                yield pa.RecordBatch.from_arrays([b.column("key"), lists(f)], names=["key", "f"])

    kind = vectors.schema[key].dataType.simpleString()
    feats = persist(vectors.select(F.col(key).alias("key"), F.col(col).alias("v"))
                    .mapInArrow(features, f"key {kind}, f array<double>"))
    m = len(at)
    g = np.zeros((m, m))
    for r in gram_stats(feats, "f", m).collect():
        g[r["i"], r["j"]] = g[r["j"], r["i"]] = r["g"]
    w, u = np.linalg.eigh(g)
    top = u[:, np.argsort(w)[::-1][:k]]

    def project(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("key"), lists(matrix(b.column("f")) @ top)], names=["key", "v"])
    out = materialize(feats.mapInArrow(project, f"key {kind}, v array<double>").withColumnsRenamed({"key": key, "v": col}))
    feats.unpersist()
    return out
