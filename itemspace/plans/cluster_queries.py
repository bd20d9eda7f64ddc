"""Clustering and intrinsic-metric queries (F3 vectors, K sweep 2..4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from itemspace.operators import cluster as K
from itemspace.operators import lloyd as L
from itemspace.operators import metrics as M
from itemspace.operators import seeding as S
from itemspace.operators import vectors as V
from itemspace.plans.catalog import query
from itemspace.plans.sqlgen import kmeans_ctes, long_vectors, metric_ctes
from itemspace.session import materialize
from itemspace.sources import fixtures as fx

KS = [2, 3, 4]
ROUNDS = 5
VS = fx.VECTORS_SQL
KM, PRED = kmeans_ctes(long_vectors(VS), KS, ROUNDS)
VA = f"(select subject, v from ({VS}))"


def _vec(spark, sf):
    return fx.vectors(spark, sf)


def _sweep(spark, sf):
    vec = _vec(spark, sf)
    a, _ = K.lloyd_sweep(vec.select("subject", "v"), KS, ROUNDS, dims=64)
    return vec, a


@query("kmeans_fixed", f"with {KM} select cast(k as integer) as k, subject, cast(prediction as integer) as prediction "
                       f"from {PRED}")
def q_kmeans_fixed(spark, sf):
    _, a = _sweep(spark, sf)
    return a.select(F.col("k").cast("int").alias("k"), "subject", F.col("prediction").cast("int").alias("prediction"))


@query("kmeans_bounded", f"with {KM} select cast(k as integer) as k, subject, cast(prediction as integer) as prediction, "
                         f"round(dist, 5) as sqdist from {PRED}")
def q_kmeans_bounded(spark, sf):
    """The rounds of kmeans_fixed with distance bounds carried between them."""
    vec = _vec(spark, sf).select("subject", "v")
    init = {k: c for (_, k), c in K.initial_centres(vec, KS).items()}
    a, _, _ = L.bounded_lloyd(vec, init, ROUNDS)
    return a.select("k", "subject", "prediction", F.round("sqdist", 5).alias("sqdist"))


DRAW_STARTS, DRAW_K = 3, 4


def _draws_sql() -> str:
    def unit(*key: str) -> str:
        return ("cast('0x' || substr(md5(concat_ws(':', cast(42 + s as varchar), "
                + ", ".join(f"cast({k} as varchar)" for k in key) + ")), 1, 8) as bigint)")
    ctes = [f"""v as ({VS}), st as (select unnest(range({DRAW_STARTS})) as s),
p0 as (select s, subject, v from st, v qualify row_number() over (partition by s order by {unit("subject")}, subject) = 1),
n0 as (select st.s, v.subject, v.v, list_distance(v.v, p0.v) ** 2 as d2 from st join p0 using (s) cross join v)"""]
    for r in (1, 2):
        ctes.append(f"""
p{r} as (select s, subject, v from n{r - 1} join (select s, sum(d2) as phi from n{r - 1} group by s) using (s)
       where {unit(str(r), "subject")} / 4294967296 * phi < {2 * DRAW_K} * d2),
n{r} as (select n.s, n.subject, n.v, least(any_value(n.d2), min(list_distance(n.v, p.v) ** 2)) as d2
       from n{r - 1} n left join p{r} p on p.s = n.s group by n.s, n.subject, n.v)""")
    return "with " + ",".join(ctes) + "\n" + " union all ".join(
        f"select cast(s as integer) as start, {r} as round, subject from p{r}" for r in range(3))


@query("kmeans_parallel_draws", _draws_sql())
def q_kmeans_parallel_draws(spark, sf):
    """The candidates that k-means|| draws for three starts in two rounds."""
    found = S.draws(_vec(spark, sf), DRAW_K, DRAW_STARTS, rounds=2)
    rows = [(s, r, int(key)) for s, f in enumerate(found) for r, key, _ in f]
    return spark.createDataFrame(rows, "start int, round int, subject long")


@query("kmeans_inertia", f"with {KM} select cast(k as integer) as k, round(sum(dist), 4) as inertia "
                         f"from {PRED} group by k")
def q_kmeans_inertia(spark, sf):
    _, a = _sweep(spark, sf)
    return K.inertia(a).select(F.col("k").cast("int").alias("k"), F.round("inertia", 4).alias("inertia"))


@query("check_label_count", f"with {KM} select cast(k as integer) as k, count(distinct prediction) as n_labels, "
                            f"count(distinct prediction) < k as fewer_than_k from {PRED} group by k")
def q_check_label_count(spark, sf):
    _, a = _sweep(spark, sf)
    out = K.check_label_count(a)
    return out.select(F.col("k").cast("int").alias("k"), F.col("n_labels").cast("long").alias("n_labels"),
                      "fewer_than_k")


def _sweep_metrics(spark, sf):
    vec, a = _sweep(spark, sf)
    data = M.labelled_blocks(vec, a.select("subject", "k", "prediction"))
    st = M.cluster_stats(data.rows(), ["k"], dims=64)
    db = M.davies_bouldin(st, ["k"])
    ch = M.calinski_harabasz(st, ["k"])
    sil = M.silhouette_of(spark, data)
    # K rows, read several times by the correlation and curve tables
    return materialize(db.join(ch, "k").join(sil, "k").join(K.inertia(a), "k")
                       .join(K.check_label_count(a).select("k", "n_labels"), "k"))


_SWEEP_SQL = f"""with {KM}{metric_ctes(PRED, "km_v", VA)},
sw as (select db.k, davies_bouldin_score, calinski_harabasz_score, silhouette_score, i.inertia, n.n_labels
       from m_db db join m_ch using (k) join m_sil using (k)
       join (select k, sum(dist) as inertia from {PRED} group by k) i using (k)
       join (select k, count(distinct prediction) as n_labels from {PRED} group by k) n using (k))"""

R5 = 5


@query("intrinsic_sweep", _SWEEP_SQL + f"""
select cast(k as integer) as k, round(davies_bouldin_score, {R5}) as davies_bouldin_score,
       round(calinski_harabasz_score, 4) as calinski_harabasz_score, round(silhouette_score, {R5}) as silhouette_score,
       round(inertia, 4) as inertia, n_labels from sw""")
def q_intrinsic_sweep(spark, sf):
    m = _sweep_metrics(spark, sf)
    return m.select(F.col("k").cast("int").alias("k"),
                    F.round("davies_bouldin_score", R5).alias("davies_bouldin_score"),
                    F.round("calinski_harabasz_score", 4).alias("calinski_harabasz_score"),
                    F.round("silhouette_score", R5).alias("silhouette_score"),
                    F.round("inertia", 4).alias("inertia"), F.col("n_labels").cast("long").alias("n_labels"))


_KENDALL = """
(select sum(sign(a.{m} - b.{m}) * sign(a.inertia - b.inertia)) /
        nullif(sqrt((count(*) - count(*) filter (where a.{m} = b.{m})) *
                    (count(*) - count(*) filter (where a.inertia = b.inertia))), 0)
 from sw a join sw b on a.k < b.k)"""
NAMES = ["davies_bouldin_score", "calinski_harabasz_score", "silhouette_score"]


@query("metric_inertia_correlation", _SWEEP_SQL + "\nselect " + ", ".join(
    f"round(({_KENDALL.format(m=m)} + 1) / 2, 6) as COR_{m}" for m in NAMES))
def q_metric_inertia_correlation(spark, sf):
    m = _sweep_metrics(spark, sf)
    c = M.metric_inertia_correlation(m, NAMES)
    return c.select(*[F.round(f"COR_{n}", 6).alias(f"COR_{n}") for n in NAMES])


@query("normalized_metric_curves", _SWEEP_SQL + """,
mm as (select min(inertia) as i0, max(inertia) as i1, min(davies_bouldin_score) as d0, max(davies_bouldin_score) as d1,
              min(silhouette_score) as s0, max(silhouette_score) as s1,
              min(calinski_harabasz_score) as c0, max(calinski_harabasz_score) as c1 from sw)
select cast(k as integer) as k,
  round(case when i1 > i0 then (inertia - i0) / (i1 - i0) else 0.0 end, 5) as inertia_norm,
  round(case when d1 > d0 then (davies_bouldin_score - d0) / (d1 - d0) else 0.0 end, 5) as davies_bouldin_norm,
  round(1 - case when s1 > s0 then (silhouette_score - s0) / (s1 - s0) else 0.0 end, 5) as silhouette_norm,
  round(1 - case when c1 > c0 then (calinski_harabasz_score - c0) / (c1 - c0) else 0.0 end, 5)
    as calinski_harabasz_norm
from sw, mm""")
def q_normalized_metric_curves(spark, sf):
    n = M.normalized_metric_curves(_sweep_metrics(spark, sf))
    return n.select(F.col("k").cast("int").alias("k"), *[F.round(c, 5).alias(c) for c in n.columns if c != "k"])


# ----------------------------------------------------- metrics of given labels
LBL = f"(select 1 as k, subject, label as prediction from ({VS}))"
VL = f"(select * from ({long_vectors(VS)}))"


def _labelled(spark, sf):
    vec = _vec(spark, sf)
    return vec, vec.select("subject", "v", F.lit(1).alias("k"), F.col("label").alias("prediction"))


@query("cluster_stats", f"with x as (select 1) {metric_ctes(LBL, VL, VA)}" + """
select s.label as prediction, z.size, round(s.scatter, 6) as scatter, round(s.sse, 5) as sse
from m_st s join m_sz z using (k, label)""")
def q_cluster_stats(spark, sf):
    _, df = _labelled(spark, sf)
    st = M.cluster_stats(df, dims=64)
    return st.select("prediction", "size", F.round("scatter", 6).alias("scatter"), F.round("sse", 5).alias("sse"))


@query("davies_bouldin", f"with x as (select 1) {metric_ctes(LBL, VL, VA)}"
                         " select round(davies_bouldin_score, 6) as davies_bouldin_score from m_db")
def q_davies_bouldin(spark, sf):
    _, df = _labelled(spark, sf)
    return M.davies_bouldin(M.cluster_stats(df, dims=64)).select(
        F.round("davies_bouldin_score", 6).alias("davies_bouldin_score"))


@query("calinski_harabasz", f"with x as (select 1) {metric_ctes(LBL, VL, VA)}"
                            " select round(calinski_harabasz_score, 5) as calinski_harabasz_score from m_ch")
def q_calinski_harabasz(spark, sf):
    _, df = _labelled(spark, sf)
    return M.calinski_harabasz(M.cluster_stats(df, dims=64)).select(
        F.round("calinski_harabasz_score", 5).alias("calinski_harabasz_score"))


@query("silhouette", f"with x as (select 1) {metric_ctes(LBL, VL, VA)}"
                     " select round(silhouette_score, 6) as silhouette_score from m_sil")
def q_silhouette(spark, sf):
    vec, df = _labelled(spark, sf)
    s = M.silhouette(vec, df.select("subject", "k", "prediction"))
    return s.select(F.round("silhouette_score", 6).alias("silhouette_score"))


@query("silhouette_sq", f"""
with v as ({VS}),
ps as (select a.subject, a.label as own, b.label as ol,
              sum(list_distance(a.v, b.v) * list_distance(a.v, b.v)) as ds, count(*) as cnt
       from v a join v b on a.subject <> b.subject group by a.subject, a.label, b.label),
pw as (select subject, max(case when ol = own then ds / cnt end) as a,
              min(case when ol <> own then ds / cnt end) as b from ps group by subject)
select round(avg(case when a is null or b is null then 0.0 else (b - a) / greatest(a, b) end), 6) as silhouette_sq
from pw""")
def q_silhouette_sq(spark, sf):
    vec = _vec(spark, sf)
    return M.silhouette_sq(vec, label="label", dims=64).select(F.round("silhouette_sq", 6).alias("silhouette_sq"))


@query("assign_clusters", f"""
with v as ({long_vectors(VS)}), lb as ({VS}),
c as (select l.label, v.d, avg(v.x) as c from v join lb l using (subject) group by l.label, v.d),
dd as (select v.subject, c.label, sum((v.x - c.c) * (v.x - c.c)) as dist from v join c on v.d = c.d
       group by v.subject, c.label)
select d.subject, l.label, d.label as assigned from dd d join lb l using (subject)
qualify row_number() over (partition by d.subject order by d.dist, d.label) = 1""")
def q_assign_clusters(spark, sf):
    vec = _vec(spark, sf)
    st = M.cluster_stats(vec, label="label", dims=64).select("label", "centroid").orderBy("label").collect()
    labels = [r["label"] for r in st]
    a = K.assign_clusters(vec, {1: [list(r["centroid"]) for r in st]})
    lab_arr = F.array(*[F.lit(x) for x in labels])
    return a.select("subject", "label", F.element_at(lab_arr, F.col("prediction") + 1).alias("assigned"))


@query("bisecting_kmeans")
def q_bisecting_kmeans(spark, sf):
    vec = _vec(spark, sf)
    pred, _ = K.bisecting_kmeans(vec.select("subject", "v"), 4)
    return pred


@query("kmeans_restarts")
def q_kmeans_restarts(spark, sf):
    vec = _vec(spark, sf)
    pred, _ = K.kmeans_restarts(vec.select("subject", "v"), 4)
    return pred


@query("spectral_basis")
def q_spectral_basis(spark, sf):
    """Spectral coordinates of every row for K up to 3, with the residual of the
    eigenvectors that they come from."""
    basis, found = K.spectral_basis(_vec(spark, sf).select("subject", "v"), 3)
    return (V.to_long(basis).withColumn("rounds", F.lit(found.rounds))
            .withColumn("within_tolerance", F.lit(found.converged)))


@query("spectral_clustering")
def q_spectral_clustering(spark, sf):
    return K.spectral_clustering(_vec(spark, sf).select("subject", "v"), [2, 3], gamma=1.0)
