"""Run-comparison queries.  F9: three deterministic k-means runs on the F3
vectors (raw, L1 and L2 rows after the non-negative shift), K = 2..4, plus
each run's random run; F7: two labelings of the same documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemspace.operators import cluster as K
from itemspace.operators import compare as CP
from itemspace.operators import vectors as V
from itemspace.operators.blocks import block_count
from itemspace.plans.catalog import query
from itemspace.plans.sqlgen import compare_ctes, kmeans_ctes, long_vectors
from itemspace.session import materialize, persist
from itemspace.sources import fixtures as fx

KS = [2, 3, 4]
ROUNDS = 5
RUNS = [("kmeans_l1", 1), ("kmeans_l2", 2), ("kmeans_raw", None)]
VS = fx.VECTORS_SQL


def run_vectors(spark, sf, p, vec=None):
    vec = fx.vectors(spark, sf).select("subject", "v") if vec is None else vec
    return vec if p is None else V.normalize_rows(V.shift_nonnegative(vec), p)


def grid_sweep(spark, sf, vec=None, wide=False):
    """(stacked vectors(subject, v, run), assignments(subject, run, k,
    prediction, sqdist)) of the F9 runs, all swept in the same passes; with ``wide`` the
    vectors with their assignments (``cluster.assign_all``)."""
    stacked = reduce(DataFrame.unionByName, [
        run_vectors(spark, sf, p, vec).withColumn("run", F.lit(i)) for i, (_, p) in enumerate(RUNS)])
    a, _ = K.lloyd_sweep(stacked, KS, ROUNDS, dims=64, group="run", wide=wide)
    return stacked, a


def run_name(col="run"):
    return F.element_at(F.array(*[F.lit(r) for r, _ in RUNS]), F.col(col) + 1)


def grid_predictions(spark, sf) -> DataFrame:
    """predictions(run_id, k, subject, prediction) of the F9 runs."""
    _, a = grid_sweep(spark, sf)
    return a.select(run_name().alias("run_id"), F.col("k").cast("int").alias("k"),
                    "subject", F.col("prediction").cast("int").alias("prediction"))


def grid_runs(spark, sf) -> DataFrame:
    """Run parameter table of the F9 grid."""
    rows = [(r, "embedding", "none" if p is None else f"l{p}", "kmeans", "none", None, True) for r, p in RUNS]
    return spark.createDataFrame(rows, "run_id string, mode string, norm string, cluster_method string, "
                                       "dimred_method string, n_components int, is_orig_dim boolean")


METRIC_NAMES = ["davies_bouldin_score", "calinski_harabasz_score", "silhouette_score"]


def grid_run_metrics(spark, sf) -> DataFrame:
    """run_metrics(run_id, k, davies_bouldin_score, calinski_harabasz_score,
    silhouette_score, inertia, n_labels, COR_<metric>...) for the F9 grid:
    every run and K scored in the same jobs (grouped by run, k)."""
    from itemspace.operators import metrics as M
    # the table is dealt once, as narrow as it is stored; every run's vectors lie as its rows do
    table = fx.table(spark, sf, "embeddings").select("vec_id", "embedding")
    held = persist(table.repartition(block_count(table.count()), "vec_id"))
    vec = held.select(F.col("vec_id").alias("subject"), F.col("embedding").cast("array<double>").alias("v"))
    _, rows = grid_sweep(spark, sf, vec, wide=True)
    # vectors keep their labels beside them, for the cluster statistics and the silhouette
    data = M.labelled_in_place(rows.withColumn("labels", F.transform("near", lambda s: s["id"])), KS, group="run")
    st = M.cluster_stats(data.rows(), ["run", "k"], dims=64)
    g = ["run", "k"]
    # the outer form: a filter on near's size would assign every row again
    a = (rows.select("run", F.posexplode_outer("near").alias("_ki", "_near")).where(F.col("_ki").isNotNull())
         .select("run", F.element_at(F.array(*[F.lit(k) for k in KS]), F.col("_ki") + 1).alias("k"),
                 F.col("_near.id").alias("prediction"), F.col("_near.dist").alias("sqdist")))
    m = (M.davies_bouldin(st, g).join(M.calinski_harabasz(st, g), g)
         .join(M.silhouette_of(spark, data), g)
         .join(a.groupBy(*g).agg(F.sum("sqdist").alias("inertia"),
                                 F.count_distinct("prediction").alias("n_labels")), g))
    m = materialize(m)  # runs x K rows, read by every report table
    data.release()
    held.unpersist()
    cor = M.metric_inertia_correlation(m, METRIC_NAMES, ["run"])
    return m.join(cor, "run").select(run_name().alias("run_id"), F.col("k").cast("int").alias("k"),
                                     *METRIC_NAMES, "inertia", "n_labels", *[f"COR_{n}" for n in METRIC_NAMES])


def _norm_long_sql(p):
    base = long_vectors(VS)
    if p is None:
        return base
    nexpr = "sum(abs(w)) over (partition by subject)" if p == 1 else "sqrt(sum(w * w) over (partition by subject))"
    return (f"select subject, d, case when nr > 0 then w / nr else w end as x from ("
            f"select subject, d, w, {nexpr} as nr from ("
            f"select subject, d, x + (select abs(min(x)) from ({base})) as w from ({base})))")


def _grid_sql():
    ctes, preds = [], []
    for i, (run_id, p) in enumerate(RUNS):
        c, pred = kmeans_ctes(_norm_long_sql(p), KS, ROUNDS, prefix=f"g{i}")
        ctes.append(c)
        preds.append(f"select '{run_id}' as run_id, cast(k as integer) as k, subject, "
                     f"cast(prediction as integer) as prediction from {pred}")
    return ",\n".join(ctes) + ",\npred as (" + " union all ".join(preds) + ")"


GRID = _grid_sql()
CMP = "with recursive " + GRID + compare_ctes("pred")


@query("grid_predictions", "with " + GRID + " select * from pred")
def q_grid_predictions(spark, sf):
    return grid_predictions(spark, sf)


@query("random_run", "with " + GRID + f""",
rng as (select run_id, min(prediction) as lo, max(prediction) as hi from pred group by run_id)
select p.run_id as run_a, p.k, p.subject, p.prediction as la,
       cast(lo + cast('0x' || substr(md5(concat_ws(':', '42', 'randomGuess', cast(p.run_id as varchar),
            cast(p.k as varchar), cast(p.subject as varchar))), 1, 8) as bigint) % (hi - lo + 1) as integer) as lb
from pred p join rng using (run_id)""")
def q_random_run(spark, sf):
    return CP.random_run(grid_predictions(spark, sf))


@query("random_run_per_k", "with " + GRID + f""",
rng as (select run_id, k, min(prediction) as lo, max(prediction) as hi from pred group by run_id, k)
select p.run_id as run_a, p.k, p.subject, p.prediction as la,
       cast(lo + cast('0x' || substr(md5(concat_ws(':', '42', 'randomGuess', cast(p.run_id as varchar),
            cast(p.k as varchar), cast(p.subject as varchar))), 1, 8) as bigint) % (hi - lo + 1) as integer) as lb
from pred p join rng using (run_id, k)""")
def q_random_run_per_k(spark, sf):
    return CP.random_run(grid_predictions(spark, sf), per_k=True)


@query("enumerate_pairs", "with " + GRID + """
select a.run_id as run_a, b.run_id as run_b from (select distinct run_id from pred) a
join (select distinct run_id from pred) b on a.run_id < b.run_id""")
def q_enumerate_pairs(spark, sf):
    return CP.enumerate_pairs(grid_predictions(spark, sf).select("run_id").distinct())


@query("pair_contingency", CMP + " select run_a, run_b, k, la, lb, n from cmp_cont")
def q_pair_contingency(spark, sf):
    p = grid_predictions(spark, sf)
    return CP.pair_contingency(p).unionByName(CP.random_contingency(p))


def _scores(spark, sf):
    return CP.pairwise_scores(grid_predictions(spark, sf))


@query("adjusted_rand_pairs", CMP + " select run_a, run_b, k, round(randindex, 6) as randindex, "
                                     "cast(n as bigint) as n from cmp_ari")
def q_adjusted_rand_pairs(spark, sf):
    p = grid_predictions(spark, sf)
    cont = CP.pair_contingency(p).unionByName(CP.random_contingency(p))
    return CP.adjusted_rand(cont).select(*CP.PAIR, F.round("randindex", 6).alias("randindex"),
                                         F.col("n").cast("long").alias("n"))


@query("match_labels", CMP + " select run_a, run_b, k, la, lb, la_present, matched from cmp_map")
def q_match_labels(spark, sf):
    p = grid_predictions(spark, sf)
    return CP.match_labels(CP.pair_contingency(p).unionByName(CP.random_contingency(p)))


_SC = ["randindex", "f1", "randindex_vs_randint", "f1_vs_randint", "perf_randindex_raw", "perf_f1_raw"]


@query("pairwise_scores", CMP + " select run_a, run_b, k, cast(n as bigint) as n, " +
       ", ".join(f"round({c}, 6) as {c}" for c in _SC) + " from cmp_scores")
def q_pairwise_scores(spark, sf):
    s = _scores(spark, sf)
    return s.select(*CP.PAIR, F.col("n").cast("long").alias("n"), *[F.round(c, 6).alias(c) for c in _SC])


@query("pairwise_summary", CMP + """
select run_a, run_b,
  round(max(perf_f1_raw), 6) as perf_f1_max, arg_min(k, (-perf_f1_raw, k)) as perf_f1_max_k,
  round(avg(perf_f1_raw), 6) as perf_f1_mean,
  round(max(perf_randindex_raw), 6) as perf_randindex_max, arg_min(k, (-perf_randindex_raw, k)) as perf_randindex_max_k,
  round(avg(perf_randindex_raw), 6) as perf_randindex_mean
from cmp_scores group by run_a, run_b""")
def q_pairwise_summary(spark, sf):
    m = CP.score_margin(_scores(spark, sf))
    return m.select("run_a", "run_b", *[F.round(c, 6).alias(c) if not c.endswith("_k") else F.col(c)
                                        for c in m.columns if c not in ("run_a", "run_b")])


@query("predictions_wide", "with " + GRID + """
select run_id, subject, max(case when k = 2 then prediction end) as pred_k2,
       max(case when k = 3 then prediction end) as pred_k3, max(case when k = 4 then prediction end) as pred_k4
from pred group by run_id, subject""")
def q_predictions_wide(spark, sf):
    return CP.predictions_wide(grid_predictions(spark, sf), KS)


# ------------------------------------------------------------- F7 labelings
LBL = "(select doc_id, quality as la, toxic as lb from labels)"


@query("contingency", f"select la, lb, count(*) as n from {LBL} group by la, lb")
def q_contingency(spark, sf):
    return CP.contingency(fx.partitions(spark, sf), "quality", "toxic")


@query("adjusted_rand", "with c as (select 1 as g, la, lb, count(*) as n from labels_l group by la, lb)".replace(
    "labels_l", LBL) + " select round(" + __import__("itemspace.plans.sqlgen", fromlist=["x"]).ari_expr() +
    ", 6) as randindex from " + __import__("itemspace.plans.sqlgen", fromlist=["x"])._ari("c", "g"))
def q_adjusted_rand(spark, sf):
    c = CP.contingency(fx.partitions(spark, sf), "quality", "toxic")
    return CP.adjusted_rand(c, []).select(F.round("randindex", 6).alias("randindex"))


@query("micro_f1", f"""
with c as (select la, lb, count(*) as n from {LBL} group by la, lb),
t as (select sum(n) as nn from c),
s as (select greatest(coalesce((select n from c where la = 0 and lb = 0), 0) + coalesce((select n from c where la = 1 and lb = 1), 0),
                      coalesce((select n from c where la = 0 and lb = 1), 0) + coalesce((select n from c where la = 1 and lb = 0), 0)) as m)
select round(m / nn, 6) as f1 from s, t""")
def q_micro_f1(spark, sf):
    c = CP.contingency(fx.partitions(spark, sf), "quality", "toxic")
    c = c.select(F.lit("quality").alias("run_a"), F.lit("toxic").alias("run_b"), F.lit(1).alias("k"), "la", "lb", "n")
    return CP.micro_f1(CP.match_labels(c), c).select(F.round("f1", 6).alias("f1"))


@query("subject_diff", f"""
with a as (select distinct subject from ({fx.RESPONSES_SQL}) group by subject having count(answer) = {fx.N_ITEMS_F1}),
b as (select subject from ({fx.SUBJECT_SIDE_SQL}) where age between 18 and 80),
j as (select a.subject as sa, b.subject as sb from a full outer join b on a.subject = b.subject)
select count(sa) as n_a, count(sb) as n_b, count(*) filter (where sa is not null and sb is not null) as n_common,
       count(*) filter (where sa is null or sb is null) as n_diff,
       round(count(*) filter (where sa is null or sb is null) / floor((count(sa) + count(sb)) / 2) * 100, 6) as diff_pct
from j""")
def q_subject_diff(spark, sf):
    from itemspace.operators import clean as C
    a = C.drop_incomplete_long(fx.responses(spark, sf), fx.N_ITEMS_F1)
    b = C.filter_between(fx.subject_side(spark, sf), "age", 18, 80)
    d = CP.subject_diff(a, b)
    return d.select("n_a", "n_b", "n_common", "n_diff", F.round("diff_pct", 6).alias("diff_pct"))


_VARIED = GRID + """,
varied as (select run_id, k, subject, prediction from pred
  union all select 'without_k4', k, subject, prediction from pred where run_id = 'kmeans_l2' and k < 4
  union all select 'one_cluster', k, subject, prediction from pred where run_id = 'kmeans_l2'
    and subject in (select subject from pred where run_id = 'kmeans_l2' and k = 2 and prediction = 0)
  union all select 'copy', k, subject, prediction from pred where run_id = 'kmeans_l2')"""


def varied_predictions(spark, sf):
    """The grid's runs, and variants of one that differ in K, in subjects, or not at all."""
    pred = grid_predictions(spark, sf).select("run_id", "k", "subject", "prediction")
    base = pred.where(F.col("run_id") == "kmeans_l2")
    inside = base.where("k = 2 and prediction = 0").select("subject")
    parts = [("without_k4", base.where("k < 4")), ("one_cluster", base.join(inside, "subject", "left_semi")), ("copy", base)]
    for name, part in parts:
        pred = pred.unionByName(part.withColumn("run_id", F.lit(name)))
    return pred


@query("check_comparable", "with " + _VARIED + """,
r as (select run_id, list_sort(list(distinct k)) as ks, count(distinct subject) as n from varied group by run_id),
p as (select a.run_id as run_a, b.run_id as run_b, a.ks = b.ks as same_k, a.n as na, b.n as nb
      from r a join r b on a.run_id < b.run_id),
s as (select distinct run_id, subject from varied),
c as (select a.run_id as run_a, b.run_id as run_b, count(*) as common from s a join s b using (subject)
      where a.run_id < b.run_id group by a.run_id, b.run_id),
d as (select a.run_id as run_a, b.run_id as run_b, count(*) as same from varied a join varied b
      on a.subject = b.subject and a.k = b.k and a.prediction = b.prediction and a.run_id < b.run_id
      group by a.run_id, b.run_id),
z as (select run_id, count(*) as m from varied group by run_id)
select p.run_a, p.run_b, same_k, na = nb as same_n,
       coalesce(d.same, 0) = za.m and za.m = zb.m as identical,
       na + nb - 2 * coalesce(common, 0) as n_diff,
       round((na + nb - 2 * coalesce(common, 0)) / floor((na + nb) / 2) * 100, 6) as diff_pct
from p left join c using (run_a, run_b) left join d using (run_a, run_b)
join z za on za.run_id = p.run_a join z zb on zb.run_id = p.run_b""")
def q_check_comparable(spark, sf):
    out = CP.check_comparable(varied_predictions(spark, sf))
    return out.withColumn("diff_pct", F.round("diff_pct", 6))
