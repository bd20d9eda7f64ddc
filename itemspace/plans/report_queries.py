"""Run metrics of the F9 grid and the report tables built on them (K = 3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from itemspace.operators import compare as CP
from itemspace.operators import report as RP
from itemspace.plans.catalog import query
from itemspace.plans.compare_queries import (
    CMP, GRID, METRIC_NAMES, RUNS, grid_predictions, grid_run_metrics, grid_runs,
)
from itemspace.plans.sqlgen import metric_ctes
from itemspace.sources import fixtures as fx

K_REPORT = 3


def _grid_metrics_sql() -> str:
    parts, sels = [], []
    for i, (rid, _p) in enumerate(RUNS):
        parts.append(f",\ngm{i}_va as (select subject, list(x order by d) as v from g{i}_v group by subject)")
        parts.append(metric_ctes(f"g{i}_a6", f"g{i}_v", f"gm{i}_va", p=f"m{i}"))
        sels.append(f"""select '{rid}' as run_id, cast(db.k as integer) as k, davies_bouldin_score,
  calinski_harabasz_score, silhouette_score, i.inertia, i.n_labels
  from m{i}_db db join m{i}_ch using (k) join m{i}_sil using (k)
  join (select k, sum(dist) as inertia, count(distinct prediction) as n_labels from g{i}_a6 group by k) i using (k)""")
    kend = []
    for m in METRIC_NAMES:
        kend.append(f"""(sum(sign(a.{m} - b.{m}) * sign(a.inertia - b.inertia)) /
    nullif(sqrt((count(*) - count(*) filter (where a.{m} = b.{m})) *
                (count(*) - count(*) filter (where a.inertia = b.inertia))), 0) + 1) / 2 as COR_{m}""")
    return ("".join(parts) + ",\nrm_base as (" + " union all ".join(sels) + ")" +
            ",\nrm_cor as (select a.run_id, " + ", ".join(kend) +
            " from rm_base a join rm_base b on a.run_id = b.run_id and a.k < b.k group by a.run_id)" +
            ",\nrm as (select * from rm_base join rm_cor using (run_id))")


GM = _grid_metrics_sql()
RM_SQL = "with recursive " + GRID[len(""):] + GM  # grid CTEs + run metrics
RPT = CMP + GM  # grid + comparison + run metrics

_R = {"davies_bouldin_score": 5, "calinski_harabasz_score": 4, "silhouette_score": 5}


@query("run_metrics", RM_SQL + "\nselect run_id, k, " + ", ".join(
    f"round({m}, {d}) as {m}" for m, d in _R.items()) + ", round(inertia, 4) as inertia, n_labels, " +
    ", ".join(f"round(COR_{m}, 6) as COR_{m}" for m in METRIC_NAMES) + " from rm")
def q_run_metrics(spark, sf):
    m = grid_run_metrics(spark, sf)
    return m.select("run_id", "k", *[F.round(c, d).alias(c) for c, d in _R.items()],
                    F.round("inertia", 4).alias("inertia"), F.col("n_labels").cast("long").alias("n_labels"),
                    *[F.round(f"COR_{n}", 6).alias(f"COR_{n}") for n in METRIC_NAMES])


def _long_round(df, d=6):
    return df.select("metric", "run_row", "run_col", F.round("value", d).alias("value"))


def _both(sql_ab: str, sql_ba: str) -> str:
    return f"({sql_ab} union all {sql_ba})"


_SYM = " union all ".join(
    f"select '{m}' as metric, run_a as run_row, run_b as run_col, {m} as value from cmp_scores where k = {K_REPORT} "
    f"union all select '{m}', run_b, run_a, {m} from cmp_scores where k = {K_REPORT}" for m in RP.MATRIX_SCORES)


@query("symmetric_matrix", CMP + f"\nselect metric, run_row, run_col, round(value, 6) as value from ({_SYM})")
def q_symmetric_matrix(spark, sf):
    return _long_round(RP.symmetric_matrix(CP.pairwise_scores(grid_predictions(spark, sf)), K_REPORT))


@query("random_threshold", CMP + f"""
select round(case when f = 0.5 then f - 0.001 else f end, 6) as random_thsh_f1,
       round(case when r = 0.5 then r - 0.001 else r end, 6) as random_thsh_randindex
from (select avg(f1_vs_randint) as f, avg(randindex_vs_randint) as r from cmp_scores where k = {K_REPORT})""")
def q_random_threshold(spark, sf):
    t = RP.random_threshold(CP.pairwise_scores(grid_predictions(spark, sf)), K_REPORT)
    return t.select(*[F.round(c, 6).alias(c) for c in t.columns])


_BEST = (f"select greatest(max(davies_bouldin_score), 0.0) as davies_bouldin_score, "
         f"greatest(max(calinski_harabasz_score), 0.0) as calinski_harabasz_score, "
         f"(greatest(max(silhouette_score), 0.0) + 1) / 2 as silhouette_score from rm where k = {K_REPORT}")


@query("metric_maxima", RM_SQL + f"\nselect round(davies_bouldin_score, 5) as davies_bouldin_score, "
       f"round(calinski_harabasz_score, 4) as calinski_harabasz_score, "
       f"round(silhouette_score, 5) as silhouette_score from ({_BEST})")
def q_metric_maxima(spark, sf):
    m = RP.metric_maxima(grid_run_metrics(spark, sf), K_REPORT)
    return m.select(*[F.round(c, d).alias(c) for c, d in _R.items()])


def _scaled_sql(m, v):
    if "silhouette" in m:
        return f"(({v} + 1) / 2 / bst.{m})"
    if "davies" in m:
        return f"(1 - {v} / bst.{m})"
    return f"({v} / bst.{m})"


def _share_sql() -> str:
    sel = []
    for m in METRIC_NAMES:
        va, vb = _scaled_sql(m, f"ra.{m}"), _scaled_sql(m, f"rb.{m}")
        den = f"({va} + {vb} + case when {va} + {vb} = 0 then 1e-8 else 0.0 end)"
        sel.append(f"select '{m}' as metric, p.run_a as run_row, p.run_b as run_col, {va} / {den} as value {{F}}")
        sel.append(f"select '{m}', p.run_b, p.run_a, {vb} / {den} {{F}}")
    frm = (f"from (select distinct run_a, run_b from cmp_scores where run_a <> 'randomGuess' and run_b <> 'randomGuess') p "
           f"join (select * from rm where k = {K_REPORT}) ra on ra.run_id = p.run_a "
           f"join (select * from rm where k = {K_REPORT}) rb on rb.run_id = p.run_b cross join ({_BEST}) bst")
    return " union all ".join(s.replace("{F}", frm) for s in sel)


def _cor_sql() -> str:
    frm = (f"from (select distinct run_a, run_b from cmp_scores where run_a <> 'randomGuess' and run_b <> 'randomGuess') p "
           f"join (select * from rm where k = {K_REPORT}) ra on ra.run_id = p.run_a "
           f"join (select * from rm where k = {K_REPORT}) rb on rb.run_id = p.run_b")
    return " union all ".join(
        f"select '{m}' as metric, p.run_a as run_row, p.run_b as run_col, ra.COR_{m} as value {frm} "
        f"union all select '{m}', p.run_b, p.run_a, rb.COR_{m} {frm}" for m in METRIC_NAMES)


def _spark_report_inputs(spark, sf):
    """Run metrics and the (non-random) run pairs they are compared over."""
    rm = grid_run_metrics(spark, sf)
    pairs = CP.enumerate_pairs(rm.select("run_id").distinct())
    return None, rm, pairs


@query("relative_metric_share", RPT + f",\nsh as ({_share_sql()})\n"
       "select metric, run_row, run_col, round(value, 6) as value from sh")
def q_relative_metric_share(spark, sf):
    scores, rm, pairs = _spark_report_inputs(spark, sf)
    return _long_round(RP.relative_metric_share(rm, pairs, K_REPORT))


@query("correlation_matrix", RPT + f",\nco as ({_cor_sql()})\n"
       "select metric, run_row, run_col, round(value, 6) as value from co")
def q_correlation_matrix(spark, sf):
    scores, rm, pairs = _spark_report_inputs(spark, sf)
    return _long_round(RP.correlation_matrix(rm, pairs, K_REPORT))


_MINMAX = """mm as (select sh.metric, sh.run_row, sh.run_col, (value - mn) / (mx - mn) as value from sh
            join (select metric, min(value) as mn, max(value) as mx from sh group by metric) s using (metric))"""


@query("minmax_matrix", RPT + f",\nsh as ({_share_sql()}),\n{_MINMAX}\n"
       "select metric, run_row, run_col, round(value, 6) as value from mm")
def q_minmax_matrix(spark, sf):
    scores, rm, pairs = _spark_report_inputs(spark, sf)
    return _long_round(RP.minmax_matrix(RP.relative_metric_share(rm, pairs, K_REPORT)))


@query("combined_metric", RPT + f",\nsh as ({_share_sql()}),\n{_MINMAX},\nco as ({_cor_sql()}),\n" + """
j as (select run_row, run_col, im, c from (select run_row, run_col, avg(value) as im from mm group by run_row, run_col)
      join (select run_row, run_col, avg(value) as c from co group by run_row, run_col) using (run_row, run_col))
select metric, run_row, run_col, round(value, 6) as value from (
  select 'combined' as metric, run_row, run_col, im as value from j union all
  select 'combined_cor', run_row, run_col, c from j union all
  select 'combined_diff', run_row, run_col, abs(abs(im) - abs(c)) from j)""")
def q_combined_metric(spark, sf):
    scores, rm, pairs = _spark_report_inputs(spark, sf)
    shares = RP.minmax_matrix(RP.relative_metric_share(rm, pairs, K_REPORT))
    return _long_round(RP.combined_metric(shares, RP.correlation_matrix(rm, pairs, K_REPORT)))


_EDGES = f"""summ as (select run_a, run_b, avg(perf_f1_raw) as pf, avg(perf_randindex_raw) as pr from cmp_scores
                 group by run_a, run_b),
st as (select min(wk) as mi, avg(wk) as mea from (select (perf_randindex_raw + perf_f1_raw) / 2 as wk
       from cmp_scores where k = {K_REPORT})),
ed as (select run_a as src, run_b as dst, power(((pf + pr) / 2 - mi + 0.1) / (mea - mi + 0.1) + 2, 2) as weight,
              (pf + pr) / 2 as raw_weight from summ, st)"""


@query("similarity_edges", CMP + ",\n" + _EDGES +
       "\nselect src, dst, round(weight, 6) as weight, round(raw_weight, 6) as raw_weight from ed")
def q_similarity_edges(spark, sf):
    scores = CP.pairwise_scores(grid_predictions(spark, sf))
    e = RP.similarity_edges(CP.score_margin(scores), scores, K_REPORT)
    return e.select("src", "dst", F.round("weight", 6).alias("weight"), F.round("raw_weight", 6).alias("raw_weight"))


@query("similarity_nodes", CMP + ",\n" + _EDGES + """
select name, case when contains(name, 'feat_raw') or contains(name, 'feat_agg') then 'feature' else 'model' end as kind
from (select src as name from ed union select dst from ed)""")
def q_similarity_nodes(spark, sf):
    scores = CP.pairwise_scores(grid_predictions(spark, sf))
    return RP.similarity_nodes(RP.similarity_edges(CP.score_margin(scores), scores, K_REPORT))


_LABEL_ROWS = " union all ".join(
    f"select '{r}' as run_id, 'embedding|{'none' if p is None else f'l{p}'}|kmeans|none|OrigD' as label"
    for r, p in RUNS)


@query("run_label", "with " + GRID[:0] + f"x as (select 1) select run_id, label from ({_LABEL_ROWS}) "
       "where run_id in (select distinct run_id from (" + "with " + GRID + " select run_id from pred))")
def q_run_label(spark, sf):
    used = grid_predictions(spark, sf).select("run_id").distinct()
    return RP.run_label(grid_runs(spark, sf)).join(used, "run_id", "left_semi")


@query("check_unique_runs", CMP + """
select 'duplicate_pair' as rule, run_a, run_b, count(*) as n from cmp_scores group by run_a, run_b having count(*) > 1
union all select 'self_pair', run_a, run_a, count(distinct k) from cmp_scores group by run_a""")
def q_check_unique_runs(spark, sf):
    """The raw per-K score rows (a pair stands once per K, so each is found) and
    every run paired with itself once per K."""
    pairs = CP.pairwise_scores(grid_predictions(spark, sf)).select("run_a", "run_b", "k")
    own = pairs.select("run_a", F.col("run_a").alias("run_b"), "k").distinct()
    found = RP.check_unique_runs(pairs.unionByName(own).drop("k"))
    return found.where((F.col("rule") == "self_pair") | (F.col("run_a") != F.col("run_b")))


@query("exclude_runs", CMP + """
select run_a, run_b, round(avg(perf_f1_raw), 6) as perf_f1_mean from cmp_scores
where not (contains(lower(run_a), 'raw') or contains(lower(run_b), 'raw')) group by run_a, run_b""")
def q_exclude_runs(spark, sf):
    m = CP.score_margin(CP.pairwise_scores(grid_predictions(spark, sf)))
    return RP.exclude_runs(m, ["RAW"]).select("run_a", "run_b", F.round("perf_f1_mean", 6).alias("perf_f1_mean"))


@query("json_lists", RM_SQL + """
select run_id, k, round(silhouette_score, 5) as silhouette_score from rm""")
def q_json_lists(spark, sf):
    """Per-K values held as JSON text per run (as the run tables store them)
    and zipped back to K."""
    m = grid_run_metrics(spark, sf)
    js = m.groupBy("run_id").agg(
        F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("k", "silhouette_score"))),
                              lambda s: s["silhouette_score"])).alias("silhouette_json"),
        F.sort_array(F.collect_list("k")).alias("K_list"))
    back = js.select("run_id", F.explode(F.arrays_zip(F.col("K_list").alias("k"),
                                                      F.from_json("silhouette_json", "array<double>").alias("s"))).alias("z"))
    return back.select("run_id", F.col("z.k").alias("k"), F.round("z.s", 5).alias("silhouette_score"))


@query("attach_run_params", CMP + """,
summ as (select run_a, run_b, avg(perf_f1_raw) as pf from cmp_scores group by run_a, run_b),
rp as (""" + " union all ".join(
    f"select '{r}' as run_id, 'embedding' as mode, '{'none' if p is None else f'l{p}'}' as norm, "
    "'kmeans' as cluster_method" for r, p in RUNS) + """)
select s.run_a, s.run_b, a.norm as normA, b.norm as normB, a.cluster_method as cluster_methodA,
       round(s.pf, 6) as perf_f1_mean
from summ s join rp a on a.run_id = s.run_a left join rp b on b.run_id = s.run_b""")
def q_attach_run_params(spark, sf):
    m = CP.score_margin(CP.pairwise_scores(grid_predictions(spark, sf)))
    runs = grid_runs(spark, sf)
    a = runs.select(F.col("run_id").alias("run_a"), F.col("norm").alias("normA"),
                    F.col("cluster_method").alias("cluster_methodA"))
    b = runs.select(F.col("run_id").alias("run_b"), F.col("norm").alias("normB"))
    return (m.join(a, "run_a").join(b, "run_b", "left")
            .select("run_a", "run_b", "normA", "normB", "cluster_methodA",
                    F.round("perf_f1_mean", 6).alias("perf_f1_mean")))


@query("metric_maxima_first_side", RM_SQL + f"\nselect round(davies_bouldin_score, 5) as davies_bouldin_score, "
       f"round(calinski_harabasz_score, 4) as calinski_harabasz_score, round(silhouette_score, 5) as silhouette_score "
       f"from ({_BEST} and run_id <> '{max(r for r, _ in RUNS)}')")
def q_metric_maxima_first_side(spark, sf):
    """The last run by name stands only on second sides."""
    pairs = CP.enumerate_pairs(grid_runs(spark, sf))
    m = RP.metric_maxima(grid_run_metrics(spark, sf), K_REPORT, pairs=pairs)
    return m.select(*[F.round(c, d).alias(c) for c, d in _R.items()])


_PARAM_ROWS = " union all ".join(
    f"select '{r}' as run_id, 'embedding' as mode, '{'none' if p is None else f'l{p}'}' as norm, 'kmeans' as cluster_method, "
    "'none' as dimred_method, null::integer as n_components" for r, p in RUNS)


@query("pair_run_params", CMP + f""",
summ as (select run_a, run_b, avg(perf_f1_raw) as pf from cmp_scores group by run_a, run_b), rp as ({_PARAM_ROWS})
select s.run_a, s.run_b, """ + ", ".join(f"{x}.{p} as {p}{x.upper()}" for x in "ab" for p in RP.PARAMS) + """,
  round(s.pf, 6) as perf_f1_mean
from summ s left join rp a on a.run_id = s.run_a left join rp b on b.run_id = s.run_b""")
def q_pair_run_params(spark, sf):
    """All five parameters of both sides."""
    m = CP.score_margin(CP.pairwise_scores(grid_predictions(spark, sf)))
    return (RP.attach_run_params(m.select("run_a", "run_b", "perf_f1_mean"), grid_runs(spark, sf))
            .withColumn("perf_f1_mean", F.round("perf_f1_mean", 6)))


@query("labelled_edges", CMP + ",\n" + _EDGES + """
select src, dst, round(weight, 6) as weight, contains(src, 'l1') or contains(dst, 'l1') as show_label from ed""")
def q_labelled_edges(spark, sf):
    scores = CP.pairwise_scores(grid_predictions(spark, sf))
    e = RP.similarity_edges(CP.score_margin(scores), scores, K_REPORT)
    return RP.labelled_edges(e, ("l1",)).select("src", "dst", F.round("weight", 6).alias("weight"), "show_label")


# Parameter tables made of the events: every kind of event as a model, and the sources.
_NAMED = """(select distinct event_type || '|' || m as run_id, case m when 'llm' then 'llm_' || event_type
    when 'random' then 'llm_random_' || length(event_type) else m end as mode,
  case when length(event_type) % 2 = 0 then 'l1' else 'none' end as norm,
  case when length(event_type) % 3 = 0 then 'BisectingKMeans' when length(event_type) % 3 = 1 then 'kmeans' else event_type end
    as cluster_method,
  case when length(event_type) % 2 = 0 then 'pca' else event_type end as dimred_method,
  case when length(event_type) % 2 = 0 then length(event_type) end as n_components
from events, (values ('llm'), ('random'), ('feat_raw'), ('feat_agg_no_norm')) t(m))"""


@query("display_name", f"""
select run_id, case when mode = 'feat_raw' then ' FeaturesRaw' when mode = 'feat_agg_no_norm' then ' FeaturesAggloNoNorm'
    when starts_with(mode, 'llm_random') then ' RandomVec' || replace(mode, 'llm_random_', '') || 'D' else 'sbert?' end
  || ' ' || case when cluster_method = 'BisectingKMeans' then 'BisKMeans' when cluster_method = 'kmeans' then 'KMeans' else 'meth?' end
  || ' ' || case norm when 'l1' then 'L1' else 'norm?' end || ' ' || case dimred_method when 'pca' then 'PCA' else 'dimred?' end
  || ' D' || coalesce(cast(n_components as varchar), 'OrigD') as label
from {_NAMED}""")
def q_display_name(spark, sf):
    kind, m = F.col("event_type"), F.col("m")
    n = F.length(kind)
    runs = (fx.table(spark, sf, "events").select("event_type").distinct()
            .withColumn("m", F.explode(F.array(*[F.lit(x) for x in ("llm", "random", "feat_raw", "feat_agg_no_norm")])))
            .select(F.concat_ws("|", kind, m).alias("run_id"),
                    F.when(m == "llm", F.concat(F.lit("llm_"), kind)).when(m == "random", F.concat(F.lit("llm_random_"), n.cast("string")))
                    .otherwise(m).alias("mode"),
                    F.when(n % 2 == 0, F.lit("l1")).otherwise(F.lit("none")).alias("norm"),
                    F.when(n % 3 == 0, F.lit("BisectingKMeans")).when(n % 3 == 1, F.lit("kmeans")).otherwise(kind).alias("cluster_method"),
                    F.when(n % 2 == 0, F.lit("pca")).otherwise(kind).alias("dimred_method"),
                    F.when(n % 2 == 0, n).alias("n_components")))
    return RP.display_name(runs)


@query("same_name_runs", CMP + """
select 'same_name' as rule, run_a, run_b, count(*) as n from cmp_scores where run_b <> 'randomGuess' group by run_a, run_b""")
def q_same_name_runs(spark, sf):
    """Runs whose names leave out what tells them apart: every pair is found."""
    pairs = CP.pairwise_scores(grid_predictions(spark, sf)).select("run_a", "run_b")
    labels = RP.display_name(grid_runs(spark, sf).withColumn("norm", F.lit("l2")).withColumn("mode", F.lit("feat_raw")))
    return RP.check_unique_runs(pairs, labels=labels).where("rule = 'same_name'")
