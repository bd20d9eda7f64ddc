"""Grid runs over the F1 survey, result sinks read back with partition
pruning, and the streaming scorer fed with the F1 answers."""

from __future__ import annotations

import functools
import os
import uuid

from pyspark.sql import functions as F

from itemspace.operators import clean as C
from itemspace.operators import cluster as K
from itemspace.operators import encode as E
from itemspace.operators import vectors as V
from itemspace.plans import flagship
from itemspace.plans.catalog import query
from itemspace.plans.compare_queries import GRID, grid_predictions
from itemspace.plans.grid import param_grid, run_grid, run_grid_durable
from itemspace.plans.sqlgen import kmeans_ctes
from itemspace.plans.survey_queries import _embed_sql
from itemspace.session import checkpoint_dir
from itemspace.sources import fixtures as fx
from itemspace.sources import readers as RD
from itemspace.sources import sinks as SK
from itemspace.streaming.keyed_scoring import start_keyed_scoring
from itemspace.streaming.score_stream import score_batch, start_scoring


def _scratch(spark, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:8]}")


def mode_parts(mode: str) -> tuple[str, bool, int | None]:
    """(source, no_norm, random dims) of a mode name; the operator on a one-row
    parameter table would be ``functions.text.parse_mode``."""
    base = mode.removesuffix("_no_norm")
    if base.startswith("llm_random_"):
        dims = base.removeprefix("llm_random_")
        if not dims.isdigit():
            raise ValueError(f"mode {mode!r} names no number of dimensions")
        return "random", base != mode, int(dims)
    if base not in ("feat_raw", "feat_agg", "embed"):
        raise ValueError(f"no mode is called {mode!r}")
    return base, base != mode, None


# Subscales of the 7-item survey: item numbers.
_F1_SCALES = ((1, 4, 7), (2, 5), (3, 6))


def _build_vectors(spark, sf):
    def build(cell):
        source, no_norm, dims = mode_parts(cell["mode"])
        if source in ("feat_raw", "feat_agg"):
            wide = C.drop_incomplete(fx.survey_wide(spark, sf), fx.Q_COLS)
            if source == "feat_agg":
                sums = [sum((F.col(f"q{i}") for i in items), F.lit(0)).alias(f"s{n}") for n, items in enumerate(_F1_SCALES)]
                wide = wide.select("subject", *sums)
            vec = V.wide_to_vectors(wide, [c for c in wide.columns if c[0] in "qs" and c[1:].isdigit()])
        else:
            items = fx.item_vectors(spark, sf)
            if source == "random":
                items = E.encode_random(items, "item_id", dims).withColumnRenamed("v", "e")
            vec = V.shift_nonnegative(V.embed_subjects(fx.responses(spark, sf), items, n_items=fx.N_ITEMS_F1))
        return vec if no_norm else V.normalize_rows(vec, 1 if cell["norm"] == "l1" else 2)
    return build


_GRID_CELLS = [(m, d, n) for m in ("feat_raw", "embed") for d, n in
               (("pca", None), ("pca", 3), ("pca", 8), ("nmf", None))]
_GRID_DIMS = {"feat_raw": fx.N_ITEMS_F1, "embed": 64}


@query("run_grid", f"""
with c as (select * from (values {", ".join(f"('{m}', '{d}', {'null' if n is None else n})" for m, d, n in _GRID_CELLS)})
           t(mode, dimred_method, n_components)),
dm as (select * from (values ('feat_raw', {_GRID_DIMS["feat_raw"]}), ('embed', {_GRID_DIMS["embed"]})) t(mode, d)),
ns as (select count(*) as n from (select subject from ({fx.RESPONSES_SQL}) group by subject
                                  having count(answer) = {fx.N_ITEMS_F1}))
select c.mode, 'l2' as norm, c.dimred_method, c.n_components,
       case when dimred_method <> 'pca' and (n_components is null or n_components >= d) then 'skipped' else 'ok' end
         as status,
       case when dimred_method <> 'pca' and (n_components is null or n_components >= d) then null
            when n_components is null or n_components >= d then d else n_components end as n_dims,
       case when dimred_method <> 'pca' and (n_components is null or n_components >= d) then null
            else (select n from ns) end as n_subjects
from c join dm using (mode)""")
def q_run_grid(spark, sf):
    """A small grid on the F1 survey: raw answers and embeddings, PCA to 3 or
    8 dims or none (OrigD), and an NMF cell that the dimension rule skips."""
    opts = {"dataset": ["F1"], "norm": ["l2"], "cluster_method": ["kmeans"]}
    grid = None
    for m, d, n in _GRID_CELLS:
        g = param_grid(spark, {**opts, "mode": [m], "dimred_method": [d], "n_components": [n]})
        grid = g if grid is None else grid.unionByName(g)
    pred, _met, status = run_grid(spark, grid, _build_vectors(spark, sf), [2, 3])
    ns = pred.groupBy("run_id").agg(F.count_distinct("subject").alias("n_subjects"))
    return (grid.join(status, "run_id").join(ns, "run_id", "left")
            .select("mode", "norm", "dimred_method", "n_components", "status", "n_dims", "n_subjects"))


_DURABLE_CELLS = (("pca", None), ("pca", 3), ("nmf", None))


@query("run_grid_durable", f"""
with c as (select * from (values {", ".join(f"('{d}', {'null' if n is None else n})" for d, n in _DURABLE_CELLS)})
           t(dimred_method, n_components)),
ns as (select count(*) as n from (select subject from ({fx.RESPONSES_SQL}) group by subject
                                  having count(answer) = {fx.N_ITEMS_F1}))
select c.dimred_method, c.n_components, case dimred_method when 'nmf' then 'skipped' else 'ok' end as status,
       case dimred_method when 'nmf' then null else (select n from ns) end as n_subjects,
       case dimred_method when 'nmf' then null else 2 end as n_labels
from c""")
def q_run_grid_durable(spark, sf):
    """A grid whose first cell is run alone, and that is then taken up as a whole."""
    opts = {"dataset": ["F1"], "norm": ["l2"], "cluster_method": ["kmeans"], "mode": ["feat_raw"]}
    grid = functools.reduce(lambda a, b: a.unionByName(b), [
        param_grid(spark, {**opts, "dimred_method": [d], "n_components": [n]}) for d, n in _DURABLE_CELLS])
    folder, build = _scratch(spark, "grid"), _build_vectors(spark, sf)
    run_grid_durable(spark, grid.where("dimred_method = 'pca' and n_components is null"), build, [2], folder, n_init=3)
    pred, _met, status = run_grid_durable(spark, grid, build, [2], folder, n_init=3)
    n = pred.groupBy("run_id").agg(F.count_distinct("subject").alias("n_subjects"),
                                   F.count_distinct("prediction").cast("int").alias("n_labels"))
    return (grid.join(status, "run_id").join(n, "run_id", "left")
            .select("dimred_method", "n_components", "status", "n_subjects", "n_labels"))


_METHODS = (("kmeans", "feat_agg", "ok"), ("bisectingkmeans", "feat_agg_no_norm", "ok"),
            ("spectral", "feat_raw", "ok"), ("spectralcosine", "llm_random_16", "ok"),
            ("no such method", "feat_raw", "failed"), ("kmeans", "llm_random_x", "failed"))


@query("run_grid_methods", f"""
with c as (select * from (values {", ".join(f"('{m}', '{d}', '{s}')" for m, d, s in _METHODS)}) t(cluster_method, mode, status)),
ns as (select count(*) as n from (select subject from ({fx.RESPONSES_SQL}) group by subject
                                  having count(answer) = {fx.N_ITEMS_F1}))
select c.cluster_method, c.mode, c.status, case status when 'ok' then k.k end as k,
       case status when 'ok' then (select n from ns) end as n_subjects,
       case status when 'ok' then k.k end as n_labels, status = 'failed' as has_reason,
       status = 'ok' and cluster_method not like 'spectral%' as has_inertia
from c join (values (2), (3)) k(k) on c.status = 'ok' or k.k = 2""")
def q_run_grid_methods(spark, sf):
    """Every cluster method and several modes; unknown ones fail with a reason."""
    rows = [("F1", m, "l2", c, "pca", None) for c, m, _ in _METHODS]
    cells = [param_grid(spark, dict(zip(("dataset", "mode", "norm", "cluster_method", "dimred_method", "n_components"),
                                        ([x] for x in r)))) for r in rows]
    grid = functools.reduce(lambda a, b: a.unionByName(b), cells)
    pred, mets, status = run_grid(spark, grid, _build_vectors(spark, sf), [2, 3])
    n = pred.groupBy("run_id", "k").agg(F.count_distinct("subject").alias("n_subjects"),
                                        F.count_distinct("prediction").cast("int").alias("n_labels"))
    return (grid.join(status, "run_id").join(n, "run_id", "left")
            .join(mets.select("run_id", "k", "inertia"), ["run_id", "k"], "left")
            .select("cluster_method", "mode", "status", "k", "n_subjects", "n_labels",
                    F.col("reason").isNotNull().alias("has_reason"), F.col("inertia").isNotNull().alias("has_inertia")))


@query("run_tables_roundtrip", "with " + GRID + """
select run_id, k, cast(count(*) as bigint) as n, 'ok' as status, null::varchar as reason from pred group by run_id, k
union all select 'broken', null, null, 'failed', 'no such method'""")
def q_run_tables_roundtrip(spark, sf):
    """Run metrics and failures written to their folders and listed again."""
    path, failed = _scratch(spark, "metrics"), _scratch(spark, "failures")
    m = grid_predictions(spark, sf).groupBy("run_id", "k").agg(F.count("*").alias("n"))
    SK.write_run_metrics(m.withColumn("dataset", F.lit("F3")), path)
    SK.write_failures(spark.createDataFrame([("broken", "no such method")], "run_id string, reason string"), failed)
    ok = RD.list_runs(spark, path).select("run_id", "k", "n", F.lit("ok").alias("status"),
                                          F.lit(None).cast("string").alias("reason"))
    bad = spark.read.parquet(failed).select("run_id", F.lit(None).cast("int").alias("k"),
                                            F.lit(None).cast("long").alias("n"), F.lit("failed").alias("status"), "reason")
    return ok.unionByName(bad)


@query("predictions_roundtrip", "with " + GRID + " select run_id, k, subject, prediction from pred "
       "where run_id = 'kmeans_l2'")
def q_predictions_roundtrip(spark, sf):
    path = _scratch(spark, "predictions")
    SK.write_predictions(grid_predictions(spark, sf).withColumn("dataset", F.lit("F3")), path)
    _m, p = RD.read_run(spark, path, path, "kmeans_l2")
    return p.select("run_id", "k", "subject", "prediction")


_STREAM_KM, _STREAM_PRED = kmeans_ctes("select subject, d, x from u", [3], 5)


@query("score_stream", _embed_sql("max") + ",\n" + _STREAM_KM +
       f"\nselect subject, cast(k as integer) as k, cast(prediction as integer) as prediction from {_STREAM_PRED}")
def q_score_stream(spark, sf):
    """Train centres on the batch embeddings (K = 3), then stream the F1
    answers file by file through the scorer; the streamed assignment must
    equal the batch one."""
    emb_raw = V.embed_subjects(fx.responses(spark, sf), fx.item_vectors(spark, sf), n_items=fx.N_ITEMS_F1)
    shift = abs(emb_raw.agg(F.min(F.array_min("v"))).first()[0])
    train = flagship.subject_embeddings(spark, sf)
    _a, centres = K.lloyd_sweep(train, [3], 5, dims=64)
    src, sink, ck = _scratch(spark, "stream-src"), _scratch(spark, "stream-out"), _scratch(spark, "stream-ck")
    # arrival files: every subject's answers land in exactly one file
    fx.responses(spark, sf).repartition(4, "subject").write.parquet(src)
    q = start_scoring(spark, src, sink, ck, fx.item_vectors(spark, sf), fx.N_ITEMS_F1, shift, centres[3])
    q.awaitTermination()
    return spark.read.parquet(sink).select("subject", "k", "prediction")


@query("score_stream_keyed", _embed_sql("max") + ",\n" + _STREAM_KM +
       f"\nselect subject, cast(k as integer) as k, cast(prediction as integer) as prediction from {_STREAM_PRED}")
def q_score_stream_keyed(spark, sf):
    """The scorer with keyed state, fed with the F1 answers in files that split every
    subject's answers."""
    emb_raw = V.embed_subjects(fx.responses(spark, sf), fx.item_vectors(spark, sf), n_items=fx.N_ITEMS_F1)
    shift = abs(emb_raw.agg(F.min(F.array_min("v"))).first()[0])
    _a, centres = K.lloyd_sweep(flagship.subject_embeddings(spark, sf), [3], 5, dims=64)
    src, sink, ck = _scratch(spark, "keyed-src"), _scratch(spark, "keyed-out"), _scratch(spark, "keyed-ck")
    # as many files as the answers fill, dealt by (item, subject); three batches take them all
    fx.responses(spark, sf).repartition("item_id", "subject").write.parquet(src)
    files = len(spark.read.parquet(src).inputFiles())
    q = start_keyed_scoring(spark, src, sink, ck, fx.item_vectors(spark, sf), fx.N_ITEMS_F1, shift, centres[3],
                            max_files_per_trigger=-(-files // 3))
    q.awaitTermination()
    return spark.read.parquet(f"{sink}/scores").select("subject", "k", "prediction")


def score_static(spark, sf, centres, shift):
    """The same transform on the static table (used by tests)."""
    return score_batch(fx.responses(spark, sf), fx.item_vectors(spark, sf), fx.N_ITEMS_F1, shift, centres)


@query("pairwise_roundtrip", "with recursive " + GRID + __import__("itemspace.plans.sqlgen", fromlist=["x"])
       .compare_ctes("pred") + """
select run_a, run_b, round(avg(perf_randindex_raw), 6) as perf_randindex_mean,
       round(avg(perf_f1_raw), 6) as perf_f1_mean
from cmp_scores group by run_a, run_b""")
def q_pairwise_roundtrip(spark, sf):
    """Pair summaries written sorted by mean ARI margin (JSON) and read back."""
    from itemspace.operators import compare as CP
    path = _scratch(spark, "pairwise")
    SK.write_pairwise(CP.score_margin(CP.pairwise_scores(grid_predictions(spark, sf))), path, fmt="json")
    back = RD.read_pairwise(spark, path, fmt="json")
    return back.select("run_a", "run_b", F.round("perf_randindex_mean", 6).alias("perf_randindex_mean"),
                       F.round("perf_f1_mean", 6).alias("perf_f1_mean"))


@query("export_subject_projector", "with " + GRID + """
select run_id, subject, max(case when k = 2 then prediction end) as pred_k2,
       max(case when k = 3 then prediction end) as pred_k3, max(case when k = 4 then prediction end) as pred_k4,
       case run_id when 'kmeans_raw' then 'none' when 'kmeans_l1' then 'l1' else 'l2' end as norm,
       64 as n_dims
from pred group by run_id, subject""")
def q_export_subject_projector(spark, sf):
    """Vectors + per-K predictions + run parameters per subject, joined by the
    subject id, written as Parquet and read back."""
    from itemspace.operators import compare as CP
    from itemspace.plans.compare_queries import KS, grid_runs
    path = _scratch(spark, "projector")
    wide = CP.predictions_wide(grid_predictions(spark, sf), KS)
    SK.export_subject_projector(fx.vectors(spark, sf).select("subject", "v"), wide,
                                grid_runs(spark, sf).select("run_id", "norm"), path)
    back = spark.read.parquet(path)
    return back.select("run_id", "subject", "pred_k2", "pred_k3", "pred_k4", "norm",
                       F.size("v").alias("n_dims"))


@query("read_responses", f"""
select subject, {", ".join(fx.Q_COLS)} from ({fx.SURVEY_WIDE_SQL})
where {" and ".join(f"{q} is not null" for q in fx.Q_COLS)}""")
def q_read_responses(spark, sf):
    """The wide survey written as a tab-separated file with 'NA' for missing
    answers, read back with an explicit schema, incomplete rows dropped."""
    path = _scratch(spark, "responses-tsv")
    cols = ["subject", *fx.Q_COLS, "age"]
    (fx.survey_wide(spark, sf).select(*cols).write.option("sep", "\t").option("header", True)
     .option("nullValue", "NA").csv(path))
    schema = "subject long, " + ", ".join(f"{q} int" for q in fx.Q_COLS) + ", age int"
    back = RD.read_responses(spark, path, schema)
    return C.drop_incomplete(back, fx.Q_COLS).select("subject", *fx.Q_COLS)


@query("export_item_projector", """
select cast(vec_id + 1 as integer) as item_id, cast(len(embedding) as integer) as n_dims,
       'kmeans_l2' as run_id, 'l2' as norm
from embeddings""")
def q_export_item_projector(spark, sf):
    """Item vectors with the parameters of one run, written as Parquet and
    read back."""
    from itemspace.plans.compare_queries import grid_runs
    path = _scratch(spark, "item-projector")
    run = grid_runs(spark, sf).where(F.col("run_id") == "kmeans_l2").select("run_id", "norm")
    # every embedding row as an item vector (the whole table, not the 7-item survey)
    items = fx.table(spark, sf, "embeddings").select(
        (F.col("vec_id") + 1).cast("int").alias("item_id"), F.col("embedding").cast("array<double>").alias("e"))
    SK.export_item_projector(items, run, path)
    back = spark.read.parquet(path)
    return back.select("item_id", F.size("e").alias("n_dims"), "run_id", "norm")
