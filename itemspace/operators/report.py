"""Report tables over pairwise results: run x run matrices (long form),
relative intrinsic-metric shares, correlation and combined matrices, random
thresholds and the weighted similarity graph as node / edge tables.

Every table is long ``(metric, run_row, run_col, value)``; a square matrix is
one ``groupBy(run_row).pivot(run_col, names)`` away.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemspace.operators.compare import RANDOM_RUN

MATRIX_SCORES = ("perf_f1_raw", "perf_randindex_raw", "f1", "randindex", "f1_vs_randint", "randindex_vs_randint")
INTRINSIC = ("davies_bouldin_score", "calinski_harabasz_score", "silhouette_score")


def run_label(runs: DataFrame) -> DataFrame:
    """Display name from the run parameters: source|norm|method|reducer|D."""
    d = F.coalesce(F.col("n_components").cast("string"), F.lit("OrigD"))
    label = F.when(F.col("run_id") == RANDOM_RUN, F.lit(RANDOM_RUN)).otherwise(
        F.concat_ws("|", "mode", "norm", "cluster_method", "dimred_method", d))
    return runs.select("run_id", F.trim(label).alias("label"))


# Display names.  Of a parameter's pairs the first whose key the value
# holds counts; models by their whole mode.
NORM_NAMES = (("l1", "L1"), ("l2", "L2"))
METHOD_NAMES = (("bisectingkmeans", "BisKMeans"), ("kmeans", "KMeans"), ("spectralcosine", "SpectralCosine"))
REDUCER_NAMES = (("pca", "PCA"), ("umap", "UMAP"), ("nmf", "NMF"), ("dictionnarylearning", "DicLear"), ("vae", "VAE"))
SOURCE_NAMES = {
    "feat_raw": " FeaturesRaw", "feat_agg": " FeaturesAgglo", "feat_raw_no_norm": " FeaturesRawNoNorm",
    "feat_agg_no_norm": " FeaturesAggloNoNorm", "llm_openai": "OpenAI", "llm_all-mpnet-base-v2": "AllMpnetBaseV2",
    "llm_all-distilroberta-v1": "AllDistilRobertaV1",
    "llm_distiluse-base-multilingual-cased-v2": "DistiluseBaseMultilCasedV2",
    "llm_multi-qa-distilbert-cos-v1": "MultiQADistilbertCosV1",
    "llm_paraphrase-multilingual-mpnet-base-v2": "ParaphMultilMpnetBaseV2",
    "llm_msmarco-distilbert-cos-v5": "MSMarcoDistilbertCosV5", "llm_clip-vit-l-14": "ClipViTL14",
    "llm_clip-vit-b-32-multilingual-v1": "ClipViTB32MultiV1",
    "llm_average_word_embeddings_glove.6b.300d": "Glove6B300d",
    "llm_facebook-dpr-ctx_encoder-multiset-base": "DPRCtxMultiBase",
    "llm_facebook-dpr-question_encoder-multiset-base": "DPRQuestMultiBase", "llm_jina-embeddings-v2-base-en": "JinaV2BaseEn",
}


def _named(col: str, names: Sequence[tuple[str, str]], unknown: str) -> Column:
    out = F.lit(unknown)
    for key, name in reversed(names):
        out = F.when(F.lower(col).contains(key), F.lit(name)).otherwise(out)
    return out


def display_name(runs: DataFrame) -> DataFrame:
    """(run_id, label) by the name tables: source, method, norm, reducer and D with
    the number of dimensions; what no table names ends in '?'.  A mode that is neither a
    source nor of a model has no label."""
    mode = F.lower("mode")
    known = F.create_map(*[F.lit(x) for kv in SOURCE_NAMES.items() for x in kv])
    source = F.coalesce(F.try_element_at(known, mode), F.when(mode.startswith("llm_random"), F.concat(
        F.lit(" RandomVec"), F.replace(mode, F.lit("llm_random_"), F.lit("")), F.lit("D"))),
        F.when(mode.startswith("llm_"), F.lit("sbert?")))
    d = F.concat(F.lit("D"), F.coalesce(F.col("n_components").cast("string"), F.lit("OrigD")))
    name = F.concat(source, F.lit(" "), _named("cluster_method", METHOD_NAMES, "meth?"), F.lit(" "),
                    _named("norm", NORM_NAMES, "norm?"), F.lit(" "), _named("dimred_method", REDUCER_NAMES, "dimred?"), F.lit(" "), d)
    return runs.select("run_id", F.when(F.col("run_id") == RANDOM_RUN, F.lit("  RandomGuess")).otherwise(name).alias("label"))


PARAMS = ("mode", "norm", "cluster_method", "dimred_method", "n_components")


def attach_run_params(pairs: DataFrame, runs: DataFrame, params: Sequence[str] = PARAMS) -> DataFrame:
    """``pairs`` with every run parameter of both sides (<param>A, <param>B; null where the
    run has none, as the random run)."""
    out = pairs
    for side in "AB":
        key = f"run_{side.lower()}"
        out = out.join(runs.select(F.col("run_id").alias(key), *[F.col(p).alias(f"{p}{side}") for p in params]), key, "left")
    return out


def exclude_runs(pairs: DataFrame, tokens: Sequence[str], a: str = "run_a", b: str = "run_b") -> DataFrame:
    """Drop pairs whose run name contains any token (case-insensitive)."""
    cond = F.lit(False)
    for t in tokens:
        cond = cond | F.lower(a).contains(t.lower()) | F.lower(b).contains(t.lower())
    return pairs.where(~cond)


def check_unique_runs(pairs: DataFrame, a: str = "run_a", b: str = "run_b", labels: DataFrame | None = None) -> DataFrame:
    """Pairs occurring more than once, or a run paired with itself; with ``labels`` (run_id,
    label) also pairs of different runs that are shown under one name."""
    dup = pairs.groupBy(a, b).agg(F.count("*").alias("n")).where("n > 1") \
        .select(F.lit("duplicate_pair").alias("rule"), a, b, "n")
    same = pairs.where(F.col(a) == F.col(b)).groupBy(a, b).agg(F.count("*").alias("n")) \
        .select(F.lit("self_pair").alias("rule"), a, b, "n")
    found = dup.unionByName(same)
    if labels is None:
        return found
    named = pairs.where(F.col(a) != F.col(b))
    for c in (a, b):
        named = named.join(labels.select(F.col("run_id").alias(c), F.col("label").alias(f"_{c}")), c)
    alike = named.where(F.col(f"_{a}") == F.col(f"_{b}")).groupBy(a, b).agg(F.count("*").alias("n"))
    return found.unionByName(alike.select(F.lit("same_name").alias("rule"), a, b, "n"))


def _both_ways(df: DataFrame, val_ab: Column, val_ba: Column, metric: Column) -> DataFrame:
    ab = df.select(metric.alias("metric"), F.col("run_a").alias("run_row"), F.col("run_b").alias("run_col"),
                   val_ab.alias("value"))
    ba = df.select(metric.alias("metric"), F.col("run_b").alias("run_row"), F.col("run_a").alias("run_col"),
                   val_ba.alias("value"))
    return ab.unionByName(ba)


def symmetric_matrix(scores: DataFrame, k: int, metrics: Sequence[str] = MATRIX_SCORES) -> DataFrame:
    """Scores of each pair at K, mirrored: (metric, run_row, run_col, value)."""
    s = scores.where(F.col("k") == k)
    parts = [_both_ways(s, F.col(m), F.col(m), F.lit(m)) for m in metrics]
    return reduce(DataFrame.unionByName, parts)


def random_threshold(scores: DataFrame, k: int) -> DataFrame:
    """Mean random-baseline score at K, nudged off exactly 0.5."""
    s = scores.where(F.col("k") == k)
    out = s.agg(F.avg("f1_vs_randint").alias("f1"), F.avg("randindex_vs_randint").alias("randindex"))

    def nudge(c):
        return F.when(F.col(c) == 0.5, F.col(c) - 0.001).otherwise(F.col(c)).alias(f"random_thsh_{c}")
    return out.select(nudge("f1"), nudge("randindex"))


def metric_maxima(run_metrics: DataFrame, k: int, metrics: Sequence[str] = INTRINSIC,
                  pairs: DataFrame | None = None) -> DataFrame:
    """Best value per intrinsic metric at K (floor 0); silhouette mapped to
    (best + 1) / 2.  With ``pairs`` only over the runs that stand on a pair's first side."""
    rm = run_metrics.where(F.col("k") == k)
    if pairs is not None:
        rm = rm.join(pairs.select(F.col("run_a").alias("run_id")).distinct(), "run_id", "left_semi")
    aggs = []
    for m in metrics:
        best = F.greatest(F.max(m), F.lit(0.0))
        if "silhouette" in m:
            best = (best + 1) / 2
        aggs.append(best.alias(m))
    return rm.agg(*aggs)


def _scaled(m: str, v: Column, best: Column) -> Column:
    """The value on the scale of the best one; 0 where the best is 0."""
    if "silhouette" in m:
        return F.coalesce(F.try_divide((v + 1) / 2, best), F.lit(0.0))
    if "davies" in m:
        return F.coalesce(1 - F.try_divide(v, best), F.lit(0.0))
    return F.coalesce(F.try_divide(v, best), F.lit(0.0))


def relative_metric_share(run_metrics: DataFrame, pairs: DataFrame, k: int,
                          metrics: Sequence[str] = INTRINSIC) -> DataFrame:
    """For each non-random pair and metric: both runs' values scaled to the
    best run, then a / (a + b) and b / (a + b) (1e-8 guard when both are 0)."""
    rm = run_metrics.where(F.col("k") == k)
    best = metric_maxima(run_metrics, k, metrics)
    p = pairs.where((F.col("run_a") != RANDOM_RUN) & (F.col("run_b") != RANDOM_RUN)).select("run_a", "run_b").distinct()
    a = rm.select(F.col("run_id").alias("run_a"), *[F.col(m).alias(f"{m}_A") for m in metrics])
    b = rm.select(F.col("run_id").alias("run_b"), *[F.col(m).alias(f"{m}_B") for m in metrics])
    bb = best.select(F.lit(1).alias("_one"), *[F.col(m).alias(f"{m}_best") for m in metrics])
    j = p.join(a, "run_a").join(b, "run_b").withColumn("_one", F.lit(1)).join(bb, "_one")
    parts = []
    for m in metrics:
        va = _scaled(m, F.col(f"{m}_A"), F.col(f"{m}_best"))
        vb = _scaled(m, F.col(f"{m}_B"), F.col(f"{m}_best"))
        den = va + vb + F.when(va + vb == 0, F.lit(1e-8)).otherwise(F.lit(0.0))
        parts.append(_both_ways(j, va / den, vb / den, F.lit(m)))
    return reduce(DataFrame.unionByName, parts)


def correlation_matrix(run_metrics: DataFrame, pairs: DataFrame, k: int,
                       metrics: Sequence[str] = INTRINSIC) -> DataFrame:
    """(metric, run_row, run_col, COR of the row run) for non-random pairs."""
    rm = run_metrics.where(F.col("k") == k)
    p = pairs.where((F.col("run_a") != RANDOM_RUN) & (F.col("run_b") != RANDOM_RUN)).select("run_a", "run_b").distinct()
    a = rm.select(F.col("run_id").alias("run_a"), *[F.col(f"COR_{m}").alias(f"{m}_A") for m in metrics])
    b = rm.select(F.col("run_id").alias("run_b"), *[F.col(f"COR_{m}").alias(f"{m}_B") for m in metrics])
    j = p.join(a, "run_a").join(b, "run_b")
    return reduce(DataFrame.unionByName,
                  [_both_ways(j, F.col(f"{m}_A"), F.col(f"{m}_B"), F.lit(m)) for m in metrics])


def minmax_matrix(long: DataFrame) -> DataFrame:
    """Per metric: subtract the minimum, then divide by the (shifted) maximum;
    a constant metric is 0 everywhere."""
    mm = long.groupBy("metric").agg(F.min("value").alias("_mn"), F.max("value").alias("_mx"))
    scaled = F.try_divide(F.col("value") - F.col("_mn"), F.col("_mx") - F.col("_mn"))
    return (long.join(mm, "metric")
            .withColumn("value", F.when(F.col("_mx") == F.col("_mn"), F.lit(0.0)).otherwise(scaled))
            .drop("_mn", "_mx"))


def combined_metric(shares_minmax: DataFrame, cors: DataFrame) -> DataFrame:
    """'combined' = mean of the metric matrices, 'combined_cor' = mean of the
    correlation matrices, 'combined_diff' = | |combined| - |combined_cor| |."""
    im = shares_minmax.groupBy("run_row", "run_col").agg(F.avg("value").alias("im"))
    co = cors.groupBy("run_row", "run_col").agg(F.avg("value").alias("co"))
    j = im.join(co, ["run_row", "run_col"])
    return reduce(DataFrame.unionByName, [
        j.select(F.lit("combined").alias("metric"), "run_row", "run_col", F.col("im").alias("value")),
        j.select(F.lit("combined_cor").alias("metric"), "run_row", "run_col", F.col("co").alias("value")),
        j.select(F.lit("combined_diff").alias("metric"), "run_row", "run_col",
                 F.abs(F.abs("im") - F.abs("co")).alias("value"))])


def similarity_edges(summary: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """Edge weight w = (mean F1 margin + mean ARI margin) / 2 and the drawn
    weight ((w - mi + 0.1) / (mea - mi + 0.1) + 2)^2, where mi / mea are the
    min / mean over pairs of the per-K margin average at K (kept as in the
    original report, which mixes per-K and mean margins)."""
    at_k = scores.where(F.col("k") == k).select(
        ((F.col("perf_randindex_raw") + F.col("perf_f1_raw")) / 2).alias("wk"))
    st = at_k.agg(F.min("wk").alias("mi"), F.avg("wk").alias("mea"))
    w = (F.col("perf_f1_mean") + F.col("perf_randindex_mean")) / 2
    e = summary.select(F.col("run_a").alias("src"), F.col("run_b").alias("dst"), w.alias("raw_weight"))
    e = e.withColumn("_mi", st.select("mi").scalar()).withColumn("_mea", st.select("mea").scalar())
    adj = F.pow((F.col("raw_weight") - F.col("_mi") + 0.1) / (F.col("_mea") - F.col("_mi") + 0.1) + 2, 2)
    return e.select("src", "dst", adj.alias("weight"), "raw_weight")


def similarity_nodes(edges: DataFrame, feature_tokens: Sequence[str] = ("feat_raw", "feat_agg")) -> DataFrame:
    """Distinct endpoints; 'feature' nodes (raw or aggregated answers) vs
    'model' nodes; edge labels are shown for feature nodes only."""
    names = edges.select(F.col("src").alias("name")).unionByName(edges.select(F.col("dst").alias("name"))).distinct()
    is_feat = reduce(lambda x, y: x | y, [F.col("name").contains(t) for t in feature_tokens])
    return names.select("name", F.when(is_feat, F.lit("feature")).otherwise(F.lit("model")).alias("kind"))


def labelled_edges(edges: DataFrame, feature_tokens: Sequence[str] = ("feat_raw", "feat_agg")) -> DataFrame:
    """``edges`` with show_label: an edge's weight is written where either end is a feature node."""
    def feature(c: str) -> Column:
        return reduce(lambda x, y: x | y, [F.col(c).contains(t) for t in feature_tokens])
    return edges.withColumn("show_label", feature("src") | feature("dst"))
