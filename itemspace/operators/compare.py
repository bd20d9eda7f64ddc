"""Pairwise comparison of clustering runs: contingency, optimal label
matching, adjusted Rand index, micro-F1, random baselines and margins.

Input is the long ``predictions(run_id, k, subject, prediction)`` table of a
whole grid.  All pairs of runs are compared in one job:

* contingency tables of every pair come from a per-partition one-hot Gram
  matrix X^T X (NumPy inside ``mapInPandas``), summed across partitions by a
  Spark aggregation.  No per-subject pair rows are ever produced: each task
  emits at most (runs x labels)^2 partial counts, whatever its row count.
* label matching is a K x K assignment per (pair, K) group (bounded size).
* random baselines are drawn once per run (md5-seeded), not once per pair.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemspace.functions.hashing import det_uint32
from itemspace.session import materialize, ship_package

PAIR = ["run_a", "run_b", "k"]
RANDOM_RUN = "randomGuess"


def enumerate_pairs(runs: DataFrame, key: str = "run_id") -> DataFrame:
    """All unordered pairs (run_a < run_b) of a run table (a theta self-join
    on the small run table)."""
    a = runs.select(F.col(key).alias("run_a"))
    b = runs.select(F.col(key).alias("run_b"))
    return a.join(b, F.col("run_a") < F.col("run_b"))


def random_run(predictions: DataFrame, seed: int = 42, per_k: bool = False) -> DataFrame:
    """Random labels on each run's (subject, K) grid, uniform over the run's
    global label range across all K, or with ``per_k`` over its range at that K."""
    by = ["run_id", "k"] if per_k else ["run_id"]
    rng = predictions.groupBy(*by).agg(F.min("prediction").alias("_lo"), F.max("prediction").alias("_hi"))
    h = det_uint32(seed, F.lit(RANDOM_RUN), "run_id", "k", "subject")
    return (predictions.join(rng, by)
            .select(F.col("run_id").alias("run_a"), "k", "subject", F.col("prediction").alias("la"),
                    (F.col("_lo") + F.pmod(h, F.col("_hi") - F.col("_lo") + 1)).cast("int").alias("lb")))


def contingency(df: DataFrame, a: str, b: str, group: Sequence[str] = ()) -> DataFrame:
    """Label x label counts of two labelings held in the same rows."""
    return df.groupBy(*group, F.col(a).alias("la"), F.col(b).alias("lb")).agg(F.count("*").alias("n"))


def _gram_counts(runs: list[str], sizes: list[int]):
    offs = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
    width = int(offs[-1])
    nr = len(runs)

    def fn(batches):
        acc: dict[int, np.ndarray] = {}
        for pdf in batches:
            for k, g in pdf.groupby("k"):
                X = np.zeros((len(g), width))
                for r in range(nr):
                    col = g[f"r{r}"].to_numpy()
                    ok = ~pd.isna(col)
                    lab = col[ok].astype(np.int64)
                    X[np.nonzero(ok)[0], offs[r] + lab] = 1.0
                G = X.T @ X
                acc[int(k)] = acc.get(int(k), 0) + G
        rows = []
        for k, G in acc.items():
            for a in range(nr):
                for b in range(a + 1, nr):
                    blk = G[offs[a]:offs[a + 1], offs[b]:offs[b + 1]]
                    ia, ib = np.nonzero(blk)
                    if len(ia):
                        rows.append(pd.DataFrame({
                            "run_a": runs[a], "run_b": runs[b], "k": np.int32(k),
                            "la": ia.astype(np.int32), "lb": ib.astype(np.int32),
                            "n": blk[ia, ib].astype(np.int64)}))
        if rows:
            yield pd.concat(rows, ignore_index=True)
    return fn


def pair_contingency(predictions: DataFrame) -> DataFrame:
    """(run_a, run_b, k, la, lb, n) for every pair run_a < run_b, on the
    subjects both runs labelled at that K."""
    spark = predictions.sparkSession
    ship_package(spark)
    info = predictions.groupBy("run_id").agg(F.max("prediction").alias("mx")).orderBy("run_id").collect()
    runs = [r["run_id"] for r in info]
    sizes = [int(r["mx"]) + 1 for r in info]
    wide = predictions.groupBy("k", "subject").pivot("run_id", runs).agg(F.max("prediction"))
    wide = wide.select("k", *[F.col(f"`{r}`").cast("double").alias(f"r{i}") for i, r in enumerate(runs)])
    out = wide.mapInPandas(_gram_counts(runs, sizes),
                           "run_a string, run_b string, k int, la int, lb int, n long")
    return out.groupBy(*PAIR, "la", "lb").agg(F.sum("n").alias("n"))


def random_contingency(predictions: DataFrame, seed: int = 42) -> DataFrame:
    """Contingency of every run against its random run."""
    rr = random_run(predictions, seed)
    return (rr.groupBy("run_a", "k", "la", "lb").agg(F.count("*").alias("n"))
            .select("run_a", F.lit(RANDOM_RUN).alias("run_b"), "k", "la", "lb", "n"))


# ------------------------------------------------------------------- scores
def _comb2(c):
    return c * (c - 1) / 2


def adjusted_rand(cont: DataFrame, group: Sequence[str] = PAIR) -> DataFrame:
    """ARI from a contingency table; 1.0 when the expected index equals its
    maximum (identical partitions)."""
    g = list(group) or ["_g"]
    if "_g" in g:
        cont = cont.withColumn("_g", F.lit(0))
    s = cont.groupBy(*g).agg(F.sum(_comb2(F.col("n"))).alias("sc"), F.sum("n").alias("nn"))
    ra = cont.groupBy(*g, "la").agg(F.sum("n").alias("a")).groupBy(*g).agg(F.sum(_comb2(F.col("a"))).alias("sa"))
    cb = cont.groupBy(*g, "lb").agg(F.sum("n").alias("b")).groupBy(*g).agg(F.sum(_comb2(F.col("b"))).alias("sb"))
    j = s.join(ra, g).join(cb, g)
    exp = F.col("sa") * F.col("sb") / _comb2(F.col("nn"))
    mx = (F.col("sa") + F.col("sb")) / 2
    ari = F.when(mx == exp, F.lit(1.0)).otherwise((F.col("sc") - exp) / (mx - exp))
    keep = [c for c in g if c != "_g"]
    return j.select(*keep, ari.alias("randindex"), F.col("nn").alias("n"))


def _lex_best_assignment(C: np.ndarray) -> tuple[list[int], float]:
    """Max-agreement one-to-one map row -> column; among optimal maps the
    lexicographically smallest (rows in order).

    One optimal matching and its dual prices come from augmenting paths.  A map is
    optimal exactly if it uses tight cells only (price of row plus price of
    column equals the cost), so the tie-break rewires the matching along tight
    cells: row by row, the smallest column that a rewiring of the later rows allows."""
    m = C.shape[0]
    cost = C.max() - C if m else C
    row_of, u, v = _matching(cost)
    tight = np.isclose(cost - u[:, None] - v[None, :], 0.0, atol=1e-9)
    col_of = np.empty(m, dtype=int)
    col_of[row_of] = np.arange(m)
    for r in range(m):
        for c in np.flatnonzero(tight[r]):
            if c == col_of[r]:
                break
            if row_of[c] > r and _rewire(r, c, tight, row_of, col_of):
                break
    return col_of.tolist(), float(C[np.arange(m), col_of].sum()) if m else 0.0


def _rewire(r: int, c: int, tight: np.ndarray, row_of: np.ndarray, col_of: np.ndarray) -> bool:
    """Give column ``c`` to row ``r`` if its present row can move along tight
    cells of later rows to the column that ``r`` leaves."""
    free, start = col_of[r], row_of[c]
    came = {start: None}
    queue = [start]
    for row in queue:
        for col in np.flatnonzero(tight[row]):
            if col == free:
                while row is not None:                 # shift columns back along the path
                    left = col_of[row]
                    col_of[row], row_of[col] = col, row
                    row, col = came[row], left
                col_of[r], row_of[c] = c, r
                return True
            nxt = row_of[col]
            if nxt > r and nxt not in came:
                came[nxt] = row
                queue.append(nxt)
    return False


def _matching(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of each column in a minimum-cost perfect matching, with row and
    column prices: one shortest augmenting path per row, O(m^3)."""
    m = cost.shape[0]
    u, v, row_of = np.zeros(m), np.zeros(m), np.full(m, -1)
    for start in range(m):
        dist, via = np.full(m, np.inf), np.full(m, -1)      # via: the row a column was reached from
        done = np.zeros(m, dtype=bool)
        row, reach = start, 0.0
        while True:
            through = reach + cost[row] - u[row] - v
            better = ~done & (through < dist)
            dist[better], via[better] = through[better], row
            col = int(np.argmin(np.where(done, np.inf, dist)))
            reach = dist[col]
            done[col] = True
            if row_of[col] < 0:
                break
            row = row_of[col]
        u[start] += reach
        for j in np.flatnonzero(done):
            if row_of[j] >= 0:
                u[row_of[j]] += reach - dist[j]
            v[j] -= reach - dist[j]
        while True:                                        # flip the path
            row = via[col]
            previous = np.flatnonzero(row_of == row)
            row_of[col] = row
            if row == start:
                break
            col = previous[previous != col][0]
    return row_of, u, v


def _match_group(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    m = int(max(pdf["la"].max(), pdf["lb"].max())) + 1
    C = np.zeros((m, m))
    C[pdf["la"].to_numpy(), pdf["lb"].to_numpy()] = pdf["n"].to_numpy()
    perm, total = _lex_best_assignment(C)
    present = np.zeros(m, dtype=bool)
    present[pdf["la"].to_numpy()] = True
    return pd.DataFrame({"run_a": keys[0], "run_b": keys[1], "k": np.int32(keys[2]),
                         "la": np.arange(m, dtype=np.int32), "lb": np.array(perm, dtype=np.int32),
                         "la_present": present, "matched": np.int64(round(total))})


def match_labels(cont: DataFrame) -> DataFrame:
    """(run_a, run_b, k, la, lb, la_present, matched): the relabelling of A
    into B's labels that maximises agreement (Hungarian criterion), one
    bounded K x K problem per group."""
    ship_package(cont.sparkSession)
    return cont.groupBy(*PAIR).applyInPandas(
        _match_group, "run_a string, run_b string, k int, la int, lb int, la_present boolean, matched long")


def random_baseline(predictions: DataFrame, maps: DataFrame, reps: int = 10, seed: int = 42) -> DataFrame:
    """Mean ARI and micro-F1 of A's relabelled predictions against ``reps``
    random labelings drawn uniformly in the relabelled range.  Random labels
    are drawn per (run A, K, range), so pairs sharing A reuse them; the F1
    needs only the pair's map joined to that contingency."""
    rng = (maps.where("la_present").groupBy(*PAIR)
           .agg(F.min("lb").alias("lo"), F.max("lb").alias("hi")))
    ranges = rng.select(F.col("run_a").alias("run_id"), "k", "lo", "hi").distinct()
    rep = F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))
    h = det_uint32(seed, "run_id", "k", "rep", "subject")
    draws = (predictions.join(ranges, ["run_id", "k"])
             .withColumn("rep", rep)
             .withColumn("lr", (F.col("lo") + F.pmod(h, F.col("hi") - F.col("lo") + 1)).cast("int")))
    crand = draws.groupBy("run_id", "k", "lo", "hi", "rep", F.col("prediction").alias("la"), "lr") \
        .agg(F.count("*").alias("n"))
    # ARI is invariant to relabelling A, so it is computed on A's own labels
    ari = adjusted_rand(crand.withColumnRenamed("lr", "lb"), ["run_id", "k", "lo", "hi", "rep"])
    ari_mean = ari.groupBy("run_id", "k", "lo", "hi").agg(F.avg("randindex").alias("randindex_vs_randint"))
    # agreement of map(la) with the random label
    pm = maps.join(rng, PAIR).select(F.col("run_a").alias("run_id"), "run_b", "k", "lo", "hi", "la", "lb")
    hit = (crand.join(pm, ["run_id", "k", "lo", "hi", "la"])
           .where(F.col("lr") == F.col("lb"))
           .groupBy("run_id", "run_b", "k", "rep").agg(F.sum("n").alias("hits")))
    tot = crand.groupBy("run_id", "k", "lo", "hi", "rep").agg(F.sum("n").alias("nn"))
    f1 = (pm.select("run_id", "run_b", "k", "lo", "hi").distinct()
          .join(tot, ["run_id", "k", "lo", "hi"])
          .join(hit, ["run_id", "run_b", "k", "rep"], "left")
          .groupBy("run_id", "run_b", "k", "lo", "hi")
          .agg(F.avg(F.coalesce("hits", F.lit(0)) / F.col("nn")).alias("f1_vs_randint")))
    return (f1.join(ari_mean, ["run_id", "k", "lo", "hi"])
            .select(F.col("run_id").alias("run_a"), "run_b", "k", "randindex_vs_randint", "f1_vs_randint"))


def pairwise_scores(predictions: DataFrame, reps: int = 10, seed: int = 42,
                    include_random: bool = True) -> DataFrame:
    """Per (run_a, run_b, k): randindex, f1 (matched agreement / n), the
    random baselines and the margins perf_* = score - baseline."""
    cont = pair_contingency(predictions)
    if include_random:
        cont = cont.unionByName(random_contingency(predictions, seed))
    # both are tiny (pairs x K x labels^2 rows) and read several times below:
    # materialise them once in the shared checkpoint folder
    cont = materialize(cont)
    maps = materialize(match_labels(cont))
    ari = adjusted_rand(cont)
    matched = maps.groupBy(*PAIR).agg(F.first("matched").alias("matched"))
    base = random_baseline(predictions, maps, reps, seed)
    out = (ari.join(matched, PAIR).join(base, PAIR)
           .withColumn("f1", F.col("matched") / F.col("n"))
           .withColumn("perf_randindex_raw", F.col("randindex") - F.col("randindex_vs_randint"))
           .withColumn("perf_f1_raw", F.col("f1") - F.col("f1_vs_randint")))
    # pairs x K rows, usually read by several report tables
    return materialize(out.select(*PAIR, "n", "randindex", "f1", "randindex_vs_randint", "f1_vs_randint",
                                  "perf_randindex_raw", "perf_f1_raw"))


def score_margin(scores: DataFrame) -> DataFrame:
    """Per pair: max margin, the first K reaching it, and the mean margin."""
    aggs = []
    for s in ("f1", "randindex"):
        raw = F.col(f"perf_{s}_raw")
        aggs += [F.max(raw).alias(f"perf_{s}_max"),
                 F.min_by("k", F.struct(-raw, F.col("k"))).alias(f"perf_{s}_max_k"),
                 F.avg(raw).alias(f"perf_{s}_mean")]
    return scores.groupBy("run_a", "run_b").agg(*aggs)


def micro_f1(maps: DataFrame, cont: DataFrame) -> DataFrame:
    n = cont.groupBy(*PAIR).agg(F.sum("n").alias("n"))
    m = maps.groupBy(*PAIR).agg(F.first("matched").alias("matched"))
    return m.join(n, PAIR).select(*PAIR, (F.col("matched") / F.col("n")).alias("f1"))


def subject_diff(a: DataFrame, b: DataFrame, key: str = "subject") -> DataFrame:
    """Symmetric difference of two subject sets: sizes, common ids and the
    difference as a share of the mean size."""
    sa = a.select(key).distinct().withColumn("_a", F.lit(1))
    sb = b.select(key).distinct().withColumn("_b", F.lit(1))
    j = sa.join(sb, key, "full_outer")
    agg = j.agg(F.count("_a").alias("n_a"), F.count("_b").alias("n_b"),
                F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_common"),
                F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("n_diff"))
    return agg.withColumn("diff_pct", F.col("n_diff") / F.floor((F.col("n_a") + F.col("n_b")) / 2) * 100)


def common_counts(predictions: DataFrame, key: str = "subject") -> DataFrame:
    """(run_a, run_b, common) for run_a < run_b: subjects that both runs hold.  A subject is one
    row with the set of its runs; every task adds its sets up as a runs x runs matrix, so
    there is no row per subject and pair.  Only the run names reach the driver."""
    ship_package(predictions.sparkSession)
    names = sorted(r[0] for r in predictions.select("run_id").distinct().collect())
    if not names:
        return predictions.sparkSession.createDataFrame([], "run_a string, run_b string, common long")
    held = F.array(*[F.lit(n) for n in names])
    sets = predictions.groupBy(key).agg(F.collect_set((F.array_position(held, F.col("run_id")) - 1).cast("int")).alias("r"))

    def fn(batches):
        total = np.zeros((len(names), len(names)))
        for b in batches:
            r = b.column("r")
            x = np.zeros((b.num_rows, len(names)))
            x[np.repeat(np.arange(b.num_rows), np.diff(r.offsets.to_numpy())), r.flatten().to_numpy()] = 1
            total += x.T @ x
        i, j = np.nonzero(np.triu(total, 1))
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                                          pa.array(total[i, j].astype(np.int64))], names=["i", "j", "n"])
    counts = sets.select("r").mapInArrow(fn, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("common"))
    return counts.select(F.element_at(held, F.col("i") + 1).alias("run_a"), F.element_at(held, F.col("j") + 1).alias("run_b"), "common")


def check_comparable(predictions: DataFrame) -> DataFrame:
    """For every pair of runs (run_a < run_b): same_k (both hold the same K), same_n
    (equally many subjects), identical (every label equal) and n_diff, the subjects
    that only one of them has, with diff_pct, their share of the mean size.

    Each run is summed up in one row (K list, counts, an order-free digest), and
    common subjects are counted by ``common_counts``."""
    runs = predictions.groupBy("run_id").agg(
        F.sort_array(F.collect_set("k")).alias("ks"), F.count_distinct("subject").alias("n"),
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.xxhash64("subject", "k", "prediction").cast("decimal(38,0)")).alias("digest"))
    a = runs.select(*[F.col(c).alias(f"{c}_a") for c in runs.columns]).withColumnRenamed("run_id_a", "run_a")
    b = runs.select(*[F.col(c).alias(f"{c}_b") for c in runs.columns]).withColumnRenamed("run_id_b", "run_b")
    common = common_counts(predictions)
    n_diff = F.col("n_a") + F.col("n_b") - 2 * F.coalesce("common", F.lit(0))
    return (a.join(b, F.col("run_a") < F.col("run_b")).join(common, ["run_a", "run_b"], "left")
            .select("run_a", "run_b", (F.col("ks_a") == F.col("ks_b")).alias("same_k"),
                    (F.col("n_a") == F.col("n_b")).alias("same_n"),
                    ((F.col("rows_a") == F.col("rows_b")) & (F.col("digest_a") == F.col("digest_b"))).alias("identical"),
                    n_diff.alias("n_diff"),
                    (n_diff / F.floor((F.col("n_a") + F.col("n_b")) / 2) * 100).alias("diff_pct")))


def common_subjects(a: DataFrame, b: DataFrame, strict: bool = True, key: str = "subject") -> tuple[DataFrame, DataFrame]:
    """Both predictions over their common subjects.  In strict mode differing
    subjects are an error that names their number."""
    if strict:
        d = subject_diff(a, b, key).first()
        if d["n_diff"]:
            raise ValueError(f"{d['n_diff']} subjects are in one run only ({d['diff_pct']:.1f} % of the mean size)")
        return a, b
    return (a.join(b.select(key).distinct(), key, "left_semi"), b.join(a.select(key).distinct(), key, "left_semi"))


def predictions_wide(predictions: DataFrame, ks: Sequence[int]) -> DataFrame:
    """One column per K ('pred_k<k>') per (run, subject), joined by subject."""
    w = predictions.groupBy("run_id", "subject").pivot("k", list(ks)).agg(F.first("prediction"))
    return w.withColumnsRenamed({str(k): f"pred_k{k}" for k in ks})
