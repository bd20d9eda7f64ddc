"""Intrinsic clustering metrics as aggregates over (group..., label, vector).

``group`` columns (e.g. run_id, k) let one job score every K of a sweep and
every run of a grid.  Cluster statistics are K-sized and joined back; the exact
silhouette is a blocked all-pairs computation that aggregates inside each task: it
emits a matrix per block and span of blocks, never a row per pair of rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from itemspace.functions.vector import array_sqdist
from itemspace.operators.blocks import SPAN_ROWS, Block, block_count, block_pairs, met, packed_blocks, same_key, unpacked
from itemspace.operators.vectors import vector_dims
from itemspace.session import materialize, persist


def cluster_stats(df: DataFrame, group: Sequence[str] = (), label: str = "prediction",
                  col: str = "v", dims: int | None = None) -> DataFrame:
    """(group..., label, size, centroid, scatter, sse); scatter is the mean
    Euclidean distance to the centroid."""
    g = list(group)
    dims = dims or vector_dims(df, col)
    # groups x K rows: materialised once and reused
    cent = materialize(df.groupBy(*g, label).agg(
        F.count("*").alias("size"),
        F.array(*[F.avg(F.col(col)[i]) for i in range(dims)]).alias("centroid")))
    j = df.join(cent.select(*g, label, "centroid"), g + [label])
    d2 = array_sqdist(col, "centroid")
    scat = j.groupBy(*g, label).agg(F.avg(F.sqrt(d2)).alias("scatter"), F.sum(d2).alias("sse"))
    return materialize(cent.join(scat, g + [label]))


def davies_bouldin(stats: DataFrame, group: Sequence[str] = (), label: str = "prediction") -> DataFrame:
    """Mean over clusters of max_j (S_i + S_j) / |c_i - c_j|; 0 when every
    scatter or every centroid distance is 0."""
    g = list(group) or ["_g"]
    if "_g" in g:
        stats = stats.withColumn("_g", F.lit(0))
    a = stats.select(*g, F.col(label).alias("li"), F.col("centroid").alias("ci"), F.col("scatter").alias("si"))
    b = stats.select(*g, F.col(label).alias("lj"), F.col("centroid").alias("cj"), F.col("scatter").alias("sj"))
    pairs = a.join(b, g).where(F.col("li") != F.col("lj")).withColumn("dc", F.sqrt(array_sqdist("ci", "cj")))
    per_i = pairs.groupBy(*g, "li").agg(
        F.max(F.try_divide(F.col("si") + F.col("sj"), "dc")).alias("r"),
        F.max("dc").alias("max_dc"), F.max("si").alias("si"))
    out = per_i.groupBy(*g).agg(
        F.when((F.max("si") == 0) | (F.max("max_dc") == 0), F.lit(0.0))
        .otherwise(F.avg(F.coalesce("r", F.lit(0.0)))).alias("davies_bouldin_score"))
    return out.drop("_g") if "_g" in g else out


def calinski_harabasz(stats: DataFrame, group: Sequence[str] = (), label: str = "prediction") -> DataFrame:
    """(between / (L - 1)) / (within / (n - L)); 1 when within is 0, null with
    a single label (the index needs two)."""
    g = list(group) or ["_g"]
    if "_g" in g:
        stats = stats.withColumn("_g", F.lit(0))
    dims_expr = F.size(F.first("centroid"))
    tot = stats.groupBy(*g).agg(
        F.sum("size").alias("n"), F.count("*").alias("nl"), F.sum("sse").alias("within"),
        dims_expr.alias("_d"))
    # global mean = size-weighted mean of centroids, per position
    weighted = stats.select(*g, "size", F.posexplode("centroid").alias("pos", "c"))
    gm = (weighted.groupBy(*g, "pos").agg((F.sum(F.col("c") * F.col("size")) / F.sum("size")).alias("m")))
    between = (weighted.join(gm, g + ["pos"])
               .groupBy(*g).agg(F.sum(F.col("size") * (F.col("c") - F.col("m")) ** 2).alias("between")))
    j = tot.join(between, g)
    keep = [c for c in g if c != "_g"]
    return j.select(*keep, F.when(F.col("nl") < 2, F.lit(None).cast("double")).when(F.col("within") == 0, F.lit(1.0)).otherwise(
        F.try_divide(F.col("between") * (F.col("n") - F.col("nl")), F.col("within") * (F.col("nl") - 1)))
        .alias("calinski_harabasz_score"))


# ------------------------------------------------------------ silhouette
_PART = "grp int, at long, own binary, times binary, sums binary, counts binary"
_SCORES = "grp int, kidx int, total double, n long"


# rows of a left block whose distances to a right block are held at once: they stay in a core's cache
STRIP_ROWS = 64
# beyond this many rows a pair of blocks meets once and serves both; a task then keeps the sums of so many rows
ONE_WAY_ROWS, BOTH_WAYS_ROWS = SPAN_ROWS, 2 * SPAN_ROWS


class _Sums:
    """A block's sums of distances to the rows of every label, and the numbers of those rows."""

    def __init__(self, block: Block, hot: np.ndarray):
        self.block, self.hot = block, hot
        self.sums, self.counts, self.itself = np.zeros((len(block.key), hot.shape[1])), np.zeros(hot.shape[1]), False


def _block_sums(names: Sequence[Sequence[int]], grp: int, both_ways: bool = False):
    """A left block's sums of the distances to the rows of every label of each K, over a span of blocks:
    a row of binary matrices, known by its least key.  ``names`` holds the labels of each K.  Rows of the same key,
    which lie in one block, are added up (``times``); ``own`` is a row's place among the labels, -1 if null; both are
    sent once, from where a block meets itself.  With ``both_ways`` a pair of blocks comes once, and the right block gets
    its sums, too."""
    def one_hot(labels: np.ndarray) -> np.ndarray:
        return np.hstack([labels[:, i:i + 1] == np.array(of)[None, :] for i, of in enumerate(names)]).astype(np.float64)

    starts = np.cumsum([0] + [len(of) for of in names])

    def part(of: _Sums) -> pa.RecordBatch:
        left, held = of.block, [b"", b""]
        keys, first, at, times = np.unique(left.key, return_index=True, return_inverse=True, return_counts=True)
        total = of.sums if len(keys) == len(left.key) and (at[1:] > at[:-1]).all() else np.zeros((len(keys), of.sums.shape[1]))
        if total is not of.sums:
            np.add.at(total, at, of.sums)
        if of.itself:
            own = np.stack([np.searchsorted(n, left.labels[:, i]) + starts[i] for i, n in enumerate(names)], axis=1)
            own[left.unlabelled] = -1
            held = [own[first].astype(np.int64).tobytes(), times.astype(np.float64).tobytes()]
        return pa.RecordBatch.from_arrays(
            [pa.array([grp], pa.int32()), pa.array([keys[0]], pa.int64()),
             *[pa.array([x], pa.binary()) for x in (*held, total.tobytes(), of.counts.tobytes())]],
            names=["grp", "at", "own", "times", "sums", "counts"])

    def meet(a: np.ndarray, left: _Sums, right: _Sums, mutual: bool) -> None:
        y = right.block.x
        # |x|^2 + |y|^2 - 2 x.y as one product
        b = np.hstack([y, np.ones((len(y), 1)), (y * y).sum(1)[:, None]]).T
        same = same_key(left.block, right.block)
        d = np.empty((min(STRIP_ROWS, len(a)), len(y)))
        for s in range(0, len(a), STRIP_ROWS):
            strip = d[:len(a) - s]
            np.matmul(a[s:s + STRIP_ROWS], b, out=strip)
            np.maximum(strip, 0.0, out=strip)
            np.sqrt(strip, out=strip)
            if same is not None:
                here = (same[0] >= s) & (same[0] < s + STRIP_ROWS)
                strip[same[0][here] - s, same[1][here]] = 0.0
            left.sums[s:s + STRIP_ROWS] += strip @ right.hot
            if mutual:
                right.sums += strip.T @ left.hot[s:s + STRIP_ROWS]
        left.counts += right.hot.sum(0)
        if mutual:
            right.counts += left.hot.sum(0)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, met_right = None, {}
        for left, new, right in met(batches):
            if new:
                if of is not None:
                    yield part(of)
                of = _Sums(left, one_hot(left.labels))
                a = np.hstack([-2.0 * left.x, (left.x * left.x).sum(1)[:, None], np.ones((len(left.key), 1))])
            itself = left.key[0] == right.key[0]
            of.itself |= itself
            if both_ways and not itself:
                name = int(right.key[0])
                if name not in met_right:
                    # the batch's memory does not outlive it
                    kept = right._replace(key=right.key.copy(), null=right.null.copy(), labels=right.labels.copy(),
                                          unlabelled=right.unlabelled.copy(), x=right.x[:0])
                    met_right[name] = _Sums(kept, one_hot(kept.labels))
                other = met_right[name]
                other.block = other.block._replace(x=right.x)
                meet(a, of, other, True)
                other.block = other.block._replace(x=right.x[:0])
            else:
                meet(a, of, _Sums(right, one_hot(right.labels)), False)
        if of is not None:
            yield part(of)
        for other in met_right.values():
            yield part(other)
    return fn


def _met_once(pairs: DataFrame) -> DataFrame:
    """Of the pairs of blocks (a, b) and (b, a) one, half of a task's pairs whatever blocks it has; a block
    and itself.  A block is known by its least key."""
    left, right = F.col("lkey")[0], F.col("rkey")[0]
    even = F.pmod(F.xxhash64(left).bitwiseXOR(F.xxhash64(right)), F.lit(2)) == 0
    return pairs.where((left == right) | ((left < right) == even))


def _block_scores(names: dict[int, Sequence[Sequence[int]]]):
    """Per K the sum of the silhouettes of a block's keys and their number, from its sums over every span."""
    def fn(parts: pa.Table) -> pa.Table:
        grp = parts.column("grp")[0].as_py()
        widths = [len(of) for of in names[grp]]
        m, out = sum(widths), []

        def matrices(name: str, wide: int, kind=np.float64) -> Iterator[np.ndarray]:
            return (np.frombuffer(x.as_buffer(), dtype=kind).reshape(-1, wide) for x in parts.column(name))
        sums, counts = sum(matrices("sums", m)), sum(matrices("counts", m))
        # sent with the part of a block and itself
        own, times = (next(x for x in matrices(*c) if len(x)) for c in (("own", len(widths), np.int64), ("times", 1)))
        counts = times * counts
        rows, at = np.arange(len(sums)), 0
        for i, wide in enumerate(widths):
            place = own[:, i]
            other = counts[:, at:at + wide] > 0
            known = np.flatnonzero(place >= 0)
            other[known, place[known] - at] = False
            with np.errstate(divide="ignore", invalid="ignore"):
                near = np.where(other, sums[:, at:at + wide] / counts[:, at:at + wide], np.inf).min(axis=1)
                own_n = counts[rows, place]
                inner = sums[rows, place] / (own_n - 1)
                most = np.maximum(inner, near)
                s = (near - inner) / most
            s[(place < 0) | (own_n <= 1) | ~other.any(axis=1) | (most == 0)] = 0.0
            out.append((grp, i, s.sum(), len(s)))
            at += wide
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.float64(), pa.int64()))],
                        names=["grp", "kidx", "total", "n"])
    return fn


class LabelledBlocks(NamedTuple):
    """Vectors with their label of each K, in blocks by group: ``parts`` holds (group, rows, labels
    of each K, blocks)."""
    ks: list
    parts: list[tuple[int | None, int, list[list[int]], DataFrame]]
    block_rows: int
    group: str | None

    def rows(self, col: str = "v", k_col: str = "k", label: str = "prediction") -> DataFrame | None:
        """([group,] k, label, vector) for every K, read from the blocks without a join."""
        kmap = F.array(*[F.lit(k) for k in self.ks])
        out = [unpacked(blocks).select(*([F.lit(g).alias(self.group)] if self.group else []), F.col("v").alias(col),
                                       F.posexplode("labels").alias("_ki", label))
               .withColumn(k_col, F.element_at(kmap, F.col("_ki") + 1)).drop("_ki") for g, _, _, blocks in self.parts]
        return functools.reduce(DataFrame.unionByName, out) if out else None

    def release(self) -> None:
        for _, _, _, blocks in self.parts:
            blocks.unpersist()


def labelled_blocks(vectors: DataFrame, labels: DataFrame, key: str = "subject", col: str = "v",
                    k_col: str = "k", label: str = "prediction", block_rows: int = 2048,
                    group: str | None = None) -> LabelledBlocks:
    """Vectors joined with their labels.  Both are dealt by key into as many partitions as
    blocks: the vectors are shuffled once, and what the join leaves in a partition is a block.
    A row without a label for every K is an error."""
    gk = [group] if group else []
    ks = sorted(r[0] for r in labels.select(k_col).distinct().collect())
    nk = len(ks)
    kidx = F.array_position(F.array(*[F.lit(k) for k in ks]), F.col(k_col)).cast("int") - 1
    lab = (labels.withColumn("_ki", kidx)
           .groupBy(key, *gk).agg(F.sort_array(F.collect_list(F.struct("_ki", label))).alias("_l"))
           .select(key, *gk, F.transform("_l", lambda s: s[label]).alias("labels")))
    if not lab.where(F.size("labels") != nk).isEmpty():
        raise ValueError(f"some rows do not have one label for each of the {nk} K")
    grp = F.col(group).cast("int") if group else F.lit(0)
    # groups x K x labels rows: a null label counts as label 0
    used = {}
    for r in labels.select(grp.alias("g"), kidx.alias("i"),
                           F.coalesce(F.col(label).cast("int"), F.lit(0)).alias("l")).distinct().collect():
        used.setdefault(r["g"], [set() for _ in ks])[r["i"]].add(r["l"])
    parts = []
    for r in vectors.groupBy(grp.alias("g")).count().orderBy("g").collect():
        g, n = r["g"], r["count"]
        if g not in used or (group and g is None):
            continue
        many = block_count(n, block_rows)

        def dealt(df: DataFrame) -> DataFrame:
            return df.where(grp == F.lit(g)).repartition(many, key, *gk)
        both = dealt(vectors.select(key, *gk, col)).join(dealt(lab), [key, *gk])
        rows = both.select(F.col(key).cast("long").alias("key"), F.col(col).alias("v"), "labels")
        blocks = packed_blocks(rows.sortWithinPartitions("key"), block_rows)
        parts.append((g, n, [sorted(of) for of in used[g]], blocks))
    return LabelledBlocks(ks, parts, block_rows, group)


def labelled_in_place(rows: DataFrame, ks: Sequence[int], key: str = "subject", col: str = "v", labels: str = "labels",
                      block_rows: int = 2048, group: str | None = None) -> LabelledBlocks:
    """``labelled_blocks`` of vectors that carry their label of each K (an array, in the order of ``ks``): packed where
    they lie and persisted until ``release``, so nothing is shuffled or written but the keys.  A key
    that repeats within a group is an error; a null key takes no part."""
    grp = F.col(group).cast("int") if group else F.lit(0)
    of = rows.select(F.col(key).cast("long").alias("key"), F.col(col).alias("v"), F.col(labels).alias("labels"), grp.alias("_grp"))
    if not of.groupBy("_grp", "key").count().where("count > 1").isEmpty():
        raise ValueError(f"some rows do not have one label for each of the {len(ks)} K")
    parts = []
    for g in sorted(r[0] for r in of.select("_grp").distinct().collect() if r[0] is not None):
        part = of.where((F.col("_grp") == g) & F.col("key").isNotNull()).sortWithinPartitions("key")
        blocks = packed_blocks(part, block_rows, persist)
        names = [set() for _ in ks]
        for r in (blocks.select(F.posexplode("labels").alias("at", "l"))
                  .select((F.col("at") % len(ks)).alias("i"), F.coalesce("l", F.lit(0)).alias("l")).distinct().collect()):
            names[r["i"]].add(r["l"])
        n = blocks.agg(F.sum(F.size("key"))).first()[0]
        if n:
            parts.append((g, n, [sorted(x) for x in names], blocks))
    return LabelledBlocks(list(ks), parts, block_rows, group)


def silhouette(vectors: DataFrame, labels: DataFrame, key: str = "subject", col: str = "v",
               k_col: str = "k", label: str = "prediction", block_rows: int = 2048,
               group: str | None = None) -> DataFrame:
    """Exact mean silhouette (Euclidean) for every K at once:
    ([group,] k, silhouette_score).

    Every block of rows meets every other (``blocks.block_pairs``): NumPy computes the
    distances of a pair of blocks and adds them up per (row, cluster) of every K over a span
    of blocks.  The cost is the unavoidable n^2 d of the exact metric, spread over
    tasks; rows are shuffled once, and a matrix of a number per (row, label, K) for every span.  For large n
    ``silhouette_sq`` is linear.
    ``group`` (an integer column of both inputs, e.g. the run) keeps
    independent vector sets apart.  0 for clusters of one row.  A row without a
    label for every K is an error.
    """
    return silhouette_of(vectors.sparkSession,
                         labelled_blocks(vectors, labels, key, col, k_col, label, block_rows, group), k_col)


def silhouette_of(spark: SparkSession, data: LabelledBlocks, k_col: str = "k") -> DataFrame:
    """``silhouette`` of vectors already in blocks."""
    parts = spark.createDataFrame([], _PART)
    for g, n, names, blocks in data.parts:
        if n > ONE_WAY_ROWS:
            spans = max(3, -(-n // BOTH_WAYS_ROWS))
            pairs = _met_once(block_pairs(blocks.coalesce(spans), n, data.block_rows, -(-n // spans)))
        else:
            pairs = block_pairs(blocks, n, data.block_rows)
        parts = parts.unionByName(pairs.mapInArrow(_block_sums(names, g, n > ONE_WAY_ROWS), _PART))
    scores = _block_scores({g: names for g, _, names, _ in data.parts})
    out = (parts.groupBy("grp", "at").applyInArrow(scores, _SCORES)
           .groupBy("grp", "kidx").agg((F.sum("total") / F.sum("n")).alias("silhouette_score")))
    kmap = F.array(*[F.lit(k) for k in data.ks])
    sel = [F.col("grp").alias(data.group)] if data.group else []
    return out.select(*sel, F.element_at(kmap, F.col("kidx") + 1).alias(k_col), "silhouette_score")


def silhouette_sq(df: DataFrame, group: Sequence[str] = (), label: str = "prediction",
                  col: str = "v", dims: int | None = None) -> DataFrame:
    """Linear-time silhouette on *squared* Euclidean distances (the
    definition used by MLlib's ClusteringEvaluator), from per-cluster sums:
    sum_y |x - y|^2 = n|x|^2 - 2 x.S + Q.  Cluster statistics are K-sized:
    they are gathered into one array per group and joined back by group."""
    g = list(group) or ["_g"]
    if "_g" in g:
        df = df.withColumn("_g", F.lit(0))
    dims = dims or vector_dims(df, col)
    sq = F.aggregate(col, F.lit(0.0), lambda a, x: a + x * x)
    st = df.groupBy(*g, label).agg(
        F.count("*").alias("n"), F.array(*[F.sum(F.col(col)[i]) for i in range(dims)]).alias("s"),
        F.sum(sq).alias("q"))
    per_group = st.groupBy(*g).agg(F.collect_list(F.struct(F.col(label).alias("l"), "n", "s", "q")).alias("cs"))
    j = df.join(per_group, g).withColumn("_x2", sq)

    def mean_d(c):
        dot = F.aggregate(F.zip_with(col, c["s"], lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        return F.col("_x2") + c["q"] / c["n"] - 2 * dot / c["n"]
    own = F.filter("cs", lambda c: c["l"] == F.col(label))[0]
    others = F.filter("cs", lambda c: c["l"] != F.col(label))
    j = j.withColumn("_own", own).withColumn(
        "_b", F.array_min(F.transform(others, lambda c: mean_d(c))))
    a = F.try_divide(mean_d(F.col("_own")) * F.col("_own.n"), F.col("_own.n") - 1)
    s = F.when((F.col("_own.n") <= 1) | F.col("_b").isNull(), F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(F.col("_b") - a, F.greatest(a, F.col("_b"))), F.lit(0.0)))
    keep = [c for c in g if c != "_g"]
    return j.groupBy(*g).agg(F.avg(s).alias("silhouette_sq")).select(*keep, "silhouette_sq")


# -------------------------------------------------------- K-sweep summaries
def kendall_tau_b(df: DataFrame, x: str, y: str, group: Sequence[str] = ()) -> DataFrame:
    """Kendall tau-b between two columns over the rows of each group (the K
    list: a handful of rows), by a pairwise self join i < j."""
    added = not group
    g = list(group) or ["_g"]
    if added:
        df = df.withColumn("_g", F.lit(0))
    a = df.select(*g, F.col("k").alias("ka"), F.col(x).alias("xa"), F.col(y).alias("ya"))
    b = df.select(*g, F.col("k").alias("kb"), F.col(x).alias("xb"), F.col(y).alias("yb"))
    p = a.join(b, g).where(F.col("ka") < F.col("kb"))
    sx = F.signum(F.col("xa") - F.col("xb"))
    sy = F.signum(F.col("ya") - F.col("yb"))
    agg = p.groupBy(*g).agg(
        F.sum(sx * sy).alias("s"), F.count("*").alias("n0"),
        F.count_if(sx == 0).alias("tx"), F.count_if(sy == 0).alias("ty"))
    den = F.sqrt((F.col("n0") - F.col("tx")).cast("double") * (F.col("n0") - F.col("ty")).cast("double"))
    keep = [c for c in g if not (added and c == "_g")]
    return agg.select(*keep, F.when(den > 0, F.try_divide(F.col("s"), den)).alias("tau"))


def metric_inertia_correlation(metrics: DataFrame, names: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """(tau_b(metric, inertia) + 1) / 2 per metric; null without inertia."""
    g = list(group) or ["_g"]
    if "_g" in g:
        metrics = metrics.withColumn("_g", F.lit(0))
    out = None
    for m in names:
        t = kendall_tau_b(metrics, m, "inertia", g).select(*g, ((F.col("tau") + 1) / 2).alias(f"COR_{m}"))
        out = t if out is None else out.join(t, g)
    return out.drop("_g") if "_g" in g else out


def normalized_metric_curves(metrics: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Inertia and DB min-max scaled; silhouette and CH as 1 - min-max."""
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))

    def mm(c):
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        return F.when(hi > lo, F.try_divide(F.col(c) - lo, hi - lo)).otherwise(F.lit(0.0))
    return metrics.select(*group, "k", mm("inertia").alias("inertia_norm"),
                          mm("davies_bouldin_score").alias("davies_bouldin_norm"),
                          (1 - mm("silhouette_score")).alias("silhouette_norm"),
                          (1 - mm("calinski_harabasz_score")).alias("calinski_harabasz_norm"))
