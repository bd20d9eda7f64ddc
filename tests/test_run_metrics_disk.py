"""Run metrics keep the vectors' labels beside them: no vector is shuffled or written for the grid's silhouette,
and its sums travel as matrices of blocks."""

import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from itemspace.operators import blocks, cluster, metrics
from itemspace.plans import compare_queries
from itemspace.session import checkpoint_dir


def _bytes(folder):
    folder = folder.removeprefix("file:")
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)


def test_run_metrics_write_less_than_the_vectors(spark, tmp_path):
    n = 400
    x = np.random.default_rng(3).standard_normal((n, 64)).astype(np.float32)
    pq.write_table(pa.table({"vec_id": pa.array(range(n), pa.int64()), "embedding": list(x), "label": pa.array([0] * n, pa.int32())}),
                   tmp_path / "embeddings.parquet")
    checkpoint_dir(spark)
    folder = spark.sparkContext.getCheckpointDir()
    before = _bytes(folder)
    rows = compare_queries.grid_run_metrics(spark, str(tmp_path)).collect()
    assert _bytes(folder) - before < x.nbytes
    assert len(rows) == 9


def _labelled(spark, n=90):
    rng = np.random.default_rng(6)
    rows = [(i, r, rng.random(3).tolist(), [(i + r) % 2, (i * i + r) % 3]) for r in (0, 1) for i in range(n)]
    return spark.createDataFrame(rows, "subject long, run int, v array<double>, labels array<int>").repartition(5)


def test_labels_in_place_equal_joined_labels(spark):
    df = _labelled(spark)
    labels = df.selectExpr("subject", "run", "explode(map(2, labels[0], 3, labels[1])) as (k, prediction)")
    here = metrics.labelled_in_place(df, [2, 3], block_rows=16, group="run")
    joined = metrics.labelled_blocks(df, labels, block_rows=16, group="run")
    assert [(g, n, names) for g, n, names, _ in here.parts] == [(g, n, names) for g, n, names, _ in joined.parts]
    got = sorted((r.run, r.k, r.prediction, tuple(r.v)) for r in here.rows().collect())
    assert got == sorted((r.run, r.k, r.prediction, tuple(r.v)) for r in joined.rows().collect())
    want = {(r.run, r.k): r.silhouette_score for r in metrics.silhouette_of(spark, joined).collect()}
    for r in metrics.silhouette_of(spark, here).collect():
        assert abs(r.silhouette_score - want.pop((r.run, r.k))) < 1e-12
    assert not want
    here.release()
    with pytest.raises(ValueError):
        metrics.labelled_in_place(df.unionByName(df.limit(1)), [2, 3], group="run")


def test_sums_travel_by_block_and_span(spark):
    df = _labelled(spark).where("run = 0")
    data = metrics.labelled_in_place(df, [2, 3], block_rows=16)
    (g, n, names, held), = data.parts
    parts = blocks.block_pairs(held, n, 16, span_rows=32).mapInArrow(metrics._block_sums(names, 0), metrics._PART)
    assert parts.count() <= held.count() * 3                      # three spans of 32 rows, whatever the labels
    data.release()


def test_silhouette_of_repeated_keys_and_null_labels(spark):
    x = np.random.default_rng(2).random((40, 3))
    key = [i if i < 38 else i - 38 for i in range(40)]           # two keys twice, with other vectors
    lab = [None if k == 5 else k % 3 for k in range(38)]
    vec = spark.createDataFrame([(key[i], x[i].tolist()) for i in range(40)], "subject long, v array<double>")
    labels = spark.createDataFrame([(k, 3, lab[k]) for k in range(38)], "subject long, k int, prediction int")
    own = np.array([lab[k] or 0 for k in key])                   # a null label counts as 0 among the others
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) * (np.array(key)[:, None] != np.array(key)[None])
    s = []
    for k in range(38):
        if lab[k] is None:
            s.append(0.0)
            continue
        mine = [i for i in range(40) if key[i] == k]
        sums = [sum(d[i][own == c].sum() for i in mine) for c in range(3)]
        cnt = [len(mine) * (own == c).sum() for c in range(3)]
        a = sums[lab[k]] / (cnt[lab[k]] - 1)
        b = min(sums[c] / cnt[c] for c in range(3) if c != lab[k])
        s.append((b - a) / max(a, b))
    got = metrics.silhouette(vec, labels, block_rows=7).first().silhouette_score
    assert abs(got - np.mean(s)) < 1e-9


def test_rows_of_one_key_share_a_block(spark):
    rows = spark.createDataFrame([(i // 5, [float(i)], [0]) for i in range(100)], "key long, v array<double>, labels array<int>")
    held = [set(r.key) for r in blocks.packed_blocks(rows.coalesce(1).sortWithinPartitions("key"), 8).collect()]
    assert len(held) > 5 and sum(len(h) for h in held) == 20


def test_assign_all_equals_assign_clusters(spark):
    df = _labelled(spark, 20).drop("labels")
    centres = {(g, k): np.random.default_rng(g + k).random((k, 3)).tolist() for g in (0, 1) for k in (2, 4)}
    want = {(r.subject, r.run, r.k): (r.prediction, r.sqdist) for r in cluster.assign_clusters(df, centres, group="run").collect()}
    got = {(r.subject, r.run, k): (n.id, n.dist) for r in cluster.assign_all(df, centres, group="run").collect()
           for k, n in zip((2, 4), r.near)}
    assert got == want and len(got) == 80
