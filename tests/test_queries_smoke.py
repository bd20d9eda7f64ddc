"""The flagship runs on sf0.001 with a stable schema, and a sample of oracle
queries matches DuckDB there (tools/oracle_check.py runs them all)."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from itemspace.sources.fixtures import TABLES

SF = "/root/testdata/sf0.001"
CHEAP = ["survey_embedding_summary", "filter_funnel", "validate_responses", "score_two_level", "sample_n",
         "kmeans_fixed", "silhouette", "pairwise_scores", "encode_hashing", "split_long_sentences",
         "codebook_html", "covariance", "knn_graph", "stitch_numbered_lines", "run_metrics"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    return v


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["d", "n", "mean", "max"]
    assert df.count() == 64


@pytest.mark.parametrize("name", CHEAP)
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    sdf = E.queries()[name](spark, SF)
    cols = sorted(sdf.columns)
    a = sorted(repr(tuple(_norm(r[c]) for c in cols)) for r in sdf.collect())
    rel = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in rel.description]
    assert sorted(dcols) == cols
    idx = sorted(range(len(dcols)), key=lambda i: dcols[i])
    b = sorted(repr(tuple(_norm(r[i]) for i in idx)) for r in rel.fetchall())
    assert a == b
