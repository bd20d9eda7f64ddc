import math

from pyspark.sql import functions as F

from itemspace.operators import clean as C
from itemspace.operators import scoring as S


def _resp(spark, rows):
    return spark.createDataFrame(rows, "subject long, item_id int, answer int")


def test_drop_incomplete_long_and_wide(spark):
    r = _resp(spark, [(1, 1, 3), (1, 2, 4), (2, 1, 5), (3, 1, 1), (3, 2, 1)])
    assert sorted(x.subject for x in C.drop_incomplete_long(r, 2).select("subject").distinct().collect()) == [1, 3]
    w = C.long_to_wide(r, [1, 2])
    assert sorted(w.columns) == ["q1", "q2", "subject"]
    assert sorted(x.subject for x in C.drop_incomplete(w, ["q1", "q2"]).collect()) == [1, 3]
    back = C.wide_to_long(w, ["q1", "q2"])
    assert back.count() == 5


def test_try_numeric_and_between(spark):
    df = spark.createDataFrame([("a", "12"), ("b", "x"), ("c", None), ("d", "150")], "id string, t string")
    ok = C.try_numeric(df, ["t"])
    assert sorted(r.id for r in ok.collect()) == ["a", "d"]
    assert [r.id for r in C.filter_between(ok, "t", 10, 100).collect()] == ["a"]


def test_rowsum_outliers_sample_sd(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "subject long, total double")
    mu = sum(vals) / 5
    sd = math.sqrt(sum((v - mu) ** 2 for v in vals) / 4)
    keep = sorted(r.total for r in C.filter_rowsum_outliers(df, F.col("total")).collect())
    assert keep == [v for v in vals if mu - sd / 2 <= v <= mu + 2 * sd]


def test_funnel_is_cumulative(spark):
    df = spark.createDataFrame([(1, 20, 3), (2, 15, 3), (3, 30, None), (4, 40, 9)], "s int, age int, q int")
    f = C.filter_funnel(df, [("complete", F.col("q").isNotNull()), ("adult", F.col("age") >= 18),
                             ("scale", F.col("q").between(1, 5))]).orderBy("step").collect()
    assert [r.rows for r in f] == [4, 3, 2, 1]


def test_sample_n_exact_and_partition_independent(spark):
    df = spark.range(100).withColumnRenamed("id", "subject")
    a = sorted(r.subject for r in C.sample_n(df, 10).collect())
    b = sorted(r.subject for r in C.sample_n(df.repartition(7), 10).collect())
    assert a == b and len(a) == 10
    assert C.sample_n(df, 1000).count() == 100


def test_validate_responses_flags(spark):
    r = _resp(spark, [(1, 1, 0), (1, 2, 0), (2, 1, 3)])
    d = {x.rule: x.violations for x in C.validate_responses(r, 2).collect()}
    assert d["incomplete_subjects"] == 1 and d["all_zero_subjects"] == 1 and d["below_min_subjects"] == 1


def test_scoring_two_level_overlapping(spark):
    r = _resp(spark, [(1, 1, 1), (1, 2, 2), (1, 3, 3)])
    m = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "item_id int, scale int")
    f = spark.createDataFrame([("A", 0), ("B", 0), ("B", 1)], "factor string, scale int")
    out = {x.factor: x.score for x in S.score_two_level(r, m, f).collect()}
    assert out == {"A": 3.0, "B": 6.0}


def test_unit_circle_and_shift_positive(spark):
    t = spark.createDataFrame([(1, 0.0), (2, 5.0), (3, 10.0)], "subject long, total double")
    c = {r.subject: (round(r.circle_x, 9), round(r.circle_y, 9)) for r in S.project_unit_circle(t).collect()}
    assert c[1] == (-1.0, 0.0) and c[3] == (1.0, 0.0) and c[2] == (0.0, 1.0)
    z = _resp(spark, [(1, 1, 0), (1, 2, 4)])
    assert sorted(r.answer for r in S.shift_positive(z).collect()) == [1, 5]


def test_dimred_rule_and_k_range():
    from itemspace.operators.reduce import dimred_rule, umap_neighbours
    assert dimred_rule(3, 7, "pca") == "reduce"
    assert dimred_rule(8, 7, "pca") == "orig"      # PCA keeps the original dimension
    assert dimred_rule(None, 7, "pca") == "orig"
    assert dimred_rule(8, 7, "nmf") == "skipped"   # redundant with the PCA/OrigD cell
    assert dimred_rule(None, 64, "umap") == "skipped"
    assert C.k_range("2-9") == list(range(2, 10))
    assert umap_neighbours(100) == 15 and umap_neighbours(1000) == 94 and umap_neighbours(5000) == 100
