"""Queries over the survey fixtures: sources, cleaning, scoring, vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from itemspace.operators import clean as C
from itemspace.operators import scoring as S
from itemspace.operators import spec as SP
from itemspace.operators import vectors as V
from itemspace.plans import flagship
from itemspace.plans.catalog import query
from itemspace.sources import fixtures as fx

R = fx.RESPONSES_SQL
IV = fx.ITEM_VECTORS_SQL
N7 = fx.N_ITEMS_F1
QC, TC = fx.Q_COLS, fx.T_COLS
W = fx.SURVEY_WIDE_SQL


def _round(c, d=6):
    return F.round(c, d)


# --------------------------------------------------------------- embeddings
def _embed_sql(agg: str, norm: str = "l2") -> str:
    nexpr = "sqrt(sum(w * w))" if norm == "l2" else "sum(abs(w))"
    return f"""
with resp as ({R}),
iv as ({IV}),
ive as (select item_id, generate_subscripts(e, 1) - 1 as d, unnest(e) as x from iv),
comp as (select subject from resp group by subject having count(answer) = {N7}),
v as (select r.subject, ive.d, {agg}(cast(r.answer as double) * ive.x) as v
      from resp r join ive on r.item_id = ive.item_id
      where r.subject in (select subject from comp)
      group by r.subject, ive.d),
sh as (select abs(min(v)) as s from v),
w as (select subject, d, v + s as w from v, sh),
nr as (select subject, {nexpr} as nr from w group by subject),
u as (select w.subject, w.d, case when nr > 0 then w / nr else w end as x from w join nr using (subject))"""


FLAGSHIP_SQL = _embed_sql("max") + """
select cast(d as integer) as d, count(x) as n, round(avg(x), 6) as mean, round(max(x), 6) as max
from u group by d"""

query("survey_embedding_summary", FLAGSHIP_SQL)(flagship.survey_embedding_summary)


def _embedded(spark, sf, how, p):
    return flagship.subject_embeddings(spark, sf, how=how, norm=p)


for _how, _p, _agg, _norm in (("max", 2, "max", "l2"), ("sum", 1, "sum", "l1"), ("mean", 2, "avg", "l2")):
    query(f"embed_subjects_{_how}", _embed_sql(_agg, _norm) + """
select subject, cast(d as integer) as d, round(x, 6) as value from u""")(
        (lambda h, p: lambda spark, sf: V.to_long(_embedded(spark, sf, h, p)))(_how, _p))


@query("validate_vectors", _embed_sql("max") + """
select count(*) as n_rows, count(*) filter (where abs(nr2 - 1) > 1e-5) as off_unit_norm,
       count(*) filter (where mx = mn) as constant_rows, round(min(mn), 6) as min_value,
       round(max(mx), 6) as max_value
from (select subject, sqrt(sum(x * x)) as nr2, max(x) as mx, min(x) as mn from u group by subject)""")
def q_validate_vectors(spark, sf):
    chk = V.vector_norm_checks(_embedded(spark, sf, "max", 2))
    return chk.select("n_rows", "off_unit_norm", "constant_rows",
                      _round(F.col("min_value")).alias("min_value"), _round(F.col("max_value")).alias("max_value"))


@query("run_shape", _embed_sql("max") + """
select count(distinct subject) as n_subjects, cast(count(distinct d) as integer) as n_dims from u""")
def q_run_shape(spark, sf):
    return S.run_shape(_embedded(spark, sf, "max", 2))


def _raw_vectors(spark, sf):
    wide = C.drop_incomplete(fx.survey_wide(spark, sf), QC)
    return V.wide_to_vectors(wide, QC)


_RAW_SQL = f"""
with w as ({W}), c as (select * from w where {" and ".join(f"{q} is not null" for q in QC)}),
l as (select subject, d, cast(x as double) as x from (
  select subject, unnest([{", ".join(QC)}]) as x, generate_subscripts([{", ".join(QC)}], 1) - 1 as d from c))"""

for _p, _nexpr in ((1, "sum(abs(x))"), (2, "sqrt(sum(x * x))")):
    query(f"normalize_rows_l{_p}", _RAW_SQL + f"""
, n as (select subject, {_nexpr} as nr from l group by subject)
select subject, cast(d as integer) as d, round(case when nr > 0 then x / nr else x end, 6) as value
from l join n using (subject)""")(
        (lambda p: lambda spark, sf: V.to_long(V.normalize_rows(_raw_vectors(spark, sf), p=p)))(_p))


@query("explode_dims", f"""
select subject, printf('V_%04d', d + 1) as dim_name, cast(d as integer) as d, round(value, 6) as value
from (select subject, unnest(v) as value, generate_subscripts(v, 1) - 1 as d from ({fx.VECTORS_SQL}))""")
def q_explode_dims(spark, sf):
    e = V.explode_dims(fx.vectors(spark, sf))
    return e.withColumn("value", _round(F.col("value")))


@query("pool_groups_max", f"""
select label, cast(d as integer) as d, round(max(x), 6) as value
from (select label, unnest(v) as x, generate_subscripts(v, 1) - 1 as d from ({fx.VECTORS_SQL}))
group by label, d""")
def q_pool_groups(spark, sf):
    pooled = V.pool_groups(fx.vectors(spark, sf), "label", "max", dims=64)
    return V.to_long(pooled, key="label")


# ------------------------------------------------------------------ sources
query("responses_long", R)(fx.responses)


@query("responses_wide", f"""
select subject, {", ".join(f"max(case when item_id = {i} then answer end) as q{i}" for i in fx.ITEM_IDS_F1)}
from ({R}) group by subject""")
def q_responses_wide(spark, sf):
    return C.long_to_wide(fx.responses(spark, sf), fx.ITEM_IDS_F1)


@query("wide_to_long", f"""
select subject, cast(regexp_extract(item, '(\\d+)$', 1) as integer) as item_id, cast(answer as integer) as answer
from (unpivot (select subject, {", ".join(QC)} from ({W})) on {", ".join(QC)} into name item value answer)""")
def q_wide_to_long(spark, sf):
    return C.wide_to_long(fx.survey_wide(spark, sf).select("subject", *QC), QC)


# ---------------------------------------------------------------- filters
@query("drop_incomplete", f"""
select r.* from ({R}) r where subject in (
  select subject from ({R}) group by subject having count(answer) = {N7})""")
def q_drop_incomplete(spark, sf):
    return C.drop_incomplete_long(fx.responses(spark, sf), N7)


def _funnel_rules():
    total = C.row_sum(QC)
    return [
        ("complete", C.complete_rows(QC)),
        ("age_18_80", F.col("age").between(18, 80)),
        ("items_1_5", C.all_items_between(QC, 1, 5)),
        ("total_time", C.row_sum(TC).between(1_000_000, 3_000_000)),
    ], total


@query("filter_funnel", f"""
with w as ({W}),
f as (select *, ({" and ".join(f"{q} is not null" for q in QC)}) as r1,
             (age between 18 and 80) as r2,
             ({" and ".join(f"{q} between 1 and 5" for q in QC)}) as r3,
             (({" + ".join(TC)}) between 1000000 and 3000000) as r4,
             ({" + ".join(QC)}) as total from w),
p as (select * from f where coalesce(r1 and r2 and r3 and r4, false)),
st as (select avg(total) as mu, stddev_samp(total) as sd from p)
select * from (values (0, 'input', (select count(*) from f)),
  (1, 'complete', (select count(*) from f where coalesce(r1, false))),
  (2, 'age_18_80', (select count(*) from f where coalesce(r1 and r2, false))),
  (3, 'items_1_5', (select count(*) from f where coalesce(r1 and r2 and r3, false))),
  (4, 'total_time', (select count(*) from p)),
  (5, 'rowsum_outliers', (select count(*) from p, st where total >= mu - sd / 2 and total <= mu + 2 * sd))
) t(step, rule, rows)""")
def q_filter_funnel(spark, sf):
    df = fx.survey_wide(spark, sf)
    rules, total = _funnel_rules()
    passed = df.where(C.all_of([F.coalesce(c, F.lit(False)) for _, c in rules]))
    lo, hi = C.rowsum_outlier_bounds(passed, total)
    rules.append(("rowsum_outliers", (total >= lo) & (total <= hi)))
    out = C.filter_funnel(df, rules)
    return out.select(F.col("step").cast("int").alias("step"), "rule", F.col("rows").cast("long").alias("rows"))


# The funnel's rules and the survey's scores as a specification.
F1_SURVEY = SP.Survey("F1", SP.Cols("q[1-7]"), (
    SP.Rule("complete", "complete", SP.Cols("q[1-7]")), SP.Rule("age_18_80", "between", SP.Cols("age"), 18, 80),
    SP.Rule("items_1_5", "between", SP.Cols("q[1-7]"), 1, 5),
    SP.Rule("total_time", "total", SP.Cols("t[1-7]"), 1_000_000, 3_000_000),
    SP.Rule("rowsum_outliers", "outlier", SP.Cols("q[1-7]"), 0.5, 2)),
    (SP.Score("odd", SP.Cols("q[1357]")), SP.Score("even", SP.Cols("q[246]"), "mean"), SP.Score("both", SP.Cols("odd|even"))))

_SPEC_SQL = f"""
with w as ({W}),
f as (select *, ({" and ".join(f"{q} is not null" for q in QC)}) as r1, coalesce(age between 18 and 80, false) as r2,
             coalesce({" and ".join(f"{q} between 1 and 5" for q in QC)}, false) as r3,
             coalesce(({" + ".join(TC)}) between 1000000 and 3000000, false) as r4, ({" + ".join(QC)}) as total from w),
st as (select avg(total) as mu, stddev_samp(total) as sd from f where r1 and r2 and r3 and r4),
g as (select f.*, coalesce(total >= mu - sd / 2 and total <= mu + 2 * sd, false) as r5 from f, st)"""


@query("survey_spec_report", _SPEC_SQL + """
select * from (values (0, 'input', (select count(*) from g), 0::bigint),
  (1, 'complete', (select count(*) from g where r1), (select count(*) from g where not r1)),
  (2, 'age_18_80', (select count(*) from g where r1 and r2), (select count(*) from g where not r2)),
  (3, 'items_1_5', (select count(*) from g where r1 and r2 and r3), (select count(*) from g where not r3)),
  (4, 'total_time', (select count(*) from g where r1 and r2 and r3 and r4), (select count(*) from g where not r4)),
  (5, 'rowsum_outliers', (select count(*) from g where r1 and r2 and r3 and r4 and r5), (select count(*) from g where not r5))
) t(step, rule, rows, rejected)""")
def q_survey_spec_report(spark, sf):
    return SP.compile_survey(fx.survey_wide(spark, sf), F1_SURVEY).report()


@query("survey_spec_rows", _SPEC_SQL + f"""
select subject, {", ".join(QC)}, cast(q1 + q3 + q5 + q7 as double) as odd, (q2 + q4 + q6) / 3.0 as even,
       q1 + q3 + q5 + q7 + (q2 + q4 + q6) / 3.0 as both
from g where r1 and r2 and r3 and r4 and r5""")
def q_survey_spec_rows(spark, sf):
    return SP.compile_survey(fx.survey_wide(spark, sf), F1_SURVEY).rows()


@query("filter_equals", f"select subject, segment from ({W}) where segment = 'BUILDING'")
def q_filter_equals(spark, sf):
    return C.filter_equals(fx.survey_wide(spark, sf), "segment", "BUILDING").select("subject", "segment")


@query("filter_between", f"select subject, age from ({W}) where age between 18 and 80")
def q_filter_between(spark, sf):
    return C.filter_between(fx.survey_wide(spark, sf), "age", 18, 80).select("subject", "age")


@query("filter_all_items_between", f"""
select subject from ({W}) where {" and ".join(f"{q} between 2 and 5" for q in QC)}""")
def q_filter_all_items_between(spark, sf):
    return C.filter_all_items_between(fx.survey_wide(spark, sf), QC, 2, 5).select("subject")


@query("filter_total_time", f"""
select subject, round({" + ".join(TC)}, 2) as total_time from ({W})
where ({" + ".join(TC)}) between 1000000 and 3000000""")
def q_filter_total_time(spark, sf):
    df = C.filter_total_time(fx.survey_wide(spark, sf), TC, 1_000_000, 3_000_000)
    return df.select("subject", F.round(C.row_sum(TC), 2).alias("total_time"))


@query("filter_rowsum_outliers", f"""
with t as (select subject, cast(sum(answer) as double) as total from ({R}) group by subject
           having count(answer) = {N7}),
st as (select avg(total) as mu, stddev_samp(total) as sd from t)
select subject, total from t, st where total >= mu - sd / 2 and total <= mu + 2 * sd""")
def q_filter_rowsum_outliers(spark, sf):
    t = S.score_total(C.drop_incomplete_long(fx.responses(spark, sf), N7))
    return C.filter_rowsum_outliers(t, F.col("total"))


@query("validate_responses", f"""
with p as (select subject, count(answer) as n, count(*) filter (where answer is null) as nulls,
                  sum(abs(answer)) as abs_sum, min(answer) as mn,
                  count(*) filter (where cast(answer as double) != floor(cast(answer as double))) as frac
           from ({R}) group by subject)
select * from (values
  ('subjects', (select count(*) from p)),
  ('incomplete_subjects', (select count(*) from p where n != {N7})),
  ('null_answers', (select cast(sum(nulls) as bigint) from p)),
  ('all_zero_subjects', (select count(*) from p where abs_sum = 0)),
  ('below_min_subjects', (select count(*) from p where mn < 1)),
  ('non_integral_answers', (select cast(sum(frac) as bigint) from p))) t(rule, violations)""")
def q_validate_responses(spark, sf):
    return C.validate_responses(fx.responses(spark, sf), N7)


@query("sample_n", f"""
select subject from (select subject from ({R}) group by subject having count(answer) = {N7})
order by cast('0x' || substr(md5(concat_ws(':', '42', cast(subject as varchar))), 1, 8) as bigint), subject
limit 500""")
def q_sample_n(spark, sf):
    comp = C.drop_incomplete_long(fx.responses(spark, sf), N7).select("subject").distinct()
    return C.sample_n(comp, 500)


@query("align_items", f"""
select subject, printf('item%02d', item_id) as item_code, answer
from ({fx.DENSE_RESPONSES_SQL}) where item_id in (select item_id from ({fx.SUBSCALE_MAP_SQL}))
  and item_id not in (25)""")
def q_align_items(spark, sf):
    r = C.align_to_items(fx.dense_responses(spark, sf), fx.subscale_map(spark, sf))
    r = C.drop_items(r, [25])
    r = r.select("subject", F.format_string("B%02d", "item_id").alias("item_code"), "answer")
    return C.rename_items(r, "^B", "item")


# ---------------------------------------------------------------- scoring
for _how, _agg in (("sum", "sum"), ("mean", "avg")):
    query(f"score_subscales_{_how}", f"""
select subject, scale, round({_agg}(cast(answer as double)), 6) as score
from ({fx.DENSE_RESPONSES_SQL}) r join ({fx.SUBSCALE_MAP_SQL}) m using (item_id)
group by subject, scale""")(
        (lambda h: lambda spark, sf: S.score_subscales(
            fx.dense_responses(spark, sf), fx.subscale_map(spark, sf), h)
         .withColumn("score", _round(F.col("score"))))(_how))


@query("score_two_level", f"""
with s as (select subject, scale, sum(cast(answer as double)) as score
           from ({fx.DENSE_RESPONSES_SQL}) r join ({fx.SUBSCALE_MAP_SQL}) m using (item_id)
           group by subject, scale)
select subject, factor, round(sum(score), 6) as score from s join {fx.FACTOR_MAP_SQL} using (scale)
group by subject, factor""")
def q_score_two_level(spark, sf):
    out = S.score_two_level(fx.dense_responses(spark, sf), fx.subscale_map(spark, sf), fx.factor_map(spark))
    return out.withColumn("score", _round(F.col("score")))


@query("scores_wide", f"""
select subject, {", ".join(f"max(case when scale = {s} then score end) as s{s}" for s in range(5))}
from (select subject, scale, sum(cast(answer as double)) as score
      from ({fx.DENSE_RESPONSES_SQL}) r join ({fx.SUBSCALE_MAP_SQL}) m using (item_id)
      group by subject, scale) group by subject""")
def q_scores_wide(spark, sf):
    s = S.score_subscales(fx.dense_responses(spark, sf), fx.subscale_map(spark, sf), "sum")
    return S.scores_wide(s, list(range(5)))


_TOTAL_SQL = f"""select subject, cast(sum(answer) as double) as total from ({R}) group by subject
having count(answer) = {N7}"""


@query("score_total", _TOTAL_SQL)
def q_score_total(spark, sf):
    return S.score_total(C.drop_incomplete_long(fx.responses(spark, sf), N7))


@query("project_unit_circle", f"""
with t as ({_TOTAL_SQL}), m as (select max(total) as mx from t)
select subject, total, round(cos(acos(total / (mx / 2) - 1)), 6) as circle_x,
       round(sin(acos(total / (mx / 2) - 1)), 6) as circle_y from t, m""")
def q_project_unit_circle(spark, sf):
    t = S.score_total(C.drop_incomplete_long(fx.responses(spark, sf), N7))
    out = S.project_unit_circle(t)
    return out.select("subject", "total", _round(F.col("circle_x")).alias("circle_x"),
                      _round(F.col("circle_y")).alias("circle_y"))


@query("shift_positive", f"""
with z as (select subject, item_id, answer - 1 as answer from ({R})), m as (select min(answer) as mn from z)
select subject, item_id, case when mn = 0 then answer + 1 else answer end as answer from z, m""")
def q_shift_positive(spark, sf):
    z = fx.responses(spark, sf).withColumn("answer", F.col("answer") - 1)
    return S.shift_positive(z)


@query("reverse_score", f"""
select subject, cast(sum(case when item_id % 2 = 0 then 6 - answer else answer end) as bigint) as total
from ({R}) group by subject""")
def q_reverse_score(spark, sf):
    r = fx.responses(spark, sf)
    neg = r.select("item_id").distinct().where(F.col("item_id") % 2 == 0)
    out = S.reverse_score(r, neg, 1, 5)
    return out.groupBy("subject").agg(F.sum("answer").cast("bigint").alias("total"))


@query("select_precomputed_scores", f"""
select subject, s1, s3 from (
  select subject, {", ".join(f"max(case when scale = {s} then score end) as s{s}" for s in range(5))}
  from (select subject, scale, sum(cast(answer as double)) as score
        from ({fx.DENSE_RESPONSES_SQL}) r join ({fx.SUBSCALE_MAP_SQL}) m using (item_id)
        group by subject, scale) group by subject)""")
def q_select_precomputed_scores(spark, sf):
    """Keep only the already-computed score columns a study ships with."""
    s = S.score_subscales(fx.dense_responses(spark, sf), fx.subscale_map(spark, sf), "sum")
    return S.select_precomputed_scores(S.scores_wide(s, list(range(5))), ["s1", "s3"])


@query("try_numeric", """
select page_id, try_cast(regexp_extract(url, '/([^/]*)$', 1) as double) as page_no from pages
where try_cast(regexp_extract(url, '/([^/]*)$', 1) as double) is not null""")
def q_try_numeric(spark, sf):
    """A text field that should be numeric (the last URL segment, a page
    number): invalid text becomes null and the row is dropped."""
    p = fx.table(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"/([^/]*)$", 1).alias("page_no"))
    return C.try_numeric(p, ["page_no"])


@query("select_items_by_name", f"""
select subject, cast(regexp_extract(item, '(\\d+)$', 1) as integer) as item_id, cast(answer as integer) as answer
from (unpivot (select subject, {", ".join(QC)} from ({W})) on {", ".join(QC)} into name item value answer)""")
def q_select_items_by_name(spark, sf):
    """Item columns picked by name prefix from the wide table (the time,
    age, attempt and segment columns are left out), then unpivoted."""
    wide = fx.survey_wide(spark, sf)
    items = C.select_items_by_name(wide, prefix="q")
    return C.wide_to_long(wide.select("subject", *items), items)


@query("cast_answers", f"""
select subject, {", ".join(f"cast({q} as double) / 4 as {q}" for q in fx.Q_COLS)} from ({fx.SURVEY_WIDE_SQL})""")
def q_cast_answers(spark, sf):
    """Answers as doubles, so that they divide exactly."""
    wide = C.cast_answers(fx.survey_wide(spark, sf).select("subject", *fx.Q_COLS), fx.Q_COLS)
    return wide.select("subject", *[(F.col(q) / 4).alias(q) for q in fx.Q_COLS])


@query("k_range", f"""
select item_id, k, count(*) as n from ({fx.DENSE_RESPONSES_SQL}), (select unnest(range(2, 6)) as k)
where answer <= k group by item_id, k""")
def q_k_range(spark, sf):
    """Answers up to each K of the range '2-5', per item."""
    ks = F.explode(F.array(*[F.lit(k).cast("long") for k in C.k_range("2-5")]))
    return (fx.dense_responses(spark, sf).withColumn("k", ks).where("answer <= k")
            .groupBy("item_id", "k").agg(F.count(F.lit(1)).alias("n")))
