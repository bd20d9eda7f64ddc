"""Projections, data-quality rules, funnels and deterministic sampling.

Answers live in the long form ``responses(subject, item_id, answer)`` with
one row per (subject, item); the wide form (one column per item) is built by
a pivot with an explicit id list, so no extra job discovers the values.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemspace.functions.hashing import det_uint32


# ---------------------------------------------------------------- projections
def select_items_by_name(df: DataFrame, prefix: str = "", suffix: str = "",
                         exclude: Sequence[str] = ()) -> list[str]:
    """Item columns chosen by name (schema only, no job)."""
    return [c for c in df.columns if c.startswith(prefix) and c.endswith(suffix) and c not in exclude]


def long_to_wide(responses: DataFrame, item_ids: Sequence, key: str = "subject",
                 values: Sequence[str] = ("answer",), prefixes: Sequence[str] = ("q",)) -> DataFrame:
    """One row per subject, one column per item (``q<id>``); missing -> null."""
    aggs = [F.max(v).alias(p) for v, p in zip(values, prefixes)]
    wide = responses.groupBy(key).pivot("item_id", list(item_ids)).agg(*aggs)
    ren = {}
    for i in item_ids:
        for p in prefixes:
            src = f"{i}_{p}" if len(aggs) > 1 else str(i)
            ren[src] = f"{p}{i}"
    return wide.withColumnsRenamed(ren)


def wide_to_long(wide: DataFrame, item_cols: Sequence[str], key: str = "subject",
                 id_pattern: str = r"(\d+)$") -> DataFrame:
    """Unpivot item columns back to (subject, item_id, answer), nulls dropped.
    An item name without trailing digits has a null item_id."""
    long = wide.unpivot(key, list(item_cols), "item", "answer")
    return (long.where(F.col("answer").isNotNull())
            .select(key, F.regexp_extract("item", id_pattern, 1).try_cast("int").alias("item_id"),
                    F.col("answer").cast("int").alias("answer")))


def align_to_items(responses: DataFrame, items: DataFrame, key: str = "item_id") -> DataFrame:
    """Keep only answers to items of the codebook (semi join)."""
    return responses.join(items.select(key).distinct(), key, "left_semi")


def drop_items(responses: DataFrame, item_ids: Sequence, key: str = "item_id") -> DataFrame:
    return responses.where(~F.col(key).isin(list(item_ids)))


def rename_items(responses: DataFrame, pattern: str, replacement: str, key: str = "item_code") -> DataFrame:
    return responses.withColumn(key, F.regexp_replace(key, pattern, replacement))


def cast_answers(df: DataFrame, cols: Sequence[str], dtype: str = "double") -> DataFrame:
    return df.withColumns({c: F.col(c).cast(dtype) for c in cols})


def try_numeric(df: DataFrame, cols: Sequence[str], dtype: str = "double") -> DataFrame:
    """Invalid text becomes null, and such rows are dropped."""
    out = df.withColumns({c: F.expr(f"try_cast(`{c}` as {dtype})") for c in cols})
    return out.na.drop("any", subset=list(cols))


# -------------------------------------------------------------------- filters
def all_of(conds: Sequence[Column]) -> Column:
    return functools.reduce(operator.and_, conds) if conds else F.lit(True)


def complete_rows(cols: Sequence[str]) -> Column:
    return all_of([F.col(c).isNotNull() for c in cols])


def drop_incomplete(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Wide form: drop a subject with any null answer."""
    return df.na.drop("any", subset=list(cols) if cols else None)


def drop_incomplete_long(responses: DataFrame, n_items: int, key: str = "subject") -> DataFrame:
    """Long form: keep subjects that answered all ``n_items`` items.  A window
    count needs a single shuffle on the subject (no join back)."""
    w = Window.partitionBy(key)
    return (responses.withColumn("_n", F.count("answer").over(w))
            .where(F.col("_n") == n_items).drop("_n"))


def filter_equals(df: DataFrame, col: str, value) -> DataFrame:
    return df.where(F.col(col) == F.lit(value))


def filter_between(df: DataFrame, col: str, lo, hi) -> DataFrame:
    return df.where(F.col(col).between(lo, hi))


def all_items_between(cols: Sequence[str], lo, hi) -> Column:
    return all_of([F.col(c).between(lo, hi) for c in cols])


def filter_all_items_between(df: DataFrame, cols: Sequence[str], lo, hi) -> DataFrame:
    return df.where(all_items_between(cols, lo, hi))


def row_sum(cols: Sequence[str]) -> Column:
    return functools.reduce(operator.add, [F.col(c) for c in cols])


def filter_total_time(df: DataFrame, time_cols: Sequence[str], lo, hi) -> DataFrame:
    return df.where(row_sum(time_cols).between(lo, hi))


def rowsum_outlier_bounds(df: DataFrame, value: Column) -> tuple[Column, Column]:
    """(lower, upper) = (mean - sd/2, mean + 2 sd), sample sd, computed once on
    ``df`` as scalar subqueries (one extra aggregate pass)."""
    stats = df.agg(F.struct(F.avg(value).alias("mu"), F.stddev_samp(value).alias("sd")).alias("st")).scalar()
    # one scalar subquery (one aggregate pass) holding both statistics
    return stats["mu"] - stats["sd"] / 2, stats["mu"] + 2 * stats["sd"]


def filter_rowsum_outliers(df: DataFrame, value: Column) -> DataFrame:
    lo, hi = rowsum_outlier_bounds(df, value)
    return df.where((value >= lo) & (value <= hi))


def filter_funnel(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows surviving each successive rule, in one pass over ``df``:
    (step, rule, rows).  Step 0 is the input."""
    flags = []
    acc = F.lit(True)
    for _name, cond in rules:
        acc = acc & F.coalesce(cond, F.lit(False))
        flags.append(acc)
    aggs = [F.count("*").alias("s0")] + [F.count_if(f).alias(f"s{i + 1}") for i, f in enumerate(flags)]
    counts = df.agg(*aggs)
    names = ["input"] + [n for n, _ in rules]
    stack = ", ".join(f"{i}, '{n}', cast(s{i} as bigint)" for i, n in enumerate(names))
    return counts.selectExpr(f"stack({len(names)}, {stack}) as (step, rule, rows)")


def validate_responses(responses: DataFrame, n_items: int, lo: int = 1, key: str = "subject") -> DataFrame:
    """Data-quality counts per rule: (rule, violations)."""
    per_subject = responses.groupBy(key).agg(
        F.count("answer").alias("n"), F.count_if(F.col("answer").isNull()).alias("nulls"),
        F.sum(F.abs(F.col("answer"))).alias("abs_sum"),
        F.min("answer").alias("mn"),
        F.count_if(F.col("answer").cast("double") != F.floor(F.col("answer").cast("double"))).alias("frac"))
    out = per_subject.agg(
        F.count_if(F.col("n") != n_items).alias("incomplete_subjects"),
        F.sum("nulls").alias("null_answers"),
        F.count_if(F.col("abs_sum") == 0).alias("all_zero_subjects"),
        F.count_if(F.col("mn") < lo).alias("below_min_subjects"),
        F.sum("frac").alias("non_integral_answers"),
        F.count("*").alias("subjects"))
    return out.selectExpr(
        "stack(6, 'subjects', cast(subjects as bigint), 'incomplete_subjects', cast(incomplete_subjects as bigint),"
        " 'null_answers', cast(null_answers as bigint), 'all_zero_subjects', cast(all_zero_subjects as bigint),"
        " 'below_min_subjects', cast(below_min_subjects as bigint),"
        " 'non_integral_answers', cast(non_integral_answers as bigint)) as (rule, violations)")


# ------------------------------------------------------------------- sampling
def sample_n(df: DataFrame, n: int, key: str = "subject", seed: int = 42) -> DataFrame:
    """Exactly min(n, rows) rows, no replacement, independent of partitioning:
    the n smallest md5 ranks (a TakeOrdered top-k: each task keeps n rows)."""
    h = det_uint32(seed, key)
    return df.withColumn("_h", h).orderBy("_h", key).limit(n).drop("_h")


def k_range(spec: str) -> list[int]:
    """'2-9' -> [2, ..., 9]."""
    a, b = spec.split("-")
    return list(range(int(a), int(b) + 1))
