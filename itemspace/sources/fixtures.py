"""Survey-shaped views over the driver's test tables (see FIXTURES.md).

Each view is a lazy DataFrame over the parquet files, so filters and column
pruning reach the scan.  The DuckDB text of the same view lives next to it
(``*_SQL``) and is reused by the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# subject = customer, item = line number, Likert answer 1..5.
def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return (li.join(o, li.l_orderkey == o.o_orderkey)
            .groupBy(F.col("o_custkey").alias("subject"), F.col("l_linenumber").alias("item_id"))
            .agg((F.lit(1) + F.sum("l_quantity").cast("bigint") % 5).cast("int").alias("answer")))


RESPONSES_SQL = """
select o_custkey as subject, l_linenumber as item_id,
       cast(1 + cast(sum(l_quantity) as bigint) % 5 as integer) as answer
from lineitem join orders on l_orderkey = o_orderkey
group by o_custkey, l_linenumber"""


# F1b: per-subject side columns used by the quality rules.
def subject_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    per_order = li.groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("price"))
    per_cust = (o.join(per_order, o.o_orderkey == per_order.l_orderkey, "left")
                .groupBy("o_custkey")
                .agg(F.sum("price").alias("elapsed"), F.count("o_orderkey").cast("int").alias("attempts")))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return (c.join(per_cust, c.c_custkey == per_cust.o_custkey, "left")
            .select(F.col("c_custkey").alias("subject"),
                    (F.lit(10) + F.floor(F.abs("c_acctbal") / 125).cast("int")).alias("age"),
                    F.coalesce("attempts", F.lit(0)).alias("attempts"),
                    F.col("elapsed"),
                    F.col("c_mktsegment").alias("segment")))


SUBJECT_SIDE_SQL = """
select c_custkey as subject,
       cast(10 + cast(floor(abs(c_acctbal) / 125) as integer) as integer) as age,
       cast(coalesce(pc.attempts, 0) as integer) as attempts,
       pc.elapsed as elapsed,
       c_mktsegment as segment
from customer left join (
    select o_custkey, sum(price) as elapsed, count(o_orderkey) as attempts
    from orders left join (select l_orderkey, sum(l_extendedprice) as price
                           from lineitem group by l_orderkey) po on o_orderkey = po.l_orderkey
    group by o_custkey) pc on c_custkey = pc.o_custkey"""


# F1c: dense survey, subject = supplier, item = brand number 1..25.
def dense_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return (li.join(p, li.l_partkey == p.p_partkey)
            .groupBy(F.col("l_suppkey").alias("subject"),
                     F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int").alias("item_id"))
            .agg((F.lit(1) + F.sum("l_quantity").cast("bigint") % 5).cast("int").alias("answer")))


DENSE_RESPONSES_SQL = """
select l_suppkey as subject, cast(regexp_extract(p_brand, '(\\d+)$', 1) as integer) as item_id,
       cast(1 + cast(sum(l_quantity) as bigint) % 5 as integer) as answer
from lineitem join part on l_partkey = p_partkey
group by l_suppkey, cast(regexp_extract(p_brand, '(\\d+)$', 1) as integer)"""


# Survey spec for F1c (fixed parameters, like a codebook's scoring key):
# item -> scale is item mod 5; scale -> overlapping global factor below.
GLOBAL_FACTORS = {"G1": (0, 1, 2), "G2": (2, 3), "G3": (3, 4, 0)}


def subscale_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item -> scale, derived from the brands present in ``part``."""
    return (table(spark, sf_dir, "part")
            .select(F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int").alias("item_id"))
            .distinct()
            .select("item_id", (F.col("item_id") % 5).cast("int").alias("scale")))


SUBSCALE_MAP_SQL = """
select item_id, cast(item_id % 5 as integer) as scale from (
  select distinct cast(regexp_extract(p_brand, '(\\d+)$', 1) as integer) as item_id from part)"""


def factor_map(spark: SparkSession) -> DataFrame:
    rows = [(g, s) for g, scales in GLOBAL_FACTORS.items() for s in scales]
    return spark.createDataFrame(rows, "factor string, scale int")


FACTOR_MAP_SQL = "(values " + ", ".join(
    f"('{g}', {s})" for g, scales in GLOBAL_FACTORS.items() for s in scales) + ") fm(factor, scale)"


# item vectors for the 7-item survey (line numbers start at 1).  Every row of
# ``embeddings`` is a window of some item's text; an item's vector is their mean.
N_ITEMS_F1 = 7


def item_vectors(spark: SparkSession, sf_dir: str, n_items: int = N_ITEMS_F1) -> DataFrame:
    from itemspace.operators.vectors import pool_groups
    windows = table(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") % n_items + 1).cast("int").alias("item_id"), F.col("embedding").cast("array<double>").alias("e"))
    return pool_groups(windows, "item_id", "mean", "e")


ITEM_VECTORS_SQL = f"""
select item_id, list(x order by d) as e from (
  select item_id, d, avg(x) as x from (
    select cast(vec_id % {N_ITEMS_F1} + 1 as integer) as item_id, unnest(cast(embedding as double[])) as x,
           unnest(range(len(embedding))) as d from embeddings) group by item_id, d) group by item_id"""


# subject vectors with an external label.
def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("subject"), F.col("embedding").cast("array<double>").alias("v"),
        F.col("label").cast("int").alias("label"))


VECTORS_SQL = """
select vec_id as subject, cast(embedding as double[]) as v, cast(label as integer) as label
from embeddings"""


# item table (codebook sentences).
def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id"), F.col("text").alias("sentence"))


# long texts.
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


# two labelings of the same documents.
def partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")


# F1 with a per-item time column (seconds = summed extended price), for the
# total-time rule; and the wide survey table with the F1b side columns.
def responses_timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return (li.join(o, li.l_orderkey == o.o_orderkey)
            .groupBy(F.col("o_custkey").alias("subject"), F.col("l_linenumber").alias("item_id"))
            .agg((F.lit(1) + F.sum("l_quantity").cast("bigint") % 5).cast("int").alias("answer"),
                 F.sum("l_extendedprice").alias("seconds")))


RESPONSES_TIMED_SQL = """
select o_custkey as subject, l_linenumber as item_id,
       cast(1 + cast(sum(l_quantity) as bigint) % 5 as integer) as answer,
       sum(l_extendedprice) as seconds
from lineitem join orders on l_orderkey = o_orderkey
group by o_custkey, l_linenumber"""

ITEM_IDS_F1 = list(range(1, N_ITEMS_F1 + 1))
Q_COLS = [f"q{i}" for i in ITEM_IDS_F1]
T_COLS = [f"t{i}" for i in ITEM_IDS_F1]


def survey_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, q1..q7, t1..t7 joined to the side columns (all customers)."""
    from itemspace.operators.clean import long_to_wide
    wide = long_to_wide(responses_timed(spark, sf_dir), ITEM_IDS_F1,
                        values=("answer", "seconds"), prefixes=("q", "t"))
    return subject_side(spark, sf_dir).join(wide, "subject", "left")


SURVEY_WIDE_SQL = f"""
select s.*, {", ".join(f"w.q{i}, w.t{i}" for i in ITEM_IDS_F1)}
from ({SUBJECT_SIDE_SQL}) s left join (
  select subject, {", ".join(f"max(case when item_id = {i} then answer end) as q{i}, "
                              f"max(case when item_id = {i} then seconds end) as t{i}" for i in ITEM_IDS_F1)}
  from ({RESPONSES_TIMED_SQL}) group by subject) w using (subject)"""
