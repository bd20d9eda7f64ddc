"""Codebook documents larger than a task: the same parsers on a table of lines.

The lines (key, line_no, line) of a document may lie in any number of partitions.
Which record a line belongs to is a count of the record marks before it, taken as a
segmented prefix sum: lines are dealt by range of (key, line_no), every part counts its
own marks, the parts' totals are carried along each document, and the count within a
part is added.  No task holds more of a document than its range.  A record's lines
then meet by (key, record).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemspace.functions.text import clean_sentence, strip_item_number
from itemspace.session import written


def running_count(lines: DataFrame, mark: Column, key: str = "doc_id", order: str = "line_no") -> DataFrame:
    """``lines`` with marks (lines of the document up to and with this one where ``mark``
    holds), first_mark (1 if it holds on the document's first line) and all_marks."""
    by = [key, order]
    dealt = (lines.withColumn("_mark", F.coalesce(mark, F.lit(False)).cast("int")).repartitionByRange(*by)
             .sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()))
    placed = written(dealt)
    parts = placed.groupBy(key, "_part").agg(F.sum("_mark").alias("n"), F.min_by("_mark", order).alias("first"))
    along = Window.partitionBy(key).orderBy("_part")
    carry = parts.select(
        key, "_part", F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.first("first").over(along).alias("first_mark"), F.sum("n").over(Window.partitionBy(key)).alias("all_marks"))
    within = Window.partitionBy("_part", key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (placed.withColumn("_within", F.sum("_mark").over(within)).join(carry, [key, "_part"])
            .withColumn("marks", F.col("_before") + F.col("_within")).drop("_mark", "_part", "_before", "_within"))


def line_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, line) of documents held as text."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def stitch_line_table(lines: DataFrame, key: str = "doc_id", order: str = "line_no", line: str = "line") -> DataFrame:
    """``readers.stitch_numbered_lines`` on a table of lines: (key, rec_no, sentence)."""
    full = lines.where(F.col(line) != "").select(key, order, line)
    counted = running_count(full, F.col(line).rlike("^[0-9]"), key, order)
    rec = (F.col("marks") - F.col("first_mark")).cast("int")
    parts = F.sort_array(F.collect_list(F.struct(order, line)))
    return (counted.groupBy(key, rec.alias("rec_no")).agg(F.array_join(F.transform(parts, lambda s: s[line]), "").alias("rec"))
            .select(key, "rec_no", clean_sentence(strip_item_number(F.col("rec"))).alias("sentence")))


def parse_pipe_line_table(lines: DataFrame, key: str = "doc_id", order: str = "line_no", line: str = "line") -> DataFrame:
    """``readers.parse_pipe_table`` on a table of lines: (key, rec, code, sentence, values)."""
    full = lines.select(key, order, F.trim(F.col(line)).alias("line")).where("line <> ''")
    sep = F.col("line").contains("-----")
    counted = running_count(full, sep, key, order)
    cells = F.filter(F.split(F.col("line"), r"\|"), lambda x: x != "")
    # a record is closed by its separator: the open tail after the last one is dropped
    body = counted.where(~sep & (F.col("marks") < F.col("all_marks"))).select(
        key, F.col("marks").cast("int").alias("rec"), order, cells.alias("c"))
    parts = body.groupBy(key, "rec").agg(F.sort_array(F.collect_list(F.struct(order, "c"))).alias("parts"))

    def column(i: int) -> Column:
        return F.trim(F.array_join(F.transform("parts", lambda p: F.coalesce(F.get(p["c"], F.lit(i)), F.lit(""))), ""))
    return parts.select(key, "rec", column(0).alias("code"), clean_sentence(column(1)).alias("sentence"),
                        column(2).alias("values")).where("code <> ''")
