"""Readers: answer files and codebooks.  Codebook parsers take a *table of
documents* (id, text or html) and parse all of them in one job, row-locally
(no shuffle): each document is one row, its lines an array inside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from itemspace.functions.text import clean_sentence, strip_item_number


def read_responses(spark: SparkSession, path: str, schema: StructType | str, sep: str = "\t") -> DataFrame:
    """Delimited answer file with a header and an explicit schema; both the
    empty string and 'NA' read as null (as a pandas reader would)."""
    return (spark.read.schema(schema).option("sep", sep).option("header", True)
            .option("nullValue", "NA").option("emptyValue", None).csv(path))


def _from(array, start: int):
    """The elements of an array from a position on."""
    return F.filter(array, lambda x, i: i >= start)


def codebook_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", start: int = 0,
                   stop: int | None = None, sep: str = " ") -> DataFrame:
    """Lines ``start <= line_no < stop`` of every document (0-based, Python
    slice semantics; the whole text by default), split once on ``sep`` into
    (code, sentence).  sep='\\t' for tab codebooks, ' ' for space ones."""
    lines = docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    cond = F.col("line_no") >= start
    if stop is not None:
        cond = cond & (F.col("line_no") < stop)
    parts = F.split(F.col("line"), sep, 2)
    return (lines.where(cond)
            .select(key, F.col("line_no").cast("int").alias("line_no"),
                    F.trim(F.get(parts, F.lit(0))).alias("code"),
                    clean_sentence(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("sentence")))


def html_rows(pages: DataFrame, key: str = "page_id", html: str = "html", row_tag: str = "tr",
              cell_tag: str = "td") -> DataFrame:
    """(key, row_no, cells, hrefs): rows of ``row_tag`` with the text of each
    ``cell_tag`` inside (tags stripped, entities for quotes/ampersands
    decoded) and the link targets of the row."""
    rows = F.regexp_extract_all(F.col(html), F.lit(f"(?s)<{row_tag}\\b[^>]*>(.*?)</{row_tag}>"), 1)
    r = pages.select(key, F.posexplode(rows).alias("row_no", "row"))
    cells = F.regexp_extract_all(F.col("row"), F.lit(f"(?s)<{cell_tag}\\b[^>]*>(.*?)</{cell_tag}>"), 1)
    strip = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(
        F.regexp_replace(c, "<[^>]+>", ""), "&quot;", '"'), "&#39;", "'"), "&amp;", "&"))
    return r.select(key, F.col("row_no").cast("int").alias("row_no"),
                    F.transform(cells, strip).alias("cells"),
                    F.regexp_extract_all(F.col("row"), F.lit('href="([^"]*)"'), 1).alias("hrefs"))


def codebook_html(pages: DataFrame, key: str = "page_id", html: str = "html", skip: int = 1,
                  id_cell: int = 0, text_cell: int = 2, quoted: bool = True) -> DataFrame:
    """Table codebook: id from one cell, sentence from another (the part
    between the first pair of double quotes when ``quoted``).  A row without the
    cell or the quotes has a null there."""
    r = html_rows(pages, key, html).where(F.col("row_no") >= skip)
    txt = F.get("cells", F.lit(text_cell))
    if quoted:
        txt = F.get(F.split(txt, '"'), F.lit(1))
    return r.select(key, "row_no", F.get("cells", F.lit(id_cell)).alias("code"),
                    clean_sentence(txt).alias("sentence"))


def stitch_numbered_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Glue every line that does not start with a digit onto the record of
    the last line that does (no separator, as in the original codebook
    parser), skip empty lines, then strip the item number and collapse
    spaces.  Lines before the first numbered line form a record of their
    own.  Row-local and linear: the text is cut before each numbered line."""
    recs = F.filter(F.transform(F.split(F.col(text), "\n(?=[0-9])"), lambda r: F.replace(r, F.lit("\n"), F.lit(""))),
                    lambda r: r != "")
    return (docs.select(key, F.posexplode(recs).alias("rec_no", "rec"))
            .select(key, F.col("rec_no").cast("int").alias("rec_no"),
                    clean_sentence(strip_item_number(F.col("rec"))).alias("sentence")))


def parse_pipe_table(docs: DataFrame, key: str = "doc_id", text: str = "text", skip_lines: int = 0) -> DataFrame:
    """Markdown grid table: a line containing '-----' ends a record; cells of
    the lines of one record (split on '|', empty pieces dropped, three cells
    expected, a missing one is empty) are concatenated column-wise; records with an empty id are
    dropped.  Row-local (one document per row)."""
    lines = F.filter(F.transform(_from(F.split(F.col(text), "\n"), skip_lines), lambda x: F.trim(x)),
                     lambda x: x != "")
    d = docs.select(key, F.posexplode(lines).alias("pos", "line"))
    sep = F.col("line").contains("-----")
    d = d.withColumn("rec", F.sum(sep.cast("int")).over(Window.partitionBy(key).orderBy("pos")))
    cells = F.filter(F.split(F.col("line"), r"\|"), lambda x: x != "")
    body = d.where(~sep).select(key, "rec", "pos", cells.alias("c"))
    g = body.groupBy(key, "rec").agg(F.sort_array(F.collect_list(F.struct("pos", "c"))).alias("parts"))
    def cell(idx):
        return lambda p: F.coalesce(F.get(p["c"], F.lit(idx)), F.lit(""))  # one-argument lambda: Spark reads two arguments as (x, index)
    joined = g.select(key, "rec", *[F.array_join(F.transform("parts", cell(i)), "").alias(n)
                                    for i, n in enumerate(["code", "question", "values"])])
    # a record is closed by its separator line: the open tail after the last one is dropped
    closed = d.where(sep).groupBy(key).agg(F.max("rec").alias("_last"))
    return (joined.join(closed, key).where(F.col("rec") < F.col("_last"))
            .select(key, F.col("rec").cast("int").alias("rec"), F.trim("code").alias("code"),
                    clean_sentence(F.trim("question")).alias("sentence"), F.trim("values").alias("values"))
            .where(F.col("code") != ""))


def split_numbered_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Cut a text at lines holding only an item number; each block keeps its
    number, digits are removed from the text and it is trimmed."""
    parts = F.split(F.col(text), r"(?m)^\s*[0-9]+\s*$")
    nums = F.regexp_extract_all(F.col(text), F.lit(r"(?m)^\s*([0-9]+)\s*$"), 1)
    d = docs.select(key, parts.alias("p"), nums.alias("n"))
    return (d.select(key, F.posexplode(_from(F.col("p"), 1)).alias("i", "block"), "n")
            .select(key, F.get("n", F.col("i")).cast("int").alias("item"),
                    clean_sentence(F.regexp_replace("block", "[0-9]", "")).alias("sentence")))


def list_runs(spark: SparkSession, path: str) -> DataFrame:
    """All run-metric tables below a folder (partition discovery)."""
    return spark.read.option("recursiveFileLookup", False).parquet(path)


def read_run(spark: SparkSession, metrics_path: str, predictions_path: str, run_id: str) -> tuple[DataFrame, DataFrame]:
    """Metrics and predictions of one run (partition pruning on run_id)."""
    m = spark.read.parquet(metrics_path).where(F.col("run_id") == run_id)
    p = spark.read.parquet(predictions_path).where(F.col("run_id") == run_id)
    return m, p


def read_pairwise(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(path)
