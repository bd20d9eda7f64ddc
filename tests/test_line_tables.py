"""Documents as tables of lines, split over many partitions, against the row-local parsers."""

import numpy as np

from itemspace.sources import line_tables as LT
from itemspace.sources import readers as RD


def both(spark, texts, local, table):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lines = LT.line_table(docs).repartition(13)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(map(tuple, table(lines).collect()))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    return got, sorted(map(tuple, local(docs).collect()))


def test_stitched_lines(spark):
    rng = np.random.default_rng(0)
    one = "\n".join(f"{k}. starts here" if rng.random() < 0.3 else ("" if rng.random() < 0.1 else f" goes on  {k}") for k in range(4000))
    texts = [one, "", "1. a\nb\n\n2. c", "no number\nat all", "\n\n3 x\n4 y", "head\n1. a", "9"]
    got, want = both(spark, texts, RD.stitch_numbered_lines, LT.stitch_line_table)
    assert got == want and len(got) > 1000


def test_pipe_tables(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(1500):
        rows.append("-----" if rng.random() < 0.4 else f"|Q{k}| text {k} |{k % 5}|" if rng.random() < 0.7 else " | more |")
    texts = ["\n".join(rows), "", "-----", "|a|b|c|", "-----\n|a|b|c|\n-----\n|tail|x|", "x|y\n-----\n| |no code|\n-----"]
    got, want = both(spark, texts, RD.parse_pipe_table, LT.parse_pipe_line_table)
    assert got == want and len(got) > 100


def test_counts_carry_over_parts(spark):
    lines = spark.range(1000).selectExpr("id % 3 as doc_id", "id as line_no", "id % 7 = 0 as m").repartition(9)
    got = LT.running_count(lines, lines["m"]).collect()
    marks = {d: [i for i in range(1000) if i % 3 == d and i % 7 == 0] for d in range(3)}
    for r in got:
        assert r.marks == sum(i <= r.line_no for i in marks[r.doc_id]) and r.all_marks == len(marks[r.doc_id])
        assert r.first_mark == int(r.doc_id % 7 == 0)
