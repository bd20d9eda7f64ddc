import os
import tempfile

from pyspark.sql import functions as F

from itemspace.functions import text as T
from itemspace.sources import readers as RD


def test_clean_and_multiline(spark):
    df = spark.createDataFrame([("  a   b \t",), ("x\ny",), ("x\n",)], "s string")
    got = [r[0] for r in df.select(T.clean_sentence("s")).collect()]
    assert got == ["a b", "x\ny", "x"]
    assert [r[0] for r in df.select(T.flag_multiline("s")).collect()] == [False, True, False]


def test_word_windows_cover_whole_text(spark):
    words = [f"w{i}" for i in range(50)]
    df = spark.createDataFrame([(" ".join(words),), ("short text",)], "s string")
    wins = [r[0] for r in df.select(T.word_windows("s", 10)).collect()]
    w0 = [w.split(" ") for w in wins[0]]
    assert all(len(w) <= 9 for w in w0[:-1]) and len(w0[-1]) <= 10
    assert w0[-1][-1] == "w49" and w0[0][0] == "w0"
    covered = set(x for w in w0 for x in w)
    assert covered == set(words)
    assert wins[1] == ["short text"]


def test_parse_mode(spark):
    df = spark.createDataFrame([("feat_raw_no_norm",), ("llm_random_768",), ("llm_openai",)], "m string")
    src, nn, dims = T.parse_mode("m")
    got = [tuple(r) for r in df.select(src, nn, dims).collect()]
    assert got == [("features", True, None), ("embedding", False, 768), ("embedding", False, None)]


def test_stitch_pipe_blocks(spark):
    doc = "1. I like\n cats\n\n2. Dogs  are\nfine\n"
    d = spark.createDataFrame([(1, doc)], "doc_id long, text string")
    got = [r.sentence for r in RD.stitch_numbered_lines(d).orderBy("rec_no").collect()]
    # continuation lines are glued without a separator, as in the original parser
    assert got == ["I like cats", "Dogs arefine"]
    pipe = "| 1 | Age | n |\n| 0 | in years | |\n------\n|  | skip | x |\n------\n| 3 | Mood | 1-5 |\n------\n| 9 | open | |"
    p = spark.createDataFrame([(1, pipe)], "doc_id long, text string")
    rows = [(r.code, r.sentence) for r in RD.parse_pipe_table(p).orderBy("rec").collect()]
    # cells are concatenated as written (spaces kept), then trimmed
    assert rows == [("1  0", "Age in years"), ("3", "Mood")]
    blocks = "intro\n1\nSad  2x\n2\nTired\n"
    b = spark.createDataFrame([(1, blocks)], "doc_id long, text string")
    assert [(r.item, r.sentence) for r in RD.split_numbered_blocks(b).collect()] == [(1, "Sad x"), (2, "Tired")]


def test_html_codebook(spark):
    html = ('<table><tr><th>id</th><th>x</th><th>q</th></tr>'
            '<tr><td>A1</td><td>-</td><td>Says "I am  calm" often</td></tr>'
            '<tr><td>A2</td><td>-</td><td>Says "I worry"</td></tr></table>')
    p = spark.createDataFrame([(1, html)], "page_id long, html string")
    got = [(r.code, r.sentence) for r in RD.codebook_html(p).orderBy("row_no").collect()]
    assert got == [("A1", "I am calm"), ("A2", "I worry")]


def test_read_responses_na(spark):
    d = tempfile.mkdtemp(prefix="itemspace-tsv-", dir="/tmp")
    with open(os.path.join(d, "a.tsv"), "w") as fh:
        fh.write("Q1\tQ2\tage\n1\t2\t30\nNA\t3\t\n4\tx\t20\n")
    df = RD.read_responses(spark, d, "Q1 int, Q2 int, age int")
    rows = [tuple(r) for r in df.collect()]
    assert rows == [(1, 2, 30), (None, 3, None), (4, None, 20)]
    assert df.na.drop().count() == 1


def test_stream_equals_batch(spark):
    from itemspace.operators import cluster as K
    from itemspace.operators import vectors as V
    from itemspace.plans import flagship
    from itemspace.plans.grid_queries import q_score_stream, score_static
    from itemspace.sources import fixtures as fx
    sf = "/root/testdata/sf0.001"
    streamed = sorted(tuple(r) for r in q_score_stream(spark, sf).collect())
    emb_raw = V.embed_subjects(fx.responses(spark, sf), fx.item_vectors(spark, sf), n_items=fx.N_ITEMS_F1)
    shift = abs(emb_raw.agg(F.min(F.array_min("v"))).first()[0])
    _a, centres = K.lloyd_sweep(flagship.subject_embeddings(spark, sf), [3], 5, dims=64)
    static = sorted(tuple(r) for r in score_static(spark, sf, centres[3], shift)
                    .select("subject", "k", "prediction").collect())
    assert streamed == static and len(streamed) > 0


def test_sink_roundtrip_partition_pruning(spark):
    from itemspace.sources import sinks as SK
    d = tempfile.mkdtemp(prefix="itemspace-sink-", dir="/tmp")
    df = spark.createDataFrame([("F1", "r1", 2, 1, 0), ("F1", "r2", 2, 1, 1), ("F1", "r1", 2, 2, 1)],
                               "dataset string, run_id string, k int, subject long, prediction int")
    SK.write_predictions(df, d)
    _m, p = RD.read_run(spark, d, d, "r1")
    assert sorted((r.subject, r.prediction) for r in p.collect()) == [(1, 0), (2, 1)]
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "run_id" in plan.split("PartitionFilters: [", 1)[1][:200]
