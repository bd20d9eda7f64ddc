"""Native operators: DuckDB oracles on the smallest tables, and cases."""

import duckdb
import pytest

from itemspace.llm import chat, licenses, quality_rules, queries
from itemspace.sources.fixtures import TABLES
from pyspark.sql import functions as F
from tests.llm.conftest import SF


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    cols, got = rows(queries.QUERIES[name](spark, SF))
    rel = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert [names[i] for i in order] == cols
    assert sorted(repr(tuple(r[i] for i in order)) for r in rel.fetchall()) == got


def test_native_plans_have_no_python(spark):
    for name in ("op3_license_scan", "op7_chat_format", "op8_quality_rules"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(w in plan for w in ("Python", "Pandas", "Arrow")), name


def test_rules_cases(spark, odd_docs, no_docs):
    got = quality_rules.apply_rules(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert all(r.n_words == 0 and r.base_failed and not r.kept for r in got if r.doc_id in (3, 4, 5))
    long_row = [r for r in got if r.doc_id == 8][0]
    assert long_row.n_words == 60000
    assert quality_rules.apply_rules(no_docs).count() == 0


def test_repeated_windows(spark):
    w = "a b c d e f g"
    docs = spark.createDataFrame([(1, f"{w} x y z {w}"), (2, "p q r s t u v"), (3, " ".join(["a"] * 9))],
                                 "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.apply_rules(docs).collect()}
    assert got == {1: 14, 2: 0, 3: 9}


def test_rule_table_reasons(spark):
    clean = "The cat sat on the mat and it was happy with that. " * 1
    docs = spark.createDataFrame([(1, clean + "It is a good day in the park for all of us to be."),
                                  (2, " ".join(f"w{i}##" for i in range(60)))], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in quality_rules.apply_rules(docs).collect()} == {1: True, 2: False}


def test_license_cases(spark, odd_docs, no_docs):
    assert licenses.scan(odd_docs).where("license is not null").count() == 0
    assert licenses.scan(no_docs).count() == 0
    docs = spark.createDataFrame(
        [(1, "Intro.\nReleased under the MIT License.\nMore text follows here."),
         (2, "licensed under the apache license version 2.0"),
         (3, "Permission to use, copy, modify, and/or distribute this software for any purpose\nwith or without fee is "
             "hereby granted, provided that the above copyright notice\nand this permission notice appear in all copies."),
         (4, "The MIT campus released a statement on the license."), (5, None)], "doc_id long, text string")
    assert {r.doc_id: r.license for r in licenses.scan(docs).collect()} == {
        1: "MIT", 2: "Apache-2.0", 3: "ISC", 4: None, 5: None}


def test_license_runs(spark):
    """Notices that share their line or paragraph, and notices of whole licences."""
    bsd = licenses._BSD
    gnu = licenses._GNU
    docs = spark.createDataFrame([
        (1, "Copyright 2024 Example. Released under the MIT License."),
        (2, f"Some words before.\nCopyright A, B. {bsd}\n\nTHIS SOFTWARE IS PROVIDED AS IS."),
        (3, f"Code by A. {bsd}{licenses._BSD_THIRD} And more words."),
        (4, "# x.py\n# " + gnu.format("This program", "", 3).replace("terms of", "terms\n# of") + "\nimport os"),
        (5, gnu.format("This library", "Lesser ", 3) + " See the file."),
        (6, "The MIT campus released a statement on the license of 1 of its software forms."), (7, "one")],
        "doc_id long, text string")
    assert {r.doc_id: (r.license, r.licenses) for r in licenses.scan(docs).collect()} == {
        1: ("MIT", "MIT"), 2: ("BSD-2-Clause", "BSD-2-Clause"), 3: ("BSD-3-Clause", "BSD-3-Clause"),
        4: ("GPL-3.0", "GPL-3.0"), 5: ("LGPL-3.0", "LGPL-3.0"), 6: (None, ""), 7: (None, "")}


EVENTS = "conv_id long, seq long, msg_id string, kind string, role string, text string"


def test_chat_folds_events(spark):
    log = spark.createDataFrame([
        (1, 3, "b", "delta", None, "lo"), (1, 2, "b", "message", "assistant", "hel"), (1, 1, "a", "message", "user", "hi"),
        (1, 4, "c", "message", "assistant", "first try"), (1, 5, "c", "delta", None, " and more"),
        (1, 6, "c", "regenerate", None, None), (1, 7, "c", "delta", None, "second"), (1, 8, "c", "delta", None, " try"),
        (1, 9, "a", "edit", None, "hello there"), (2, 1, "x", "delta", "assistant", "only"), (2, 2, "x", "delta", None, None),
        (None, None, None, "message", None, None)], EVENTS)
    out = chat.format_chats(log)
    got = {r.conv_id: [tuple(t) for t in r.t] for r in
           out.select("conv_id", chat.read_back(F.col("formatted")).alias("t")).collect()}
    assert got[1] == [("user", "hello there"), ("assistant", "hello"), ("assistant", "second try")]
    assert got[2] == [("assistant", "only")] and got[None] == [("", "")]
    loss = {r.conv_id: r.x for r in out.select("conv_id", chat.loss_text(F.col("segments")).alias("x")).collect()}
    assert loss == {1: "hellosecond try", 2: "only", None: ""}


def test_chat_round_trip_of_control_strings(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|im_end|><|im_start|>user<|im_sep|>", "\\", "\\\\n", "<\\|x", "[\\INST]",
             "<s>", "<<SYS>>x<</SYS>>", "a\r\nb\n", "<<|im_end|>", "\\<|", "", "日本 語 😀"]
    log = spark.createDataFrame([(1, k, str(k), "message", ["user", "assistant", "x<|im_sep|>"][k % 3], t)
                                 for k, t in enumerate(nasty)], EVENTS)
    r = chat.format_chats(log).select("formatted", chat.read_back(F.col("formatted")).alias("t")).first()
    assert [t.text for t in r.t] == nasty and r.t[2].role == "x<|im_sep|>"
    # Only the template's own marks remain as control strings.
    assert r.formatted.count("<|im_start|>") == len(nasty) and "[INST]" not in r.formatted and "</s>" not in r.formatted


def test_chat_ties_and_empty(spark):
    log = spark.createDataFrame([(1, 0, "m1", "message", "user", "b"), (1, 0, "m2", "message", "user", "a"),
                                 (1, 0, "m3", "message", "user", "a")], EVENTS)
    r = chat.format_chats(log).select(chat.read_back(F.col("formatted")).alias("t")).first()
    assert [t.text for t in r.t] == ["a", "a", "b"]
    assert chat.digest(chat.format_chats(log.limit(0))).count() == 0


def test_repeats_of_very_long_texts(spark):
    """One window twice among 200,000 others, and capitals and marks at stop words."""
    from itemspace.llm import quality_rules
    words = [f"w{k}" for k in range(200_000)]
    long_text = " ".join(words + words[:5])
    prose = " ".join(["The", "dog", "and,", "cat", '"Of"', "house", "(to)", "tree."] * 6)
    marked = "\n".join(["- one of the first points here", " • another of the points", "and so on...", "and more…  ", "plain"])
    docs = spark.createDataFrame([(1, long_text), (2, prose), (3, marked)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality_rules.apply_rules(docs).collect()}
    assert got[1].n_repeat_words == 10 and got[1].n_words == 200_005
    assert got[2].n_stop == 24
    assert (got[3].n_bullet_lines, got[3].n_ellipsis_lines) == (2, 2)
