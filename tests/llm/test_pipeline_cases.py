"""Stages on odd rows, and names that clash with columns of the operators."""

import corpus_pipeline
from itemspace.llm import decontam, quality_classifier
from itemspace.llm.runtime import stored
from tests.llm.conftest import SF


def test_odd_rows_go_through_every_stage(spark, odd_docs):
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, SF), "odd")
        assert out.columns == odd_docs.columns and out.count() <= docs.count()
        docs = out
    assert stored(corpus_pipeline.STAGES[-1][1](spark, docs, SF), "odd").select("doc_id").distinct().count() \
        == docs.select("doc_id").distinct().count()


def test_verdict_is_the_rows_own(spark):
    """A rejected and a kept text under one id, and both without an id."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    said = quality_classifier.classify(docs, labels)
    good, bad = (docs.join(said.where(f"predicted = {p}"), "doc_id").orderBy("doc_id").first().text for p in (1, 0))
    rows = docs.unionByName(spark.createDataFrame(
        [(-5, good, "en", "s", 1), (-5, bad, "en", "s", 1), (None, good, "en", "s", 1), (None, bad, "en", "s", 1)], docs.schema))
    left = corpus_pipeline.quality(spark, rows, SF).where("doc_id is null or doc_id = -5").collect()
    assert sorted((str(r.doc_id), r.text) for r in left) == sorted([("-5", good), ("None", good)])


def test_decontamination_with_clashing_names(spark):
    text = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, text, 1, "a", "b"), (2, "nothing here", 2, "c", "d")],
                                 "doc_id long, text string, _words int, _spans string, _items string")
    items = spark.createDataFrame([("i", "two three four five six seven eight nine ten eleven")], "item_id string, text string")
    for remove in (False, True):
        got = {r.doc_id: r for r in decontam.decontaminate(docs, items, remove=remove).collect()}
        assert got[1]._items == ["i"] and len(got[1]._spans) == 1 and got[2]._items == [] and got[2].text == "nothing here"
