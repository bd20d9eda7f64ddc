"""The pipeline's stages, each on its own input."""

import corpus_pipeline
import __spark_entry__ as entry
from itemspace.llm import near_dup, quality_classifier
from itemspace.llm.runtime import stored
from tests.llm.conftest import SF, split_words


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    bench = [split_words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    phrases = {tuple(w[k:k + 10]) for w in bench for k in range(max(len(w) - 9, 1))}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "line dedup", "MinHash near-dedup", "benchmark decontamination",
                     "best-fit packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, SF), "test")
        if name == "quality classifier":
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            bad = {r.doc_id for r in quality_classifier.classify(docs, labels).where("predicted = 0").collect()}
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()} - bad
        if name == "line dedup":
            before = {r.doc_id: r.text.split("\n") for r in docs.collect()}
            for r in out.collect():
                left = iter(before[r.doc_id])
                assert all(any(x == y for y in left) for x in r.text.split("\n"))     # a subsequence
        if name == "MinHash near-dedup":
            classes = {r._id: r.class_id for r in near_dup.near_duplicates(docs).collect()}
            assert sorted(r.doc_id for r in out.collect()) == sorted(set(classes.values()))
        if name == "benchmark decontamination":
            for r in out.collect():
                w = split_words(r.text)
                assert not any(tuple(w[k:k + 10]) in phrases for k in range(len(w) - 9))
        if name == "best-fit packing":
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
        else:
            assert out.columns == columns
            docs = out


def test_run_is_registered(spark):
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        if out.columns == docs.columns:
            docs = out
