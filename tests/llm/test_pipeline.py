"""The pipeline, stage by stage, against brute-force versions."""

import re

import corpus_pipeline
from kinweave.llm import decontam, neardup, quality
from tests.conftest import SF
from tests.llm.helpers import brute_classes, no_documents, odd_documents
from tests.llm.test_operators import brute_lines


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id")
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontaminate", "source_mix"]

    one = spark.createDataFrame(stages["quality_rules"](spark, docs, SF).orderBy("doc_id").collect(), docs.schema)
    verdicts = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert one.columns == names
    assert [(r.doc_id, r.text) for r in one.collect()] == [(i, r.clean_text) for i, r in sorted(verdicts.items()) if r.kept]

    before = one.collect()
    two = spark.createDataFrame(stages["line_dedup"](spark, one, SF).orderBy("doc_id").collect(), docs.schema)
    assert [r.text for r in two.collect()] == [x[3] for x in brute_lines([r.text for r in before])]
    assert all(r.n_chars == len(r.text) for r in two.collect())

    before = two.collect()
    three = spark.createDataFrame(stages["near_dedup"](spark, two, SF).orderBy("doc_id").collect(), docs.schema)
    classes = brute_classes([r.text for r in before], neardup.frequencies(two))
    assert [r.doc_id for r in three.collect()] == [r.doc_id for i, r in enumerate(before) if classes[i] == i]

    four = stages["decontaminate"](spark, three, SF)
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    leaked = {r.doc_id for r in decontam.find_leaks(three, items).filter("size(leaks) > 0").collect()}
    words = lambda s: " ".join(re.findall(r"[^\W_]+", s.lower()))
    whole = {r.doc_id for r in three.collect() if any(f" {words(i.text)} " in f" {words(r.text)} " for i in items.collect())}
    assert whole <= leaked
    assert {r.doc_id for r in four.collect()} == {r.doc_id for r in three.collect()} - leaked

    out = {r.doc_id: r.taken for r in stages["source_mix"](spark, four, SF).collect()}
    assert {r.doc_id: r.taken for r in corpus_pipeline.run(spark, SF).collect()} == out


def test_stages_on_awkward_tables(spark):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd_documents(spark), SF).columns == odd_documents(spark).columns
        assert stage(spark, no_documents(spark), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, no_documents(spark), SF).count() == 0
