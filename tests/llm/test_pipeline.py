"""The stages one after the other, against brute force where that is short."""

from conftest import SMALL

import corpus_pipeline
from pagewright.llm import langid, simhash
from pagewright.llm.common import Scratch, table


def test_stages(spark):
    scratch = Scratch(spark, "test")
    docs = table(spark, SMALL, "documents")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        now = scratch.keep(stage(spark, before, SMALL))
        ids = {r["doc_id"] for r in now.select("doc_id").collect()}
        assert ids <= {r["doc_id"] for r in before.select("doc_id").collect()} and len(ids) == now.count()
        if name != "byte_bpe":
            assert [f.name for f in now.schema] == corpus_pipeline.COLUMNS
        if name == "language_id":
            told = {r["doc_id"]: r for r in langid.identify(before).collect()}
            assert ids == {k for k, r in told.items() if r["accepted"]} and len(ids) > 0.98 * len(told)
            assert all(r["lang"] == told[r["doc_id"]]["lang_pred"] for r in now.collect())
        if name == "line_dedup":
            assert now.count() == before.count()
        if name == "simhash":
            found = simhash.near_duplicates(before)
            assert ids == {r["component_id"] for r in found.collect()}
        before = now
    assert sorted(before.columns) == ["decoded_sha256", "doc_id", "ids_sha256", "n_tokens"]
    assert {tuple(r) for r in corpus_pipeline.run(spark, SMALL).collect()} == {tuple(r) for r in before.collect()}


def test_line_dedup_takes_two_edits(spark):
    line = "The cat sat on the mat and looked at all of the other cats there."
    docs = spark.createDataFrame([(1, line), (2, line.replace("cat sat", "cow sat"))], "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source", "0L n_chars")
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs, SMALL).collect()} == {1: line, 2: ""}
