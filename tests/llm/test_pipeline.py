"""The corpus pipeline, stage by stage, against what each stage must keep."""

from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from evigrain.llm import simhash, toxicity
from evigrain.runtime import table
from tests.llm.test_llm import DOCS, SMALL, brute_near_copies, brute_overlap, brute_spans


def test_stages_against_brute_force(spark):
    docs = table(spark, SMALL, "documents")
    items = [(str(r["item_id"]), r["text"]) for r in table(spark, SMALL, "benchmark").collect()]
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in now.collect()}
        after = stage(spark, now, SMALL)
        kept = {r["doc_id"]: r for r in after.collect()}
        if name != "mix":
            assert after.columns == docs.columns
        if name == "toxicity":
            assert set(kept) < set(before)
        if name == "near_dedup":
            assert set(kept) == set(brute_near_copies({i: r["text"] or "" for i, r in before.items()}).values())
        if name == "decontaminate":
            assert set(kept) == {i for i, r in before.items() if brute_overlap(items, r["text"])[1] == 0}
        if name == "pii":
            assert set(kept) == set(before) and not any(brute_spans(r["text"]) for r in kept.values())
            assert all(r["n_chars"] == len(r["text"]) for r in kept.values())
            assert all(r["text"] == before[i]["text"] for i, r in kept.items() if not any(c in before[i]["text"] for c in "0123456789@"))
        if name == "mix":
            assert set(kept) == set(before) and 0 < sum(r["taken"] for r in kept.values()) <= 1.5 * sum(r["size"] for r in kept.values()) + 1
        now = spark.createDataFrame([tuple(r) for r in kept.values()], after.schema)
    assert Counter(map(str, corpus_pipeline.run(spark, SMALL).select("doc_id", "taken").collect())) == Counter(map(str, now.select("doc_id", "taken").collect()))


def test_pipeline_on_odd_tables(spark, tmp_path):
    data = [(1, "plain words in one row of text", "en", "a", 5), (None, None, None, None, None), (2, "", None, "b", 0), (2, "", None, "b", 0), (3, "w " * 70_000, "en", None, 1)]
    docs = spark.createDataFrame(data, DOCS).withColumn("score", F.lit("mine"))
    for now in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, SMALL)
        found = now.collect()
        assert all(r["score"] == "mine" for r in found)


def test_parameters():
    assert toxicity.THRESHOLD == 0.3 and (simhash.SHINGLE_WORDS, simhash.MAX_DISTANCE) == (4, 4)
