"""Scores of the classifiers' queries against a plain reading of their models, n-gram by n-gram."""

import math
from itertools import groupby

import numpy as np
import pytest

from evigrain.llm import quality, queries, samples, toxicity
from evigrain.runtime import table
from tests.llm.test_llm import SMALL

MASK = 0xFFFFFFFF


def gram_place(data, bits):
    h = len(data) * 0x9E3779B1 & MASK
    for c in data:
        h = (h ^ c) * 0x01000193 & MASK
    h ^= h >> 15
    return (h * 0x85EBCA6B & MASK) >> (32 - bits)


def curve(model, raw):
    return 1 / (1 + math.exp(-min(max(model.slope * raw + model.offset, -30), 30)))


def brute_quality(model, text):
    places = {gram_place(text[i : i + n], quality.BITS) for n in quality.GRAMS for i in range(len(text) - n + 1)}
    longest = max((len(list(g)) for _, g in groupby(text.split())), default=1)
    places |= {(1 << quality.BITS) - 1 - k for k, n in enumerate(quality.RUNS) if n <= longest}
    length = max(math.sqrt(sum(float(model.scale[p]) ** 2 for p in places)), 1e-9)
    return curve(model, sum(float(model.weight[p]) * float(model.scale[p]) for p in places) / length + float(model.weight[1 << quality.BITS]))


def brute_toxicity(model, text):
    own = [w for w, _ in groupby(x.strip(b".,;:!?|#%&$*<>()[]{}\"'-_~") for x in text.lower().split()) if w]
    scores = []
    for word in own:
        marked = b"<" + word + b">"
        grams = [gram_place(marked[i : i + n], toxicity.BUCKETS_LOG2) for n in toxicity.GRAMS for i in range(len(marked) - n + 1)]
        scores.append(sum(float(model.gram[g]) for g in grams) / len(grams))
    raw = max(((a + b) / 2 for a, b in zip(scores, [*scores[1:], 0.0], strict=True)), default=0.0)
    return curve(model, raw)


@pytest.mark.parametrize(("name", "module", "label", "fold", "brute"), [("op7_quality", quality, "quality", (5, 0), brute_quality), ("op9_toxicity", toxicity, "toxic", (4, 2), brute_toxicity)])
def test_scores_equal_a_plain_reading_of_the_model(spark, name, module, label, fold, brute):
    docs = table(spark, SMALL, "documents").select("doc_id", "text")
    model = module.fit(docs, table(spark, SMALL, "labels"), samples.fold("doc_id", fold[0]) != fold[1])
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    found = queries.QUERIES[name](spark, SMALL).collect()
    assert len(found) == len(texts)
    for r in found:
        if len(texts[r["doc_id"]]) < 20_000:
            expected = brute(model, texts[r["doc_id"]])
            assert r["score"] == pytest.approx(expected, abs=2e-4) and (r["predicted"] == int(r["score"] >= 0.3))
    assert len({round(r["score"], 6) for r in found}) > 50 and isinstance(model.slope, float) and np.isfinite(model.offset)
