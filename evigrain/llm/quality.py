"""Quality classifier: naive Bayes support vectors.

Indicators of byte n-grams, and of n-grams of repeat marks (is a word the same as
the one before it?), are scaled by the log-ratio of their counts in good
and bad documents; a linear model with hinge loss is fitted on the scaled
indicators, normalised per document, by dual coordinate descent; a logistic
curve turns its margins into scores.

Defined cases: a null or empty text has no indicators and scores by the offset
alone; without labels of both classes every text scores the share of good
labels, without any labels 0.5. Of documents that share an id one is learned from.
Extra columns are carried along.
"""

from __future__ import annotations

from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigrain.llm.samples import calibrated, families, fitted, labelled
from evigrain.runtime import tuned

BITS = 18
GRAMS = (2, 3, 4)
RUNS = (2, 3, 4, 5, 6, 8, 10, 15, 20)
#: Labelled documents that training uses at most.
TRAINING_ROWS = 6000
SMOOTHING = 1.0
COST = 1.0
PASSES = 20
THRESHOLD = 0.3

_SLICE = 1 << 18


class Model(NamedTuple):
    """scale: the log-count ratios; weight: the hinge-loss weights on scaled indicators."""

    scale: np.ndarray
    weight: np.ndarray
    slope: float
    offset: float


def repeats(text: bytes) -> np.ndarray:
    """Indicators of n-grams of repeat marks: how long runs of one word get. They take the last places of the hash range."""
    words = text.split()
    differs = np.flatnonzero(~np.fromiter(map(eq, words, words[1:]), bool, max(len(words) - 1, 0)))
    longest = int(np.diff(np.concatenate(([-1], differs, [max(len(words) - 1, 0)]))).max())
    return np.array([(1 << BITS) - 1 - k for k, n in enumerate(RUNS) if n <= longest], np.uint32)


def indicators(text: bytes, last: np.ndarray) -> np.ndarray:
    """Distinct hashed n-grams of a text; `last` is scratch of 2**BITS int64."""
    found = []
    for at in range(0, max(len(text), 1), _SLICE):  # slices overlap by the longest n-gram less one
        data = np.frombuffer(text[at : at + _SLICE + max(GRAMS) - 1], np.uint8).astype(np.uint32)
        for n in GRAMS:
            count = min(len(data) - n + 1, _SLICE)
            if count > 0:
                h = np.full(count, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
                for k in range(n):
                    h = (h ^ data[k : k + count]) * np.uint32(0x01000193)
                h ^= h >> np.uint32(15)
                h = h * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS)
                place = np.arange(count)
                last[h] = place  # of equal values the last write stays
                found.append(h[last[h] == place])
    found.append(repeats(text))
    every = np.concatenate(found)
    place = np.arange(len(every))
    last[every] = place
    return every[last[every] == place]


def descend(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, cost: np.ndarray, passes: int = PASSES, seed: int = 7) -> np.ndarray:
    """Weights of least hinge loss for unit rows (indices, values) and labels of -1 and 1, by dual coordinate descent."""
    weight, dual = np.zeros((1 << BITS) + 1), np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    squares = np.array([float(v @ v) for _, v in rows])
    for _ in range(passes):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            at, value = rows[i]
            slack = labels[i] * float(weight[at] @ value) - 1
            new = min(max(dual[i] - slack / max(squares[i], 1e-12), 0.0), cost[i])
            if new != dual[i]:
                weight[at] += (new - dual[i]) * labels[i] * value
                moved = max(moved, abs(new - dual[i]))
                dual[i] = new
        if moved < 1e-3:
            break
    return weight


def _scaled(at: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A document's row: its scaled indicators at unit length, and a constant."""
    value = scale[at]
    return np.append(at, 1 << BITS), np.append(value / max(float(np.sqrt(value @ value)), 1e-9), 1.0)


def train(texts: list[bytes], labels: np.ndarray) -> Model:
    own = families(texts)
    texts, labels = [texts[i] for i in own], labels[own]
    share = float(labels.mean()) if len(labels) else 0.5
    size = 1 << BITS
    if len(set(labels.tolist())) < 2:
        share = min(max(share, 1e-9), 1 - 1e-9)
        return Model(np.zeros(size, np.float32), np.zeros(size + 1, np.float32), 0.0, float(np.log(share / (1 - share))))
    last = np.zeros(size, np.int64)
    sets = [indicators(t, last) for t in texts]
    counts = [SMOOTHING + np.bincount(np.concatenate([s for s, y in zip(sets, labels, strict=True) if y == k]).astype(np.int64), minlength=size) for k in (0, 1)]
    scale = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    rows = [_scaled(s, scale) for s in sets]
    cost = COST * np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    weight = descend(rows, labels * 2 - 1, cost)
    raw = np.array([float(weight[at] @ value) for at, value in rows])
    return Model(scale.astype(np.float32), weight.astype(np.float32), *calibrated(raw, labels))


def scores(texts: list[bytes | None], model: Model, last: np.ndarray) -> np.ndarray:
    raw = np.empty(len(texts))
    for i, text in enumerate(texts):
        at, value = _scaled(indicators(text or b"", last), model.scale)
        raw[i] = float(model.weight[at] @ value)
    return 1 / (1 + np.exp(-np.clip(model.slope * raw + model.offset, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, usable: Column, rows: int = TRAINING_ROWS, label: str = "quality", **columns) -> Model:
    """A model from the labelled documents for which usable (over the labels) is true."""
    return Model(*fitted(labelled(docs, labels, label, usable, rows, **columns), train))


def score(docs: DataFrame, model: Model, text_col: str = "text", to: str = "score") -> DataFrame:
    """docs with a score of 0 to 1, higher: likelier good."""
    shared = tuned(docs.sparkSession).sparkContext.broadcast(tuple(model))

    @F.arrow_udf(T.DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(scores(texts.cast(pa.large_binary()).to_pylist(), Model(*shared.value), np.zeros(1 << BITS, np.int64)))

    return docs.withColumn(to, scored(F.col(text_col)))
