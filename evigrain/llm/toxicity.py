"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the embeddings of its character n-grams, a stretch of
words is the mean of its words, and a softmax over two classes reads it. A
document is as toxic as its most toxic stretch of two words, wherever that
starts, so that length does not dilute a few bad words. Training first draws
longer stretches of each document at random. Later passes take its most toxic
stretch among words that are not hidden in that pass, so that no word leaves the
others unlearned. Words are replaced by edited copies (a letter lost, doubled,
swapped or exchanged) now and then: misspellings share n-grams with these and
with the words they stand for.

Defined cases: a null or wordless text scores as a stretch without words; without
labels of both classes every text scores the share of toxic labels (0 without
labels). Of documents that share an id one is learned from. Extra columns are
carried along.
"""

from __future__ import annotations

from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigrain.llm.batches import groups
from evigrain.llm.samples import calibrated, families, fitted, labelled
from evigrain.runtime import tuned

STRETCH = 2
BUCKETS_LOG2 = 18
BUCKETS = 1 << BUCKETS_LOG2
DIMENSIONS = 8
GRAMS = (3, 4, 5)
#: Labelled documents that training uses at most.
TRAINING_ROWS = 6000
PASSES, RANDOM_PASSES, RANDOM_STRETCH = 60, 8, 16
#: Fingerprints of one family of near copies are so many bits apart at most; unrelated texts are 32 on average.
FAMILY = 16
#: Share of words that a pass hides, and of those in a stretch that an edited copy takes the place of.
HIDDEN, EDITED = 0.5, 0.8
#: Share of misspelled words that clean documents are expected to have.
MISSPELLED = 0.05
THRESHOLD = 0.3
#: A toxic label is doubted (weighs DOUBTED) while its document scores below this share of the others: some labels are wrong.
TRUSTED, DOUBTED = 0.95, 0.05
#: Step, decay, and the floor of the squared gradients that divide the step: it keeps n-grams of few documents small.
STEP, DECAY, FLOOR = 0.5, 1e-3, 1e-8

_EDGES = b".,;:!?|#%&$*<>()[]{}\"'-_~"


class Model(NamedTuple):
    """gram: the difference of the two classes' logits that each n-gram's embedding gives; slope and offset make it a probability."""

    gram: np.ndarray
    slope: float
    offset: float


def words(text: bytes) -> list[bytes]:
    """ASCII-lowered words without edge punctuation; a word repeated at once counts once."""
    return [w for w, _ in groupby(x.strip(_EDGES) for x in text.lower().split()) if w]


_CHUNK_WORDS = 20_000


def _subwords(vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter((len(w) + 2 for w in vocabulary), np.int32, len(vocabulary))
    text = np.frombuffer(b"<" + b"><".join(vocabulary) + b">", np.uint8).astype(np.uint32)
    word = np.repeat(np.arange(len(vocabulary), dtype=np.int32), sizes)
    left = np.cumsum(sizes)[word] - np.arange(len(text))
    grams, owners = [], []
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h = (h ^ text[at + k]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        grams.append((h * np.uint32(0x85EBCA6B) >> np.uint32(32 - BUCKETS_LOG2)).astype(np.int32))
        owners.append(word[at])
    owner = np.concatenate(owners)
    return np.concatenate(grams)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(vocabulary))


def subwords(vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all words, one after the other, and where each word's begin (with the end of all)."""
    parts = [_subwords(vocabulary[i : i + _CHUNK_WORDS]) for i in range(0, len(vocabulary), _CHUNK_WORDS)]
    return np.concatenate([g for g, _ in parts]), np.concatenate(([0], np.cumsum(np.concatenate([n for _, n in parts]))))


def _means(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Mean of values between starts; every word has an n-gram, so no range is empty."""
    return np.add.reduceat(values, starts[:-1]) / np.diff(starts)


def _stretches(scores: np.ndarray) -> np.ndarray:
    """Mean scores of the stretches that start at each word; nothing follows the last one."""
    return (scores + np.append(scores[1:], 0)) / STRETCH


#: Letters that misspellings exchange, by look; any other letter becomes some letter.
_LIKE = {97: b"4@", 101: b"3", 105: b"1!", 111: b"0", 115: b"5$", 116: b"7"}


def edited(word: bytes, rng: np.random.Generator) -> bytes:
    """A word with one letter lost, doubled, swapped or exchanged, or letters by digits; short words stay."""
    if len(word) < 4:
        return word
    kind, at = int(rng.integers(5)), int(rng.integers(1, len(word) - 1))
    if kind == 0:
        return word[:at] + word[at + 1 :]
    if kind == 1:
        return word[: at + 1] + word[at:]
    if kind == 2:
        return word[: at - 1] + word[at : at + 1] + word[at - 1 : at] + word[at + 1 :]
    if kind == 3:
        return word[:at] + bytes([97 + int(rng.integers(26))]) + word[at + 1 :]
    return b"".join(bytes([_LIKE[c][int(rng.integers(len(_LIKE[c])))]]) if c in _LIKE and rng.random() < 0.7 else bytes([c]) for c in word)


def train(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    own = families(texts, FAMILY)
    texts, labels = [texts[i] for i in own], labels[own]
    share = float(labels.mean()) if len(labels) else 0.0
    index: dict[bytes, int] = {}
    tokens = [np.array([index.setdefault(w, len(index)) for w in words(t)] or [0], np.int64) for t in texts]
    if not index or not 0 < share < 1:
        return Model(np.zeros(BUCKETS, np.float32), 0.0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    known = list(index)
    grams, starts = subwords(known)
    size = np.array([len(t) for t in tokens])
    text, begin, owner = np.concatenate(tokens), np.cumsum(size) - size, np.repeat(np.arange(len(tokens)), size)
    embedding = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    softmax = rng.normal(0, 0.1, (DIMENSIONS, 2)).astype(np.float32)
    bias, seen_e, seen_s = np.zeros(2, np.float32), np.full(BUCKETS, FLOOR, np.float32), 1e-8
    weight, trust = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)), np.ones(len(labels))
    for turn in range(PASSES):
        if turn < RANDOM_PASSES:
            most, draws = RANDOM_STRETCH, 3
            start = rng.integers(0, size[:, None], (len(tokens), draws))
        else:
            most, draws = STRETCH, 1
            score = _means((embedding @ (softmax[:, 1] - softmax[:, 0]))[grams], starts)
            score[rng.random(len(known)) < HIDDEN] = -1e6
            own = score[text]
            after = np.append(own[1:], 0)
            after[begin[1:] - 1] = 0  # nothing follows a text's last word
            found = (own + after) / STRETCH
            top = np.maximum.reduceat(found, begin)
            best = np.flatnonzero(found == top[owner])
            start = (best[np.searchsorted(owner[best], np.arange(len(tokens)))] - begin)[:, None]
            trust = np.where((labels == 1) & (top < np.quantile(top[labels == 0], TRUSTED)) | (top < -1e5), DOUBTED, 1.0)
        for part in np.array_split(rng.permutation(len(tokens)), min(6, len(tokens))):
            of, at = np.repeat(part, draws), start[part].ravel()
            length = np.minimum(most, size[of] - at)
            bag = np.repeat(np.arange(len(of)), length)
            word = text[np.repeat(begin[of] + at - (np.cumsum(length) - length), length) + np.arange(length.sum())]
            gram, ends = subwords([edited(known[w], rng) if copy else known[w] for w, copy in zip(word.tolist(), (rng.random(len(word)) < EDITED).tolist(), strict=True)])
            n = np.diff(ends)
            of_bag = np.repeat(bag, n)
            part_of = np.repeat(1 / (n * np.maximum(length, STRETCH)[bag]), n)
            hidden = np.stack([np.bincount(of_bag, embedding[gram, k] * part_of, len(of)) for k in range(DIMENSIONS)], axis=1)
            logits = hidden @ softmax + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(of)), labels[of]] -= 1
            p *= (weight[of] * trust[of] / len(of))[:, None]
            back = p @ softmax.T
            grad_s, grad_b = hidden.T @ p, p.sum(axis=0)
            met, at = np.unique(gram, return_inverse=True)
            grad_e = np.stack([np.bincount(at, back[of_bag, k] * part_of, len(met)) for k in range(DIMENSIONS)], axis=1)
            seen_e[met] += (grad_e**2).mean(axis=1)
            seen_s += float((grad_s**2).mean())
            embedding *= np.float32(1 - DECAY)
            embedding[met] -= (STEP * grad_e / np.sqrt(seen_e[met])[:, None]).astype(np.float32)
            softmax -= (0.5 * grad_s / np.sqrt(seen_s)).astype(np.float32)
            bias -= (0.5 * grad_b).astype(np.float32)
    gram_score = (embedding @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32)
    scored = lambda own: _means(gram_score[(found := subwords(own))[0]], found[1])
    stretches = [_stretches(x) for x in np.split(scored(known)[text], begin[1:])]
    # The curve is laid between misspelled stretches of toxic documents and clean documents with some misspellings, besides the documents themselves.
    copies = np.where(rng.random(len(text)) < MISSPELLED, scored([edited(w, rng) for w in known])[text], scored(known)[text])
    most = np.array([x.max() for x in stretches])
    wrong = np.array([_stretches(x).max() for x in np.split(copies, begin[1:])])
    toxic = np.flatnonzero(labels == 1)
    worst = [text[begin[d] + (at := int(np.argmax(stretches[d]))) : begin[d] + min(at + STRETCH, size[d])] for d in toxic]
    lone = scored([edited(known[w], rng) for pair in worst for w in pair])
    wrong[toxic] = [x.sum() / STRETCH for x in np.split(lone, np.cumsum([len(p) for p in worst])[:-1])]
    return Model(gram_score, *calibrated(np.concatenate([most, wrong]), np.concatenate([labels, labels])))


class Scorer:
    """Scores texts; keeps the scores of words it has met, up to a bound."""

    KEPT = 300_000

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def _most(self, tokens: list[list[bytes]]) -> list[float]:
        """The logit difference of each text's most toxic stretch."""
        known = self.known
        if len(known) > self.KEPT:
            known.clear()
        new = list({w for t in tokens for w in t if w not in known})
        if new:
            grams, starts = subwords(new)
            known.update(zip(new, _means(self.model.gram[grams], starts).tolist(), strict=True))
        return [float(_stretches(np.fromiter(map(known.__getitem__, t), np.float64, len(t))).max()) if t else 0.0 for t in tokens]

    def __call__(self, texts: list[bytes | None]) -> np.ndarray:
        read = [t or b"" for t in texts]
        raw = np.array([x for part in groups(read, 1 << 20) for x in self._most([words(t) for t in read[part]])])
        return 1 / (1 + np.exp(-np.clip(self.model.slope * raw + self.model.offset, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, usable: Column, rows: int = TRAINING_ROWS, label: str = "toxic", **columns) -> Model:
    """A model from the labelled documents for which usable (over the labels) is true."""
    return Model(*fitted(labelled(docs, labels, label, usable, rows, **columns), train))


def score(docs: DataFrame, model: Model, text_col: str = "text", to: str = "score") -> DataFrame:
    """docs with a score of 0 to 1, higher: likelier toxic."""
    shared = tuned(docs.sparkSession).sparkContext.broadcast(tuple(model))
    scorers: dict[int, Scorer] = {}

    @F.arrow_udf(T.DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        if 0 not in scorers:
            scorers[0] = Scorer(Model(*shared.value))
        return pa.array(scorers[0](texts.cast(pa.large_binary()).to_pylist()))

    return docs.withColumn(to, scored(F.col(text_col)))
