"""Token counts by linear longest-match: a vocabulary trie with failure links.

Greedy longest-match word pieces of a word are counted in one pass over its
characters. A trie holds the pieces that start words and, under a second root,
those that continue them. Where no edge goes on, the failure link leads to the
place from which matching continues, and the link carries how many pieces it
closes, so pieces are never built. The word mark alone is a piece too: a word
that no longer piece starts is the mark and continuing pieces. Where the
vocabulary has byte pieces, a character that no piece starts with is as many of
them as its UTF-8 has bytes; without them such a word is one unknown token.

Defined cases: a null text counts as empty and has no words; repeated rows stay;
an empty table gives an empty result. Extra columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigrain.runtime import tuned

TOKENIZERS = "/opt/tokenizers"
#: Words whose counts a worker keeps, and the longest of them in bytes.
KEPT_WORDS, KEPT_BYTES = 300_000, 64

_COUNTS = T.StructType([T.StructField(k, T.LongType()) for k in ("n_words", "n_tokens", "n_unknown")])


class Vocabulary(NamedTuple):
    """Pieces that start words, without their mark (the empty one is the mark alone), those that go on anywhere, and whether bytes are pieces."""

    starting: list[str]
    continuing: list[str]
    by_bytes: bool


MARK = "▁"


class Automaton:
    """Longest-match counts; root 0 is where words start (after the mark), root 1 where pieces go on."""

    def __init__(self, starting: Iterable[str], continuing: Iterable[str], by_bytes: bool = False):
        self.next: list[dict[str, int]] = [{}, {}]
        self.by_bytes = by_bytes
        whole = [False, False]
        for root, pieces in ((0, starting), (1, continuing)):
            for piece in pieces:
                node = root
                for c in piece:
                    if c not in self.next[node]:
                        self.next[node][c] = len(self.next)
                        self.next.append({})
                        whole.append(False)
                    node = self.next[node][c]
                whole[node] = whole[node] or node != 1
        self.link, self.closes = [-1] * len(self.next), [0] * len(self.next)
        if whole[0]:
            self.link[0], self.closes[0] = 1, 1
        elif by_bytes:
            self.link[0], self.closes[0] = 1, len(MARK.encode())
        level = [0, 1]
        while level:
            below = []
            for node in level:
                for c, child in self.next[node].items():
                    below.append(child)
                    if whole[child]:
                        self.link[child], self.closes[child] = 1, 1
                    elif node == 1 and by_bytes:
                        self.link[child], self.closes[child] = 1, len(c.encode())
                    else:
                        self.link[child], self.closes[child] = self._after(self.link[node], self.closes[node], c)
            level = below

    def _after(self, at: int, closed: int, c: str) -> tuple[int, int]:
        """Where a character leads from a failure link, and how many pieces are closed on the way; -1 where nothing covers it."""
        while at >= 0 and c not in self.next[at]:
            if at == 1 and self.by_bytes:
                return 1, closed + len(c.encode())
            closed += self.closes[at]
            at = self.link[at]
        return (self.next[at][c], closed) if at >= 0 else (-1, 0)

    def count(self, word: str) -> int:
        """Number of pieces of a word; -1 if the vocabulary can't cover it."""
        edges, link, closes = self.next, self.link, self.closes
        node = total = 0
        for c in word:
            after = edges[node].get(c)
            if after is None:
                if node != 1:
                    total += closes[node]
                    node = link[node]
                node, closed = self._after(node, 0, c)
                if node < 0:
                    return -1
                total += closed
            else:
                node = after
        while node > 1:
            total += closes[node]
            node = link[node]
        return total if node == 1 else -1


def vocabulary(model_file: str) -> Vocabulary:
    """The pieces of a public sentence-piece vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = range(model.get_piece_size())
    pieces = [model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return Vocabulary([p[1:] for p in pieces if p[0] == MARK], pieces, sum(map(model.is_byte, ids)) == 256)


class Counter:
    """Counts of texts; keeps the counts of words it has met, up to a bound."""

    def __init__(self, automaton: Automaton):
        self.automaton, self.known = automaton, {}

    def __call__(self, text: bytes | None) -> dict[str, int]:
        words, known, count = (text or b"").split(), self.known, self.automaton.count
        tokens = unknown = 0
        for word in words:
            n = known.get(word)
            if n is None:
                n = count(word.decode("utf-8", "replace"))
                if len(word) <= KEPT_BYTES:
                    if len(known) >= KEPT_WORDS:
                        known.clear()
                    known[word] = n
            if n < 0:
                unknown += 1
            else:
                tokens += n
        return {"n_words": len(words), "n_tokens": tokens + unknown, "n_unknown": unknown}


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, text_col: str = "text", model_file: str = f"{TOKENIZERS}/piece_bpe_32k.model", to: str = "counts") -> DataFrame:
    """docs with a struct of n_words (runs without white space), n_tokens and n_unknown (unknown words, each one token)."""
    tuned(docs.sparkSession)

    @F.arrow_udf(_COUNTS)
    def counted(texts: pa.Array) -> pa.Array:
        counter = _counters.get(model_file) or _counters.setdefault(model_file, Counter(Automaton(*vocabulary(model_file))))
        return pa.array([counter(t) for t in texts.cast(pa.large_binary()).to_pylist()], pa.struct([(k, pa.int64()) for k in ("n_words", "n_tokens", "n_unknown")]))

    return docs.withColumn(to, counted(F.col(text_col)))
