"""Quality rules from tokeniser fertility, after plain counts.

Two public vocabularies read the words of each text: a byte-pair vocabulary with
byte fallback gives characters per token, the share of bytes it had to fall back
to and the entropy of the tokens; a byte-level one gives characters per token
again. Characters are those of words and one for the space before each. Texts are
read in groups of bounded size, each different word of a group once. A text is
rejected where a measure leaves the band of its language or, for other languages,
of the script that most of its letters are in. Bands widen with the error that a
measure over so few tokens can have, so texts of every length are judged alike.

Defined cases: a null text counts as empty and has no words; a null or unknown
language goes by script. Repeated rows stay. Extra columns are carried along.
"""

from __future__ import annotations

import base64
from collections import Counter
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigrain.llm.batches import groups
from evigrain.runtime import tuned

TOKENIZERS = "/opt/tokenizers"
WINDOW = 5
FEWEST_WORDS = 10
MOST_REPEATED = 20
#: How many standard errors a measure may be outside of its band, and what one token adds to the error: of the characters of a token and of its bits.
ERRORS, SPREAD_CHARS, SPREAD_BITS = 3.0, 2.0, 1.5
#: Bits of entropy that a text of any length can be asked parts of: prose has no more words for being longer.
MOST_BITS = 10.0


class Band(NamedTuple):
    """Bounds of a language or script: characters per token in the byte-fallback and in the byte-level vocabulary, fallback share, entropy by its most."""

    pieces: tuple[float, float]
    bytes: tuple[float, float]
    fallback: float
    entropy: float


#: By language where known, else by script. Entropy is in parts of the most that so many tokens can have, MOST_BITS at most.
BANDS = {
    "en": Band((2.1, 8.0), (2.1, 8.0), 0.05, 0.46),
    "de": Band((2.0, 8.0), (2.0, 8.0), 0.05, 0.46),
    "fr": Band((1.9, 8.0), (1.8, 8.0), 0.05, 0.46),
    "es": Band((1.85, 8.0), (1.7, 8.0), 0.05, 0.46),
    "latin": Band((1.5, 10.0), (1.3, 10.0), 0.2, 0.42),
    "cyrillic": Band((1.2, 8.0), (0.7, 6.0), 0.3, 0.42),
    "cjk": Band((0.4, 4.0), (0.25, 4.0), 0.7, 0.42),
    "other": Band((0.2, 10.0), (0.2, 10.0), 1.0, 0.40),
}

# The pattern that the byte-level vocabulary's merges start from, and its text before byte pieces of the other one.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_SPACES = np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens")
_RATES = ("chars_per_piece", "chars_per_byte_token", "fallback_share", "entropy")
_MEASURES = T.StructType([T.StructField(k, T.LongType()) for k in _LONGS] + [T.StructField(k, T.DoubleType()) for k in _RATES] + [T.StructField("script", T.StringType()), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that the text has more than once; hashes find the windows, comparison confirms them."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    own = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + own[k : k + n]
    order = np.argsort(mixed, kind="stable")
    same = mixed[order][1:] == mixed[order][:-1]
    if not same.any():
        return 0
    maybe = np.unique(np.concatenate((order[1:][same], order[:-1][same]))).tolist()
    found = Counter(tuple(words[i : i + window]) for i in maybe)
    hit = np.zeros(len(words) + 1, np.int64)
    for i in maybe:
        if found[tuple(words[i : i + window])] > 1:
            hit[i] += 1
            hit[i + window] -= 1
    return int((np.cumsum(hit) > 0).sum())


def counts(text: bytes, words: list[bytes] | None = None) -> tuple[dict, np.ndarray]:
    """The plain counts of a text, and how often each byte value is in it."""
    words = text.split() if words is None else words
    values = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    points = int(values.sum() - values[0x80:0xC0].sum())
    seen: set[bytes] = set()
    repeats = 0
    for line in text.split(b"\n"):
        if line in seen:
            repeats += 1
        elif line.strip():
            seen.add(line)
    return {"n_words": len(words), "word_chars": points - int(values[_SPACES].sum()), "n_symbols": int(values[_SYMBOLS].sum()), "n_dup_lines": repeats, "n_repeat_words": repeated_words(words)}, values


def script(values: np.ndarray) -> str:
    """The script of most letters, by the first bytes of their UTF-8."""
    of = {"latin": int(values[65:91].sum() + values[97:123].sum() + values[0xC3:0xCA].sum()), "cyrillic": int(values[0xD0:0xD4].sum()), "cjk": int(values[0xE3:0xEE].sum())}
    of["other"] = int(values[0xC2:0xF8].sum()) - int(values[0xC3:0xCA].sum()) - of["cyrillic"] - of["cjk"]
    return max(of, key=of.get)


class Meter:
    """Measures of texts under the two vocabularies."""

    def __init__(self, folder: str = TOKENIZERS):
        import sentencepiece
        import tiktoken

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/piece_bpe_32k.model")
        self.fallback = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])
        self.fallback[[self.pieces.piece_to_id(f"<0x{c:02X}>") for c in (9, 10, 13)]] = False
        with open(f"{folder}/byte_bpe_50k.tiktoken", "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.bytes = tiktoken.Encoding("byte_bpe_50k", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.spaced = np.zeros(max(ranks.values()) + 1, bool)
        self.spaced[[i for token, i in ranks.items() if token[:1] == b" "]] = True

    def _byte_tokens(self, words: list[str]) -> np.ndarray:
        """Byte-level tokens of each word with a space before it: read at once, they part where a token starts with a space."""
        if not words:
            return np.zeros(0, np.int64)
        starts = self.spaced[self.bytes.encode_to_numpy(" " + " ".join(words), disallowed_special=())]
        if int(starts.sum()) != len(words):
            return np.array([len(self.bytes.encode_ordinary(f" {w}")) for w in words], np.int64)
        return np.bincount(np.cumsum(starts) - 1, minlength=len(words))

    def rates(self, texts: list[list[bytes]], chars: list[int]) -> list[dict]:
        """Measures of texts given as words, with the number of characters in these."""
        index: dict[bytes, int] = {}
        for words in texts:
            for word in set(words):
                index.setdefault(word, len(index))
        known = [w.decode("utf-8", "replace") for w in index]
        pieces = self.pieces.encode(known)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        first = np.cumsum(size) - size
        flat = np.fromiter(chain.from_iterable(pieces), np.int64, int(size.sum()))
        level = self._byte_tokens(known)
        out = []
        for words, n_chars in zip(texts, chars, strict=True):
            at = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
            sizes = size[at]
            n = int(sizes.sum())
            if not n:
                out.append({"n_tokens": 0} | dict.fromkeys(_RATES, 0.0))
                continue
            ids = flat[np.repeat(first[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(n)]
            share = np.bincount(ids)
            share = share[share > 0] / n
            read, most = n_chars + len(words), min(float(np.log2(n)), MOST_BITS) or 1.0
            out.append({"n_tokens": n, "chars_per_piece": read / n, "chars_per_byte_token": read / max(int(level[at].sum()), 1), "fallback_share": float(self.fallback[ids].mean()), "entropy": max(0.0, float(-(share * np.log2(share)).sum())) / most})
        return out


def within(rates: dict, band: Band) -> bool:
    """Whether all measures are in their bands, or no further outside than a sample of so many tokens may be."""
    n = rates["n_tokens"]
    if not n:
        return True
    error = ERRORS / np.sqrt(n)
    chars, bits = error * SPREAD_CHARS, error * SPREAD_BITS / min(max(np.log2(n), 1.0), MOST_BITS)
    share = rates["fallback_share"]
    # Wilson's lower bound of a share, which keeps to 0 and 1.
    surely = (share + error**2 / 2 - error * np.sqrt(share * (1 - share) + error**2 / 4)) / (1 + error**2)
    return (
        bool(band.pieces[0] - chars <= rates["chars_per_piece"] <= band.pieces[1] + chars)
        and bool(band.bytes[0] - chars <= rates["chars_per_byte_token"] <= band.bytes[1] + chars)
        and bool(surely <= band.fallback)
        and bool(rates["entropy"] >= band.entropy - bits)
    )


def measure(meter: Meter, texts: list[bytes], langs: list[str | None], bands: dict[str, Band] = BANDS) -> list[dict]:
    words = [t.split() for t in texts]
    plain = [counts(t, w) for t, w in zip(texts, words, strict=True)]
    out = []
    for (base, values), rates, lang in zip(plain, meter.rates(words, [base["word_chars"] for base, _ in plain]), langs, strict=True):
        kind = script(values)
        failed = base["n_words"] < FEWEST_WORDS or 100 * base["n_repeat_words"] > MOST_REPEATED * base["n_words"]
        out.append(base | rates | {"script": kind, "base_failed": failed, "kept": not failed and within(rates, bands[lang] if lang in bands else bands[kind])})
    return out


_meters: dict[str, Meter] = {}


def measures(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", folder: str = TOKENIZERS, bands: dict[str, Band] = BANDS, to: str = "measures") -> DataFrame:
    """docs with a struct of counts, rates, script, base_failed and kept."""
    tuned(docs.sparkSession)
    plain = {k: tuple(v) for k, v in bands.items()}

    @F.arrow_udf(_MEASURES)
    def measured(texts: pa.Array, langs: pa.Array) -> pa.Array:
        meter = _meters.get(folder) or _meters.setdefault(folder, Meter(folder))
        own = {k: Band(*v) for k, v in plain.items()}
        read, of = [t or b"" for t in texts.cast(pa.large_binary()).to_pylist()], langs.to_pylist()
        rows = [r for part in groups(read) for r in measure(meter, read[part], of[part], own)]
        return pa.array(rows, pa.struct([(k, pa.int64()) for k in _LONGS] + [(k, pa.float64()) for k in _RATES] + [("script", pa.string()), ("base_failed", pa.bool_()), ("kept", pa.bool_())]))

    return docs.withColumn(to, measured(F.col(text_col), F.col(lang_col)))
