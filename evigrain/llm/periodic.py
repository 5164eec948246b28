"""Periodic runs of words: stretches in which a text repeats itself at a fixed lag.

Matches at a lag (equal words so far apart) are counted for all lags of a text
first: words with many places by the exact autocorrelation of their places
(FFT), words with few by the differences of their places. A stretch of length
n with period q has n - q matches at lag q, so only lags with enough matches
are looked at, less those that shorter periods account for already. There a
grid of places, q apart, shows where matches can lie closely enough, and the
islands of matches are scanned only if some of them can.

Defined cases: a null or wordless text has no words and no runs; runs may
overlap, each is listed; of equal texts each is worked on by itself; an empty
table gives an empty result. Extra columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigrain.runtime import tuned

#: A run has so many words at least, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Places of words whose autocorrelation is taken at once.
FFT_CELLS = 1 << 20
#: Offsets between the places of the grid that are looked at before the islands of a lag are scanned.
PROBES = 16

_FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))),
        T.StructField("collapsed", T.StringType()),
    ]
)
_RUN = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, the same for equal words."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))


def _frequent(own: np.ndarray, heavy: np.ndarray, most: int, counts: np.ndarray) -> None:
    """Add the matches of heavy words at lags up to `most`, by the transform of their places."""
    size = 1 << int(len(own) + most).bit_length()
    step = max(1, FFT_CELLS // size)
    power = np.zeros(size // 2 + 1)
    for at in range(0, len(heavy), step):
        places = np.zeros((len(heavy[at : at + step]), size))
        places[:, : len(own)] = own == heavy[at : at + step, None]
        seen = np.fft.rfft(places, axis=1)
        power += (seen.real**2 + seen.imag**2).sum(axis=0)
    counts += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)


def _rare(place: np.ndarray, left: np.ndarray, most: int, counts: np.ndarray) -> None:
    """Add the differences between places of one word, step by step; `left` tells how many places of its word follow each."""
    at, step = np.flatnonzero(left > 0), 1
    while len(at):
        apart = place[at + step] - place[at]
        near = apart <= most
        counts += np.bincount(apart[near], minlength=most + 1)
        step += 1
        at = at[near]
        at = at[left[at] >= step]


def lag_counts(own: np.ndarray, most: int) -> np.ndarray:
    """Matches at each lag from 0 to `most`, exact; that of lag 0 is not told."""
    counts = np.zeros(most + 1, np.int64)
    n = len(own)
    often = np.bincount(own)
    limit = max(4.0, (n * np.log2(n + 1)) ** 0.5 / 4)
    heavy = np.flatnonzero(often > limit)
    if len(heavy):
        _frequent(own, heavy.astype(own.dtype), most, counts)
    place = np.argsort(own, kind="stable")
    left = np.repeat(np.cumsum(often), often) - 1 - np.arange(n)
    _rare(place, np.where(np.repeat(often <= limit, often), left, 0), most, counts)
    counts[0] = 0
    return counts


def _hopeful(own: np.ndarray, lag: int) -> bool:
    """Whether matches at three places of the grid, and at places between them, leave room for an island of three lags."""
    grid = np.arange(0, len(own) - lag, lag)
    hit = own[grid] == own[grid + lag]
    at = grid[:-2][hit[:-2] & hit[1:-1] & hit[2:]]
    for k in range(1, PROBES + 1):
        aside = at + k * lag // (PROBES + 1)
        at = at[(own[aside] == own[aside + lag]) & (own[aside + lag] == own[aside + 2 * lag])]
        if not len(at):
            return False
    return True


def _islands(own: np.ndarray, lag: int, least: int) -> Iterator[tuple[int, int]]:
    """(start, matches) of stretches of at least so many matches at a lag."""
    same = np.zeros(len(own) - lag + 2, np.int8)
    same[1:-1] = own[lag:] == own[:-lag]
    edges = np.flatnonzero(np.diff(same))
    starts, size = edges[::2], edges[1::2] - edges[::2]
    for i in np.flatnonzero(size >= least):
        yield int(starts[i]), int(size[i])


def _primes(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out + [n] * (n > 1)


def find(own: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in numbered words, by start, then period."""
    n, out = len(own), []
    if n < LEAST_WORDS:
        return out
    most = max(1, n // LEAST_PERIODS)
    counts = lag_counts(own, most)
    need = np.maximum(LEAST_WORDS, LEAST_PERIODS * np.arange(most + 1)) - np.arange(most + 1)
    for lag in np.flatnonzero(counts >= need).tolist():
        if lag == 0 or counts[lag] < need[lag] or not _hopeful(own, lag):
            continue
        for start, matches in _islands(own, lag, int(need[lag])):
            stretch = own[start : start + matches + lag]
            if any(np.array_equal(stretch[d:], stretch[:-d]) for d in (lag // p for p in _primes(lag))):
                continue
            out.append((start, matches + lag, lag))
            # Matches within this run at multiples of its period belong to no stretch with a longer smallest period.
            counts[2 * lag :: lag] -= np.maximum(len(stretch) - np.arange(2 * lag, most + 1, lag), 0)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run repeats, joined by blanks: of each run its first period stays."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join(words[i] for i in np.flatnonzero(keep).tolist())


@F.arrow_udf(_FOUND)
def _found(texts: pa.Array) -> pa.Array:
    sizes, each, collapsed = [], [], []
    for text in texts.cast(pa.large_binary()).to_pylist():
        words = (text or b"").split()
        runs = find(numbered(words))
        sizes.append(len(words))
        each.append(runs)
        collapsed.append(collapse(words, runs))
    flat = np.array([r for runs in each for r in runs], np.int64).reshape(-1, 3)
    offsets = np.concatenate(([0], np.cumsum([len(runs) for runs in each]))).astype(np.int32)
    listed = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(_RUN)))
    return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), listed, pa.array(collapsed, pa.binary()).cast(pa.string())], names=["n_words", "runs", "collapsed"])


def runs(docs: DataFrame, text_col: str = "text", to: str = "found") -> DataFrame:
    """docs with a struct: n_words, runs (start and length in words, smallest period; by start, then period) and collapsed (the text without the repetitions)."""
    tuned(docs.sparkSession)
    return docs.withColumn(to, _found(F.col(text_col)))


def longest(to: str = "found") -> Column:
    """The run of greatest length; of several the first to start, then that of the smallest period; null if there is none."""
    ranked = F.transform(F.col(f"{to}.runs"), lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    return F.array_min(ranked)


def listed(to: str = "found") -> Column:
    """All runs as lines of start, length and period."""
    return F.array_join(F.transform(F.col(f"{to}.runs"), lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")


def planted(text: Column, id_col: str = "doc_id") -> Column:
    """The text, or, for one id in ten by its crc32, its words with a stretch from some word to the end that repeats itself; a null id plants nothing."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8"))
    n, g = F.size(words), F.floor(h / 10)
    a = F.pmod(g, F.nullif(n, F.lit(0)))
    p = 1 + F.floor((n - a) / (3 + g % 8))
    turns = F.ceil((n - a) / p)
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), turns.cast("int"))), F.lit(1), (n - a).cast("int"))
    again = F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " ")
    return F.when((h % 10 == 0) & (n > 0), again).otherwise(text)
