"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of benchmark words. For the patterns of one length, the
shift table tells from the block of words under the end of a search window how
far the window can move without missing a pattern; places that it passes over
are not looked at. Where it can't move, the patterns that end in this block
(suffix hash) and start with the words at hand (prefix hash) are compared word by
word. The windows of all texts of a batch move together.

Tables are sorted numpy arrays of hashes, about 50 bytes a benchmark word.
Patterns reach the workers in chunks of bounded size; a benchmark of many
chunks is searched in as many passes. All but the last leave only what they
found, by a hash of the text; the last one meets them and gives the rows.

Defined cases: a null text has no words; items without words are ignored; items
with a null id make hits but are not named; repeated items count once; repeated
document rows stay; empty tables give empty results. Extra columns are carried
along.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigrain.llm.batches import groups
from evigrain.runtime import stored, tuned

WINDOW = 10
#: Words of a text that one search window passes over.
STRETCH = 256
#: Texts with hits of earlier passes up to which these are broadcast; beyond it both sides are shuffled.
BROADCAST_HITS = 100_000
#: Benchmark bytes that one broadcast holds; more are searched in further passes.
CHUNK_BYTES = 16 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
_ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("items", pa.list_(pa.string()))])


def words(text: bytes | None) -> list[bytes]:
    """ASCII-lowered words: runs of ASCII letters, digits and non-ASCII characters."""
    return (text or b"").translate(_LOWER).split()


def _hashes(own: list[bytes]) -> np.ndarray:
    """Python's own hashes: texts and tables meet in one process."""
    return np.fromiter(map(hash, own), np.int64, len(own)).view(np.uint64)


def _blocks_at(own: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` words from each place on."""
    mixed = np.zeros(len(at), np.uint64)
    for k in range(size):
        mixed = (mixed ^ own[at + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed


class WuManber:
    """Search tables for all patterns of one length (in words): windows of texts, given with the numbers of their items."""

    def __init__(self, length: int, texts: list[list[bytes]], items: list[int]):
        self.length, self.block = length, min(2, length)
        self.far = length - self.block + 1
        self.looked = 0  # places of texts whose blocks were looked up
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        own = _hashes(list(chain.from_iterable(texts)))
        self.text = b" ".join(chain.from_iterable(texts))
        ends = np.cumsum(np.fromiter(map(len, chain.from_iterable(texts)), np.int64, len(own)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        left = np.repeat(np.cumsum(size), size) - np.arange(len(own))
        first = np.flatnonzero(left >= length)
        item = np.repeat(np.asarray(items, np.int64), size)[first]
        blocks = _blocks_at(own, np.arange(max(len(own) - self.block + 1, 0)), self.block)
        bucket = self._bucket(blocks[first + length - self.block], blocks[first])
        order = np.lexsort((item, bucket))
        self.bucket, self.item = bucket[order], item[order]
        self.at, self.to = starts[first][order], ends[first + length - 1][order]
        known, shift = [], []
        for end in range(self.block, length + 1):
            known.append(np.unique(blocks[first + end - self.block]))
            shift.append(np.full(len(known[-1]), length - end, np.int32))
        every, moves = np.concatenate(known), np.concatenate(shift)
        order = np.lexsort((moves, every))
        self.known, least = np.unique(every[order], return_index=True)
        self.shift = moves[order][least]

    def search(self, own: list[bytes], hashed: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """(start, item numbers) of every occurrence in texts that lie one after the other, from word `first` to before `last` each.

        All windows move at once, each by the shift of the block at its end; a long text has a window for each stretch of it.
        """
        length, block = self.length, self.block
        stretches = np.maximum(last - first - length, -1) // STRETCH + 1
        of = np.repeat(np.arange(len(first)), stretches)
        turn = np.arange(len(of)) - np.repeat(np.cumsum(stretches) - stretches, stretches)
        ends = first[of] + length + turn * STRETCH
        upto = np.minimum(ends + STRETCH, last[of] + 1)
        while len(ends):
            self.looked += len(ends)
            blocks = _blocks_at(hashed, ends - block, block)
            place = np.minimum(np.searchsorted(self.known, blocks), len(self.known) - 1)
            moves = np.where(self.known[place] == blocks, self.shift[place], self.far)
            yield from self._compared(own, hashed, ends[moves == 0])
            ends = ends + np.maximum(moves, 1)
            going = ends < upto
            ends, upto = ends[going], upto[going]

    def _compared(self, own: list[bytes], hashed: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """Windows that end there, by suffix and prefix, then word by word."""
        bucket = self._bucket(_blocks_at(hashed, ends - self.block, self.block), _blocks_at(hashed, ends - self.length, self.block))
        low, high = np.searchsorted(self.bucket, bucket, "left"), np.searchsorted(self.bucket, bucket, "right")
        for k in np.flatnonzero(low < high).tolist():
            start, end = int(ends[k]) - self.length, int(ends[k])
            here = b" ".join(own[start:end])
            found = [int(self.item[i]) for i in range(low[k], high[k]) if self.text[self.at[i] : self.to[i]] == here]
            if found:
                yield start, found

    @staticmethod
    def _bucket(suffix: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        """A hash of the last and the first block of a window."""
        return (suffix * np.uint64(0x9E3779B97F4A7C15)) ^ prefix


class Machines:
    """Tables of all pattern lengths, and the items' names by number."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.names = [name for name, _ in items]
        by_length: dict[int, tuple[list[list[bytes]], list[int]]] = {}
        for i, (_, text) in enumerate(items):
            own = words(text)
            if own:
                texts, numbers = by_length.setdefault(min(window, len(own)), ([], []))
                texts.append(own)
                numbers.append(i)
        self.tables = [WuManber(k, *by_length.pop(k)) for k in sorted(by_length)]


def compiled(items: list[tuple[str | None, bytes]], window: int = WINDOW) -> Machines:
    return Machines(items, window)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def search_all(machines: Machines, texts: list[bytes | None]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """For each text: how many words it has, spans of words in windows of items, and the items' names."""
    every = [words(t) for t in texts]
    size = np.fromiter(map(len, every), np.int64, len(every))
    last = np.cumsum(size)
    first = last - size
    own = list(chain.from_iterable(every))
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[int]] = [set() for _ in texts]
    if own and machines.tables:
        hashed = _hashes(own)
        for table in machines.tables:
            for start, found in table.search(own, hashed, first, last):
                text = int(np.searchsorted(last, start, "right"))
                at = start - int(first[text])
                spans[text].append((at, at + table.length))
                items[text].update(found)
    named = ({machines.names[i] for i in found} for found in items)
    return [(len(w), merged(s), sorted(x for x in n if x is not None)) for w, s, n in zip(every, spans, named, strict=True)]


def search(machines: Machines, text: bytes | None) -> tuple[int, list[tuple[int, int]], list[str]]:
    return search_all(machines, [text])[0]


_machines: dict[str, Machines] = {}


def _searcher(items, window: int):
    """A UDF (text, what earlier passes found) -> what is found; items is a broadcast."""
    name = uuid.uuid4().hex

    @F.arrow_udf(_FOUND)
    def found(texts: pa.Array, before: pa.Array) -> pa.Array:
        if name not in _machines:
            _machines.clear()
            _machines[name] = compiled(items.value, window)
        each, olds, out = texts.cast(pa.large_binary()).to_pylist(), before.to_pylist(), []
        results = chain.from_iterable(search_all(_machines[name], each[part]) for part in groups([x or b"" for x in each]))
        for (n, spans, named), old in zip(results, olds, strict=True):
            if old:
                spans = merged(spans + [(x["start"], x["stop"]) for x in old["spans"]])
                named = sorted({*named, *old["items"]})
            out.append({"n_words": n, "spans": [{"start": a, "stop": b} for a, b in spans], "items": named})
        return pa.array(out, _ARROW)

    return found


def overlaps(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES, to: str = "found") -> DataFrame:
    """docs with a struct: n_words, spans (word offsets inside any occurrence of an item's window, merged) and items (their ids as sorted strings; null ids are not among them)."""
    spark = tuned(docs.sparkSession)
    items = benchmark.filter(F.col(item_text_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).distinct()
    key = F.md5(F.encode(text_col, "UTF-8"))
    total = items.agg(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("item"), F.lit(0)))).first()[0] or 0
    chunks = max(1, math.ceil(total / chunk_bytes))

    def searcher(chunk: int):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(chunks)) == chunk).collect()  # about chunk_bytes
        return _searcher(spark.sparkContext.broadcast([(r["item"], bytes(r["text"], "utf-8")) for r in part]), window)

    if chunks == 1:
        return docs.withColumn(to, searcher(0)(F.col(text_col), F.lit(None).cast(_FOUND)))
    hits = []
    for i in range(chunks - 1):
        found = docs.select(key.alias("_text"), searcher(i)(F.col(text_col), F.lit(None).cast(_FOUND)).alias("_hit")).filter(F.size("_hit.spans") > 0)
        hits.append(stored(found.groupBy("_text").agg(F.first("_hit").alias("_hit")), "decontam").df)
    before = stored(reduce(DataFrame.unionByName, hits).groupBy("_text").agg(F.collect_list("_hit").alias("_hits")), "decontam").df
    before = before.select("_text", F.struct(F.lit(0).cast("long").alias("n_words"), F.flatten("_hits.spans").alias("spans"), F.flatten("_hits.items").alias("items")).cast(_FOUND).alias("_before"))
    if before.count() <= BROADCAST_HITS:
        before = F.broadcast(before)
    return docs.withColumn("_text", key).join(before, "_text", "left").withColumn(to, searcher(chunks - 1)(F.col(text_col), F.col("_before"))).drop("_text", "_before")


def hit_words(to: str = "found") -> Column:
    return F.aggregate(F.col(f"{to}.spans"), F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Documents without any occurrence of a benchmark window."""
    return overlaps(docs, benchmark, to="_found", **options).filter(F.size("_found.spans") == 0).drop("_found")
