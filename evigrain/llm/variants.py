"""Spelling variants: words that one edit apart from each other are grouped under the most common form.

Words are counted over whole texts. Of two words that are one inserted, deleted
or replaced character apart, with m characters in the shorter one, either the
first half of m characters is the same or the rest of m at the end is. So each
word is filed in a forward dictionary, sorted by its first half, and in a
reversed one, sorted by its second half read backwards: as the shorter or equal
word (m is its length) and as the longer one (m is one less). A block of words
that share a half is a range of the dictionary; words in it are compared in
full. A block over BLOCK_LIMIT words is halved: the place of the edit lies in one
half of what its words need not share, and each half is a block with a longer
shared prefix, suffix or both. Down to a single place, such a block holds no more
words than one or two free characters give, so no block grows with the corpus.
Each pair is taken where the first difference lies, hence once, and never
written: a block gives a row per word, how many near words it has there and
the most common one.

Defined cases: a null text has no words; a null id counts as an empty one; equal
counts are decided by code-point order; words without a near word are their own
root; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigrain.runtime import discard, stored, tuned

LEAST_CHARS, LEAST_COUNT = 7, 2
#: A form is at least so many times as common as its variant.
DOMINANCE = 10
#: Words of one block that are compared with each other; larger blocks are halved while they can be.
BLOCK_LIMIT = 64
#: Words of a block up to which one task reads them; larger ones are halved before they are sorted.
HOT_ROWS = 32768
#: Such blocks up to which they are broadcast (8 bytes each); beyond it both sides are shuffled.
BROADCAST_BLOCKS = 1_000_000
#: Different words that a task counts before it hands them on.
COUNTED_WORDS = 1 << 17
#: One run in so many loses a character (0: none), by the crc32 of the document's id and the run.
TYPOS = 31

_RUN = re.compile(r"[a-zÀ-ÿ]+")


def spelled(doc_id: str, text: bytes | None, least_chars: int = LEAST_CHARS, typos: int = TYPOS) -> Iterator[str]:
    """The words of a text that have enough characters: ASCII-lowered runs of letters, some with a character left out."""
    prefix = zlib.crc32(f"{doc_id}:".encode())
    for run in _RUN.findall((text or b"").lower().decode()):
        if len(run) < least_chars:
            continue
        if typos:
            h = zlib.crc32(run.encode(), prefix)
            if h % typos == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < least_chars:
                    continue
        yield run


def dictionary(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, typos: int = TYPOS) -> DataFrame:
    """(word, n): words of at least so many characters that occur at least so often in all texts."""
    tuned(docs.sparkSession)

    def handed(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                counts.update(spelled(doc_id, text, least_chars, typos))
                if len(counts) > COUNTED_WORDS:
                    yield handed(counts)
                    counts = Counter()
        if counts:
            yield handed(counts)

    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col))
    return runs.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def differs_at(a: str, b: str) -> int | None:
    """The first place where two different words differ if one edit makes them equal; len(a) <= len(b) <= len(a) + 1."""
    low, high = 0, len(a)
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    same = low < len(a) and a[low + 1 :] == b[low + 1 :] if len(a) == len(b) else a[low:] == b[low + 1 :]
    return low if same else None


def compare(words: list[str], counts: list[int], shorter: int, start: int, stop: int, last: bool) -> dict[int, tuple[int, int]]:
    """Of words whose edits lie from start on and before stop (at stop too in the last block): place -> (near words, place of the most common one)."""
    found: dict[int, tuple[int, int]] = {}

    def noted(i: int, j: int) -> None:
        n, best = found.get(i, (0, j))
        found[i] = n + 1, j if (-counts[j], words[j]) < (-counts[best], words[best]) else best

    sides = [[i for i, w in enumerate(words) if len(w) == shorter + more] for more in (0, 1)]
    for k, i in enumerate(sides[0]):
        for j in sides[0][k + 1 :] + sides[1]:
            at = differs_at(words[i], words[j])
            if at is not None and start <= at < stop + last:
                noted(i, j)
                noted(j, i)
    return found


_BLOCKS = "key string, word string, n long, shorter int, start int, stop int"
_SCANNED = f"{_BLOCKS}, near long, best string, best_n long"


def _filed(words: DataFrame) -> DataFrame:
    """Each word's places in both dictionaries: blocks of words that may differ from start to stop only."""
    lengths = F.array(F.char_length("word"), F.char_length("word") - 1)
    shorter = words.select("word", "n", F.explode(lengths).alias("shorter"))
    halves = F.array(F.struct(F.floor(F.col("shorter") / 2).cast("int").alias("start"), F.col("shorter").alias("stop")), F.struct(F.lit(0).alias("start"), F.floor(F.col("shorter") / 2).cast("int").alias("stop")))
    return _keyed(shorter.withColumn("half", F.explode(halves)).select("word", "n", "shorter", "half.start", "half.stop"))


def _halved(blocks: DataFrame) -> DataFrame:
    middle = F.floor((F.col("start") + F.col("stop")) / 2).cast("int")
    halves = F.array(F.struct("start", middle.alias("stop")), F.struct(middle.alias("start"), "stop"))
    return _keyed(blocks.withColumn("half", F.explode(halves)).select("word", "n", "shorter", "half.start", "half.stop"))


def _keyed(blocks: DataFrame) -> DataFrame:
    """The range of the dictionary: forward words by what precedes the block, then, read backwards, by what follows it."""
    after = F.reverse(F.expr("right(word, shorter - stop)"))
    key = F.concat_ws("/", F.expr("left(word, start)"), after, F.col("shorter"), F.col("start"), F.col("stop"))
    return blocks.select(key.alias("key"), "word", "n", "shorter", "start", "stop")


def _scan(limit: int):
    """For sorted partitions: what a block's words find in it; words of blocks over the limit that can be halved come out as they are."""

    def scanned(rows: list[tuple]) -> list[tuple]:
        _, _, _, shorter, start, stop = rows[0]
        words, counts = [r[1] for r in rows], [r[2] for r in rows]
        found = compare(words, counts, shorter, start, stop, stop == shorter)
        return [(None, words[i], counts[i], None, None, None, near, words[j], counts[j]) for i, (near, j) in found.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        block: list[tuple] = []
        whole = False  # the block at hand is over the limit and is passed on

        def closed() -> None:
            if len(block) > 1 and not whole:
                out.extend(scanned(block))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block and row[0] != block[0][0]:
                    closed()
                    block, whole = [], False
                if whole:
                    out.append((*row, None, None, None))
                    continue
                block.append(row)
                if len(block) > limit and row[5] - row[4] > 1:
                    out.extend((*r, None, None, None) for r in block)
                    block, whole = block[:1], True
            if out:
                yield _batch(out)
                out = []
        closed()
        if out:
            yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64()]
    names = [c.split()[0] for c in _SCANNED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _parted(blocks: DataFrame, hot_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Blocks that a task can read, and blocks that no task should read whole (None if there are none); blocks of a single place are never hot."""
    marked = blocks.withColumn("block", F.xxhash64("key"))
    hot = stored(marked.groupBy("block").count().filter(F.col("count") > hot_rows).select("block"), "variants-hot").df
    many = hot.count()
    if not many:
        return blocks, None
    hot = F.broadcast(hot) if many <= BROADCAST_BLOCKS else hot
    wide = F.col("stop") - F.col("start") > 1
    large = marked.filter(wide).join(hot, "block", "left_semi").drop("block")
    return marked.filter(wide).join(hot, "block", "left_anti").drop("block").unionByName(marked.filter(~wide).drop("block")), large


def near_words(words: DataFrame, limit: int = BLOCK_LIMIT, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(word, n_near, form, form_n): for words (word, n) with near words, how many there are and the most common one."""
    spark = words.sparkSession
    tuned(spark)
    blocks, parts = _filed(words), []
    while True:
        blocks, hot = _parted(blocks, hot_rows)
        ranges = blocks.repartitionByRange("key").sortWithinPartitions("key")
        scan = stored(ranges.mapInArrow(_scan(limit), _SCANNED), "variants")
        parts.append(scan)
        skewed = scan.df.filter("near IS NULL").select(*(c.split()[0] for c in _BLOCKS.split(", ")))
        if hot is None and skewed.isEmpty():
            break
        blocks = _halved(skewed if hot is None else skewed.unionByName(hot))
    found = parts[0].df
    for more in parts[1:]:
        found = found.unionByName(more.df)
    ranked = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    each = found.filter("near IS NOT NULL").groupBy("word").agg(F.sum("near").alias("n_near"), ranked.alias("first"))
    near = stored(each.select("word", "n_near", F.col("first.word").alias("form"), (-F.col("first.less")).alias("form_n")), "variants-near")
    for part in parts:
        discard(spark, part.path)
    return near.df


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for words with a form: each step follows twice as many forms, and counts grow tenfold with each, so steps are few."""
    spark = forms.sparkSession
    now = stored(forms.select("word", F.col("form").alias("root")), "variants-roots")
    while True:
        ahead = now.df.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        if now.df.join(ahead, "root", "left_semi").isEmpty():
            return now.df
        after = stored(now.df.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root")), "variants-roots")
        discard(spark, now.path)
        now = after


def variants(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", dominance: int = DOMINANCE, limit: int = BLOCK_LIMIT, hot_rows: int = HOT_ROWS, **counting) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each word of the dictionary: its form is its most common near word if that is so many times as common."""
    words = stored(dictionary(docs, text_col, id_col, **counting), "variants-words").df
    taken = F.col("form_n") >= dominance * F.col("n")
    near = words.join(near_words(words, limit, hot_rows), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(taken, F.col("form")).alias("form"), F.when(taken, F.col("form_n")).alias("form_n"))
    near = stored(near, "variants-forms").df
    return near.join(roots(near.filter("form IS NOT NULL")), "word", "left").withColumn("root", F.coalesce("root", "word"))
