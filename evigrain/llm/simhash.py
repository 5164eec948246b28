"""SimHash near-duplicates by multi-index hashing.

Fingerprints are cut into segments. Two fingerprints within the wanted distance
differ in one of the segments by no more than that segment's radius, so each
fingerprint is filed under its own segment values (home) and under all values
inside the segment's small Hamming ball (visiting). Whoever meets at a home is
compared over all 64 bits. Each bucket gives only the links of a spanning
forest, so a dense group costs as many rows as it has members, and copies with
one fingerprint are one node from the start.

Defined cases: a null or wordless text has fingerprint 0 and is linked like any
other; rows with a null doc_id get a fingerprint and the component of their
fingerprint's documents (null if none of these has an id); repeated rows stay;
an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigrain.llm.components import connected_components
from evigrain.runtime import Stored, discard, stored, tuned

BITS = 64
SEED = 42
SHINGLE_WORDS = 4
MAX_DISTANCE = 4
SEGMENTS = 3
#: Members of one bucket that one task compares; larger buckets are cut into pairs of blocks.
BUCKET_LIMIT = 32768
#: Removed ids up to which deduplicate() broadcasts them (8 bytes each); beyond it both sides are shuffled.
BROADCAST_IDS = 1_000_000

_SLICE = 1 << 16


def hashes(words: list[bytes], shingle_words: int) -> np.ndarray:
    """XXH64 with seed 42 of each run of so many words; of all words if they are fewer, and none of no words."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - shingle_words + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    stops = ends[min(shingle_words, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n)


def majority(each: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 for none."""
    n = len(each)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, _SLICE):
        part = each[at : at + _SLICE].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((counts * 2 > n) @ (np.uint64(1) << np.arange(BITS, dtype=np.uint64)))


def fingerprint(text: bytes | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """Unsigned SimHash of one text: ASCII-lowered words, word shingles, XXH64 with seed 42; bit set if set in over half."""
    return majority(hashes((text or b"").lower().split(), shingle_words))


@F.arrow_udf(T.LongType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    values = [fingerprint(x) for x in texts.cast(pa.large_binary()).to_pylist()]
    return pa.array(np.array(values, np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, text_col: str = "text", to: str = "fp") -> DataFrame:
    """docs with the fingerprint as a long (its 64 bits)."""
    return docs.withColumn(to, _fingerprints(F.col(text_col)))


def plan_segments(max_distance: int, segments: int) -> list[tuple[int, int, list[int]]]:
    """(shift, width, ball masks) of the segments that are looked up; the radii plus ones add up to max_distance + 1."""
    base, more = divmod(max_distance + 1, segments)
    out, shift = [], 0
    for i in range(segments):
        width = BITS // segments + (i < BITS % segments)
        radius = base + (i < more) - 1
        if radius >= 0:
            out.append((shift, width, [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)]))
        shift += width
    return out


def _ball(shift: int, width: int, masks: list[int], tag: int) -> Column:
    value = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1)).cast("long")
    return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: F.struct(value.bitwiseXOR(m).bitwiseOR(F.lit(tag << 40)).alias("key"), (m != 0).alias("away")))


def _lookups(fps: DataFrame, max_distance: int, segments: int) -> DataFrame:
    """(key, fp, away): a row for each segment value in a fingerprint's balls; away is false at its own value."""
    balls = [_ball(*segment, tag) for tag, segment in enumerate(plan_segments(max_distance, segments))]
    return fps.select("fp", F.explode(F.concat(*balls)).alias("at")).select("at.key", "fp", "at.away")


def _near(a: np.ndarray, b: np.ndarray, max_distance: int) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(a, b).view(np.uint64)) <= max_distance


def _forest(fps: np.ndarray, homes: int, max_distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what the first `homes` members link; members already connected are not compared again."""
    label, out = np.arange(len(fps)), []
    for i in range(homes):
        other = np.flatnonzero(label != label[i])
        if not len(other):
            break
        other = other[_near(fps[other], fps[i], max_distance)]
        if len(other):
            _, first = np.unique(label[other], return_index=True)
            out.append((np.full(len(first), fps[i]), fps[other[first]]))
            label[np.isin(label, label[other])] = label[i]
    return out


def _links(key: np.ndarray, fps: np.ndarray, away: np.ndarray, max_distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Verified links of whole buckets; rows come sorted by key, homes before visitors."""
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(first, len(key)))
    group = np.repeat(np.arange(len(first)), size)
    last = (first + size)[group]
    small = size <= 64
    at, out, step = np.flatnonzero(~away & small[group]), [], 1
    while len(at := at[at + step < last[at]]):
        near = at[_near(fps[at], fps[at + step], max_distance)]
        if len(near):
            out.append((fps[near], fps[near + step]))
        step += 1
    for g in np.flatnonzero(~small):
        a, b = first[g], first[g] + size[g]
        out += _forest(fps[a:b], int((~away[a:b]).sum()), max_distance)
    return out


_LINK_SCHEMA = "kind int, a long, b long, away boolean"


def _link_finder(max_distance: int, limit: int | None):
    """For partitions sorted by (key, away): links as kind 0 (a, b); members of buckets over the limit as kind 1 (key, fp, away)."""

    def emit(kind: int, a: np.ndarray, b: np.ndarray, away: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(away)], names=["kind", "a", "b", "away"])

    def found(key, fps, away):
        if pairs := _links(key, fps, away, max_distance):
            a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[a != b], axis=0)
            if len(both):
                yield emit(0, np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1]), np.zeros(len(both), bool))

    def chunks(batches: Iterator[pa.RecordBatch]):
        """Key, fingerprint and away of so many batches that whole arrays are worth working on."""
        parts, rows = [], 0
        for batch in batches:
            parts.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            rows += batch.num_rows
            if rows >= _SLICE:
                yield [np.concatenate(x) for x in zip(*parts, strict=True)]
                parts, rows = [], 0
        if rows:
            yield [np.concatenate(x) for x in zip(*parts, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hot = None, None
        for rows in chunks(batches):
            key, fps, away = rows if held is None else (np.concatenate(x) for x in zip(held, rows, strict=True))
            held = None
            if hot is not None:
                if n := int(np.searchsorted(key, hot, "right")):
                    yield emit(1, key[:n], fps[:n], away[:n])
                if n == len(key):
                    continue
                key, fps, away, hot = key[n:], fps[n:], away[n:], None
            cut = int(np.searchsorted(key, key[-1], "left"))
            if cut:
                yield from found(key[:cut], fps[:cut], away[:cut])
            held = (key[cut:], fps[cut:], away[cut:])
            if limit is not None and len(held[0]) > limit:
                hot = held[0][0]
                yield emit(1, *held)
                held = None
        if held is not None:
            yield from found(*held)

    return run


def links(fps: DataFrame, max_distance: int = MAX_DISTANCE, segments: int = SEGMENTS, bucket_limit: int = BUCKET_LIMIT) -> Stored:
    """Links (a, b) between distinct fingerprints that connect all pairs within max_distance; fps has distinct values of fp.

    A bucket over bucket_limit members is cut into blocks, and every pair of its blocks is compared in a task of its own.
    """
    spark = fps.sparkSession
    found = stored(_lookups(fps, max_distance, segments).repartition("key").sortWithinPartitions("key", "away").mapInArrow(_link_finder(max_distance, bucket_limit), _LINK_SCHEMA), "simhash-links")
    near = found.df.filter("kind = 0").select("a", "b")
    large = found.df.filter("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fp"), "away")
    if large.isEmpty():
        return Stored(near, found.path)
    blocks = large.groupBy("key").agg(F.ceil(2 * F.count("*") / F.lit(bucket_limit)).cast("long").alias("blocks"))
    pairs = (
        large.join(blocks, "key")
        .withColumn("own", F.pmod(F.xxhash64("fp"), "blocks"))
        .select("key", "fp", "away", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
        .select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp", "away")
    )
    more = pairs.repartition("key").sortWithinPartitions("key", "away").mapInArrow(_link_finder(max_distance, None), _LINK_SCHEMA)
    both = stored(near.unionByName(more.select("a", "b")), "simhash-links")
    discard(spark, found.path)
    return both


def components(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", max_distance: int = MAX_DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """doc_id, fp and component_id: the smallest doc_id that links reach, the document's own included."""
    tuned(docs.sparkSession)
    marked = stored(docs.select(F.col(id_col).alias("doc_id"), _fingerprints(F.col(text_col)).alias("fp")), "simhash-fp")
    classes = marked.df.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    near = links(classes.select("fp"), max_distance, segments)
    roots = connected_components(near.df, "a", "b")
    discard(docs.sparkSession, near.path)
    linked = roots.select(F.col("node").alias("fp"), "root").join(classes, "fp")
    least = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    reached = roots.join(least, "root").select(F.col("node").alias("fp"), "component_id")
    component = classes.join(reached, "fp", "left").select("fp", F.coalesce("component_id", "least_id").alias("component_id"))
    component = stored(component, "simhash-classes").df  # so that the join below can split the documents of a hot fingerprint
    return marked.df.join(component, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def deduplicate(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """One document of each component stays: the one with the smallest doc_id.

    Of several rows with that doc_id one stays. Rows with a null doc_id stay, as nothing names them.
    """
    return keep_least(docs, components(docs, text_col, id_col, **options), id_col)


def keep_least(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """deduplicate() for components that are found already: doc_id and component_id."""
    assigned = stored(found, "simhash-components")
    removed = assigned.df.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(id_col)).distinct()
    few = assigned.df.filter(F.col("doc_id") != F.col("component_id")).count() <= BROADCAST_IDS
    rest = docs.join(F.broadcast(removed) if few else removed, id_col, "left_anti")
    repeated = assigned.df.filter(F.col("doc_id").isNotNull() & (F.col("doc_id") == F.col("component_id"))).groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias(id_col))
    if repeated.isEmpty():
        return rest
    one = rest.join(repeated, id_col, "left_semi").withColumn("_row", F.xxhash64(*docs.columns)).groupBy(id_col).agg(F.min_by(F.struct(*docs.columns), "_row").alias("_kept")).select("_kept.*")
    return rest.join(repeated, id_col, "left_anti").unionByName(one)
