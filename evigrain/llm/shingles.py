"""Near copies by SimHash, with an index of rare shingles for what balls don't reach.

Two texts are linked if their sets of five-word shingles have a Jaccard
similarity of 0.8 or more. Fingerprints of these sets find close pairs by
multi-index hashing, as in simhash. Pairs at 0.8 are about ten of 64 bits apart
and up to 22, which no affordable ball reaches, so an index brings more
fingerprints together: similar sets share one of the first n - ceil(0.8 n) + 1
shingles of each, in any order that all texts agree on, and each text is filed
under these. Shingles that a sample of texts shows to be common come last in the
order, which keeps buckets small; the order changes no result. Whoever meets is
compared by complete distance, over 128 bits so that pairs at 0.8 are six standard
deviations inside of FAR and unrelated ones outside. What is left is verified on
whole sets of 64-bit shingle hashes, after a bound on their difference.

Copies with one set are one node from the start. A bucket gives a forest of its
close pairs, so that it has no more pairs than members. Where members of a bucket
are not connected once these are verified, a forest of the pairs that the bound
allows follows, and at last all such pairs that are still not connected. A bucket
over BUCKET_LIMIT members is cut into blocks whose pairs are buckets of their own.

Defined cases: a text of fewer words is one shingle; null and wordless texts have
the empty set and are copies of each other; rows with a null doc_id link others
but get no id themselves; repeated rows stay; an empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigrain.llm import simhash
from evigrain.llm.components import connected_components
from evigrain.runtime import Stored, discard, stored, tuned

SHINGLE_WORDS = 5
#: Texts and shingles from which the order is made; only shingles that are early by hash are counted.
SAMPLE_DOCS, COMMON_SHINGLES, EARLY = 20_000, 100_000, -(1 << 62)
#: Bits of 128 that fingerprints of similar sets differ by at most.
FAR = 44
ODD_BITS = 1024
#: Members of one bucket that one task compares; larger buckets are cut into pairs of blocks.
BUCKET_LIMIT = 32768
#: Such buckets up to which they are broadcast (16 bytes each); beyond it both sides are shuffled.
BROADCAST_BUCKETS = 500_000

_MARK = T.StructType([T.StructField("key", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("fp", T.LongType()), T.StructField("more", T.LongType()), T.StructField("odd", T.ArrayType(T.LongType())), T.StructField("first", T.ArrayType(T.LongType()))])
_SET = T.StructType([T.StructField("key", T.LongType()), T.StructField("own", T.ArrayType(T.LongType()))])
_CHUNK = 1 << 17


def hashes(text: bytes | None) -> np.ndarray:
    return simhash.hashes((text or b"").lower().split(), SHINGLE_WORDS)


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(hashes(text)).view(np.int64)


def key(own: np.ndarray) -> int:
    """One number for a set; 0 for the empty one."""
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), simhash.SEED)).view(np.int64)) if len(own) else 0


def first(own: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles that a similar set must share one of: the rarest ones; common ones are sorted, with their counts."""
    if not len(own):
        return own
    size = len(own) - (4 * len(own) + 4) // 5 + 1
    if not len(common):
        return own[:size]
    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
    return own[np.lexsort((own, np.where(common[at] == own, counts[at], 0)))[:size]]


def mixed(own: np.ndarray) -> np.ndarray:
    """Other hashes of the shingles, for 64 more bits of a fingerprint."""
    own = (own ^ (own >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    own = (own ^ (own >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return own ^ (own >> np.uint64(31))


def odd(own: np.ndarray) -> np.ndarray:
    """ODD_BITS bits: which places an odd number of the shingles falls on. Two sets differ by no fewer shingles than these differ by bits."""
    return np.packbits(np.bincount(own & (ODD_BITS - 1), minlength=ODD_BITS) & 1).view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))


def _each(texts: pa.Array) -> list[np.ndarray]:
    return [shingles(x) for x in texts.cast(pa.large_binary()).to_pylist()]


@F.arrow_udf(_SET)
def _sets(texts: pa.Array) -> pa.Array:
    own = _each(texts)
    return pa.StructArray.from_arrays([pa.array([key(x) for x in own], pa.int64()), _lists(own)], names=["key", "own"])


def _marks(common: np.ndarray, counts: np.ndarray):
    @F.arrow_udf(_MARK)
    def marks(texts: pa.Array) -> pa.Array:
        own = _each(texts)
        fps = [pa.array(np.array([simhash.majority(mix(x.view(np.uint64))) for x in own], np.uint64).view(np.int64)) for mix in (np.asarray, mixed)]
        firsts = [first(x, common, counts) for x in own]
        return pa.StructArray.from_arrays([pa.array([key(x) for x in own], pa.int64()), pa.array([len(x) for x in own], pa.int32()), *fps, _lists([odd(x) for x in own]), _lists(firsts)], names=["key", "n", "fp", "more", "odd", "first"])

    return marks


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Early shingles of the texts of each batch, and in how many of these they are."""
    for batch in batches:
        found, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *(x[: np.searchsorted(x, EARLY)] for x in _each(batch.column(0)))]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts)], names=["s", "texts"])


def common_shingles(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of several texts in a sample, sorted, and in how many they are; at most COMMON_SHINGLES."""
    some = docs.select(text_col).sample(fraction=min(1.0, SAMPLE_DOCS / max(docs.count(), 1)), seed=simhash.SEED)
    shared = some.mapInArrow(_counted, "s long, texts long").groupBy("s").agg(F.sum("texts").alias("texts")).filter("texts > 2")
    found = shared.orderBy(F.desc("texts"), "s").limit(COMMON_SHINGLES).toArrow()
    own, texts = (found.column(c).to_numpy() for c in ("s", "texts"))
    order = np.argsort(own)
    return own[order], texts[order]


def _alike(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles can be similar."""
    return 5 * np.minimum(n, m) >= 4 * np.maximum(n, m)


def _bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of whole buckets, from rows that come sorted by the first column."""
    parts, rows = [], 0
    for batch in batches:
        parts.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)])
        rows += batch.num_rows
        if rows >= _CHUNK:
            now = [np.concatenate(x) for x in zip(*parts, strict=True)]
            cut = int(np.searchsorted(now[0], now[0][-1], "left"))
            if cut:
                yield [x[:cut] for x in now]
            # A bucket that goes on is held; the next look at it comes after as many rows again.
            parts, rows = [[x[cut:] for x in now]], 0 if cut == 0 else len(now[0]) - cut
    if parts:
        yield [np.concatenate(x) for x in zip(*parts, strict=True)]


def _bounds(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
    return start, np.diff(np.append(start, len(s)))


_MET = "kind int, s long, a long, b long, n int"


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distinct pairs, the smaller key first."""
    return np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (s, key, n, fp, more, part) sorted by s: a forest of each bucket's close pairs (a, b) as kind 0, members of three and more that have one as kind 1; of parts of a bucket all members."""
    for s, keys, n, fp, more, part in _buckets(batches):
        size = _bounds(s)[1]
        shared = np.repeat(size, size) > 1
        s, keys, n, fp, more, part = (x[shared] for x in (s, keys, n, fp, more, part))
        start, size = _bounds(s)

        def near(i, j) -> np.ndarray:
            return (_bits(fp[i], fp[j]) + _bits(more[i], more[j]) <= FAR) & _alike(n[i], n[j])

        two = start[size == 2]
        two = two[near(two, two + 1)]
        found, left = [_pairs(keys[two], keys[two + 1])], np.zeros(len(s), bool)
        for lo, many in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            label, groups = np.arange(lo, lo + many), many
            for i in range(lo, lo + many - 1):
                if groups == 1:
                    break
                j = i + 1 + np.flatnonzero(label[i + 1 - lo :] != label[i - lo])
                j = j[near(j, i)]
                if len(j):
                    of, one = np.unique(label[j - lo], return_index=True)
                    found.append(np.stack([keys[j[one]], np.full(len(one), keys[i])], axis=1))
                    label[np.isin(label, of)] = label[i - lo]
                    groups -= len(of)
            group, members = np.unique(label, return_counts=True)
            left[lo : lo + many] = np.isin(label, group[members > 2]) | part[lo : lo + many]
        both = np.concatenate(found)
        both = _pairs(both[:, 0], both[:, 1])
        zeros = np.zeros(len(both), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (zeros, both[:, 0] * 0, both[:, 0].copy(), both[:, 1].copy(), zeros)], names=["kind", "s", "a", "b", "n"])
        ones = np.ones(int(left.sum()), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ones, s[left], keys[left], keys[left], n[left])], names=["kind", "s", "a", "b", "n"])


def _apart(forest: bool):
    """Of (s, key, n, root, odd) sorted by s: pairs (a, b) of a bucket that have different roots and can be similar; a forest of them, or all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, keys, n, root, odd in _buckets(batches):
            out = [np.zeros((0, 2), np.int64)]
            start, size = _bounds(s)
            for lo, hi in zip(start.tolist(), (start + size).tolist(), strict=True):
                label = root[lo:hi].copy()
                if (label == label[0]).all():
                    continue
                own, many, marks = keys[lo:hi], n[lo:hi].astype(np.int64), np.stack(odd[lo:hi])
                for i in range(hi - lo - 1):
                    j = i + 1 + np.flatnonzero((label[i + 1 :] != label[i]) & _alike(many[i + 1 :], many[i]))
                    j = j[9 * _bits(marks[j], marks[i]).sum(axis=1) <= many[j] + many[i]]
                    if not len(j):
                        continue
                    if forest:
                        _, one = np.unique(label[j], return_index=True)
                        label[np.isin(label, label[j])] = label[i]
                        j = j[one]
                    out.append(_pairs(own[j], np.full(len(j), own[i])))
            both = np.unique(np.concatenate(out), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, k].copy()) for k in (0, 1)], names=["a", "b"])

    return run


def _in_blocks(filed: DataFrame, limit: int) -> DataFrame:
    """filed, with buckets over the limit cut: a row meets each block of its bucket under a name of its own (part is true there), so that every two members still meet."""
    sizes = stored(filed.groupBy("s").count().filter(F.col("count") > limit).select("s", F.ceil(2 * F.col("count") / F.lit(limit)).cast("long").alias("blocks")), "shingle-hot").df
    many = sizes.count()
    if not many:
        return filed.withColumn("part", F.lit(False))
    hot = F.broadcast(sizes) if many <= BROADCAST_BUCKETS else sizes
    own = F.pmod(F.xxhash64("key"), F.col("blocks"))
    cut = filed.join(hot, "s").withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cut = cut.select(F.xxhash64("s", F.least("_own", "_other"), F.greatest("_own", "_other")).alias("s"), "key", "n", "fp", "more", F.lit(True).alias("part"))
    return filed.join(hot, "s", "left_anti").withColumn("part", F.lit(False)).unionByName(cut)


def _close_fingerprints(classes: DataFrame, written: list[Stored]) -> DataFrame:
    """Pairs (a, b) of sets whose fingerprints are within SimHash's distance, in so far as a chain of such pairs connects them."""
    written.append(stored(classes.groupBy("fp").agg(F.min("key").alias("key")), "shingle-fps"))
    named = written[-1].df
    written.append(simhash.links(named.select("fp")))
    near = written[-1].df
    same = classes.select("fp", F.col("key").alias("a")).join(named.withColumnRenamed("key", "b"), "fp").filter("a != b").select("a", "b")
    far = near.withColumnsRenamed({"a": "fp", "b": "other"}).join(named.withColumnRenamed("key", "a"), "fp").select("a", F.col("other").alias("fp")).join(named.withColumnRenamed("key", "b"), "fp").select("a", "b")
    return same.unionByName(far).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def components(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """doc_id and component_id: the smallest doc_id that links of similarity 0.8 or more reach, the document's own included."""
    spark = tuned(docs.sparkSession)
    written: list[Stored] = []  # deleted when the components are there

    def kept(df: DataFrame, label: str) -> DataFrame:
        written.append(stored(df, label))
        return written[-1].df

    marks = _marks(*common_shingles(docs, text_col))
    marked = stored(docs.select(F.col(id_col).alias("doc_id"), marks(F.col(text_col)).alias("m")).select("doc_id", "m.*"), "shingle-marks")
    classes = kept(marked.df.groupBy("key").agg(F.min("doc_id").alias("least_id"), *(F.any_value(c).alias(c) for c in ("n", "fp", "more", "odd", "first"))), "shingle-classes")
    filed = classes.select(F.explode("first").alias("s"), "key", "n", "fp", "more")
    met = kept(_in_blocks(filed, bucket_limit).repartition("s").sortWithinPartitions("s").mapInArrow(_met, _MET), "shingle-buckets")

    def verified(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b), those with similar sets, which are made again from the texts."""
        side = lambda x: classes.select(F.col("key").alias(x), F.col("n").alias(f"n_{x}"), F.col("odd").alias(f"odd_{x}"))
        differ = F.aggregate(F.zip_with("odd_a", "odd_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
        likely = kept(pairs.join(side("a"), "a").join(side("b"), "b").filter(9 * differ <= F.col("n_a") + F.col("n_b")).select("a", "b"), "shingle-likely")
        ends = likely.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(classes, "key").select(F.col("least_id").alias(id_col)).distinct()
        rows = docs.select(id_col, text_col)
        texts = rows.join(ends, id_col, "left_semi").unionByName(rows.filter(F.col(id_col).isNull()))
        # Written, as a join above would have the sets of all texts made for its filter on keys.
        sets = stored(texts.select(_sets(F.col(text_col)).alias("m")).select("m.*").groupBy("key").agg(F.any_value("own").alias("own")), "shingle-sets")
        both = likely.join(sets.df.select(F.col("key").alias("a"), F.col("own").alias("own_a")), "a").join(sets.df.select(F.col("key").alias("b"), F.col("own").alias("own_b")), "b")
        similar = kept(both.filter(9 * F.size(F.array_intersect("own_a", "own_b")) >= 4 * (F.size("own_a") + F.size("own_b"))).select("a", "b"), "shingle-links")
        discard(spark, sets.path)
        return similar

    near = verified(met.filter("kind = 0").select("a", "b").unionByName(_close_fingerprints(classes, written)).distinct())
    roots = connected_components(near, "a", "b")
    members = met.filter("kind = 1").select("s", F.col("a").alias("key"), "n")
    for forest in (True, False):
        rooted = kept(members.join(roots.withColumnRenamed("node", "key"), "key", "left").select("s", "key", "n", F.coalesce("root", "key").alias("root")), "shingle-rooted")
        split = kept(rooted.groupBy("s").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least < most").select("s"), "shingle-split")
        if split.isEmpty():
            break
        mixed_up = rooted.join(split, "s").join(classes.select("key", "odd"), "key").select("s", "key", "n", "root", "odd")
        apart = kept(mixed_up.repartition("s").sortWithinPartitions("s", "n").mapInArrow(_apart(forest), "a long, b long").distinct(), "shingle-apart")
        if not apart.isEmpty():
            near = near.unionByName(verified(apart))
            roots = connected_components(near, "a", "b")

    linked = roots.join(classes.select(F.col("key").alias("node"), "least_id"), "node")
    least = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    reached = roots.join(least, "root").select(F.col("node").alias("key"), "component_id")
    component = classes.join(reached, "key", "left").select("key", F.coalesce("component_id", "least_id").alias("component_id"))
    component = stored(component, "shingle-components").df  # so that the join below can split the documents of a hot set
    for used in written:
        discard(spark, used.path)
    return marked.df.select("doc_id", "key").join(component, "key").select("doc_id", "component_id")


def deduplicate(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """One document of each component stays, as in simhash.deduplicate."""
    return simhash.keep_least(docs, components(docs, text_col, id_col, **options), id_col)
