"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets an exponential key, divided by its quality weight. A source
is taken in complete epochs first; what is left of its token budget is filled in
key order by a running sum of sizes, and the document in which the budget ends
gives the words that are still wanted. The running sum is made in steps: keys are
cut at quantiles, sums over the cuts tell in which one the budget ends, and only
the documents of that one go on to the next step, until they are few. So no
source, however large and whatever its keys, is sorted in one task, and texts are
not shuffled.

Defined cases: a null text has size 0; a null source is a source of its own,
last in order; a null id is replaced by the text's digest; rows with one source,
key and id share what is left for them in proportion to their sizes; an empty
table gives an empty result. A source whose documents have no words has target 0.
Extra columns are carried along by mix(); ones named like its results are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigrain.runtime import stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = "mix"
#: Cuts of a source's keys in one step, and documents of one cut that are put in order without another step.
CUTS, BUCKET_DOCS = 256, 5000
WORD = r"[^\x20\x09-\x0D]+"
#: Sources up to which their tables are broadcast (about 2 KB each); beyond it both sides are shuffled.
BROADCAST_SOURCES = 4096


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def quality(size: Column, chars: Column) -> Column:
    """A weight of 0 to 1 from the mean word length: prose has about six characters a word, junk has more or less."""
    return F.when(size > 0, 1.0 / (1.0 + F.abs(chars / size - 6.0))).otherwise(1.0)


def key(doc_id: Column, text: Column, weight: Column, seed: str = SEED) -> Column:
    """-ln(u) / weight with u in (0, 1) from 52 bits of an MD5 of the id, or of the text's digest where there is no id."""
    named = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")))))
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), named)), 1, 13), 16, 10).cast("long")
    return -F.log((bits + 0.5) / float(1 << 52)) / weight


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """For (source, source_docs, source_size), a row a source: its weight by rank, its target, whole epochs and the rest of its budget.

    Sources stop at `most` times their size; in order of size by weight, each that would pass its limit is filled and the others share the rest.
    """
    ranked = sizes.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int")))
    limited = ranked.withColumn("limit", float(most) * F.col("source_size")).withColumn("turn", F.row_number().over(Window.orderBy(F.col("limit") / F.col("weight"), "sid")))
    order, everything = Window.orderBy("turn"), Window.partitionBy()
    level = limited.withColumn("level", (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    open_level = F.min_by("level", F.when(F.col("level") < F.col("limit") / F.col("weight"), F.col("turn"))).over(everything)
    has_open = F.max(F.col("level") < F.col("limit") / F.col("weight")).over(everything)
    aimed = level.withColumn("target", F.when(has_open, F.least("limit", open_level * F.col("weight"))).otherwise(F.col("limit")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    return aimed.withColumn("epochs", epochs).withColumn("rest", rest).select("source", "source_docs", "source_size", "sid", "target", "epochs", "rest")


def _of_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    named = sources.withColumnRenamed("source", "_source")
    return rows.join(named, rows["source"].eqNullSafe(named["_source"])).drop("_source")


def _checked(rows: DataFrame) -> DataFrame:
    """rows, a few a source, with a broadcast hint if a count shows them to be few; beyond that joins shuffle."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_SOURCES else rows


def _narrowed(docs: DataFrame, open_to: DataFrame) -> DataFrame:
    """For (sid, key, doc_id, size) and each source's room: a row a source with the keys of the cut in which its room ends, and the room left in there."""
    cuts = stored(docs.groupBy("sid").agg(F.percentile_approx("key", [i / CUTS for i in range(1, CUTS)], F.lit(CUTS * 40)).alias("cuts")).join(open_to, "sid"), "mix-quantiles").df
    place = F.aggregate(F.col("cuts"), F.lit(0), lambda n, c: n + F.when(c < F.col("key"), 1).otherwise(0))
    sums = docs.join(_checked(cuts), "sid").groupBy("sid", place.alias("cut"), "room").agg(F.sum("size").alias("words"), F.min("key").alias("first"), F.max("key").alias("last"))
    passed = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("sid").orderBy("cut"))).filter("upto > room")
    return passed.groupBy("sid").agg(F.min_by(F.struct("first", "last", (F.col("room") - F.col("upto") + F.col("words")).alias("room")), "cut").alias("end")).select("sid", "end.*")


def _tied(docs: DataFrame) -> DataFrame:
    return docs.groupBy("sid", "key", "doc_id").agg(F.sum("size").alias("size"))


def ends(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """(sid, end_key, end_id, room, words): where each budget ends in the order of (key, doc_id): the words left for the rows there, and how many these have.

    docs: (sid, key, doc_id, size), written. The first step reads all of them, every other one the rows of a single cut a source.
    """
    open_to, now = sources.filter("source_size > 0").select("sid", F.col("rest").alias("room")), docs
    most = sources.agg(F.max("source_docs")).first()[0] or 0
    while most > BUCKET_DOCS:
        narrowed = stored(_narrowed(now, open_to), "mix-cuts").df
        inside = now.join(_checked(narrowed.select("sid", "first", "last")), "sid").filter("key BETWEEN first AND last")
        now, open_to = stored(_tied(inside), "mix-open").df, narrowed.select("sid", "room")
        most = now.groupBy("sid").count().agg(F.max("count")).first()[0] or 0
    order = Window.partitionBy("sid").orderBy("key", F.col("doc_id").asc_nulls_first())
    passed = _tied(now).join(_checked(open_to), "sid").withColumn("upto", F.sum("size").over(order)).withColumn("place", F.row_number().over(order)).filter("upto > room")
    end = F.struct(F.col("key").alias("end_key"), F.col("doc_id").alias("end_id"), (F.col("room") - F.col("upto") + F.col("size")).alias("room"), F.col("size").alias("words"))
    return passed.groupBy("sid").agg(F.min_by(end, "place").alias("end")).select("sid", "end.*")


def decide(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """For (doc_id, source, size, key): the table of sources with target, whole epochs and where each budget ends."""
    sizes = docs.groupBy("source").agg(F.count("*").alias("source_docs"), F.sum("size").alias("source_size"))
    sources = stored(targets(sizes, weights, share, most), "mix-targets").df
    found = ends(_of_sources(docs, sources.select("source", "sid")).select("sid", "key", "doc_id", "size"), sources)
    return stored(sources.join(found, "sid", "left"), "mix-ends").df


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", sized: DataFrame | None = None, **options) -> DataFrame:
    """docs with size, source_size, target and taken: the words that the mix takes, repeats counted.

    sized: docs' (doc_id, source, size, key) if they are there already; docs must then have these columns too.
    """
    if sized is None:
        docs = sizes(docs, id_col, text_col, source_col)
        sized = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col("_size").alias("size"), F.col("_key").alias("key")), "mix-sizes").df
    found = decide(sized, **options)
    found = found.select(*[F.col(c).alias(f"_mix_{c}") for c in found.columns])
    joined = docs.join(found, docs[source_col].eqNullSafe(found["_mix_source"]))
    size, key_at, end_key, end_id = F.col("_size"), F.col("_key"), F.col("_mix_end_key"), F.col("_mix_end_id")
    same = F.col(id_col).eqNullSafe(end_id)
    before = (key_at < end_key) | ((key_at == end_key) & ~same & (F.col(id_col).isNull() | (F.col(id_col) < end_id)))
    ending = F.expr("_size * _mix_room DIV greatest(_mix_words, 1)")
    part = F.when(end_key.isNull() | F.coalesce(before, F.lit(False)), size).when((key_at == end_key) & same, ending).otherwise(F.lit(0))
    taken = F.when(F.col("_mix_source_size") > 0, size * F.col("_mix_epochs") + part).otherwise(0)
    kept = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken", "_size", "_key")]
    return joined.select(*kept, size.alias("size"), F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), taken.cast("long").alias("taken"))


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with _size (words) and _key."""
    counted = docs.withColumn("_size", words(text_col))
    return counted.withColumn("_key", key(F.col(id_col), F.col(text_col), quality(F.col("_size"), F.char_length(F.col(text_col)))))
