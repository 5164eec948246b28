"""Evidence: containment, citations, reference integrity, summaries.

Inputs are tables of chunks, facts and claims as in the schemas of this package.
Matching by containment joins on a word inside the claim first, or on its first
characters, so that only pairs which share it are compared; texts are read where
they lie if claims are few, and cross a shuffle once if they are many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigrain.functions import text

#: Reasons for an unsupported claim in order of precedence, with whether the claim counts as rejected.
REASONS = {
    "missing_verifiable_evidence": False,
    "missing_source_chunk": True,
    "unknown_source_chunk_id": True,
    "missing_verbatim_evidence": True,
    "verbatim_evidence_not_in_source_chunk": True,
    "unknown_fact_id": True,
    "fact_not_owned_by_cited_source_chunk": True,
    "content_not_verbatim_evidence": False,
    "numeric_claim_not_supported_by_cited_facts": True,
    "date_claim_not_supported_by_cited_facts": True,
}


#: Claims and their characters up to which they are broadcast, so that chunks are read once and not shuffled.
BROADCAST_CLAIMS, BROADCAST_CHARS = 20_000, 8 << 20
#: Inner words of a claim of which the rarest finds its chunks.
ANCHORS = 3


def _grams(x: Column, size: int) -> Column:
    """All runs of `size` characters, in one pass over the text."""
    return F.regexp_extract_all(x, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))


def _words(x: Column) -> Column:
    return F.split(x, " ")


def _longest(inner: Column) -> Column:
    """The longest different words, ANCHORS at most."""
    ranked = F.sort_array(F.transform(F.array_distinct(inner), lambda w: F.struct(F.char_length(w).alias("n"), w.alias("w"))), asc=False)
    return F.transform(F.slice(ranked, 1, ANCHORS), lambda r: r["w"])


def _met(chunks: DataFrame, claims: DataFrame, anchors: Column, few: bool) -> DataFrame:
    """(claim_id, chunk_id, ord) where a chunk contains a claim; anchors are the chunk's, claims have one anchor each.

    Few claims are broadcast. With many, ids meet first and the texts of the pairs that met follow.
    """
    if few:
        met = chunks.select("chunk_id", "ord", "chunk_text", F.explode(F.array_distinct(anchors)).alias("anchor")).join(F.broadcast(claims), "anchor")
        return met.filter(F.contains("chunk_text", "claim_text")).select("claim_id", "chunk_id", "ord")
    wanted = claims.select("anchor").distinct()
    filed = chunks.select("chunk_id", F.explode(F.array_distinct(anchors)).alias("anchor")).join(wanted, "anchor", "left_semi")
    pairs = filed.join(claims, "anchor").select("chunk_id", "claim_id", "claim_text")
    return pairs.join(chunks, "chunk_id").filter(F.contains("chunk_text", "claim_text")).select("claim_id", "chunk_id", "ord")


def _rarest(chunks: DataFrame, claims: DataFrame) -> DataFrame:
    """claims with the one of their anchors that the fewest chunks have; a claim with an anchor that no chunk has is left out."""
    each = claims.select("claim_id", "claim_text", F.explode("anchors").alias("anchor"))
    wanted = each.select("anchor").distinct()
    counted = chunks.select(F.explode(F.array_distinct(_words(F.col("chunk_text")))).alias("anchor")).join(wanted, "anchor", "left_semi").groupBy("anchor").agg(F.count("*").alias("chunks"))
    met = each.join(counted, "anchor", "left").groupBy("claim_id", "claim_text")
    return met.agg(F.min_by("anchor", F.struct("chunks", "anchor")).alias("anchor"), F.bool_and(F.col("chunks").isNotNull()).alias("everywhere")).filter("everywhere").drop("everywhere")


def containing(chunks: DataFrame, claims: DataFrame) -> DataFrame:
    """(claim_id, chunk_id, ord): all chunks whose normalised text has the claim's normalised text in it.

    A claim of three words or more meets the chunks that have one of its inner words whole; a shorter one those that have its first three characters (or fewer, if it is no longer).
    """
    normal = chunks.select("chunk_id", "ord", text.normalized(F.col("text")).alias("chunk_text"))
    wanted = claims.select("claim_id", text.normalized(F.col("text")).alias("claim_text")).filter("claim_text <> ''").withColumn("words", _words(F.col("claim_text"))).distinct()
    sizes = wanted.groupBy((F.size("words") >= 3).alias("long"), F.least(F.char_length("claim_text"), F.lit(3)).alias("size")).agg(F.count("*").alias("n"), F.sum(F.char_length("claim_text")).alias("chars")).collect()  # six rows at most
    few = sum(r["n"] for r in sizes) <= BROADCAST_CLAIMS and sum(r["chars"] for r in sizes) <= BROADCAST_CHARS
    parts = []
    if any(r["long"] for r in sizes):
        long = wanted.filter(F.size("words") >= 3).select("claim_id", "claim_text", _longest(F.slice("words", 2, F.greatest(F.size("words") - 2, F.lit(0)))).alias("anchors"))
        one = long.select("claim_id", "claim_text", F.get("anchors", 0).alias("anchor")) if few else _rarest(normal, long)
        parts.append(_met(normal, one, _words(F.col("chunk_text")), few))
    short = sorted({r["size"] for r in sizes if not r["long"]})
    if short:
        own = wanted.filter(F.size("words") < 3).select("claim_id", "claim_text", F.substring("claim_text", 1, 3).alias("anchor"))
        parts.append(_met(normal, own, F.concat(*[_grams(F.col("chunk_text"), n) for n in short]), few))
    if not parts:
        return normal.join(wanted.select("claim_id"), F.lit(False)).select("claim_id", "chunk_id", "ord")
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return found.distinct()


def first_grounding(chunks: DataFrame, claims: DataFrame) -> DataFrame:
    """Each claim with the first chunk that contains it, and whether it is grounded."""
    first = containing(chunks, claims).groupBy("claim_id").agg(F.min_by("chunk_id", "ord").alias("chunk_id"))
    return claims.join(first, "claim_id", "left").withColumn("grounding", F.when(F.col("chunk_id").isNull(), "unsupported").otherwise("grounded"))


def summary(aligned: DataFrame) -> DataFrame:
    """Totals of grounded, unsupported and rejected claims."""
    rejected = F.count_if("rejected") if "rejected" in aligned.columns else F.lit(0).cast("long")
    return aligned.agg(F.count("*").alias("total"), F.count_if(F.col("grounding") == "grounded").alias("grounded"), F.count_if(F.col("grounding") != "grounded").alias("unsupported"), rejected.alias("rejected"))


def _blank(x: Column) -> Column:
    return text.trimmed(F.coalesce(x, F.lit(""))) == ""


def align(claims: DataFrame, chunks: DataFrame, facts: DataFrame) -> DataFrame:
    """claims (claim_id, text, chunk_ids, fact_ids, quote) with grounding, reason, rejected and precision.

    The first reason that holds wins; a claim without any is grounded, precise if any cited chunk is exact.
    """
    cited = claims.select("claim_id", "quote", F.explode_outer("chunk_ids").alias("chunk_id")).filter("chunk_id IS NOT NULL")
    by_chunk = (
        cited.join(chunks.select("chunk_id", F.col("text").alias("chunk_text"), "precision"), "chunk_id", "left")
        .groupBy("claim_id")
        .agg(F.bool_or(F.col("chunk_text").isNull()).alias("chunk_unknown"), F.bool_or(F.coalesce(F.contains("chunk_text", "quote"), F.lit(False))).alias("quoted"), F.bool_or(F.coalesce(F.col("precision") == "exact", F.lit(False))).alias("exact"))
    )
    named = claims.select("claim_id", "chunk_ids", F.explode_outer("fact_ids").alias("fact_id")).filter("fact_id IS NOT NULL")
    own = facts.select("fact_id", F.col("chunk_id").alias("fact_chunk"), "value_type", "value_num", "value_str")
    by_fact = (
        named.join(own, "fact_id", "left")
        .groupBy("claim_id")
        .agg(
            F.bool_or(F.col("fact_chunk").isNull()).alias("fact_unknown"),
            F.bool_or(~F.coalesce(F.array_contains("chunk_ids", F.col("fact_chunk")), F.lit(False))).alias("fact_foreign"),
            F.collect_set(F.when(F.col("value_type") == "number", F.col("value_num"))).alias("numbers"),
            F.collect_set(F.when(F.col("value_type") == "date", F.substring("value_str", 1, 10))).alias("dates"),
        )
    )
    joined = claims.join(by_chunk, "claim_id", "left").join(by_fact, "claim_id", "left")
    none = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) == 0
    is_true = lambda c: F.coalesce(F.col(c), F.lit(False))
    numbers, dates = text.numeric_claims(F.col("text")), text.date_claims(F.col("text"))
    holds = {
        "missing_verifiable_evidence": _blank(F.col("quote")) & none("chunk_ids") & none("fact_ids"),
        "missing_source_chunk": none("chunk_ids"),
        "unknown_source_chunk_id": is_true("chunk_unknown"),
        "missing_verbatim_evidence": _blank(F.col("quote")),
        "verbatim_evidence_not_in_source_chunk": ~is_true("quoted"),
        "unknown_fact_id": is_true("fact_unknown"),
        "fact_not_owned_by_cited_source_chunk": is_true("fact_foreign"),
        "content_not_verbatim_evidence": ~F.contains(text.normalized(F.col("quote")), text.normalized(F.col("text"))),
        "numeric_claim_not_supported_by_cited_facts": F.size(F.array_except(numbers, F.coalesce("numbers", F.array().cast("array<double>")))) > 0,
        "date_claim_not_supported_by_cited_facts": F.size(F.array_except(dates, F.coalesce("dates", F.array().cast("array<string>")))) > 0,
    }
    reason = F.lit(None).cast("string")
    for name in reversed(REASONS):
        reason = F.when(holds[name], name).otherwise(reason)
    aligned = joined.withColumn("reason", reason)
    rejected = F.coalesce(F.col("reason").isin(*[r for r, x in REASONS.items() if x]), F.lit(False))
    grounded = F.col("reason").isNull()
    return aligned.select(*claims.columns, F.when(grounded, "grounded").otherwise("unsupported").alias("grounding"), "reason", rejected.alias("rejected"), F.when(grounded & is_true("exact"), "exact").otherwise("document").alias("precision"))


def search(requests: DataFrame, chunks: DataFrame, facts: DataFrame) -> DataFrame:
    """Matches of requests (request_id, chunk_ids, fact_ids, query): chunks by id, by fact and by text, in this order.

    Of several ways to a chunk the first gives the order; its facts are united. Unknown ids give error rows.
    """
    by_id = requests.select("request_id", F.posexplode("chunk_ids").alias("at", "chunk_id")).select("request_id", F.lit(1).alias("way"), F.col("at").cast("long").alias("at"), "chunk_id", F.lit(None).cast("string").alias("fact_id"), F.lit(None).cast("string").alias("unknown"))
    own = facts.select("fact_id", F.col("chunk_id").alias("fact_chunk"))
    by_fact = requests.select("request_id", F.posexplode("fact_ids").alias("at", "fact_id")).join(own, "fact_id", "left").select("request_id", F.lit(2).alias("way"), F.col("at").cast("long").alias("at"), F.col("fact_chunk").alias("chunk_id"), "fact_id", F.when(F.col("fact_chunk").isNull(), "unknown_fact_id").alias("unknown"))
    asked = requests.filter(F.col("query").isNotNull()).select(F.col("request_id").cast("string").alias("claim_id"), F.col("query").alias("text"), "request_id")
    by_text = containing(chunks, asked).join(asked.select("claim_id", "request_id"), "claim_id").select("request_id", F.lit(3).alias("way"), F.col("ord").cast("long").alias("at"), "chunk_id", F.lit(None).cast("string").alias("fact_id"), F.lit(None).cast("string").alias("unknown"))
    every = by_id.unionByName(by_fact).unionByName(by_text)
    known = every.join(chunks.select("chunk_id", F.lit(True).alias("known")), "chunk_id", "left")
    error = F.coalesce("unknown", F.when(F.col("known").isNull(), F.when(F.col("way") == 1, "unknown_source_chunk_id").otherwise("unconfirmed_evidence")))
    return known.withColumn("error", error).groupBy("request_id", "chunk_id", "error").agg(F.min(F.struct("way", "at")).alias("first"), F.array_sort(F.collect_set("fact_id")).alias("fact_ids")).select("request_id", "chunk_id", "error", F.col("first.way").alias("way"), F.col("first.at").alias("at"), "fact_ids")


def integrity(facts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each fact's first error against its chunk: unknown chunk, other source, other locator, other merged range; or a repeated id."""
    own = chunks.select("chunk_id", F.col("source_id").alias("c_source"), F.col("locator").alias("c_locator"), F.col("merged_range").alias("c_range"))
    repeated = F.count("*").over(Window.partitionBy("fact_id")) > 1
    error = (
        F.when(repeated, "duplicate_fact_id")
        .when(F.col("c_source").isNull(), "unknown_source_chunk_id")
        .when(F.col("c_source") != F.col("source_id"), "source_mismatch")
        .when(F.col("c_locator") != F.col("locator"), "locator_mismatch")
        .when(~F.col("c_range").eqNullSafe(F.col("merged_range")), "merged_range_mismatch")
    )
    return facts.join(own, "chunk_id", "left").withColumn("error", error).select(*facts.columns, "error")


def dangling(refs: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """References that nothing known answers."""
    return refs.join(known.select(key), key, "left_anti")


def specialist_errors(refs: DataFrame, facts: DataFrame) -> DataFrame:
    """For (ref_id, chunk_ids, fact_id): facts that are unknown or belong to no cited chunk."""
    joined = refs.join(facts.select("fact_id", F.col("chunk_id").alias("fact_chunk")), "fact_id", "left")
    error = F.when(F.col("fact_chunk").isNull(), "unknown_fact_id").when(~F.array_contains("chunk_ids", F.col("fact_chunk")), "fact_outside_cited_chunks")
    return joined.select("ref_id", "fact_id", error.alias("error"))


def datum_errors(data: DataFrame, facts: DataFrame, chunks: DataFrame, citations: DataFrame) -> DataFrame:
    """For (datum_id, fact_id, chunk_id, value_num, value_str): the first error of a value shown in a visual.

    citations has (fact_id, chunk_id) of grounded claims.
    """
    own = facts.select("fact_id", F.col("chunk_id").alias("f_chunk"), F.col("source_id").alias("f_source"), "value_type", F.col("value_num").alias("f_num"), F.col("value_str").alias("f_str"))
    joined = data.join(own, "fact_id", "left").join(chunks.select("chunk_id", F.col("source_id").alias("c_source")), "chunk_id", "left")
    joined = joined.join(citations.select("fact_id", "chunk_id", F.lit(True).alias("cited")).distinct(), ["fact_id", "chunk_id"], "left")
    numeric = F.col("value_num").isNotNull()
    error = (
        F.when(F.col("f_chunk").isNull(), "unknown_fact_id")
        .when(F.col("c_source").isNull(), "unknown_source_chunk_id")
        .when((F.col("f_chunk") != F.col("chunk_id")) | (F.col("f_source") != F.col("c_source")), "unconfirmed_fact_source")
        .when(F.col("cited").isNull(), "unconfirmed_plan_reference")
        .when(numeric & ((F.col("value_type") != "number") | (F.col("f_num") != F.col("value_num"))), "fact_value_mismatch")
        .when(~numeric & ((F.col("value_type") == "number") | ~F.col("f_str").eqNullSafe(F.col("value_str"))), "fact_value_mismatch")
    )
    return joined.select("datum_id", error.alias("error"))


def ordered_union(rows: DataFrame, group: str, order: str, ids: str, to: str) -> DataFrame:
    """Distinct ids of arrays per group, in order of first appearance."""
    gathered = F.array_sort(F.collect_list(F.struct(order, ids)))
    return rows.groupBy(group).agg(F.array_distinct(F.flatten(F.transform(gathered, lambda r: r[ids]))).alias(to))


def source_links(chunks: DataFrame, facts: DataFrame) -> DataFrame:
    """(source_id, kind, id): the distinct chunk and fact ids of each source, a row a link, so that no source is gathered; sort by all three for the listing."""
    link = lambda rows, kind, name: rows.select("source_id", F.lit(kind).alias("kind"), F.col(name).alias("id"))
    return link(chunks, "chunk", "chunk_id").unionByName(link(facts, "fact", "fact_id")).distinct()


def reused_claims(bindings: DataFrame) -> DataFrame:
    """For (deck, slide_no, claim_id): later slides that use a claim again, with the first slide that used it."""
    first = F.min("slide_no").over(Window.partitionBy("deck", "claim_id"))
    return bindings.select("deck", "slide_no", "claim_id").distinct().withColumn("first_slide", first).filter(F.col("slide_no") > F.col("first_slide"))
