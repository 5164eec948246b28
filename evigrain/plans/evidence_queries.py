"""Queries over evidence: grounding, citations, reference integrity, lineage of sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigrain.operators import evidence
from evigrain.plans.registered import registry
from evigrain.plans.standins import frame, run, twin

QUERIES, ORACLE_SQL, query = registry()

_NORMAL = r"lower(trim(regexp_replace({}, '\s+', ' ', 'g')))"
_BENCH_CLAIMS = "SELECT concat('b', CAST(item_id AS VARCHAR(20))) AS claim_id, text FROM benchmark"
_MATCHES = rf"""SELECT claim_id, chunk_id, ord FROM bench_claims b JOIN chunks c ON {_NORMAL.format("b.text")} <> '' AND contains({_NORMAL.format("c.text")}, {_NORMAL.format("b.text")})"""


@query("grounding_flagship", twin("""SELECT b.claim_id, min_by(m.chunk_id, m.ord) AS chunk_id, CASE WHEN count(m.chunk_id) > 0 THEN 'grounded' ELSE 'unsupported' END AS grounding
FROM bench_claims b LEFT JOIN matches m ON m.claim_id = b.claim_id GROUP BY b.claim_id""", bench_claims=_BENCH_CLAIMS, matches=_MATCHES))
def grounding_flagship(spark, sf):
    return evidence.first_grounding(frame(spark, sf, "chunks"), run(spark, sf, _BENCH_CLAIMS)).select("claim_id", "chunk_id", "grounding")


@query("grounding_summary", twin("""SELECT count(*) AS total, count(*) FILTER (WHERE n > 0) AS grounded, count(*) FILTER (WHERE n = 0) AS unsupported, CAST(0 AS BIGINT) AS rejected
FROM (SELECT b.claim_id, count(m.chunk_id) AS n FROM bench_claims b LEFT JOIN matches m ON m.claim_id = b.claim_id GROUP BY b.claim_id)""", bench_claims=_BENCH_CLAIMS, matches=_MATCHES))
def grounding_summary(spark, sf):
    return evidence.summary(evidence.first_grounding(frame(spark, sf, "chunks"), run(spark, sf, _BENCH_CLAIMS)))


@query("claims_both_ways", twin(rf"""SELECT a.claim_id AS claim_id, count(DISTINCT c.chunk_id) AS n_related FROM bench_claims a LEFT JOIN chunks c
ON contains({_NORMAL.format("c.text")}, {_NORMAL.format("a.text")}) OR contains({_NORMAL.format("a.text")}, {_NORMAL.format("c.text")}) GROUP BY a.claim_id""", bench_claims=_BENCH_CLAIMS))
def claims_both_ways(spark, sf):
    claims, chunks = run(spark, sf, _BENCH_CLAIMS), frame(spark, sf, "chunks")
    forth = evidence.containing(chunks, claims).select("claim_id", "chunk_id")
    as_chunks = claims.select(F.col("claim_id").alias("chunk_id"), F.lit(0).alias("ord"), "text")
    back = evidence.containing(as_chunks, chunks.select(F.col("chunk_id").alias("claim_id"), "text")).select(F.col("chunk_id").alias("claim_id"), F.col("claim_id").alias("chunk_id"))
    related = forth.unionByName(back).groupBy("claim_id").agg(F.countDistinct("chunk_id").alias("n"))
    return claims.join(related, "claim_id", "left").select("claim_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_related"))


_CITED = """SELECT concat('k', CAST(doc_id AS VARCHAR(20))) AS claim_id, doc_id,
CASE doc_id % 12 WHEN 7 THEN 'paraphrase' WHEN 9 THEN 'on 2024-01-15' WHEN 11 THEN 'end' ELSE concat('total ', CAST(doc_id AS VARCHAR(20))) END AS text,
CASE WHEN doc_id % 12 = 2 THEN 'c-none' WHEN doc_id % 12 IN (0, 1) THEN NULL ELSE concat('c', CAST(doc_id AS VARCHAR(20))) END AS chunk_ref,
CASE WHEN doc_id % 12 = 5 THEN 'f-none' WHEN doc_id % 12 = 6 THEN concat('f', CAST(doc_id + 1 AS VARCHAR(20))) WHEN doc_id % 12 IN (9, 10) THEN concat('f', CAST(doc_id AS VARCHAR(20))) END AS fact_ref,
CASE doc_id % 12 WHEN 0 THEN '' WHEN 3 THEN ' ' WHEN 4 THEN 'not in the chunk 123' WHEN 11 THEN '2024-01-15 end' ELSE concat('total ', CAST(doc_id AS VARCHAR(20)), ' on 2024-01-15') END AS quote FROM documents"""


@query("claim_reason_cascade", twin(rf"""SELECT claim_id, CASE WHEN reason IS NULL THEN 'grounded' ELSE 'unsupported' END AS grounding, reason,
coalesce(reason NOT IN ('missing_verifiable_evidence', 'content_not_verbatim_evidence'), false) AS rejected, CASE WHEN reason IS NULL AND precision = 'exact' THEN 'exact' ELSE 'document' END AS precision FROM (
SELECT k.claim_id, c.precision, CASE WHEN trim(quote) = '' AND chunk_ref IS NULL AND fact_ref IS NULL THEN 'missing_verifiable_evidence' WHEN chunk_ref IS NULL THEN 'missing_source_chunk' WHEN c.chunk_id IS NULL THEN 'unknown_source_chunk_id'
WHEN trim(quote) = '' THEN 'missing_verbatim_evidence' WHEN NOT contains(c.text, quote) THEN 'verbatim_evidence_not_in_source_chunk' WHEN fact_ref IS NOT NULL AND f.fact_id IS NULL THEN 'unknown_fact_id'
WHEN fact_ref IS NOT NULL AND f.chunk_id <> chunk_ref THEN 'fact_not_owned_by_cited_source_chunk' WHEN NOT contains({_NORMAL.format("quote")}, {_NORMAL.format("k.text")}) THEN 'content_not_verbatim_evidence'
WHEN len(list_filter(regexp_extract_all(k.text, '[+-]?\d+(?:[.,]\d+)?'), lambda v: coalesce(CAST(v AS DOUBLE) <> CASE WHEN f.value_type = 'number' THEN f.value_num END, true))) > 0 THEN 'numeric_claim_not_supported_by_cited_facts'
WHEN len(list_filter(regexp_extract_all(k.text, '\b\d{{4}}-\d{{2}}-\d{{2}}\b'), lambda v: coalesce(v <> CASE WHEN f.value_type = 'date' THEN substr(f.value_str, 1, 10) END, true))) > 0 THEN 'date_claim_not_supported_by_cited_facts' END AS reason
FROM cited k LEFT JOIN chunks c ON c.chunk_id = k.chunk_ref LEFT JOIN facts f ON f.fact_id = k.fact_ref)""", cited=_CITED))
def claim_reason_cascade(spark, sf):
    one = lambda c: F.when(F.col(c).isNull(), F.array().cast("array<string>")).otherwise(F.array(c))
    claims = run(spark, sf, _CITED).select("claim_id", "text", one("chunk_ref").alias("chunk_ids"), one("fact_ref").alias("fact_ids"), "quote")
    return evidence.align(claims, frame(spark, sf, "chunks"), frame(spark, sf, "facts")).select("claim_id", "grounding", "reason", "rejected", "precision")


_REQUESTS = "SELECT concat('r', CAST(item_id AS VARCHAR(20))) AS request_id, concat('c', CAST(item_id * 3 AS VARCHAR(20))) AS chunk_ref, concat('f', CAST(item_id * 7 AS VARCHAR(20))) AS fact_ref, text AS query FROM benchmark"


@query("evidence_search", twin(rf"""WITH ways AS (SELECT request_id, chunk_ref AS chunk_id, NULL AS fact_id, 1 AS way, 0 AS place, false AS lost FROM requests
UNION ALL SELECT request_id, f.chunk_id, fact_ref, 2, 0, f.fact_id IS NULL FROM requests LEFT JOIN facts f ON f.fact_id = fact_ref
UNION ALL SELECT request_id, c.chunk_id, NULL, 3, c.ord, false FROM requests JOIN chunks c ON contains({_NORMAL.format("c.text")}, {_NORMAL.format("query")})),
e AS (SELECT w.*, CASE WHEN lost THEN 'unknown_fact_id' WHEN c.chunk_id IS NULL THEN CASE WHEN way = 1 THEN 'unknown_source_chunk_id' ELSE 'unconfirmed_evidence' END END AS error FROM ways w LEFT JOIN chunks c ON c.chunk_id = w.chunk_id)
SELECT request_id, chunk_id, error, min(way) AS way, CAST(arg_min(place, CAST(way AS BIGINT) * 1000000000 + place) AS BIGINT) AS place, coalesce(string_agg(DISTINCT fact_id, ',' ORDER BY fact_id), '') AS fact_ids FROM e GROUP BY request_id, chunk_id, error""", requests=_REQUESTS))
def evidence_search(spark, sf):
    requests = run(spark, sf, _REQUESTS).select("request_id", F.array("chunk_ref").alias("chunk_ids"), F.array("fact_ref").alias("fact_ids"), "query")
    return evidence.search(requests, frame(spark, sf, "chunks"), frame(spark, sf, "facts")).withColumn("fact_ids", F.array_join("fact_ids", ",")).withColumnRenamed("at", "place")


@query("fact_chunk_integrity", twin("""SELECT f.fact_id, CASE WHEN count(*) OVER (PARTITION BY f.fact_id) > 1 THEN 'duplicate_fact_id' WHEN c.chunk_id IS NULL THEN 'unknown_source_chunk_id' WHEN c.source_id <> f.source_id THEN 'source_mismatch'
WHEN c.locator <> f.locator THEN 'locator_mismatch' WHEN c.merged_range IS DISTINCT FROM f.merged_range THEN 'merged_range_mismatch' END AS error FROM facts f LEFT JOIN chunks c ON c.chunk_id = f.chunk_id"""))
def fact_chunk_integrity(spark, sf):
    return evidence.integrity(frame(spark, sf, "facts"), frame(spark, sf, "chunks")).select("fact_id", "error")


@query("dangling_refs", twin("SELECT f.fact_id, f.chunk_id FROM facts f WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.chunk_id = f.chunk_id)"))
def dangling_refs(spark, sf):
    return evidence.dangling(frame(spark, sf, "facts"), frame(spark, sf, "chunks"), "chunk_id").select("fact_id", "chunk_id")


@query("dangling_orders", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey + CASE WHEN l_linenumber = 5 THEN 100000000 ELSE 0 END)")
def dangling_orders(spark, sf):
    """Every fifth line names an order that is not there."""
    lines = frame(spark, sf, "lineitem").withColumn("o_orderkey", F.col("l_orderkey") + F.when(F.col("l_linenumber") == 5, 100000000).otherwise(0))
    return evidence.dangling(lines, frame(spark, sf, "orders"), "o_orderkey").select("l_orderkey", "l_linenumber")


_SPECIALIST = "SELECT concat('s', CAST(doc_id AS VARCHAR(20))) AS ref_id, concat('f', CAST(doc_id + doc_id % 2 AS VARCHAR(20))) AS fact_id, concat('c', CAST(doc_id AS VARCHAR(20))) AS chunk_ref FROM documents"


@query("specialist_refs", twin("""SELECT s.ref_id, s.fact_id, CASE WHEN f.fact_id IS NULL THEN 'unknown_fact_id' WHEN f.chunk_id <> s.chunk_ref THEN 'fact_outside_cited_chunks' END AS error FROM specialist s LEFT JOIN facts f ON f.fact_id = s.fact_id""", specialist=_SPECIALIST))
def specialist_refs(spark, sf):
    return evidence.specialist_errors(run(spark, sf, _SPECIALIST).withColumn("chunk_ids", F.array("chunk_ref")), frame(spark, sf, "facts"))


_DATA = """SELECT doc_id AS datum_id, CASE WHEN doc_id % 13 = 0 THEN 'f-none' ELSE concat('f', CAST(doc_id AS VARCHAR(20))) END AS fact_id,
CASE WHEN doc_id % 11 = 0 THEN 'c-none' WHEN doc_id % 17 = 0 THEN 'c1' ELSE concat('c', CAST(doc_id AS VARCHAR(20))) END AS chunk_id,
CASE WHEN doc_id % 3 <> 0 THEN CAST(doc_id + CASE WHEN doc_id % 19 = 0 THEN 1 ELSE 0 END AS DOUBLE) END AS value_num, CASE WHEN doc_id % 3 = 0 THEN '2024-01-15T00:00:00.000Z' END AS value_str FROM documents"""
_CITATIONS = "SELECT concat('f', CAST(doc_id AS VARCHAR(20))) AS fact_id, CASE WHEN doc_id % 7 = 0 THEN 'c-other' ELSE concat('c', CAST(doc_id AS VARCHAR(20))) END AS chunk_id FROM documents"


@query("visual_datum_checks", twin("""SELECT d.datum_id, CASE WHEN f.fact_id IS NULL THEN 'unknown_fact_id' WHEN c.chunk_id IS NULL THEN 'unknown_source_chunk_id' WHEN f.chunk_id <> d.chunk_id OR f.source_id <> c.source_id THEN 'unconfirmed_fact_source'
WHEN NOT EXISTS (SELECT 1 FROM citations k WHERE k.fact_id = d.fact_id AND k.chunk_id = d.chunk_id) THEN 'unconfirmed_plan_reference'
WHEN d.value_num IS NOT NULL AND (f.value_type <> 'number' OR f.value_num <> d.value_num) THEN 'fact_value_mismatch' WHEN d.value_num IS NULL AND (f.value_type = 'number' OR f.value_str IS DISTINCT FROM d.value_str) THEN 'fact_value_mismatch' END AS error
FROM data d LEFT JOIN facts f ON f.fact_id = d.fact_id LEFT JOIN chunks c ON c.chunk_id = d.chunk_id""", data=_DATA, citations=_CITATIONS))
def visual_datum_checks(spark, sf):
    return evidence.datum_errors(run(spark, sf, _DATA), frame(spark, sf, "facts"), frame(spark, sf, "chunks"), run(spark, sf, _CITATIONS))


@query("slide_ref_union", """WITH r AS (SELECT o_custkey AS slide_id, o_orderkey AS ord, CAST(o_orderkey % 5 AS VARCHAR) AS a, CAST(o_orderkey % 3 AS VARCHAR) AS b FROM orders),
f AS (SELECT slide_id, id, min(ord * 2 + k) AS first FROM (SELECT slide_id, ord, a AS id, 0 AS k FROM r UNION ALL SELECT slide_id, ord, b, 1 FROM r) GROUP BY slide_id, id)
SELECT slide_id, string_agg(id, ',' ORDER BY first) AS refs FROM f GROUP BY slide_id""")
def slide_ref_union(spark, sf):
    rows = frame(spark, sf, "orders").select(F.col("o_custkey").alias("slide_id"), F.col("o_orderkey").alias("ord"), F.array((F.col("o_orderkey") % 5).cast("string"), (F.col("o_orderkey") % 3).cast("string")).alias("ids"))
    return evidence.ordered_union(rows, "slide_id", "ord", "ids", "refs").withColumn("refs", F.array_join("refs", ","))


@query("source_links", twin("SELECT source_id, 'chunk' AS kind, chunk_id AS id FROM chunks UNION SELECT source_id, 'fact', fact_id FROM facts"))
def source_links(spark, sf):
    return evidence.source_links(frame(spark, sf, "chunks"), frame(spark, sf, "facts"))


@query("evidence_catalogue", twin("SELECT source_id, chunk_id, text, locator, precision, merged_range FROM chunks"))
def evidence_catalogue(spark, sf):
    return frame(spark, sf, "chunks").select("source_id", "chunk_id", "text", "locator", "precision", "merged_range")


@query("critic_reuse", """WITH b AS (SELECT DISTINCT l_suppkey AS deck, l_orderkey AS slide_no, l_partkey AS claim_id FROM lineitem), f AS (SELECT *, min(slide_no) OVER (PARTITION BY deck, claim_id) AS first_slide FROM b) SELECT * FROM f WHERE slide_no > first_slide""")
def critic_reuse(spark, sf):
    return evidence.reused_claims(frame(spark, sf, "lineitem").select(F.col("l_suppkey").alias("deck"), F.col("l_orderkey").alias("slide_no"), F.col("l_partkey").alias("claim_id")))


@query("critic_unbound", "SELECT c_custkey AS slide_id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey + o_custkey % 2 = c_custkey)")
def critic_unbound(spark, sf):
    bound = frame(spark, sf, "orders").select((F.col("o_custkey") + F.col("o_custkey") % 2).alias("slide_id"))
    return evidence.dangling(frame(spark, sf, "customer").select(F.col("c_custkey").alias("slide_id")), bound, "slide_id")
