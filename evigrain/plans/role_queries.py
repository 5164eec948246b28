"""Queries over what the roles of a run give."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigrain.operators import roles
from evigrain.plans.registered import registry
from evigrain.plans.standins import frame, run

QUERIES, ORACLE_SQL, query = registry()

_LAYOUTS = "SELECT o_custkey AS run, o_orderkey AS ord, concat('layout-', CAST(o_orderkey AS VARCHAR(20))) AS layout_id, CASE o_orderkey % 3 WHEN 0 THEN 'title' WHEN 1 THEN 'cards' ELSE 'text' END AS composition, o_orderkey % 12 AS text_slots, o_orderkey % 3 AS visual_slots, o_orderkey % 7 AS card_count FROM orders"
_CHUNKS = "SELECT o_custkey AS run, o_orderkey AS ord, concat('c', CAST(o_orderkey AS VARCHAR(20))) AS chunk_id, o_orderkey % 4 AS source_id, concat(CASE WHEN o_orderkey % 5 = 0 THEN repeat('long text ', 40) ELSE 'Order ' END, CAST(o_orderkey AS VARCHAR(20))) AS excerpt, CASE WHEN o_orderkey % 2 = 0 THEN 'exact' ELSE 'document' END AS precision FROM orders"
_SOURCES = "SELECT DISTINCT o_custkey AS run, o_orderkey % 4 AS source_id FROM orders WHERE o_orderkey % 4 < 3"
_RUNS = "SELECT c_custkey AS run, CASE WHEN c_custkey % 4 = 0 THEN ' ' ELSE concat(chr(10), ' ', c_name, ' ', chr(10), 'more') END AS brief, c_custkey % 11 + 5 AS slide_count FROM customer"

_TWIN_CLAIMS = f"""claims AS (SELECT n.run, n.spot, concat('claim-', n.spot + 1) AS claim_id, CASE WHEN length(excerpt) > 280 THEN concat(rtrim(excerpt[1:279]), '…') ELSE excerpt END AS text, CASE WHEN n.spot < 3 THEN 3 ELSE 2 END AS priority, precision, chunk_id, source_id FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY ord) - 1 AS spot FROM ({_CHUNKS})) n WHERE n.spot < 40)"""
_TWIN_SLIDES = f"""slides AS (SELECT r.run, s AS slide, concat('slide-', s + 1) AS slide_id, ['title', 'problem', 'context', 'opportunity', 'solution', 'workflow', 'advantages', 'implementation', 'metrics', 'next_steps', 'summary'][s % 11 + 1] AS purpose, c.claim_id, coalesce(c.text, 'Сформулировать следующий проверяемый вывод для аудитории.') AS message,
['none', 'cards', 'diagram', 'image', 'cards', 'timeline', 'cards', 'timeline', 'metrics', 'none', 'cards'][s % 11 + 1] AS visual_intent, CASE WHEN s = 0 THEN CASE WHEN trim(brief) = '' THEN 'Новая презентация' ELSE trim(string_split(brief, chr(10))[2]) END END AS first_title, r.slide_count
FROM ({_RUNS}) r, unnest(range(0, r.slide_count)) AS t(s) LEFT JOIN (SELECT run, count(*) AS n FROM claims GROUP BY run) k ON k.run = r.run LEFT JOIN claims c ON c.run = r.run AND c.spot = s % greatest(coalesce(k.n, 0), 1))"""
_TWIN_FAMILIES = f"""families AS (SELECT run, spot, layout_id, composition AS purpose, round(greatest(0.5::DOUBLE, 0.96::DOUBLE - spot * 0.03::DOUBLE), 2) AS confidence, concat_ws(',', CASE WHEN text_slots > 8 THEN 'high_density' END, CASE WHEN visual_slots = 0 THEN 'sparse_visuals' END) AS risk_codes FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY ord) - 1 AS spot FROM ({_LAYOUTS})) WHERE spot < 20)"""
_TWIN_VARIANT = """variant AS (SELECT s.run, s.slide, s.slide_id, f.layout_id, s.claim_id, CASE WHEN visual_intent <> 'none' THEN 'title,body,visual' ELSE 'title,body' END AS roles FROM slides s JOIN (SELECT run, count(*) AS n FROM families GROUP BY run) k ON k.run = s.run JOIN families f ON f.run = s.run AND f.spot = s.slide % k.n)"""


def _claims(spark, sf):
    facts = F.array(*[F.concat(F.lit(f"f{i}-"), F.col("source_id").cast("string")) for i in range(3)])
    return roles.evidence_claims(run(spark, sf, _CHUNKS), run(spark, sf, _SOURCES).withColumn("fact_ids", facts))


def _slides(spark, sf):
    return roles.narrative(run(spark, sf, _RUNS), _claims(spark, sf))


def _variant(spark, sf, variant: str):
    return roles.variant_slides(roles.visual_specs(_slides(spark, sf)), roles.layout_families(run(spark, sf, _LAYOUTS)), variant)


@query("role_layouts", f"WITH {_TWIN_FAMILIES} SELECT * FROM families")
def role_layouts(spark, sf):
    return roles.layout_families(run(spark, sf, _LAYOUTS)).withColumn("risk_codes", F.array_join("risk_codes", ","))


@query("role_guidance", f"SELECT run, CASE WHEN max(text_slots) > 8 THEN 'compact' ELSE 'balanced' END AS density, CASE WHEN max(card_count) > 4 THEN 'tight' ELSE 'regular' END AS spacing, min(visual_slots) = 0 AS text_only FROM ({_LAYOUTS}) GROUP BY run")
def role_guidance(spark, sf):
    return roles.template_guidance(run(spark, sf, _LAYOUTS))


@query("role_claims", f"WITH {_TWIN_CLAIMS} SELECT run, spot, claim_id, text, priority, precision, chunk_id AS chunk_ids, CASE WHEN source_id < 3 THEN concat('f0-', source_id, ',f1-', source_id) ELSE '' END AS fact_ids FROM claims")
def role_claims(spark, sf):
    return _claims(spark, sf).withColumns({c: F.array_join(c, ",") for c in ("chunk_ids", "fact_ids")})


@query("role_narrative", f"WITH {_TWIN_CLAIMS}, {_TWIN_SLIDES} SELECT run, slide, slide_id, purpose, coalesce(first_title, concat(purpose, ' — вариант 1')) AS title, message, claim_id, visual_intent, CASE WHEN slide + 1 < slide_count THEN concat('К следующему слайду ', slide + 2) ELSE 'Завершить deck проверяемым следующим шагом' END AS next_transition FROM slides")
def role_narrative(spark, sf):
    return _slides(spark, sf)


@query("role_visuals", f"WITH {_TWIN_CLAIMS}, {_TWIN_SLIDES} SELECT run, slide, slide_id, claim_id, CASE visual_intent WHEN 'metrics' THEN 'chart' ELSE visual_intent END AS visual_type, CASE visual_intent WHEN 'image' THEN 'cards' ELSE 'text' END AS fallback FROM slides")
def role_visuals(spark, sf):
    return roles.visual_specs(_slides(spark, sf))


@query("role_variant", f"WITH {_TWIN_CLAIMS}, {_TWIN_SLIDES}, {_TWIN_FAMILIES}, {_TWIN_VARIANT} SELECT run, 'visual' AS variant, slide, slide_id, layout_id, claim_id, roles, 'expanded' AS content_mode, 'airy' AS density, 'high' AS visual_ratio, 'low' AS data_emphasis FROM variant")
def role_variant(spark, sf):
    return _variant(spark, sf, "visual").withColumn("roles", F.array_join("roles", ","))


@query("role_findings", f"""WITH {_TWIN_CLAIMS}, {_TWIN_SLIDES}, {_TWIN_FAMILIES}, {_TWIN_VARIANT}, bound AS (SELECT run, slide, slide_id, CASE WHEN slide = 3 THEN 'claim-99' WHEN slide = 4 THEN NULL ELSE claim_id END AS claim_id FROM variant), j AS (SELECT b.*, first_value(slide_id) OVER (PARTITION BY run, claim_id ORDER BY slide) AS first FROM bound b)
SELECT run, 'compact' AS variant, slide_id, CASE WHEN claim_id = 'claim-99' THEN 'unknown_claim' WHEN claim_id IS NULL THEN concat('advisory-unbound-', slide + 1) ELSE concat('advisory-repeated-', slide + 1, '-1') END AS finding_id, CASE WHEN claim_id = 'claim-99' THEN 'error' WHEN claim_id IS NULL THEN 'warning' ELSE 'info' END AS severity,
CASE WHEN claim_id = 'claim-99' THEN concat('Unknown evidence claim ID claim-99 on slide ', slide_id) WHEN claim_id IS NULL THEN 'No evidence claim is bound to this slide' ELSE concat('Evidence claim ', claim_id, ' is also bound to slide ', first) END AS message FROM j WHERE claim_id IS NULL OR claim_id = 'claim-99' OR first <> slide_id""")
def role_findings(spark, sf):
    """A variant in which the fourth slide names an unknown claim and the fifth none."""
    slide = F.col("slide")
    slides = _variant(spark, sf, "compact").withColumn("claim_id", F.when(slide == 3, "claim-99").when(slide != 4, F.col("claim_id")))
    return roles.semantic_findings(slides, _claims(spark, sf))


@query("role_repairs", f"SELECT DISTINCT run, 'balanced' AS variant, 1 AS round, 'no_repair' AS status FROM ({_LAYOUTS})")
def role_repairs(spark, sf):
    return roles.repair_plans(_variant(spark, sf, "balanced"))
