"""Queries over design tokens, layouts, document variants, page sets and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigrain.operators import compare, tokens
from evigrain.plans.registered import registry
from evigrain.plans.standins import frame, run, twin

QUERIES, ORACLE_SQL, query = registry()

_EVIDENCE = "SELECT p_size AS value, CAST(p_partkey % 7 AS DOUBLE) / 10 AS confidence, p_partkey AS ord, concat('layout', CAST(p_partkey % 9 AS VARCHAR(20))) AS source FROM part"


@query("evidence_consolidation", twin("""WITH s AS (SELECT value, source, min(ord) AS first FROM evidence GROUP BY value, source)
SELECT e.value, max(e.confidence) AS confidence, any_value(u.sources) AS sources, min(e.ord) AS first_ord FROM evidence e JOIN (SELECT value, string_agg(source, ',' ORDER BY first) AS sources FROM s GROUP BY value) u ON u.value = e.value GROUP BY e.value""", evidence=_EVIDENCE))
def evidence_consolidation(spark, sf):
    found = tokens.consolidated(run(spark, sf, _EVIDENCE).withColumn("sources", F.array("source")))
    return found.withColumn("sources", F.array_join("sources", ","))


@query("evidence_sorted", twin("SELECT value, max(confidence) AS confidence, min(ord) AS first_ord FROM evidence GROUP BY value ORDER BY value", evidence=_EVIDENCE))
def evidence_sorted(spark, sf):
    return tokens.sorted_evidence(tokens.consolidated(run(spark, sf, _EVIDENCE).withColumn("sources", F.array("source")))).drop("sources")


_ROUND = "CAST(floor({0} + 0.5) AS BIGINT)"


def _r(x: str) -> str:
    return _ROUND.format(x)


_SIGNATURE = "concat_ws(':', type, " + ", ".join(_r(f"{c} / 40") for c in "xywh") + ", coalesce(fill, ''))"
_COARSE = "SELECT slide_id, slide_no, ord, type, floor(x / 200) * 200 AS x, floor(y / 200) * 200 AS y, floor(w / 200) * 200 AS w, floor(h / 200) * 200 AS h, CASE ord % 2 WHEN 0 THEN '#112233' END AS fill FROM elements"


@query("recurring_elements", twin(f"""SELECT {_SIGNATURE} AS signature, count(*) AS n, concat(arg_max(type, slide_no * 50 + ord), ' at ', {_r("arg_max(x, slide_no * 50 + ord)")}, ',', {_r("arg_max(y, slide_no * 50 + ord)")}) AS description FROM coarse GROUP BY signature HAVING count(*) >= 2""", coarse=_COARSE))
def recurring_elements(spark, sf):
    return tokens.recurring(run(spark, sf, _COARSE), most=None)


_PANELS = "SELECT slide_id, CASE WHEN type = 'image' THEN 'line' ELSE type END AS type, x, y, CAST(80 + (ord % 4) * 20 AS DOUBLE) AS w, CAST(50 + (ord % 3) * 20 AS DOUBLE) AS h, CASE WHEN ord % 2 = 0 THEN '#112233' END AS fill FROM elements"
_CARDS = f"SELECT slide_id, max(n) AS card_count FROM (SELECT slide_id, CASE WHEN type = 'shape' AND w > 100 AND h > 60 THEN concat({_r('w / 20')}, ':', {_r('h / 20')}, ':', coalesce(fill, 'none')) END AS s, count(CASE WHEN type = 'shape' AND w > 100 AND h > 60 THEN 1 END) AS n FROM panels GROUP BY slide_id, s) GROUP BY slide_id"


@query("card_count", twin(_CARDS, panels=_PANELS))
def card_count(spark, sf):
    return tokens.card_counts(run(spark, sf, _PANELS))


@query("slot_metrics", twin(f"""SELECT m.slide_id, text_slots, placeholders, visual_slots, CASE WHEN card_count >= 3 THEN 'cards' WHEN lines >= 2 THEN 'timeline' WHEN visual_slots > 0 AND text_slots <= 3 THEN 'visual' WHEN text_slots <= 1 THEN 'title' WHEN left_text AND right_text THEN 'split' ELSE 'text' END AS composition FROM (
SELECT slide_id, count(*) FILTER (WHERE type IN ('text', 'placeholder')) AS text_slots, count(*) FILTER (WHERE type = 'placeholder') AS placeholders, count(*) FILTER (WHERE type IN ('image', 'chart', 'table')) AS visual_slots, count(*) FILTER (WHERE type = 'line') AS lines,
bool_or(type IN ('text', 'placeholder') AND x < 120) AS left_text, bool_or(type IN ('text', 'placeholder') AND x > 360) AS right_text FROM panels GROUP BY slide_id) m JOIN ({_CARDS}) c ON c.slide_id = m.slide_id""", panels=_PANELS))
def slot_metrics(spark, sf):
    return tokens.compositions(run(spark, sf, _PANELS)).select("slide_id", "text_slots", "placeholders", "visual_slots", "composition")


@query("visual_patterns", twin("""SELECT unnest(['Dedicated visual area', 'Colored slide backgrounds']) AS pattern WHERE EXISTS (SELECT 1 FROM elements WHERE type = 'image')"""))
def visual_patterns(spark, sf):
    layouts = tokens.slot_metrics(frame(spark, sf, "elements")).select(F.lit("text").alias("composition"), F.lit(0).alias("card_count"), "visual_slots", F.lit("#112233").alias("background"))
    return tokens.visual_patterns(layouts)


@query("spacing_gaps", twin(f"""SELECT floor(b.x - a.x - a.w + 0.5) AS gap, count(*) AS n FROM elements a JOIN elements b ON a.slide_id = b.slide_id AND a.ord <> b.ord WHERE abs(a.y - b.y) < least(a.h, b.h) * 0.45::DOUBLE AND b.x - a.x - a.w BETWEEN 0 AND 480 GROUP BY gap"""))
def spacing_gaps(spark, sf):
    return tokens.gaps(frame(spark, sf, "elements"))


_SCORES = "SELECT s_suppkey AS layout_id, CASE WHEN s_suppkey % 4 <> 0 THEN CAST(s_suppkey % 10 AS DOUBLE) / 10 END AS element_score, CASE WHEN s_suppkey % 3 <> 0 THEN CAST(s_suppkey % 5 AS DOUBLE) / 4 END AS background_score, s_suppkey % 9 AS warnings, s_suppkey % 2 = 0 AS broken_relationship FROM supplier"


@query("layout_confidence", twin("SELECT layout_id, floor(greatest(0, least(1, 0.15::DOUBLE + 0.6::DOUBLE * coalesce(element_score, 0.15::DOUBLE) + 0.25::DOUBLE * coalesce(background_score, 0.15::DOUBLE) - least(0.55::DOUBLE, warnings * 0.08::DOUBLE + CASE WHEN broken_relationship THEN 0.2::DOUBLE ELSE 0 END))) * 1000 + 0.5) / 1000 AS confidence FROM scores", scores=_SCORES))
def layout_confidence(spark, sf):
    return tokens.layout_confidence(run(spark, sf, _SCORES)).select("layout_id", "confidence")


@query("layout_dedupe", twin(f"""WITH s AS (SELECT slide_no, string_agg(concat(type, '-', {_r("x / 20")}, '-', {_r("w / 20")}), '|' ORDER BY ord) AS signature FROM folded GROUP BY slide_no) SELECT min(slide_no) AS slide_no FROM s GROUP BY signature""",
       folded="SELECT slide_no, ord, type, CAST((slide_no % 5) * 40 + ord AS DOUBLE) AS x, CAST(100 AS DOUBLE) AS w FROM elements"))
def layout_dedupe(spark, sf):
    rows = run(spark, sf, "SELECT slide_no, ord, type, CAST((slide_no % 5) * 40 + ord AS DOUBLE) AS x, CAST(100 AS DOUBLE) AS w FROM elements")
    one = F.concat_ws("-", "type", F.floor(F.col("x") / 20 + 0.5).cast("string"), F.floor(F.col("w") / 20 + 0.5).cast("string"))
    signed = rows.groupBy("slide_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", one.alias("s")))), lambda r: r["s"]), "|").alias("signature"))
    return tokens.first_of_each(signed, ["signature"], "slide_no").select("slide_no")


@query("unique_relationships", "SELECT l_suppkey, l_returnflag, l_linestatus, min(l_orderkey * 10 + l_linenumber) AS first FROM lineitem GROUP BY ALL")
def unique_relationships(spark, sf):
    rows = frame(spark, sf, "lineitem").withColumn("first", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return rows.groupBy("l_suppkey", "l_returnflag", "l_linestatus").agg(F.min("first").alias("first"))


_MASTERS = "SELECT r_regionkey AS master_id, CASE WHEN r_regionkey % 2 = 0 THEN '#101010' END AS background, CAST(0.9 AS DOUBLE) AS confidence FROM region"
_LAYOUTS = "SELECT n_nationkey AS layout_id, n_regionkey AS master_id, CASE WHEN n_nationkey % 3 = 0 THEN '#202020' END AS background, CAST(0.8 AS DOUBLE) AS confidence FROM nation"
_SLIDES = "SELECT c_custkey AS slide_id, CASE WHEN c_custkey % 7 = 0 THEN -1 ELSE c_nationkey END AS layout_id, CASE WHEN c_custkey % 5 = 0 THEN '#303030' END AS background, CAST(0.95 AS DOUBLE) AS confidence FROM customer"


@query("background_chain", twin("""WITH l AS (SELECT layout_id, coalesce(l.background, m.background, '#FFFFFF') AS background, CASE WHEN l.background IS NOT NULL THEN l.confidence WHEN m.background IS NOT NULL THEN m.confidence * 0.9::DOUBLE ELSE 0.15::DOUBLE END AS confidence FROM layouts l LEFT JOIN masters m ON m.master_id = l.master_id)
SELECT s.slide_id, coalesce(s.background, l.background, '#FFFFFF') AS background, CASE WHEN s.background IS NOT NULL THEN s.confidence WHEN l.background IS NOT NULL THEN l.confidence * 0.9::DOUBLE ELSE 0.15::DOUBLE END AS confidence FROM slides s LEFT JOIN l ON l.layout_id = s.layout_id""", masters=_MASTERS, layouts=_LAYOUTS, slides=_SLIDES))
def background_chain(spark, sf):
    return tokens.background_chain(run(spark, sf, _SLIDES), run(spark, sf, _LAYOUTS), run(spark, sf, _MASTERS))


_WARNINGS = "SELECT event_id, CASE event_id % 3 WHEN 0 THEN concat('Unresolved part; sourceFile=ppt/layout', CAST(event_id % 30 AS VARCHAR(20)), '.xml') WHEN 1 THEN concat('Fallback used for ppt/layout', CAST(event_id % 30 AS VARCHAR(20)), '.xml; none') ELSE concat('Large XML part: ppt/layout', CAST(event_id % 30 AS VARCHAR(20)), '.xml') END AS warning FROM events"
_SOURCES = "SELECT n_nationkey AS layout_id, concat('ppt/layout', CAST(n_nationkey AS VARCHAR(20)), '.xml') AS source_file FROM nation"


@query("warning_layouts", twin("SELECT event_id, event_id % 30 AS layout_id FROM warnings JOIN sources ON layout_id = event_id % 30", warnings=_WARNINGS, sources=_SOURCES))
def warning_layouts(spark, sf):
    return tokens.warning_layouts(run(spark, sf, _WARNINGS), run(spark, sf, _SOURCES)).select("event_id", F.col("layout_id").cast("long").alias("layout_id"))


def _quantized(c: str, step: int = 8) -> str:
    return f"CAST(floor({c} / {step} + 0.5) * {step} AS BIGINT)"


_FP = "concat_ws(';', type, " + ", ".join(_quantized(c) for c in "xywh") + ", z, CASE type WHEN 'text' THEN concat_ws('|', " + _quantized("font_size") + ", font_weight) WHEN 'shape' THEN concat_ws('|', shape, fill, stroke, " + _quantized("radius") + ") ELSE '' END)"
_VARIED = """SELECT 'compact' AS variant, slide_no, ord, type, x, y, w, h, z, font_size, font_weight, shape, fill, stroke, radius FROM elements
UNION ALL SELECT 'balanced', slide_no, ord, type, x + CASE WHEN slide_no % 3 = 1 AND ord % 4 = 0 THEN 40 ELSE 0 END, y, w, h, z, font_size, font_weight, shape, fill, stroke, radius FROM elements
UNION ALL SELECT 'visual', CASE WHEN slide_no % 11 = 3 THEN slide_no + 1000000 ELSE slide_no END, ord, type, x, y, w + CASE WHEN ord % 9 = 0 THEN 80 ELSE 0 END, h, z, font_size, font_weight, shape, fill, stroke, radius FROM elements"""


@query("fingerprints", twin(f"SELECT variant, slide_no, sha256(string_agg(fp, chr(10) ORDER BY fp)) AS digest, count(*) AS elements FROM (SELECT variant, slide_no, {_FP} AS fp FROM varied) GROUP BY variant, slide_no", varied=_VARIED))
def fingerprints(spark, sf):
    return compare.slide_digests(compare.fingerprints(run(spark, sf, _VARIED)), ["variant", "slide_no"])


_DIFF = f"""SELECT slide_no, sum(greatest(l - r, 0))::BIGINT AS left_only, sum(greatest(r - l, 0))::BIGINT AS right_only, sum(l + r)::BIGINT AS total FROM (
SELECT slide_no, fp, count(*) FILTER (WHERE variant = 'compact') AS l, count(*) FILTER (WHERE variant = 'balanced') AS r FROM (SELECT variant, slide_no, {_FP} AS fp FROM varied WHERE variant <> 'visual') GROUP BY slide_no, fp) GROUP BY slide_no"""


@query("multiset_diff", twin(f"SELECT *, (left_only + right_only) / total AS ratio FROM ({_DIFF})", varied=_VARIED))
def multiset_diff(spark, sf):
    marked = compare.fingerprints(run(spark, sf, _VARIED))
    return compare.multiset_diff(marked.filter("variant = 'compact'"), marked.filter("variant = 'balanced'"), ["slide_no"])


_PAIRS = f"""SELECT a AS left_variant, b AS right_variant, slide_no, sum(greatest(l - r, 0))::BIGINT AS left_only, sum(greatest(r - l, 0))::BIGINT AS right_only, sum(l + r)::BIGINT AS total FROM (
SELECT a, b, slide_no, fp, count(*) FILTER (WHERE variant = a) AS l, count(*) FILTER (WHERE variant = b) AS r FROM (SELECT variant, slide_no, {_FP} AS fp FROM varied), (VALUES ('compact', 'balanced'), ('compact', 'visual'), ('balanced', 'visual')) AS p(a, b) WHERE variant IN (a, b) GROUP BY a, b, slide_no, fp) GROUP BY a, b, slide_no"""


@query("variant_pairs", twin(f"SELECT *, (left_only + right_only) / total AS ratio FROM ({_PAIRS})", varied=_VARIED))
def variant_pairs(spark, sf):
    return compare.variant_pairs(compare.fingerprints(run(spark, sf, _VARIED)))


@query("distinctness_gates", twin(f"""SELECT left_variant, right_variant, count(*) AS slides, count(*) FILTER (WHERE left_only + right_only > 0) AS different_slides, sum(left_only)::BIGINT AS left_only, sum(right_only)::BIGINT AS right_only, sum(total)::BIGINT AS total,
count(*) FILTER (WHERE left_only + right_only > 0) / count(*) AS slide_ratio, (sum(left_only) + sum(right_only)) / sum(total) AS element_ratio, count(*) FILTER (WHERE slide_no <> 0 AND left_only + right_only > 0) AS differing_slides,
CASE WHEN count(*) FILTER (WHERE left_only + right_only > 0) = 0 THEN 'identical' WHEN count(*) FILTER (WHERE slide_no <> 0 AND left_only + right_only > 0) = 0 THEN 'only title differs' ELSE 'distinct' END AS verdict FROM ({_PAIRS}) GROUP BY left_variant, right_variant""", varied=_VARIED))
def distinctness_gates(spark, sf):
    return compare.gates(compare.variant_pairs(compare.fingerprints(run(spark, sf, _VARIED))))


@query("vector_diff", """WITH p AS (SELECT a.vec_id, a.embedding AS l, b.embedding AS r FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
d AS (SELECT vec_id, list_transform(range(1, len(l) + 1), lambda i: abs(l[i]::DOUBLE - r[i]::DOUBLE)) AS d FROM p)
SELECT vec_id, len(list_filter(d, lambda x: x > 0))::INTEGER AS differing, list_max(d) AS largest, round(list_sum(d), 6) AS total, round(list_sum(d) / len(d), 6) AS mean_abs FROM d""")
def vector_diff(spark, sf):
    vectors = frame(spark, sf, "embeddings")
    left = vectors.select("vec_id", F.col("embedding").alias("l"))
    right = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("r"))
    return compare.vector_diff(left.join(right, "vec_id"), "l", "r").select("vec_id", "differing", "largest", F.round("total", 6).alias("total"), F.round("mean_abs", 6).alias("mean_abs"))


_EXPECTED = "SELECT c_nationkey AS fixture, c_custkey AS page, 1000 + c_custkey AS bytes, md5(c_name) AS sha, 1280 AS w, 720 AS h FROM customer"
_CURRENT = "SELECT c_nationkey AS fixture, CASE WHEN c_custkey % 33 = 1 THEN -c_custkey ELSE c_custkey END AS page, 1000 + c_custkey + CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END AS bytes, md5(CASE WHEN c_custkey % 15 = 0 THEN 'x' ELSE c_name END) AS sha, 1280 AS w, CASE WHEN c_custkey % 21 = 0 THEN 721 ELSE 720 END AS h FROM customer"


@query("page_set_compare", twin("SELECT e.fixture, e.page, CASE WHEN c.sha IS NULL THEN 'missing' ELSE nullif(concat_ws(',', CASE WHEN e.bytes <> c.bytes THEN 'byte-size' END, CASE WHEN e.sha <> c.sha THEN 'sha256' END, CASE WHEN e.w <> c.w THEN 'width' END, CASE WHEN e.h <> c.h THEN 'height' END), '') END AS mismatch FROM expected e LEFT JOIN now c ON c.fixture = e.fixture AND c.page = e.page", expected=_EXPECTED, now=_CURRENT))
def page_set_compare(spark, sf):
    return compare.page_sets(run(spark, sf, _EXPECTED), run(spark, sf, _CURRENT))


@query("page_set_digest", twin("""SELECT fixture, count(*) AS pages, sha256(concat('[', string_agg(concat('[', page, ',', bytes, ',"', sha, '",', w, ',', h, ']'), ',' ORDER BY page), ']')) AS digest FROM expected GROUP BY fixture""", expected=_EXPECTED))
def page_set_digest(spark, sf):
    return compare.page_set_digest(run(spark, sf, _EXPECTED))


_BOXES = "SELECT p_partkey AS text_id, CAST(p_size * 3 AS DOUBLE) AS x, CAST(p_size * 2 AS DOUBLE) AS y, CAST(100 + p_size AS DOUBLE) AS w, CAST(20 + p_size AS DOUBLE) AS h FROM part"
_EXPORTED = "SELECT CASE WHEN p_partkey % 19 = 0 THEN -p_partkey ELSE p_partkey END AS text_id, CAST(p_size * 3 + p_partkey % 3 AS DOUBLE) AS x, CAST(p_size * 2 AS DOUBLE) AS y, CAST(100 + p_size - p_partkey % 5 AS DOUBLE) AS w, CAST(20 + p_size AS DOUBLE) AS h FROM part"


@query("text_parity", twin("SELECT b.text_id, CASE WHEN e.text_id IS NULL THEN 'missing' ELSE nullif(concat_ws(',', CASE WHEN abs(b.x - e.x) > 1 THEN 'x' END, CASE WHEN abs(b.y - e.y) > 1 THEN 'y' END, CASE WHEN abs(b.w - e.w) > 3 THEN 'w' END, CASE WHEN abs(b.h - e.h) > 1 THEN 'h' END), '') END AS finding FROM boxes b LEFT JOIN exported e ON e.text_id = b.text_id", boxes=_BOXES, exported=_EXPORTED))
def text_parity(spark, sf):
    return compare.text_parity(run(spark, sf, _BOXES), run(spark, sf, _EXPORTED), {"x": 1, "y": 1, "w": 3, "h": 1})
