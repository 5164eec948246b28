"""Queries over deck packages: relationships, groups, surfaces, placement, plans, publication, images."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigrain.functions import cells, ids
from evigrain.functions.text import resolved_font
from evigrain.operators import decks, placing
from evigrain.plans import skills
from evigrain.plans.registered import registry
from evigrain.plans.standins import frame, run, twin
from evigrain.runtime import spread
from evigrain.sources import images, template

QUERIES, ORACLE_SQL, query = registry()


@query("upload_records", r"""SELECT page_id, concat('source-', substr(sha256(encode(concat('p', page_id, '.html')) || '\x00'::BLOB || encode(html)), 1, 24)) AS source_id, sha256(html) AS sha256, strlen(html) AS byte_size, 'application/octet-stream' AS mime FROM pages""")
def upload_records(spark, sf):
    name = F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".html"))
    return frame(spark, sf, "pages").select("page_id", ids.source_id(name, F.col("html")).alias("source_id"), F.sha2("html", 256).alias("sha256"), F.octet_length("html").cast("long").alias("byte_size"), cells.media_type(name).alias("mime"))


@query("slot_surfaces", twin("""SELECT t.slide_id, t.ord, arg_min(s.fill, s.w * s.h * 1000000 - s.z * 100 + s.ord / 100.0) AS surface FROM elements t JOIN elements s ON s.slide_id = t.slide_id AND t.type = 'text' AND s.type = 'shape' AND t.x >= s.x AND t.y >= s.y AND t.x + t.w <= s.x + s.w AND t.y + t.h <= s.y + s.h GROUP BY t.slide_id, t.ord"""))
def slot_surfaces(spark, sf):
    return decks.surfaces(frame(spark, sf, "elements"))


_RENDERED = "SELECT o_custkey AS deck, o_orderkey % 7 AS slide_no, o_custkey * 10 AS bytes, md5(o_orderstatus) AS sha FROM orders"
_DECLARED = "SELECT c_custkey AS deck, s AS slide_no, c_custkey * 10 + CASE WHEN c_custkey % 6 = 0 THEN 1 ELSE 0 END AS bytes, md5('O') AS sha FROM declared_rows"
_DECLARED_ROWS = "SELECT c_custkey, 0 AS s FROM customer UNION ALL SELECT c_custkey, 2 FROM customer UNION ALL SELECT c_custkey, 4 FROM customer UNION ALL SELECT c_custkey, 5 FROM customer"


@query("page_metadata", twin("""SELECT r.deck, r.slide_no, CASE WHEN count(*) OVER (PARTITION BY r.deck, r.slide_no) > 1 THEN 'duplicate_slide' WHEN d.sha IS NULL THEN 'undeclared' WHEN d.bytes <> r.bytes OR d.sha <> r.sha THEN 'metadata_mismatch' END AS error FROM rendered r LEFT JOIN declared d ON d.deck = r.deck AND d.slide_no = r.slide_no""", rendered=_RENDERED, declared=_DECLARED, declared_rows=_DECLARED_ROWS))
def page_metadata(spark, sf):
    rows = run(spark, sf, _DECLARED_ROWS)
    declared = rows.select(F.col("c_custkey").alias("deck"), F.col("s").alias("slide_no"), (F.col("c_custkey") * 10 + (F.col("c_custkey") % 6 == 0).cast("int")).alias("bytes"), F.md5(F.lit("O")).alias("sha"))
    return decks.page_errors(run(spark, sf, _RENDERED), declared)


_RELATIONS = """SELECT p_partkey, 'ppt/slides/slide1.xml' AS source_file, CASE p_partkey % 6 WHEN 0 THEN concat('../media/image', CAST(p_partkey % 50 AS VARCHAR(20)), '.png') WHEN 1 THEN 'https://example.org/x' WHEN 2 THEN '../../../up.xml' WHEN 3 THEN './note.xml' WHEN 4 THEN '../theme/./theme1.xml' ELSE 'sub//deep.xml' END AS target FROM part"""
_PACKAGE = "SELECT concat('ppt/media/image', CAST(n_nationkey AS VARCHAR(20)), '.png') AS path FROM nation UNION ALL SELECT 'ppt/theme/theme1.xml' FROM region"


@query("relationship_targets", """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN concat('ppt/media/image', p_partkey % 50, '.png') WHEN 3 THEN 'ppt/slides/note.xml' WHEN 4 THEN 'ppt/theme/theme1.xml' WHEN 5 THEN 'ppt/slides/sub/deep.xml' END AS path,
CASE p_partkey % 6 WHEN 0 THEN CASE WHEN p_partkey % 50 < 25 THEN 'resolved' ELSE 'missing' END WHEN 3 THEN 'missing' WHEN 4 THEN 'resolved' WHEN 5 THEN 'missing' ELSE 'external' END AS state FROM part""")
def relationship_targets(spark, sf):
    return decks.relationship_states(run(spark, sf, _RELATIONS), run(spark, sf, _PACKAGE)).select("p_partkey", "path", "state")


@query("group_transforms", twin("SELECT slide_id, ord, 2.0::DOUBLE * (1 + ord % 3) AS sx, 0.5::DOUBLE * (1 + ord % 4) AS sy, 2.0::DOUBLE * w + x AS tx, 0.5::DOUBLE * h + y AS ty FROM elements"))
def group_transforms(spark, sf):
    one = lambda sx, sy, tx, ty: F.struct(sx.cast("double").alias("sx"), sy.cast("double").alias("sy"), tx.alias("tx"), ty.alias("ty"))
    c = F.col
    path = F.array(one(F.lit(2.0), F.lit(0.5), c("x"), c("y")), one(1 + c("ord") % 3, 1 + c("ord") % 4, c("w"), c("h")))
    return frame(spark, sf, "elements").select("slide_id", "ord", decks.composed(path).alias("t")).select("slide_id", "ord", "t.*")


_LINKED = "SELECT concat(a.slide_id, '-', CAST(a.ord AS VARCHAR(20))) AS edge_id, a.x AS a_x, a.y AS a_y, a.w AS a_w, a.h AS a_h, CASE WHEN a.ord % 3 = 0 THEN a.x ELSE b.x END AS b_x, b.y AS b_y, CASE WHEN a.ord % 3 = 0 THEN a.w ELSE b.w END AS b_w, b.h AS b_h FROM elements a JOIN elements b ON b.slide_id = a.slide_id AND b.ord = a.ord + 1"


@query("edge_routes", twin("""WITH c AS (SELECT edge_id, a_x + a_w / 2 AS fx, a_y + a_h / 2 AS fy, b_x + b_w / 2 AS tx, b_y + b_h / 2 AS ty FROM linked), d AS (SELECT *, floor((fy + ty) / 2 + 0.5) AS bend, fx = tx OR fy = ty AS straight FROM c)
SELECT edge_id, 0 AS segment, fx AS x1, fy AS y1, CASE WHEN straight THEN tx ELSE fx END AS x2, CASE WHEN straight THEN ty ELSE bend END AS y2 FROM d UNION ALL SELECT edge_id, 1, fx, bend, tx, bend FROM d WHERE NOT straight UNION ALL SELECT edge_id, 2, tx, bend, tx, ty FROM d WHERE NOT straight""", linked=_LINKED))
def edge_routes(spark, sf):
    return decks.edge_routes(run(spark, sf, _LINKED))


_BODY = (40.0, 60.0, 880.0, 440.0)
_LABELS = """WITH c AS (SELECT *, (a_x + a_w / 2 + b_x + b_w / 2) / 2 AS cx, (a_y + a_h / 2 + b_y + b_h / 2) / 2 AS cy FROM linked),
p AS (SELECT c.*, t.i, CASE t.i WHEN 4 THEN least(a_x, b_x) - 84 WHEN 5 THEN greatest(a_x + a_w, b_x + b_w) + 4 ELSE cx - 40 END AS px, CASE t.i WHEN 2 THEN least(a_y, b_y) - 22 WHEN 3 THEN greatest(a_y + a_h, b_y + b_h) + 4 ELSE cy - 9 END AS py FROM c, unnest([1, 2, 3, 4, 5]) AS t(i)),
q AS (SELECT *, floor(greatest(40, least(px, 840)) + 0.5) AS x, floor(greatest(60, least(py, 482)) + 0.5) AS y FROM p)
SELECT edge_id, x, y FROM (SELECT *, (x < a_x + a_w AND x + 80 > a_x AND y < a_y + a_h AND y + 18 > a_y) OR (x < b_x + b_w AND x + 80 > b_x AND y < b_y + b_h AND y + 18 > b_y) AS meets FROM q) QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY CASE WHEN meets THEN 10 ELSE i END, i) = 1"""


@query("edge_labels", twin(_LABELS, linked=_LINKED))
def edge_labels(spark, sf):
    return decks.edge_labels(run(spark, sf, _LINKED), 80.0, 18.0, _BODY)


@query("grid_nodes", twin("""SELECT graph_id, node_id, 40 + ((place % c) + 0.5) * 880 / c - 50 AS x, 60 + (place // c + 0.5) * 440 / ceil(n / c) - 20 AS y FROM (SELECT *, ceil(sqrt(n))::BIGINT AS c FROM (SELECT slide_id AS graph_id, ord AS node_id, count(*) OVER (PARTITION BY slide_id) AS n, row_number() OVER (PARTITION BY slide_id ORDER BY ord) - 1 AS place FROM elements WHERE type = 'shape'))"""))
def grid_nodes(spark, sf):
    nodes = frame(spark, sf, "elements").filter("type = 'shape'").select(F.col("slide_id").alias("graph_id"), "ord", F.col("ord").alias("node_id"))
    return decks.grid_nodes(nodes, _BODY, 100.0, 40.0)


@query("resolved_fonts", twin("SELECT slide_id, ord, CASE WHEN ord % 3 = 0 THEN font WHEN ord % 3 = 1 AND ord % 4 <> 0 THEN 'Georgia' ELSE 'Arial' END AS resolved FROM elements"))
def resolved_fonts(spark, sf):
    known = F.when(F.col("ord") % 4 == 0, F.array(F.lit(" "))).when(F.col("ord") % 3 == 1, F.array(F.lit(""), F.lit(" Georgia "), F.lit("Aptos")))
    observed = F.when(F.col("ord") % 3 == 0, F.concat(F.lit(" "), "font")).when(F.col("ord") % 3 == 1, F.lit("  "))
    return frame(spark, sf, "elements").select("slide_id", "ord", resolved_font(observed, known).alias("resolved"))


def _point(a: str) -> str:
    bare = lambda x: f"regexp_replace(regexp_replace(regexp_replace(format('{{:.4f}}', {x}), '0+$', ''), '\\.$', ''), '^-0$', '0')"
    return f"concat({bare(f'50 + cos({a}) * 48')}, ' ', {bare(f'50 + sin({a}) * 48')})"


@query("sector_paths", twin(f"""SELECT slide_id, ord, CASE WHEN e - s >= 6.283185307079586 THEN concat('M 50 50 L ', {_point('s')}, ' A 48 48 0 0 1 ', {_point('s + pi()')}, ' A 48 48 0 0 1 ', {_point('s')}, ' Z') ELSE concat('M 50 50 L ', {_point('s')}, ' A 48 48 0 ', CASE WHEN e - s > pi() THEN '1' ELSE '0' END, ' 1 ', {_point('e')}, ' Z') END AS path FROM (SELECT slide_id, ord, x / 100 AS s, CASE WHEN ord % 10 = 0 THEN x / 100 + 2 * pi() ELSE x / 100 + h / 40 END AS e FROM elements)"""))
def sector_paths(spark, sf):
    import math

    start = F.col("x") / 100
    end = F.when(F.col("ord") % 10 == 0, start + 2 * math.pi).otherwise(start + F.col("h") / 40)
    return frame(spark, sf, "elements").select("slide_id", "ord", decks.sector_path(start, end).alias("path"))


@query("pdf_boxes", twin("SELECT concat(slide_id, '-', ord) AS item_id, x - 10 AS x, 5 + 540 - y - (h - 13) AS y, w AS width, h - 13 AS height, CASE WHEN h - 13 <= 0 THEN 'non-positive bounds' END AS error FROM elements WHERE trim(text) <> ''"))
def pdf_boxes(spark, sf):
    items = frame(spark, sf, "elements").select(F.concat_ws("-", "slide_id", "ord").alias("item_id"), "text", "x", F.col("y").alias("baseline"), F.col("w").alias("width"), (F.col("h") - 13).alias("height"))
    return decks.pdf_boxes(items, 540, 10, 5)


#: Turns as boxes of a page, one below the other; the last two words of each are looked for, in order.
_ANCHORED = r"""WITH RECURSIVE b AS (SELECT conv_id AS page_id, turn AS ord, turn * 40.0::DOUBLE AS y, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS k FROM conversations),
p AS (SELECT page_id, flatten(list(k ORDER BY ord)) AS page, flatten(list(list_transform(k, lambda t: y) ORDER BY ord)) AS ys FROM b GROUP BY page_id),
w AS (SELECT page_id, ord AS text_id, row_number() OVER (PARTITION BY page_id ORDER BY ord) AS n, y, k[greatest(1, len(k) - 1):] AS want FROM b),
r AS (SELECT page_id, 0::BIGINT AS n, 0::BIGINT AS text_id, NULL::BIGINT AS start, 0::BIGINT AS words, []::BIGINT[] AS claimed FROM p
UNION ALL SELECT page_id, n, text_id, start, len(want), CASE WHEN start IS NULL THEN claimed ELSE list_concat(claimed, range(start, start + len(want))) END
FROM (SELECT r.page_id, w.n, w.text_id::BIGINT AS text_id, w.want, r.claimed, list_sort(list_transform(list_filter(range(1, greatest(1, len(page) - len(want) + 2)), lambda i: len(want) > 0 AND page[i:i + len(want) - 1] = want AND NOT list_has_any(r.claimed, range(i, i + len(want)))),
 lambda i: {'far': abs(ys[i] - w.y) + abs(ys[i + len(want) - 1] - ys[i]), 'start': i}))[1].start AS start FROM r JOIN w ON w.page_id = r.page_id AND w.n = r.n + 1 JOIN p ON p.page_id = r.page_id))
SELECT page_id, text_id, start, CASE WHEN start IS NOT NULL THEN words END AS words FROM r WHERE n > 0"""


@query("anchored_text", _ANCHORED)
def anchored_text(spark, sf):
    from evigrain.functions.text import tokens

    place = {"x": F.lit(0.0), "y": F.col("turn") * 40.0, "w": F.lit(100.0), "h": F.lit(10.0)}
    boxes = frame(spark, sf, "conversations").select(F.col("conv_id").alias("page_id"), F.col("turn").alias("ord"), "text", *(v.alias(k) for k, v in place.items()))
    own = tokens(F.col("text"))
    last = F.slice(own, F.greatest(F.size(own) - 1, F.lit(1)), 2)
    return placing.anchored(boxes.select("page_id", F.col("ord").alias("text_id"), F.array_join(last, " ").alias("text"), *"xywh"), boxes)


@query("clear_slots")
def clear_slots(spark, sf):
    role = F.when(F.col("type") == "text", "text").when((F.col("type") == "image") & (F.col("ord") % 3 == 0), "hard").when(F.col("type") == "image", "art")
    elements = frame(spark, sf, "elements").withColumn("role", role).filter("role IS NOT NULL").withColumn("font_size", F.when(F.col("ord") % 2 == 0, F.col("font_size")))
    return placing.clear_slots(elements)


@query("slot_overlap_areas", twin("""SELECT t.slide_id, t.ord, sum(greatest(0, least(t.x + t.w, e.x + e.w) - greatest(t.x, e.x)) * greatest(0, least(t.y + t.h, e.y + e.h) - greatest(t.y, e.y))) AS area FROM elements t JOIN elements e ON e.slide_id = t.slide_id AND t.type = 'text' AND e.type = 'image' GROUP BY t.slide_id, t.ord"""))
def slot_overlap_areas(spark, sf):
    elements = frame(spark, sf, "elements")
    return decks.overlap_areas(elements.filter("type = 'text'"), elements.filter("type = 'image'"))


@query("deck_plan")
def deck_plan(spark, sf):
    talks = frame(spark, sf, "conversations")
    gathered = talks.groupBy(F.col("conv_id").alias("plan_id")).agg(F.min_by("text", "turn").alias("brief"), F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda r: r["text"]).alias("signals"))
    return decks.plan_slides(gathered.withColumn("slide_count", F.col("plan_id") % 11 + 5)).withColumn("content", F.array_join("content", "|"))


_JOBS = "SELECT c_custkey AS job, CASE WHEN c_custkey % 9 = 0 THEN 'analyzing' ELSE 'generating' END AS status FROM customer"
_ARTIFACTS = "SELECT o_custkey AS job, CASE o_orderkey % 3 WHEN 0 THEN 'plan' WHEN 1 THEN 'variant' ELSE 'audit' END AS kind, o_orderkey % 40 <> 0 AS intact FROM orders"


@query("publication_state", twin("""SELECT j.job, CASE WHEN j.status <> 'generating' THEN j.status WHEN coalesce(a.broken, false) THEN 'failed' WHEN coalesce(a.kinds, 0) = 3 THEN 'ready' ELSE 'failed' END AS status FROM jobs j LEFT JOIN (SELECT job, count(DISTINCT kind) FILTER (WHERE intact) AS kinds, bool_or(NOT intact) AS broken FROM artifacts GROUP BY job) a ON a.job = j.job""", jobs=_JOBS, artifacts=_ARTIFACTS))
def publication_state(spark, sf):
    return decks.publishable(run(spark, sf, _JOBS), run(spark, sf, _ARTIFACTS), ("plan", "variant", "audit"))


_ASSETS = "SELECT p_brand AS source_file, CASE WHEN p_partkey % 12 = 0 THEN -p_partkey ELSE p_partkey END AS relation, md5(p_name) AS sha FROM part"
_PLACED = "SELECT CASE WHEN p_partkey % 7 = 0 THEN 'gone' ELSE p_brand END AS source_file, p_partkey AS relation, p_partkey * 2 AS element_id, md5(CASE WHEN p_partkey % 10 = 0 THEN 'x' ELSE p_name END) AS sha FROM part"


@query("image_graph", twin("""SELECT coalesce(a.source_file, p.source_file) AS source_file, coalesce(a.relation, p.relation) AS relation, p.element_id, CASE WHEN a.sha IS NULL THEN 'placement_without_asset' WHEN p.sha IS NULL THEN 'asset_never_placed' ELSE 'placement_differs' END AS error FROM assets a FULL JOIN placed p ON p.source_file = a.source_file AND p.relation = a.relation WHERE a.sha IS DISTINCT FROM p.sha""", assets=_ASSETS, placed=_PLACED))
def image_graph(spark, sf):
    return decks.image_graph_errors(run(spark, sf, _ASSETS), run(spark, sf, _PLACED))


_STAGE_NAMES = "['inputs', 'specialists', 'narrative-candidates', 'narrative-selection', 'visual-direction', 'variant-design', 'render-audit', 'critics', 'repair-plans', 'final-jury']"


@query("stage_trace", f"""SELECT c_custkey AS job, n AS stage_no, {_STAGE_NAMES}[n] AS stage, [0, 2, 1, 0, 1, 3, 0, 2, 1, 1][n] AS agents, [1, 2, 2, 1, 1, 3, 6, 6, 3, 1][n] AS artifacts, CASE WHEN n = 7 AND c_custkey % 4 > 0 THEN 'blocked' ELSE 'completed' END AS status, CASE WHEN n = 7 AND c_custkey % 4 > 0 THEN 'fatal_deterministic_audit' END AS error FROM customer, unnest(range(1, 11)) AS t(n) WHERE n <= 7 OR c_custkey % 4 = 0""")
def stage_trace(spark, sf):
    trace = decks.stage_trace(frame(spark, sf, "customer").select(F.col("c_custkey").alias("job"), (F.col("c_custkey") % 4).alias("audit_errors")))
    return trace.withColumns({c: F.size(c) for c in ("agents", "artifacts")})


_VARIANTS = "['compact', 'balanced', 'visual']"
_MADE = f"""made AS (SELECT * FROM (VALUES ('inputs', ['inputs']), ('specialists', ['analysis/template-analyst', 'analysis/evidence-analyst']), ('narrative-candidates', ['planning/narrative-candidate-1', 'planning/narrative-candidate-2']), ('narrative-selection', ['planning/narrative-selected']), ('visual-direction', ['planning/visual-director'])) AS t(stage, artifacts)
UNION ALL SELECT 'variant-design', list_transform({_VARIANTS}, lambda v: 'variants/' || v) UNION ALL SELECT 'render-audit', list_concat(list_transform({_VARIANTS}, lambda v: 'render-evidence/' || v), list_transform({_VARIANTS}, lambda v: 'audits/' || v))
UNION ALL SELECT 'critics', flatten(list_transform({_VARIANTS}, lambda v: ['critiques/' || v || '-semantic', 'critiques/' || v || '-visual'])) UNION ALL SELECT 'repair-plans', list_transform({_VARIANTS}, lambda v: 'repairs/' || v || '-round-1') UNION ALL SELECT 'final-jury', ['jury/ranking'])"""


@query("stage_lineage", f"""WITH {_MADE}, reads AS (SELECT unnest(['specialists', 'narrative-candidates', 'narrative-selection', 'visual-direction', 'visual-direction', 'variant-design', 'variant-design', 'variant-design', 'render-audit', 'critics', 'critics', 'critics', 'repair-plans', 'repair-plans', 'repair-plans', 'final-jury', 'final-jury', 'final-jury', 'final-jury', 'final-jury']) AS stage,
unnest(['inputs', 'specialists', 'narrative-candidates', 'specialists', 'narrative-selection', 'specialists', 'narrative-selection', 'visual-direction', 'variant-design', 'specialists', 'variant-design', 'render-audit', 'variant-design', 'render-audit', 'critics', 'specialists', 'variant-design', 'render-audit', 'critics', 'repair-plans']) AS needs)
SELECT c_custkey AS job, unnest(p.artifacts) AS parent, a.artifact FROM customer, reads r JOIN made p ON p.stage = r.needs JOIN (SELECT stage, unnest(artifacts) AS artifact FROM made) a ON a.stage = r.stage WHERE c_custkey % 4 = 0 OR r.stage NOT IN ('critics', 'repair-plans', 'final-jury')""")
def stage_lineage(spark, sf):
    return decks.stage_lineage(decks.stage_trace(frame(spark, sf, "customer").select(F.col("c_custkey").alias("job"), (F.col("c_custkey") % 4).alias("audit_errors"))))


@query("published_sets", """SELECT c_custkey AS job, CASE WHEN c_custkey % 9 = 0 THEN 'not_ready' WHEN c_custkey % 7 = 1 OR c_custkey % 11 = 1 THEN 'incomplete_set' WHEN c_custkey % 5 = 2 THEN 'failed_audit' WHEN c_custkey % 8 = 3 THEN 'jury_references_differ' WHEN c_custkey % 6 = 4 THEN 'slides_differ_from_plan' END AS error FROM customer""")
def published_sets(spark, sf):
    k = F.col("c_custkey")
    jobs = frame(spark, sf, "customer").select(k.alias("job"), "c_custkey", F.when(k % 9 == 0, "generating").otherwise("ready").alias("status"))
    kinds = F.explode(F.array(*[F.lit(x) for x in ("plan", *decks.VARIANTS, *(f"audit-{v}" for v in decks.VARIANTS))])).alias("kind")
    slides = jobs.select("job", "c_custkey", kinds).filter(~((k % 7 == 1) & (F.col("kind") == "audit-visual"))).select("job", "c_custkey", "kind", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("ord"))
    swapped = F.when((k % 6 == 4) & (F.col("kind") == "balanced"), 5 - F.col("ord")).otherwise(F.col("ord"))
    variants = jobs.select("job", "c_custkey", F.explode(F.array(*[F.lit(v) for v in decks.VARIANTS])).alias("variant")).filter(~((k % 11 == 1) & (F.col("variant") == "visual")))
    audits = variants.select("job", "variant", (~((k % 5 == 2) & (F.col("variant") == "compact"))).alias("passed"))
    return decks.published(jobs, slides.select("job", "kind", "ord", F.concat(F.lit("s"), swapped.cast("string")).alias("slide_id")), audits, jobs.select("job", (k % 8 != 3).alias("intact")))


_BYTES = "list_transform(embedding, lambda v: CAST(floor(abs(v::DOUBLE) * 200) % 256 AS INTEGER))"


@query("png_comparison", f"""WITH p AS (SELECT a.vec_id, a.b AS l, b.b AS r FROM (SELECT vec_id, {_BYTES} AS b FROM embeddings) a JOIN (SELECT vec_id, {_BYTES} AS b FROM embeddings) b ON b.vec_id = a.vec_id + 1),
d AS (SELECT vec_id, list_transform(range(1, len(l) + 1), lambda i: abs(l[i] - r[i])) AS d FROM p)
SELECT vec_id, CASE WHEN list_max(d) > 0 THEN 'pixels' END AS reason, len(list_filter(d, lambda x: x > 0))::BIGINT AS differing_pixels, 3 * len(list_filter(d, lambda x: x > 0))::BIGINT AS differing_channels, list_max(d)::BIGINT AS largest, 3 * list_sum(d)::BIGINT AS total FROM d""")
def png_comparison(spark, sf):
    @F.arrow_udf(T.BinaryType())
    def as_png(vectors: pa.Array) -> pa.Array:
        import numpy as np

        return pa.array([images.gray_png(np.floor(np.abs(np.array(v, np.float64)) * 200) % 256, 1) for v in vectors.to_pylist()], pa.binary())

    drawn = frame(spark, sf, "embeddings").select("vec_id", as_png(F.col("embedding")).alias("png"))
    pairs = drawn.select("vec_id", F.col("png").alias("l")).join(drawn.select((F.col("vec_id") - 1).alias("vec_id"), F.col("png").alias("r")), "vec_id")
    return pairs.select("vec_id", images.pixel_differences(F.col("l"), F.col("r")).alias("d")).select("vec_id", "d.*").drop("mean_abs")


@query("embedded_images", "SELECT page_id, page_id % 3 = 0 AS valid, CASE WHEN page_id % 3 = 0 THEN 3::BIGINT END AS width, CASE WHEN page_id % 3 = 0 THEN 2::BIGINT END AS height FROM pages")
def embedded_images(spark, sf):
    body = F.concat(F.unhex(F.lit("47494638396103000200")), F.col("html").cast("binary"), F.when(F.col("page_id") % 3 == 0, F.unhex(F.lit("3B"))).otherwise(F.unhex(F.lit("00"))))
    url = F.when(F.col("page_id") % 3 == 2, F.concat(F.lit("http://x/"), F.col("url"))).otherwise(F.concat(F.lit("data:image/gif;base64,"), F.replace(F.base64(body), F.lit("\r\n"), F.lit(""))))
    return frame(spark, sf, "pages").select("page_id", images.embedded_images(url).alias("i")).select("page_id", "i.*")


_THEME = """concat('<a:theme xmlns:a="urn:a"><a:clrScheme><a:dk1><a:sysClr val="windowText" lastClr="00000', CAST(p_partkey % 10 AS VARCHAR(20)), '"/></a:dk1><a:accent1><a:srgbClr val="', lpad(hex(p_partkey), 6, '0'), '"/></a:accent1></a:clrScheme><a:majorFont><a:latin typeface="', p_brand, '"/></a:majorFont><a:rPr sz="1800" b="1"/></a:theme>')"""


@query("theme_tokens", """SELECT p_partkey::VARCHAR AS name, k AS kind, CASE k WHEN 'color' THEN CASE WHEN i = 1 THEN concat('#00000', p_partkey % 10) ELSE concat('#', lpad(hex(p_partkey), 6, '0')) END WHEN 'heading_font' THEN p_brand WHEN 'font_size' THEN '24' ELSE '700' END AS value, CASE WHEN i = 2 THEN 'accent1' END AS scheme FROM part, unnest([1, 2, 3, 4, 5]) AS t(i), unnest([['color', 'color', 'heading_font', 'font_size', 'font_weight'][i]]) AS u(k)""")
def theme_tokens(spark, sf):
    parts = spread(run(spark, sf, f"SELECT p_partkey AS name, {_THEME} AS xml FROM part"), "name").select("name", F.col("xml").cast("binary").alias("content"))
    return template.tokens_of(parts).select("name", "kind", "value", "scheme")


_SLIDE = """concat('<p:sld xmlns:p="urn:p" xmlns:a="urn:a"><p:cSld><p:spTree><p:grpSp><p:grpSpPr><a:xfrm><a:off x="952500" y="0"/><a:ext cx="1905000" cy="952500"/><a:chOff x="0" y="0"/><a:chExt cx="952500" cy="952500"/></a:xfrm></p:grpSpPr><p:sp><p:nvSpPr><p:cNvPr id="', CAST(p_partkey AS VARCHAR(20)), '"/></p:nvSpPr><p:spPr><a:xfrm><a:off x="', CAST(p_size * 9525 AS VARCHAR(20)), '" y="0"/><a:ext cx="95250" cy="95250"/></a:xfrm></p:spPr><p:txBody><a:t>', p_name, '</a:t></p:txBody></p:sp></p:grpSp><p:pic/></p:spTree></p:cSld></p:sld>')"""


@query("template_elements", """SELECT p_partkey::VARCHAR AS name, 0::BIGINT AS ord, p_partkey::VARCHAR AS element_id, 'text' AS type, p_name AS text, (100 + 2 * p_size)::DOUBLE AS x, 20::DOUBLE AS w FROM part UNION ALL SELECT p_partkey::VARCHAR, 1, NULL, 'image', '', NULL, NULL FROM part""")
def template_elements(spark, sf):
    parts = spread(run(spark, sf, f"SELECT p_partkey AS name, {_SLIDE} AS xml FROM part"), "name").select("name", F.col("xml").cast("binary").alias("content"))
    return template.elements_of(parts).select("name", "ord", "element_id", "type", "text", "x", "w")


@F.arrow_udf(T.BinaryType())
def _as_template(numbers: pa.Array) -> pa.Array:
    """Packages with a theme, a layout and two slides (numbers 10 and 2); some have a broken or an unsafe part, or no presentation."""
    import io
    import zipfile

    slide = '<p:sld xmlns:p="urn:p" xmlns:a="urn:a"><p:cSld><p:spTree>{}</p:spTree></p:cSld></p:sld>'
    turned = '<p:grpSp><p:grpSpPr><a:xfrm rot="5"><a:off x="0" y="0"/></a:xfrm></p:grpSpPr></p:grpSp>'
    shape = lambda i: f'<p:sp><p:nvSpPr><p:cNvPr id="{i}"/></p:nvSpPr><p:spPr><a:xfrm><a:off x="{i * 9525}" y="0"/><a:ext cx="9525" cy="9525"/></a:xfrm></p:spPr></p:sp>'
    out = []
    for n in numbers.to_pylist():
        parts = {"ppt/slides/slide10.xml": slide.format("<p:pic/>" + shape(n)), "ppt/slides/slide2.xml": slide.format(turned + shape(n)) if n % 5 else "<broken", "ppt/slideLayouts/slideLayout1.xml": slide.format(shape(1)), "ppt/media/a.png": "x"}
        parts["ppt/slides/_rels/slide10.xml.rels"] = f'<Relationships><Relationship Id="r1" Type="http://x/slideLayout" Target="../slideLayouts/slideLayout1.xml"/><Relationship Id="r2" Type="http://x/hyperlink" Target="https://x/{n}" TargetMode="External"/></Relationships>'
        if n % 3:
            parts["ppt/presentation.xml"] = "<p/>"
        parts["ppt/theme/theme1.xml"] = "<!DOCTYPE x><t/>" if n % 7 == 0 else f'<t><a:srgbClr xmlns:a="urn:a" val="{n:06X}"/></t>'
        box = io.BytesIO()
        with zipfile.ZipFile(box, "w") as package:
            for name, body in parts.items():
                package.writestr(name, body)
        out.append(box.getvalue())
    return pa.array(out, pa.binary())


def _template_parts(spark, sf):
    jobs = spread(frame(spark, sf, "customer").select("c_custkey"), "c_custkey")
    return template.parts_of(jobs.select(F.col("c_custkey").alias("name"), _as_template(F.col("c_custkey")).alias("content")))


@query("template_parts", """SELECT c_custkey::VARCHAR AS name, CASE WHEN c_custkey % 7 <> 0 THEN p.role END AS role, CASE WHEN c_custkey % 7 <> 0 THEN p.number::BIGINT END AS number, CASE WHEN c_custkey % 7 <> 0 THEN p.part END AS part,
CASE WHEN c_custkey % 7 <> 0 AND p.part = 'ppt/slides/slide2.xml' AND c_custkey % 5 = 0 THEN 'Could not parse XML part: ppt/slides/slide2.xml' WHEN c_custkey % 7 <> 0 AND p.role = 'presentation' AND c_custkey % 3 = 0 THEN 'Missing XML part: ppt/presentation.xml' END AS warning,
CASE WHEN c_custkey % 7 = 0 THEN 'Unsafe XML declaration in PPTX package' END AS error, CASE WHEN c_custkey % 7 <> 0 THEN p.relations END AS relations
FROM customer, (VALUES ('theme', 1, 'ppt/theme/theme1.xml', 0), ('layout', 1, 'ppt/slideLayouts/slideLayout1.xml', 0), ('slide', 1, 'ppt/slides/slide2.xml', 0), ('slide', 2, 'ppt/slides/slide10.xml', 2), ('presentation', 1, 'ppt/presentation.xml', 0), ('media', 1, 'ppt/media/a.png', 0)) AS p(role, number, part, relations) WHERE c_custkey % 7 <> 0 OR p.role = 'theme'""")
def template_parts(spark, sf):
    return _template_parts(spark, sf).select("name", "role", "number", "part", "warning", "error", F.when(F.col("relations").isNotNull(), F.size("relations")).alias("relations"))


@query("template_warnings", "SELECT c_custkey::VARCHAR AS name, 'Skipped turned or flipped group' AS warning FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 5 <> 0")
def template_warnings(spark, sf):
    return template.warnings_of(_template_parts(spark, sf).filter("role = 'slide'"))


@query("element_order", "SELECT c_custkey::VARCHAR AS name, o AS ord, CASE WHEN o = 1 THEN c_custkey::VARCHAR END AS element_id, 1 - o AS z FROM customer, unnest([0, 1]) AS t(o) WHERE c_custkey % 7 <> 0")
def element_order(spark, sf):
    """Slides on which an element without an id stands before one with it."""
    slides = _template_parts(spark, sf).filter("part = 'ppt/slides/slide10.xml'")
    return template.elements_of(slides).select("name", "ord", "element_id", "z")


#: Events ask for skills by the length of what they carry; some names are none.
_ASKED = "SELECT CASE CAST(floor(value * 100) AS BIGINT) % 12 WHEN 0 THEN 'align-claims' WHEN 1 THEN 'canvas-audit' WHEN 2 THEN 'data-visual-spec' WHEN 3 THEN 'deck-plan' WHEN 4 THEN 'final-jury' WHEN 5 THEN 'grounded-deck-planner' WHEN 6 THEN 'published-ranking' WHEN 7 THEN 'search-evidence' WHEN 8 THEN concat('none-', event_type) END AS id FROM events"
_LISTED = "(VALUES ('align-claims', 'v1', 'claims,chunks,facts'), ('canvas-audit', 'v1', 'elements,fonts,colors'), ('data-visual-spec', 'v1', 'data,facts,chunks,citations'), ('deck-plan', 'v1', 'briefs'), ('final-jury', 'v1', 'variants'), ('grounded-deck-planner', 'v1', 'chunks,claims'), ('published-ranking', 'v1', 'variants'), ('search-evidence', 'v1', 'requests,chunks,facts'), ('semantic-audit', 'v1', 'findings,slides,evidence')) AS t(id, version, inputs)"


@query("skill_registry", f"WITH asked AS (SELECT id, count(*) AS requests FROM ({_ASKED}) WHERE id IS NOT NULL GROUP BY id) SELECT id, version, inputs, coalesce(requests, 0) AS requests FROM {_LISTED} FULL JOIN asked USING (id)")
def skill_registry(spark, sf):
    """All skills, and how often the events ask for them."""
    return skills.requested(run(spark, sf, _ASKED))


_ASSIGNED = "SELECT CASE o_orderkey % 3 WHEN 0 THEN 'compact' WHEN 1 THEN 'balanced' ELSE 'visual' END AS variant, CASE WHEN o_orderkey % 19 = 0 THEN -o_custkey ELSE o_custkey END AS slide_id, CASE WHEN o_orderkey % 17 = 0 THEN 99 ELSE o_orderkey % 25 END AS layout_id, concat(CAST(CASE WHEN o_orderkey % 23 = 0 THEN 7 ELSE o_custkey END AS VARCHAR(20)), '-slot') AS slot_id, o_custkey * 10 + o_orderkey % 3 AS claim_id FROM orders"
_PLAN_CLAIMS = "SELECT c_custkey AS slide_id, c_custkey * 10 AS claim_id FROM customer UNION ALL SELECT c_custkey, c_custkey * 10 + 1 FROM customer"
_KNOWN_LAYOUTS = "SELECT CAST(n_nationkey AS BIGINT) AS layout_id FROM nation"


@query("variant_references", twin("""SELECT a.variant, a.slide_id, a.slot_id, a.claim_id, CASE WHEN a.slide_id NOT IN (SELECT slide_id FROM plan_claims) THEN 'missing_variant_slide_ref' WHEN a.layout_id NOT IN (SELECT layout_id FROM known_layouts) THEN 'missing_layout_ref'
WHEN NOT starts_with(a.slot_id, concat(a.slide_id, '-')) THEN 'invalid_layout_ref' WHEN NOT EXISTS (SELECT 1 FROM plan_claims p WHERE p.slide_id = a.slide_id AND p.claim_id = a.claim_id) THEN 'missing_claim_ref' END AS error FROM assigned a""", assigned=_ASSIGNED, plan_claims=_PLAN_CLAIMS, known_layouts=_KNOWN_LAYOUTS))
def variant_references(spark, sf):
    return decks.variant_reference_errors(run(spark, sf, _ASSIGNED), run(spark, sf, _PLAN_CLAIMS), run(spark, sf, _KNOWN_LAYOUTS))


_WIDE = "SELECT slide_id, ord, CASE WHEN ord % 10 = 5 THEN 'line' ELSE type END AS type, x, y, CASE WHEN ord % 10 = 5 THEN w + 500 ELSE w END AS w, CASE WHEN ord % 10 = 5 THEN CAST(5 AS DOUBLE) ELSE h END AS h FROM elements"


@query("layout_terms", twin("""SELECT slide_id, least(0.7::DOUBLE, coalesce(max(CASE WHEN type = 'image' AND x >= 0 AND y >= 0 AND x + w <= 960 AND y + h <= 540 THEN w * h END), 0) / 518400) * 500 AS featured_image, bool_or(type = 'image' AND x >= 0 AND y >= 0 AND x + w <= 960 AND y + h <= 540 AND w * h / 518400 >= 0.5) AS full_bleed,
CASE WHEN slide_id IN (SELECT t.slide_id FROM wide t JOIN wide l ON l.slide_id = t.slide_id AND t.type IN ('text', 'placeholder') AND l.type IN ('line', 'shape', 'image') AND l.w >= 528 AND l.h <= 13.5 AND t.y < l.y AND t.y + t.h > l.y AND t.x < l.x + l.w AND t.x + t.w > l.x) THEN -40000::BIGINT ELSE 0::BIGINT END AS line_interference FROM wide GROUP BY slide_id""", wide=_WIDE))
def layout_terms(spark, sf):
    return decks.layout_terms(run(spark, sf, _WIDE))


@query("first_fit_timeline", twin("""SELECT slide_id, w AS width, s AS start, t AS top FROM (SELECT DISTINCT slide_id FROM elements), (VALUES (0, 600.0::DOUBLE), (1, 300.0::DOUBLE), (2, 120.0::DOUBLE)) AS a(wi, w), (VALUES (0, 115.0::DOUBLE), (1, 0.0::DOUBLE), (2, 700.0::DOUBLE)) AS b(si, s), (VALUES (0, 300.0::DOUBLE), (1, 120.0::DOUBLE), (2, 450.0::DOUBLE)) AS c(ti, t)
WHERE s + w <= 960 AND slide_id || '|' || wi || '|' || si || '|' || ti NOT IN (SELECT e.slide_id || '|' || wi2 || '|' || si2 || '|' || ti2 FROM elements e, (VALUES (0, 600.0), (1, 300.0), (2, 120.0)) AS a2(wi2, w2), (VALUES (0, 115.0), (1, 0.0), (2, 700.0)) AS b2(si2, s2), (VALUES (0, 300.0), (1, 120.0), (2, 450.0)) AS c2(ti2, t2) WHERE e.type = 'image' AND e.x < s2 + w2 AND e.x + e.w > s2 AND e.y < t2 + 40 AND e.y + e.h > t2)
QUALIFY row_number() OVER (PARTITION BY slide_id ORDER BY wi, si, ti) = 1"""))
def first_fit_timeline(spark, sf):
    elements = frame(spark, sf, "elements")
    return decks.first_fit(elements, elements.filter("type = 'image'"), (600, 300, 120), (115, 0, 700), (300, 120, 450), 40)


#: Ten text slots with two small images each, on slides of fifty parts; on every fifth slide one slot is wider.
_ICONS = """SELECT slide_no AS layout_id, ord, CASE WHEN ord < 10 THEN 'text' WHEN ord < 30 THEN 'image' ELSE 'shape' END AS type,
5.0 + (ord % 5) * 190 + CASE WHEN ord BETWEEN 10 AND 19 THEN 10 WHEN ord BETWEEN 20 AND 29 THEN 12 ELSE 0 END AS x, 100.0 + floor((ord % 10) / 5) * 150 + CASE WHEN ord BETWEEN 10 AND 19 THEN 10 WHEN ord BETWEEN 20 AND 29 THEN 12 ELSE 0 END AS y,
CASE WHEN ord < 10 THEN CASE WHEN ord = 3 AND slide_no % 5 = 0 THEN 180.0 ELSE 150.0 END WHEN ord < 20 THEN 30.0 ELSE 28.0 END AS w, CASE WHEN ord < 10 THEN 60.0 WHEN ord < 20 THEN 30.0 ELSE 28.0 END AS h, slide_no % 12 AS items FROM elements"""


@query("marker_rows", twin("""SELECT i.layout_id, i.ord, i.ord - 10 AS slot_ord, 2::BIGINT AS images FROM icons i JOIN (SELECT layout_id FROM icons WHERE ord < 30 GROUP BY layout_id HAVING count(*) = 30) f ON f.layout_id = i.layout_id WHERE i.ord BETWEEN 10 AND 19 AND i.items BETWEEN 1 AND 8 AND i.layout_id % 5 <> 0""", icons=_ICONS))
def marker_rows(spark, sf):
    icons = run(spark, sf, _ICONS)
    return placing.marker_rows(icons.withColumns({c: F.col(c).cast("double") for c in "xywh"}))


@query("contract_violations", twin("""SELECT slide_id || '/' || ord AS place, unnest(list_filter([CASE WHEN type = 'frame' THEN 'type_unknown' END, CASE WHEN w <= 0 THEN 'size_not_positive' END, CASE WHEN NOT regexp_full_match(color, '#[0-9A-Fa-f]{6}') THEN 'color_malformed' END], lambda r: r IS NOT NULL)) AS rule FROM loose""",
       loose="SELECT slide_id, ord, element_id, CASE WHEN ord % 9 = 0 THEN 'frame' ELSE type END AS type, x, y, CASE WHEN ord % 8 = 0 THEN CAST(0 AS DOUBLE) ELSE w END AS w, h, CASE WHEN ord % 7 = 0 THEN 'red' ELSE color END AS color FROM elements"))
def contract_violations(spark, sf):
    from evigrain import schemas

    loose = run(spark, sf, "SELECT slide_id, ord, element_id, CASE WHEN ord % 9 = 0 THEN 'frame' ELSE type END AS type, x, y, CASE WHEN ord % 8 = 0 THEN CAST(0 AS DOUBLE) ELSE w END AS w, h, CASE WHEN ord % 7 = 0 THEN 'red' ELSE color END AS color FROM elements")
    return schemas.violations(loose.withColumn("place", F.concat_ws("/", "slide_id", "ord")), "elements", "place")
