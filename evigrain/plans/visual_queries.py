"""Queries over tables, charts, diagrams and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigrain.operators import rank, visuals
from evigrain.plans.registered import registry
from evigrain.plans.standins import frame, run, twin

QUERIES, ORACLE_SQL, query = registry()

@query("grid_table", twin("""SELECT h.source_id, h.row_no, h.col_no - 1 AS col_no, h.text AS header, a.text AS label_1, b.text AS label_2, c.text AS value_1, d.text AS value_2 FROM grid h
JOIN grid a ON a.source_id = h.source_id AND a.row_no = h.row_no + 1 AND a.col_no = h.col_no - 1 AND a.value_type = 'string' JOIN grid b ON b.source_id = h.source_id AND b.row_no = h.row_no + 2 AND b.col_no = h.col_no - 1 AND b.value_type = 'string'
JOIN grid c ON c.source_id = h.source_id AND c.row_no = h.row_no + 1 AND c.col_no = h.col_no AND c.value_type = 'number' JOIN grid d ON d.source_id = h.source_id AND d.row_no = h.row_no + 2 AND d.col_no = h.col_no AND d.value_type = 'number' WHERE h.value_type = 'string'""",
       grid="SELECT CAST(o_custkey % 9 AS VARCHAR(20)) AS source_id, o_orderkey AS row_no, c AS col_no, concat(o_orderstatus, CAST(c AS VARCHAR(20))) AS text, CASE WHEN c % 2 = 0 AND o_orderkey % 3 <> 0 THEN 'number' ELSE 'string' END AS value_type FROM grid_rows",
       grid_rows="SELECT o_custkey - o_custkey AS o_custkey, o_orderkey, o_orderstatus, 1 AS c FROM orders UNION ALL SELECT o_custkey - o_custkey, o_orderkey, o_orderstatus, 2 FROM orders UNION ALL SELECT o_custkey - o_custkey, o_orderkey, o_orderstatus, 3 FROM orders"))
def grid_table(spark, sf):
    rows = run(spark, sf, "SELECT o_custkey - o_custkey AS o_custkey, o_orderkey, o_orderstatus, 1 AS c FROM orders UNION ALL SELECT o_custkey - o_custkey, o_orderkey, o_orderstatus, 2 FROM orders UNION ALL SELECT o_custkey - o_custkey, o_orderkey, o_orderstatus, 3 FROM orders")
    kind = F.when((F.col("c") % 2 == 0) & (F.col("o_orderkey") % 3 != 0), "number").otherwise("string")
    facts = rows.select((F.col("o_custkey") % 9).cast("string").alias("source_id"), F.col("o_orderkey").alias("row_no"), F.col("c").alias("col_no"), F.concat("o_orderstatus", F.col("c").cast("string")).alias("text"), kind.alias("value_type"))
    return visuals.grid_tables(facts)


@query("free_slot", twin("""WITH places AS (SELECT DISTINCT slide_id, y.y AS slot_y, x.x AS slot_x FROM elements, unnest(range(20, 441, 20)) AS y(y), unnest(range(20, 841, 20)) AS x(x)),
free AS (SELECT * FROM places p WHERE NOT EXISTS (SELECT 1 FROM elements e WHERE e.slide_id = p.slide_id AND e.x < p.slot_x + 100 AND e.x + e.w > p.slot_x AND e.y < p.slot_y + 80 AND e.y + e.h > p.slot_y))
SELECT slide_id, slot_y::INTEGER AS slot_y, slot_x::INTEGER AS slot_x FROM free QUALIFY row_number() OVER (PARTITION BY slide_id ORDER BY slot_y, slot_x) = 1"""))
def free_slot(spark, sf):
    return visuals.first_free_slot(frame(spark, sf, "elements"), 100, 80)


_RELATIONS = "SELECT n_regionkey AS source_id, CAST(n_nationkey AS BIGINT) AS row_no, CASE WHEN n_nationkey = 7 THEN '' ELSE n_name END AS source, CASE WHEN n_regionkey = 3 AND n_nationkey % 5 = 3 THEN n_name ELSE concat('R', CAST(n_nationkey % 3 AS VARCHAR(20))) END AS target, CASE WHEN n_nationkey % 2 = 0 THEN 'in' ELSE ' ' END AS relationship FROM nation"
_EDGES = "SELECT source_id, row_no, source, target, nullif(trim(relationship), '') AS relationship FROM relations WHERE source_id NOT IN (SELECT source_id FROM relations WHERE trim(source) = '' OR trim(target) = '' OR source = target)"


@query("edge_list", twin(_EDGES, relations=_RELATIONS))
def edge_list(spark, sf):
    return visuals.relation_edges(run(spark, sf, _RELATIONS))


@query("diagram_nodes", twin(f"""WITH e AS ({_EDGES}), n AS (SELECT source_id, label, min(place) AS first FROM (SELECT source_id, source AS label, row_no * 2 AS place FROM e UNION ALL SELECT source_id, target, row_no * 2 + 1 FROM e) GROUP BY source_id, label),
o AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY first) AS node_no, ceil(sqrt(count(*) OVER (PARTITION BY source_id))) AS side FROM n)
SELECT source_id, label, node_no, (node_no - 1) % side AS grid_col, floor((node_no - 1) / side) AS grid_row, ((node_no - 1) % side) * 120 AS x, floor((node_no - 1) / side) * 80 AS y FROM o""", relations=_RELATIONS))
def diagram_nodes(spark, sf):
    return visuals.grid_places(visuals.nodes_of(visuals.relation_edges(run(spark, sf, _RELATIONS))), 120.0, 80.0).select("source_id", "label", F.col("node_no").cast("long").alias("node_no"), F.col("grid_col").cast("double").alias("grid_col"), F.col("grid_row").cast("double").alias("grid_row"), "x", F.col("y").cast("double").alias("y"))


_NODES = "SELECT s_nationkey AS diagram, s_suppkey % 40 AS node_id FROM supplier"
_LINKS = "SELECT s_nationkey AS diagram, s_suppkey % 40 AS from_id, (s_suppkey * 3) % 40 AS to_id FROM supplier"


@query("diagram_checks", twin("""SELECT n.diagram, CASE WHEN max(n.c) > 1 THEN 'duplicate_node_id' WHEN bool_or(EXISTS (SELECT 1 FROM (SELECT diagram, from_id AS id FROM links UNION ALL SELECT diagram, to_id FROM links) e WHERE e.diagram = n.diagram AND NOT EXISTS (SELECT 1 FROM nodes k WHERE k.diagram = e.diagram AND k.node_id = e.id))) THEN 'unknown_node_id'
WHEN sum(n.c) > 12 OR any_value((SELECT count(*) FROM links l WHERE l.diagram = n.diagram)) > 24 THEN 'too_large' END AS error FROM (SELECT diagram, node_id, count(*) AS c FROM nodes GROUP BY diagram, node_id) n GROUP BY n.diagram""", nodes=_NODES, links=_LINKS))
def diagram_checks(spark, sf):
    return visuals.diagram_errors(run(spark, sf, _NODES), run(spark, sf, _LINKS))


_TREE = "SELECT c_custkey AS child, CAST(floor(c_custkey / 4) AS BIGINT) AS parent FROM customer WHERE c_custkey >= 4"


@query("lineage_closure", twin("WITH RECURSIVE up AS (SELECT parent AS ancestor, child AS descendant FROM tree UNION SELECT t.parent, u.descendant FROM up u JOIN tree t ON t.child = u.ancestor) SELECT ancestor, descendant FROM up", tree=_TREE))
def lineage_closure(spark, sf):
    return visuals.closure(run(spark, sf, _TREE), "parent", "child")


@query("lineage_errors", """WITH r AS (SELECT CASE WHEN c_custkey % 40 = 0 THEN c_custkey - 1 ELSE c_custkey END AS artifact_id, c_custkey AS ord, CASE WHEN c_custkey % 11 = 0 THEN c_custkey WHEN c_custkey % 13 = 0 THEN -5 WHEN c_custkey % 7 = 0 THEN c_custkey + 1 ELSE c_custkey - 1 END AS parent FROM customer),
k AS (SELECT artifact_id AS parent, min(ord) AS parent_ord FROM r GROUP BY artifact_id)
SELECT r.artifact_id, r.ord, CASE WHEN count(*) OVER (PARTITION BY r.artifact_id) > 1 THEN 'duplicate_artifact_id' WHEN r.parent = r.artifact_id THEN 'self_parent' WHEN k.parent IS NULL THEN 'unknown_parent' WHEN k.parent_ord >= r.ord THEN 'parent_not_before_child' END AS error FROM r LEFT JOIN k ON k.parent = r.parent""")
def lineage_errors(spark, sf):
    k = F.col("c_custkey")
    parent = F.when(k % 11 == 0, k).when(k % 13 == 0, F.lit(-5)).when(k % 7 == 0, k + 1).otherwise(k - 1)
    rows = frame(spark, sf, "customer").select(F.when(k % 40 == 0, k - 1).otherwise(k).alias("artifact_id"), k.alias("ord"), F.array(parent).alias("parents"))
    return visuals.lineage_errors(rows)


_SLICES = "SELECT c_nationkey AS pie, c_custkey AS ord, CASE WHEN c_custkey % 6 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(c_custkey % 50 + 1 AS DOUBLE) END AS value FROM customer"


@query("pie_angles", twin("""WITH w AS (SELECT *, sum(value) OVER (PARTITION BY pie ORDER BY ord) AS upto, sum(value) OVER (PARTITION BY pie) AS total, max(CASE WHEN value > 0 THEN ord END) OVER (PARTITION BY pie) AS last FROM slices)
SELECT pie, ord, round(-1.5707963267948966 + (upto - value) / total * 6.283185307179586, 9) AS start_angle, round(CASE WHEN ord = last THEN -1.5707963267948966 + 6.283185307179586 ELSE -1.5707963267948966 + upto / total * 6.283185307179586 END, 9) AS end_angle FROM w WHERE value > 0""", slices=_SLICES))
def pie_angles(spark, sf):
    return visuals.pie_sectors(run(spark, sf, _SLICES), "pie", "ord", "value").select("pie", "ord", F.round("start_angle", 9).alias("start_angle"), F.round("end_angle", 9).alias("end_angle"))


_BARS = "SELECT c_nationkey AS chart, c_custkey AS ord, c_acctbal AS value FROM customer"


@query("chart_baseline", twin("""WITH r AS (SELECT *, least(0, min(value) OVER (PARTITION BY chart)) AS low, greatest(0, max(value) OVER (PARTITION BY chart)) AS high FROM bars), s AS (SELECT *, CASE WHEN high = low THEN 1 ELSE high - low END AS span FROM r)
SELECT chart, ord, low, high, round(300 * high / span, 6) AS baseline, round(least(300 * (high - value) / span, 300 * high / span), 6) AS bar_top, round(300 * abs(value) / span, 6) AS bar_height FROM s""", bars=_BARS))
def chart_baseline(spark, sf):
    found = visuals.bars(run(spark, sf, _BARS), "chart", "value", 300.0)
    return found.select("chart", "ord", "low", "high", *(F.round(c, 6).alias(c) for c in ("baseline", "bar_top", "bar_height")))


@query("line_points", twin("SELECT chart, ord, value, lead(value) OVER w AS next_value, lead(ord) OVER w AS next_order FROM bars WINDOW w AS (PARTITION BY chart ORDER BY ord) QUALIFY next_order IS NOT NULL", bars=_BARS))
def line_points(spark, sf):
    return visuals.line_segments(run(spark, sf, _BARS), "chart", "ord", "value")


@query("table_matrix", "SELECT l_suppkey, l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS cells FROM lineitem GROUP BY l_suppkey, l_orderkey")
def table_matrix(spark, sf):
    return visuals.table_matrix(frame(spark, sf, "lineitem"), "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey").withColumn("cells", F.array_join(F.transform("cells", lambda c: c.cast("string")), ","))


@query("datum_refs", twin("SELECT doc_id, unnest([concat('f', doc_id), concat('f', doc_id + 1), concat('f', doc_id + 2)]) AS fact_id FROM documents"))
def datum_refs(spark, sf):
    of = lambda by: F.concat(F.lit("f"), (F.col("doc_id") + by).cast("string"))
    nested = frame(spark, sf, "documents").select("doc_id", F.array(of(0)).alias("categories"), F.array(F.struct(of(1).alias("label"), F.array(of(2)).alias("values"))).alias("series"))
    refs = F.concat("categories", F.flatten(F.transform("series", lambda s: F.concat(F.array(s["label"]), s["values"]))))
    return nested.select("doc_id", F.explode(refs).alias("fact_id"))


_VARIANTS = """SELECT c_custkey AS job, 'compact' AS variant, c_custkey % 9 AS issues, c_custkey % 4 AS warnings, c_custkey % 3 AS errors, c_custkey % 130 AS elements, 9 AS slides FROM customer
UNION ALL SELECT c_custkey, 'balanced', c_custkey % 7, c_custkey % 5, c_custkey % 2, c_custkey % 110, 9 FROM customer UNION ALL SELECT c_custkey, 'visual', c_custkey % 8, c_custkey % 3, c_custkey % 4, c_custkey % 170, 9 FROM customer"""


@query("ranking", twin("""WITH a AS (SELECT *, greatest(0, 100 - errors * 18 - warnings * 5 - greatest(0, issues - errors - warnings))::DOUBLE AS audit_score, least(100, greatest(0, floor(100 - abs(elements / slides - 12) * 2 + 0.5))) AS structure_score FROM variants),
b AS (SELECT *, least(100, greatest(0, floor(CASE variant WHEN 'compact' THEN 84 WHEN 'balanced' THEN 92 ELSE 88 END + (audit_score - 100) * 0.6::DOUBLE + (structure_score - 100) * 0.15::DOUBLE + 0.5))) AS score FROM a)
SELECT job, variant, audit_score, structure_score, score, row_number() OVER (PARTITION BY job ORDER BY score DESC, variant) AS rank FROM b""", variants=_VARIANTS))
def ranking(spark, sf):
    return rank.published_ranking(run(spark, sf, _VARIANTS)).select("job", "variant", "audit_score", "structure_score", "score", F.col("rank").cast("long").alias("rank"))


_JURY = """SELECT c_custkey AS job, 'compact' AS variant, c_custkey % 5 AS audit_issues, c_custkey % 6 AS infos, c_custkey % 4 AS warnings, c_custkey % 3 AS errors, c_custkey % 2 AS repairs, c_custkey % 7 AS grounded, CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE 7 END AS claims FROM customer
UNION ALL SELECT c_custkey, 'balanced', c_custkey % 4, c_custkey % 3, c_custkey % 5, c_custkey % 2, c_custkey % 3, c_custkey % 7, CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE 7 END FROM customer UNION ALL SELECT c_custkey, 'visual', c_custkey % 5, c_custkey % 6, c_custkey % 4, c_custkey % 3, c_custkey % 2, c_custkey % 7, CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE 7 END FROM customer"""


@query("jury", twin("""WITH a AS (SELECT *, greatest(0, 100 - audit_issues * 12) AS audit_score, greatest(0, 100 - infos * 2 - warnings * 12 - errors * 24 - repairs * 8) AS advisory_score, CASE WHEN claims = 0 THEN 0 ELSE floor(100 * grounded / claims + 0.5) END AS coverage FROM panel),
b AS (SELECT *, floor(audit_score * 0.6::DOUBLE + advisory_score * 0.3::DOUBLE + coverage * 0.1::DOUBLE + 0.5) AS score FROM a)
SELECT job, variant, audit_score, advisory_score, score, row_number() OVER (PARTITION BY job ORDER BY score DESC, CASE variant WHEN 'balanced' THEN 0 WHEN 'compact' THEN 1 ELSE 2 END) AS rank FROM b""", panel=_JURY))
def jury(spark, sf):
    return rank.jury(run(spark, sf, _JURY)).select("job", "variant", "audit_score", "advisory_score", "score", F.col("rank").cast("long").alias("rank"))


@query("minmax_features", twin("SELECT slide_id, ord, CASE WHEN max(w) OVER p = min(w) OVER p THEN 0.5 ELSE (w - min(w) OVER p) / (max(w) OVER p - min(w) OVER p) END AS feature FROM elements WINDOW p AS (PARTITION BY slide_id)"))
def minmax_features(spark, sf):
    return rank.min_max(frame(spark, sf, "elements"), "slide_id", "w", "feature").select("slide_id", "ord", "feature")


@query("image_placement", twin("SELECT slide_id, ord, row_number() OVER (PARTITION BY slide_id ORDER BY w * h DESC, z, ord) AS place FROM elements WHERE type = 'image'"))
def image_placement(spark, sf):
    from pyspark.sql import Window

    images = frame(spark, sf, "elements").filter("type = 'image'")
    return images.select("slide_id", "ord", F.row_number().over(Window.partitionBy("slide_id").orderBy(F.desc(F.col("w") * F.col("h")), "z", "ord")).cast("long").alias("place"))


@query("paint_order", twin("SELECT slide_id, ord, row_number() OVER (PARTITION BY slide_id ORDER BY x, ord) AS place FROM elements"))
def paint_order(spark, sf):
    from pyspark.sql import Window

    return frame(spark, sf, "elements").select("slide_id", "ord", F.row_number().over(Window.partitionBy("slide_id").orderBy("x", "ord")).cast("long").alias("place"))


@query("placement_order", twin("SELECT slide_id, ord, row_number() OVER (PARTITION BY slide_id ORDER BY CASE WHEN ord = 0 THEN 0 ELSE 1 END, ceil(length(text) / (w * h)) DESC, length(text) DESC, ord) AS place FROM elements"))
def placement_order(spark, sf):
    from pyspark.sql import Window

    size = F.char_length("text")
    order = Window.partitionBy("slide_id").orderBy(F.when(F.col("ord") == 0, 0).otherwise(1), F.desc(F.ceil(size / (F.col("w") * F.col("h")))), F.desc(size), "ord")
    return frame(spark, sf, "elements").select("slide_id", "ord", F.row_number().over(order).cast("long").alias("place"))


_FILES = "SELECT page_id, concat('ppt/slides/slide', CAST((page_id * 7) % 120 AS VARCHAR(20)), '.xml') AS name FROM pages"


@query("numeric_order", twin("SELECT page_id, name, row_number() OVER (PARTITION BY page_id % 16 ORDER BY CAST(regexp_extract(name, '(\\d+)\\.xml', 1) AS BIGINT), name, page_id) AS place FROM files", files=_FILES))
def numeric_order(spark, sf):
    files = run(spark, sf, _FILES).withColumn("package", F.col("page_id") % 16)
    return rank.numbered(files, ["package"], [*rank.numeric_order(F.col("name")), F.col("page_id")], "place").select("page_id", "name", "place")


@query("timeline_gaps", twin("SELECT slide_id, count(*) FILTER (WHERE kept) AS distinct_centers FROM (SELECT slide_id, coalesce(c - lag(c) OVER (PARTITION BY slide_id ORDER BY c) >= 0.12::DOUBLE, true) AS kept FROM (SELECT slide_id, (x + w / 2) / 960 AS c FROM elements)) GROUP BY slide_id"))
def timeline_gaps(spark, sf):
    centers = frame(spark, sf, "elements").withColumn("center", (F.col("x") + F.col("w") / 2) / 960)
    return rank.spaced_centers(centers, "slide_id", "center")
