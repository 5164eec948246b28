"""Queries over histories, retention, manifests, admission, and extensions on driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigrain import contracts
from evigrain.operators import decks, state
from evigrain.plans.registered import registry
from evigrain.plans.standins import frame, run, twin
from evigrain.streaming import windows

QUERIES, ORACLE_SQL, query = registry()


@query("history_last30", """WITH c AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS turn FROM events),
k AS (SELECT user_id, event_id, event_type FROM c WHERE turn = 1 OR event_type IS DISTINCT FROM before) SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 30""")
def history_last30(spark, sf):
    return state.bounded_history(frame(spark, sf, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")


_JOBS = """SELECT event_id, CASE WHEN event_id % 17 = 0 THEN concat('tmp', CAST(event_id AS VARCHAR(20))) ELSE concat('job-', substr(md5(CAST(event_id AS VARCHAR(20))), 1, 8)) END AS name,
concat('job-', substr(md5(CAST(event_id + CASE WHEN event_id % 23 = 0 THEN 1 ELSE 0 END AS VARCHAR(20))), 1, 8)) AS job_id, CASE event_id % 5 WHEN 0 THEN 'analyzing' WHEN 1 THEN 'failed' ELSE 'ready' END AS status,
event_id * 1000 AS created, event_id * 1000 + CASE WHEN event_id % 29 = 0 THEN -5 ELSE 700 END AS updated FROM events"""


@query("retention", twin("""SELECT event_id, CASE WHEN NOT regexp_full_match(name, 'job-[0-9a-f]{8}') THEN 'not a regular job directory' WHEN job_id <> name THEN 'manifest job ID does not match directory' WHEN status = 'analyzing' THEN 'active job'
WHEN created > updated OR created > 600000 OR updated > 600000 THEN 'job is inside retention window or has inconsistent timestamps' END AS skipped FROM jobs""", jobs=_JOBS))
def retention(spark, sf):
    return state.retention(run(spark, sf, _JOBS), F.lit(600000)).select("event_id", "skipped")


@query("export_merge", "SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def export_merge(spark, sf):
    return state.last_write(frame(spark, sf, "events").select("user_id", "event_type", "value", "event_id"), ["user_id", "event_type"], "event_id")


_MANIFESTS = "SELECT c_custkey AS job, concat('plan/', CAST(c_custkey AS VARCHAR(20)), '.json') AS plan, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('audit/', CAST(c_custkey AS VARCHAR(20)), '.json') END AS audit, CASE WHEN c_custkey % 4 = 0 THEN 'export/a.pptx' END AS export FROM customer"


@query("manifest_paths", twin("SELECT job, kind, path FROM (SELECT job, 'plan' AS kind, plan AS path FROM manifests UNION ALL SELECT job, 'audit', audit FROM manifests UNION ALL SELECT job, 'export', export FROM manifests) WHERE path IS NOT NULL", manifests=_MANIFESTS))
def manifest_paths(spark, sf):
    return state.flattened_paths(run(spark, sf, _MANIFESTS), ["plan", "audit", "export"])


_REFS = "SELECT o_orderkey AS artifact_id, o_orderstatus AS kind, o_custkey AS size FROM orders"
_SAVED = "SELECT o_orderkey AS artifact_id, CASE WHEN o_orderkey % 9 = 0 THEN 'X' ELSE o_orderstatus END AS kind, o_custkey + CASE WHEN o_orderkey % 31 = 0 THEN 1 ELSE 0 END AS size FROM orders"


@query("jury_binding", twin("SELECT r.artifact_id, r.kind, r.size FROM refs r WHERE NOT EXISTS (SELECT 1 FROM saved s WHERE s.artifact_id = r.artifact_id AND s.kind = r.kind AND s.size = r.size)", refs=_REFS, saved=_SAVED))
def jury_binding(spark, sf):
    return state.unbound_refs(run(spark, sf, _REFS), run(spark, sf, _SAVED), ["artifact_id", "kind", "size"])


#: Pages as files of a folder; some are links to others near them, some of these out of it.
_FILES = "SELECT concat('p/', CAST(page_id AS VARCHAR(20))) AS path FROM pages UNION ALL SELECT '../p' UNION ALL SELECT 'not/there'"
_LINKS = "SELECT concat('p/', CAST(page_id AS VARCHAR(20))) AS path, CASE WHEN length(url) % 11 = 0 THEN concat('../', host) ELSE concat('p/', CAST(page_id + length(html) % 9 - 4 AS VARCHAR(20))) END AS target FROM (SELECT page_id, url, html, split_part(url, '/', 3) AS host FROM pages) WHERE length(html) % 4 < 3"


@query("resolved_paths", twin("""WITH RECURSIVE walk AS (
  SELECT path, path AS node, []::VARCHAR[] AS seen FROM files
  UNION ALL SELECT w.path, l.target, list_append(w.seen, w.node) FROM walk w JOIN links l ON l.path = w.node WHERE NOT list_contains(w.seen, w.node)),
ends AS (SELECT path, arg_max(node, len(seen)) AS node, bool_or(list_contains(seen, node)) AS looped FROM walk GROUP BY path)
SELECT path, CASE WHEN NOT looped THEN node END AS resolved, CASE WHEN looped THEN 'cycle' WHEN len(list_filter(string_split(node || '/' || path, '/'), lambda s: s IN ('', '.', '..'))) > 0 THEN 'escape' END AS error FROM ends""", files=_FILES, links=_LINKS))
def resolved_paths(spark, sf):
    return state.resolved_paths(run(spark, sf, _FILES), run(spark, sf, _LINKS))


@query("artifact_refs", """WITH m AS (SELECT page_id::VARCHAR AS path, strlen(html) + CASE WHEN page_id % 8 = 0 THEN 1 ELSE 0 END AS size, CASE WHEN page_id % 9 = 0 THEN 'x' ELSE sha256(html) END AS sha FROM pages UNION ALL SELECT 'gone', 1, 'y')
SELECT m.path, CASE WHEN p.html IS NULL THEN 'missing' WHEN strlen(p.html) <> m.size THEN 'size_mismatch' WHEN sha256(p.html) <> m.sha THEN 'digest_mismatch' END AS error FROM m LEFT JOIN pages p ON p.page_id::VARCHAR = m.path""")
def artifact_refs(spark, sf):
    pages = frame(spark, sf, "pages")
    k = F.col("page_id")
    listed = pages.select(k.cast("string").alias("path"), (F.octet_length("html") + (k % 8 == 0).cast("int")).alias("size"), F.when(k % 9 == 0, "x").otherwise(F.sha2("html", 256)).alias("sha"))
    listed = listed.unionByName(spark.range(1).select(F.lit("gone").alias("path"), F.lit(1).alias("size"), F.lit("y").alias("sha")))
    return state.reference_errors(listed, pages.select(k.cast("string").alias("path"), F.col("html").cast("binary").alias("content")))


_GUARD = """WITH RECURSIVE a AS (SELECT user_id AS key, CASE WHEN event_type = 'click' THEN 'export' ELSE 'generation' END AS kind, epoch_ms(ts) AS now, event_id AS seq, value > 20 AS busy FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY key, kind ORDER BY now, seq) AS k, CASE kind WHEN 'export' THEN 30 ELSE 5 END AS cap FROM a),
r AS (SELECT DISTINCT key, kind, 0::BIGINT AS k, 0::BIGINT AS seq, 0 AS status, 0 AS retry_after, []::BIGINT[] AS times FROM o
UNION ALL SELECT key, kind, k, seq, CASE WHEN len(kept) >= cap THEN 429 WHEN busy THEN 503 ELSE 200 END, CASE WHEN len(kept) >= cap THEN greatest(1, ceil((kept[1] + 21600000 - now) / 1000.0))::INTEGER WHEN busy THEN {busy} ELSE 0 END, CASE WHEN len(kept) >= cap THEN kept ELSE list_append(kept, now) END
FROM (SELECT o.key, o.kind, o.k, o.seq, o.now, o.busy, o.cap, list_filter(r.times, lambda t: t > o.now - 21600000) AS kept FROM r JOIN o ON o.key = r.key AND o.kind = r.kind AND o.k = r.k + 1))
SELECT key, kind, seq, status, retry_after FROM r WHERE k > 0"""


def _millis(at):
    """Milliseconds of a time as epoch_ms gives them: to the nearest, halves away from zero."""
    return F.unix_millis(F.timestamp_micros(F.round(F.unix_micros(at), -3)))


@query("rate_guard", _GUARD.replace("{busy}", str(state.BUSY_RETRY_S)))
def rate_guard(spark, sf):
    events = frame(spark, sf, "events")
    requests = events.select("user_id", F.when(F.col("event_type") == "click", "export").otherwise("generation").alias("kind"), _millis(F.col("ts").cast("timestamp")).alias("at"), "event_id", (F.col("value") > 20).alias("busy"))
    return state.admitted(requests, "user_id", "kind", "at", "event_id", "busy", {"generation": 5, "export": 30}, 6 * 3_600_000)


@query("extension_windowed_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2")
def extension_windowed_counts(spark, sf):
    return windows.windowed_counts(frame(spark, sf, "events"))


@query("extension_pricing_summary", """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, avg(l_discount) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def extension_pricing_summary(spark, sf):
    rows = frame(spark, sf, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.avg("l_discount").alias("avg_disc"), F.count("*").alias("n"))


@query("extension_top_customers", """SELECT c_mktsegment, c_custkey, total, place FROM (SELECT c_mktsegment, c_custkey, round(sum(o_totalprice), 2) AS total, row_number() OVER (PARTITION BY c_mktsegment ORDER BY round(sum(o_totalprice), 2) DESC, c_custkey) AS place FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_mktsegment, c_custkey) WHERE place <= 5""")
def extension_top_customers(spark, sf):
    from pyspark.sql import Window

    totals = frame(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    joined = frame(spark, sf, "customer").select("c_custkey", "c_mktsegment").join(totals, "c_custkey")
    place = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("total"), "c_custkey"))
    return joined.withColumn("place", place).filter("place <= 5").select("c_mktsegment", "c_custkey", "total", F.col("place").cast("long").alias("place"))


_ROLES = "['evidence-analyst', 'final-jury', 'narrative-architect', 'repair-planner', 'semantic-critic', 'template-analyst', 'variant-designer-balanced', 'variant-designer-compact', 'variant-designer-visual', 'visual-critic', 'visual-director']"


#: Customers ask for roles, by the first letters of their segment and name; some of the names are none.
_CALLED = f"SELECT CASE WHEN c_nationkey % 12 < 11 THEN element_at(array({_ROLES[1:-1]}), CAST(c_nationkey % 12 + 1 AS INT)) ELSE 'nobody' END AS id FROM customer"
_CALLED_TWIN = f"SELECT CASE WHEN c_nationkey % 12 < 11 THEN {_ROLES}[c_nationkey % 12 + 1] ELSE 'nobody' END AS id FROM customer"


@query("role_registry", f"SELECT coalesce(r.id, c.id) AS id, CASE WHEN r.id IS NOT NULL THEN 'v1' END AS version, CASE WHEN r.id IS NOT NULL THEN 'executable' END AS status, 'agents/' || r.id || '/v1/contract.json' AS contract, 'prompts/agents/' || r.id || '/v1/system.md' AS prompt, coalesce(c.n, 0) AS calls FROM (SELECT unnest({_ROLES}) AS id) r FULL JOIN (SELECT id, count(*) AS n FROM ({_CALLED_TWIN}) GROUP BY id) c ON c.id = r.id")
def role_registry(spark, sf):
    """All roles, and how often they are called; calls of names that are no roles have no contract."""
    calls = run(spark, sf, _CALLED).groupBy("id").agg(F.count("*").alias("calls"))
    return contracts.listed(spark).join(calls, "id", "full_outer").select("id", "version", "status", "contract", "prompt", F.coalesce("calls", F.lit(0)).alias("calls"))


@query("role_violations", """SELECT c_custkey AS run, CASE c_custkey % 6 WHEN 0 THEN '$.operations[0].rationale' WHEN 1 THEN '$.operations' WHEN 2 THEN '$.round' WHEN 3 THEN '$.more' WHEN 4 THEN '$' END AS error FROM customer""")
def role_violations(spark, sf):
    """Repair plans of which one of six kinds holds."""
    k = F.col("c_custkey") % 6
    step = lambda why: f'{{"id":"a","slideId":"s1","operation":"rewrite","rationale":"{why}"}}'
    plan = lambda **own: "{" + ",".join(f'"{n}":{v}' for n, v in ({"version": '"v1"', "variant": '"visual"', "round": "1", "status": '"repair"', "operations": f"[{step('shorter')}]"} | own).items()) + "}"
    kinds = (plan(operations=f"[{step('')}]"), plan(status='"no_repair"'), plan(round="3"), plan(more="1"), "no plan", plan())
    value = F.element_at(F.array(*[F.lit(x) for x in kinds]), (k + 1).cast("int"))
    return frame(spark, sf, "customer").select(F.col("c_custkey").alias("run"), contracts.violation(F.lit("repair-planner"), F.lit("output"), value).alias("error"))


@query("partial_outputs", """SELECT o_custkey AS job, concat('j', o_custkey, '/', o_orderkey) AS path FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_custkey % 9 <> 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderkey % 3) FILTER (WHERE o_orderkey % 40 <> 0) = 3 AND count(*) FILTER (WHERE o_orderkey % 40 = 0) = 0)""")
def partial_outputs(spark, sf):
    k = F.col("o_orderkey")
    jobs = frame(spark, sf, "customer").select(F.col("c_custkey").alias("job"), F.when(F.col("c_custkey") % 9 == 0, "analyzing").otherwise("generating").alias("status"))
    made = frame(spark, sf, "orders").select(F.col("o_custkey").alias("job"), F.when(k % 3 == 0, "plan").when(k % 3 == 1, "variant").otherwise("audit").alias("kind"), (k % 40 != 0).alias("intact"), F.concat(F.lit("j"), F.col("o_custkey").cast("string"), F.lit("/"), k.cast("string")).alias("path"))
    after = decks.publishable(jobs, made, ("plan", "variant", "audit"))
    return decks.partial_outputs(jobs, after, made)


@query("render_sets", """SELECT page_id % 40 AS run, CASE page_id % 3 WHEN 0 THEN 'compact' WHEN 1 THEN 'balanced' ELSE 'visual' END AS variant, page_id AS page, CASE WHEN page_id % 7 = 0 THEN 'size_mismatch' WHEN page_id % 7 = 1 THEN 'digest_mismatch' WHEN page_id % 7 = 2 THEN 'not_a_png' END AS error FROM pages""")
def render_sets(spark, sf):
    import base64

    png = base64.b64decode("iVBORw0KGgoAAAANSUhEUgAAAAIAAAABCAAAAADRSSBWAAAAC0lEQVR4nGPgEgEAACsAH5dshyUAAAAASUVORK5CYII=")
    n = F.col("page_id") % 7
    whole, cut = F.unhex(F.lit(png.hex())), F.unhex(F.lit(png[:-3].hex()))
    content = F.when(n == 2, cut).otherwise(whole)
    variant = F.element_at(F.array(*[F.lit(v) for v in decks.VARIANTS]), (F.col("page_id") % 3 + 1).cast("int"))
    rendered = frame(spark, sf, "pages").select((F.col("page_id") % 40).alias("run"), variant.alias("variant"), F.col("page_id").alias("page"), content.alias("content"), (F.octet_length(content) + (n == 0).cast("int")).alias("bytes"), F.when(n == 1, F.lit("0" * 64)).otherwise(F.sha2(content, 256)).alias("sha"))
    return decks.render_errors(rendered)
