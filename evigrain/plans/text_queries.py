"""Queries over text expressions: normalisation, extraction, inference, paths, failures."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigrain.functions import cells, ids, text
from evigrain.operators import rank
from evigrain.plans.registered import registry
from evigrain.plans.standins import frame, run, twin

QUERIES, ORACLE_SQL, query = registry()

_NORMAL = r"lower(trim(regexp_replace({}, '\s+', ' ', 'g')))"


def _norm(x: str) -> str:
    return _NORMAL.format(x)


@query("line_locators", r"SELECT doc_id, concat('lines:1-', len(regexp_split_to_array(substr(text, 1, 50000), '\r\n|\n|\r'))) AS locator FROM documents")
def line_locators(spark, sf):
    return frame(spark, sf, "documents").select("doc_id", text.line_locator(F.col("text")).alias("locator"))


@query("compact_text", r"""WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) > 280 THEN concat(rtrim(substr(t, 1, 279)), '…') ELSE t END AS compacted FROM c""")
def compact_text(spark, sf):
    return frame(spark, sf, "documents").select("doc_id", text.compact(F.col("text"), 280).alias("compacted"))


@query("normalized_text", f"SELECT doc_id, {_norm('text')} AS normalized FROM documents")
def normalized_text(spark, sf):
    return frame(spark, sf, "documents").select("doc_id", text.normalized(F.col("text")).alias("normalized"))


@query("text_tokens", r"SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS n_tokens, md5(array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ' ')) AS tokens_md5 FROM documents")
def text_tokens(spark, sf):
    found = frame(spark, sf, "documents").select("doc_id", text.tokens(F.col("text")).alias("tokens"))
    return found.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


@query("excerpts", r"""WITH s AS (SELECT doc_id, string_split_regex(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM documents),
f AS (SELECT doc_id, list_filter(list_transform(parts, lambda p: trim(p)), lambda p: length(p) >= 45)[1:12] AS kept FROM s),
c AS (SELECT doc_id, list_transform(kept, lambda p: CASE WHEN length(p) > 280 THEN concat(rtrim(substr(p, 1, 279)), '…') ELSE p END) AS e FROM f)
SELECT doc_id, generate_subscripts(e, 1) AS ord, unnest(e) AS excerpt FROM c""")
def excerpts(spark, sf):
    return frame(spark, sf, "documents").select("doc_id", F.posexplode(text.excerpts(F.col("text"))).alias("at", "excerpt")).select("doc_id", (F.col("at") + 1).cast("long").alias("ord"), "excerpt")


@query("keyword_top20", rf"""WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}-]{{4,}}')) AS word FROM documents)
SELECT word, count(*) AS n FROM w WHERE word NOT IN ({", ".join(f"'{w}'" for w in text.STOP_WORDS)}) GROUP BY word ORDER BY n DESC, word COLLATE ru LIMIT 20""")
def keyword_top20(spark, sf):
    return rank.top_keywords(frame(spark, sf, "documents"), "text", collation="ru")


@query("value_inference", twin(r"""SELECT source_id, row_no, col_no,
CASE WHEN lower(trim(text)) IN ('true', 'false') THEN 'boolean' WHEN regexp_full_match(trim(text), '-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?') THEN 'number' ELSE 'string' END AS value_type,
CASE WHEN lower(trim(text)) IN ('true', 'false') THEN lower(trim(text)) = 'true' END AS value_bool,
CASE WHEN regexp_full_match(trim(text), '-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?') THEN TRY_CAST(trim(text) AS DOUBLE) END AS value_num,
CASE WHEN lower(trim(text)) NOT IN ('true', 'false') AND NOT regexp_full_match(trim(text), '-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?') THEN text END AS value_str FROM cells"""))
def value_inference(spark, sf):
    return frame(spark, sf, "cells").select("source_id", "row_no", "col_no", F.inline(F.array(text.inferred(F.col("text")))))


@query("numeric_claims", twin(r"""SELECT chunk_id, list_transform(regexp_extract_all(regexp_replace(concat(' total ', substr(chunk_id, 2), ' or 3,5 and -2.25 on 2024-01-15'), '(\d)-(\d)', '\1 \2', 'g'), '[+-]?\d+(?:[.,]\d+)?'), lambda v: CAST(replace(v, ',', '.') AS DOUBLE))::VARCHAR AS claims FROM chunks"""))
def numeric_claims(spark, sf):
    own = frame(spark, sf, "chunks").select("chunk_id", F.concat(F.lit(" total "), F.expr("substr(chunk_id, 2)"), F.lit(" or 3,5 and -2.25 on 2024-01-15")).alias("text"))
    return own.select("chunk_id", F.concat(F.lit("["), F.array_join(F.transform(text.numeric_claims(F.col("text")), lambda v: v.cast("string")), ", "), F.lit("]")).alias("claims"))


@query("date_claims", twin(r"SELECT chunk_id, len(regexp_extract_all(text, '\b\d{4}-\d{2}-\d{2}\b')) AS n_dates, regexp_extract(text, '\b\d{4}-\d{2}-\d{2}\b') AS first_date FROM chunks"))
def date_claims(spark, sf):
    found = frame(spark, sf, "chunks").select("chunk_id", text.date_claims(F.col("text")).alias("dates"))
    return found.select("chunk_id", F.size("dates").cast("long").alias("n_dates"), F.coalesce(F.get("dates", 0), F.lit("")).alias("first_date"))


_BRIEFS = """SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN concat('Make ', CAST(3 + conv_id % 15 AS VARCHAR(9)), ' slides about it. ', text)
WHEN 1 THEN concat('A deck of 8 to 10 slides. ', text) WHEN 2 THEN concat('slides: ', CAST(6 + conv_id % 9 AS VARCHAR(9)), ' please. ', text) ELSE text END AS brief, 5 + conv_id % 11 AS selected FROM conversations"""


@query("slide_count_phrase", twin(r"""WITH n AS (SELECT conv_id, turn, selected, CASE turn % 4 WHEN 0 THEN [3 + conv_id % 15] WHEN 1 THEN [8, 10] WHEN 2 THEN [6 + conv_id % 9] ELSE [] END AS found FROM briefs)
SELECT conv_id, turn, CASE WHEN len(found) = 1 AND found[1] BETWEEN 5 AND 15 THEN found[1] ELSE selected END AS slide_count, CASE WHEN len(found) = 1 AND found[1] BETWEEN 5 AND 15 THEN 'brief' ELSE 'selection' END AS count_source FROM n""", briefs=_BRIEFS))
def slide_count_phrase(spark, sf):
    from evigrain.functions import phrases

    found = phrases.effective_count(F.col("brief"), F.col("selected"))
    return run(spark, sf, _BRIEFS).select("conv_id", "turn", F.inline(F.array(found)))


_STEPS = """SELECT conv_id, turn, concat(text, CASE WHEN conv_id % 3 = 0 THEN concat(chr(10), 'Следующие шаги: проверить ', role, ' сегодня') ELSE '' END) AS text FROM conversations"""


@query("next_steps", twin("SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN concat('проверить ', role, ' сегодня') END AS next_steps FROM conversations"))
def next_steps(spark, sf):
    return run(spark, sf, _STEPS).select("conv_id", "turn", text.next_steps(F.col("text")).alias("next_steps"))


@query("brief_title", r"""WITH l AS (SELECT conv_id, turn, coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> '')[1], 'Новая презентация') AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN length(t) > 90 THEN concat(rtrim(substr(t, 1, 87)), '…') ELSE t END AS title FROM l""")
def brief_title(spark, sf):
    return frame(spark, sf, "conversations").select("conv_id", "turn", text.brief_title(F.col("text")).alias("title"))


@query("split_signal", rf"""WITH p AS (SELECT conv_id, turn, list_filter(list_transform(string_split_regex(regexp_replace(text, '[;:]', '.', 'g'), '[.!?]\s+'), lambda s: trim(s)), lambda s: s <> '')[1:4] AS parts FROM conversations),
q AS (SELECT conv_id, turn, list_concat(parts, list_transform(range(len(parts), 4), lambda i: [{", ".join(f"'{s}'" for s in text.SUPPLEMENTS)}][((i + 3) % 4) + 1])) AS parts FROM p)
SELECT conv_id, turn, array_to_string(list_transform(parts, lambda s: CASE WHEN length(s) > 140 THEN concat(rtrim(substr(s, 1, 137)), '…') ELSE s END), '|') AS parts FROM q""")
def split_signal(spark, sf):
    return frame(spark, sf, "conversations").select("conv_id", "turn", F.array_join(text.split_signal(F.col("text"), 4), "|").alias("parts"))


@query("round_robin_signal", """WITH s AS (SELECT *, CASE WHEN conv_id % 4 = 0 THEN [] WHEN conv_id % 4 = 1 THEN ['', 'b'] ELSE ['a', 'b', 'c'] END AS signals FROM conversations)
SELECT conv_id, turn, CASE WHEN coalesce(signals[(turn % greatest(len(signals), 1)) + 1], '') = '' THEN role ELSE signals[(turn % greatest(len(signals), 1)) + 1] END AS signal FROM s""")
def round_robin_signal(spark, sf):
    chosen = F.when(F.col("conv_id") % 4 == 0, F.array().cast("array<string>")).when(F.col("conv_id") % 4 == 1, F.array(F.lit(""), F.lit("b"))).otherwise(F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    return frame(spark, sf, "conversations").select("conv_id", "turn", text.round_robin(chosen, F.col("turn").cast("int"), F.col("role")).alias("signal"))


@query("card_clauses", r"SELECT conv_id, turn, array_to_string(list_filter(list_transform(regexp_extract_all(text, '[^,;.!?]+[,;.!?]?'), lambda s: trim(s, ' ' || chr(10) || chr(9) || chr(13))), lambda s: s <> ''), '|') AS clauses FROM conversations")
def card_clauses(spark, sf):
    return frame(spark, sf, "conversations").select("conv_id", "turn", F.array_join(text.clauses(F.col("text")), "|").alias("clauses"))


@query("packed_cards", "WITH w AS (SELECT conv_id, turn, string_split(text, ' ') AS items FROM conversations) SELECT conv_id, turn, array_to_string(CASE WHEN len(items) <= 3 THEN items ELSE list_append(items[1:2], array_to_string(items[3:], ' · ')) END, '|') AS cards FROM w")
def packed_cards(spark, sf):
    return frame(spark, sf, "conversations").select("conv_id", "turn", F.array_join(text.packed(F.split("text", " "), 3), "|").alias("cards"))


@query("token_estimate", "SELECT doc_id, CAST(ceil(strlen(text) / 3.0) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, sf):
    return frame(spark, sf, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query("placeholder_text", twin(r"SELECT slide_id, ord, regexp_matches(concat(' ', lower(text), ' '), '[^\p{L}\p{N}_](lorem\s+ipsum|xxx|todo|вставьте\s+текст)[^\p{L}\p{N}_]') AS is_placeholder FROM elements"))
def placeholder_text(spark, sf):
    return frame(spark, sf, "elements").select("slide_id", "ord", text.is_placeholder(F.col("text")).alias("is_placeholder"))


_ERRORS = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN concat('call failed: token=abc', CAST(user_id AS VARCHAR(20)), ' for ', event_type) WHEN 1 THEN concat('timeout   after 60 s in ', event_type)
WHEN 2 THEN concat('password: hunter', CAST(user_id AS VARCHAR(20)), ' rejected') WHEN 3 THEN concat('HTTP 429 from ', event_type) ELSE concat('Unsupported claim in ', event_type) END AS message,
CASE event_id % 4 WHEN 3 THEN 'rendering' ELSE 'planning' END AS stage FROM events"""


@query("redacted_errors", twin(r"SELECT event_id, substr(trim(regexp_replace(regexp_replace(replace(replace(message, 'abc1', '[redacted]'), 'hunter', '[redacted]'), '[\r\n\t]+', ' ', 'g'), '\s{2,}', ' ', 'g')), 1, 240) AS safe FROM errors", errors=_ERRORS))
def redacted_errors(spark, sf):
    return run(spark, sf, _ERRORS).select("event_id", text.redacted(F.col("message"), ["abc1", "hunter"]).alias("safe"))


@query("failure_class", twin(r"""SELECT event_id, CASE WHEN stage <> 'planning' THEN 'unknown' WHEN regexp_matches(message, '(?i)timed out|timeout|abort') THEN 'provider_timeout' WHEN regexp_matches(message, '(?i)request failed with HTTP|HTTP \d{3}') THEN 'provider_http'
WHEN regexp_matches(message, '(?i)grounded claim|unsupported claim|grounding validation|duplicate claim id|sourcechunkid|factid|precision exact') THEN 'grounding_failed' WHEN regexp_matches(message, '(?i)not valid JSON|no planner content|unexpected token|JSON') THEN 'invalid_json' ELSE 'unknown' END AS failure FROM errors""", errors=_ERRORS))
def failure_class(spark, sf):
    return run(spark, sf, _ERRORS).select("event_id", rank.failure_class(F.col("stage"), F.col("message"), F.lit(None).cast("string")).alias("failure"))


_PATHS = """SELECT page_id, CASE page_id % 6 WHEN 0 THEN concat('a/', CAST(page_id AS VARCHAR(20)), '.json') WHEN 1 THEN '../up' WHEN 2 THEN concat('/abs/', CAST(page_id AS VARCHAR(20))) WHEN 3 THEN 'a//b' WHEN 4 THEN 'x/./y' ELSE concat('deep/er/', CAST(page_id AS VARCHAR(20))) END AS path FROM pages"""


@query("path_safety", twin("SELECT page_id, path <> '' AND len(list_filter(string_split(path, '/'), lambda s: s IN ('', '.', '..'))) = 0 AS safe FROM paths", paths=_PATHS))
def path_safety(spark, sf):
    return run(spark, sf, _PATHS).select("page_id", text.safe_path(F.col("path")).alias("safe"))


@query("text_budget", """WITH r AS (SELECT source, doc_id, length(text) AS n, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id) AS upto FROM documents)
SELECT source, doc_id, CAST(greatest(0, least(n, 50000 - (upto - n))) AS BIGINT) AS kept_chars FROM r""")
def text_budget(spark, sf):
    return rank.running_budget(frame(spark, sf, "documents"), "source", "doc_id", "text", text.TEXT_LIMIT)


_LAYOUTS = """SELECT slide_id, ord, CASE ord % 8 WHEN 0 THEN 'Title_Slide' WHEN 1 THEN 'Основной текст' WHEN 2 THEN 'Wrap-up notes' WHEN 3 THEN 'Roadmap 2' WHEN 4 THEN 'Feature grid' WHEN 5 THEN 'Спасибо' WHEN 6 THEN 'Flowchart' ELSE 'Blank' END AS name FROM elements"""


@query("layout_role", twin("SELECT slide_id, ord, CASE ord % 8 WHEN 0 THEN 'opening' WHEN 1 THEN 'content' WHEN 2 THEN 'ending' WHEN 3 THEN 'timeline' WHEN 4 THEN 'cards' WHEN 5 THEN 'ending' WHEN 6 THEN 'diagram' END AS role FROM elements"))
def layout_role(spark, sf):
    return run(spark, sf, _LAYOUTS).select("slide_id", "ord", rank.layout_role(F.col("name")).alias("role"))


@query("stable_ids", r"""WITH s AS (SELECT doc_id, text, concat('doc', doc_id, '.txt') AS name FROM documents),
i AS (SELECT doc_id, text, concat('source-', substr(sha256(encode(name) || '\x00'::BLOB || encode(text)), 1, 24)) AS source_id, concat('lines:1-', len(regexp_split_to_array(text, '\r\n|\n|\r'))) AS locator FROM s)
SELECT doc_id, source_id, concat('chunk-', substr(sha256(encode(source_id) || '\x00'::BLOB || encode('0') || '\x00'::BLOB || encode(locator) || '\x00'::BLOB || encode(text)), 1, 24)) AS chunk_id FROM i""")
def stable_ids(spark, sf):
    docs = frame(spark, sf, "documents").withColumn("source_id", ids.source_id(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")), F.col("text")))
    locator = F.concat(F.lit("lines:1-"), text.line_count(F.col("text")).cast("string"))
    return docs.select("doc_id", "source_id", ids.chunk_id(F.col("source_id"), F.lit(0), locator, F.col("text")).alias("chunk_id"))


_FILES = """SELECT page_id, concat('dir.d/file', CAST(page_id AS VARCHAR(20)), CASE page_id % 7 WHEN 0 THEN '.XLSX' WHEN 1 THEN '.pdf' WHEN 2 THEN '.md' WHEN 3 THEN '.jpeg' WHEN 4 THEN '' WHEN 5 THEN '.tar.csv' ELSE '.exe' END) AS name FROM pages"""


@query("mime_lookup", twin("""SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet' WHEN 1 THEN 'application/pdf' WHEN 2 THEN 'text/markdown' WHEN 3 THEN 'image/jpeg' WHEN 5 THEN 'text/csv' ELSE 'application/octet-stream' END AS mime FROM files""", files=_FILES))
def mime_lookup(spark, sf):
    return run(spark, sf, _FILES).select("page_id", cells.media_type(F.col("name")).alias("mime"))
