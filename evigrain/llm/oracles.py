"""DuckDB SQL for the queries that SQL can express, over the same tables."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, length(text) AS chars,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, '')))), 1, 13))::BIGINT AS bits
  FROM documents),
keyed AS (
  SELECT doc_id, source, size, -ln((bits + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) /
         CASE WHEN size > 0 THEN 1.0::DOUBLE / (1.0::DOUBLE + abs(chars::DOUBLE / size::DOUBLE - 6.0::DOUBLE)) ELSE 1.0::DOUBLE END AS key
  FROM sized),
totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM keyed GROUP BY source),
weighted AS (SELECT *, (CASE (sid - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM totals),
turns AS (SELECT *, row_number() OVER (ORDER BY cap / weight, sid) AS turn FROM weighted),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
         / sum(weight) OVER (ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM turns),
aimed AS (
  SELECT l.*, CASE WHEN o.level IS NULL THEN cap ELSE least(cap, o.level * weight) END AS target
  FROM levels l LEFT JOIN (SELECT level FROM levels WHERE level < cap / weight ORDER BY turn LIMIT 1) o ON true),
planned AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM aimed),
budgets AS (SELECT *, floor(target - epochs * source_size)::BIGINT AS rest FROM planned),
filed AS (
  SELECT k.doc_id, k.size, k.key, b.sid, b.source_size, b.target, b.epochs, b.rest
  FROM keyed k JOIN budgets b ON k.source IS NOT DISTINCT FROM b.source),
tied AS (SELECT sid, key, doc_id, sum(size)::BIGINT AS words FROM filed GROUP BY sid, key, doc_id),
running AS (SELECT *, sum(words) OVER (PARTITION BY sid ORDER BY key, doc_id NULLS FIRST)::BIGINT AS upto FROM tied)
SELECT f.doc_id, f.size, f.source_size, f.target,
       (f.size * f.epochs + CASE WHEN r.upto <= f.rest THEN f.size WHEN r.upto - r.words < f.rest THEN f.size * (f.rest - r.upto + r.words) // r.words ELSE 0 END)::BIGINT AS taken
FROM filed f JOIN running r ON r.sid = f.sid AND r.key = f.key AND r.doc_id IS NOT DISTINCT FROM f.doc_id
"""

DECONTAMINATION = f"""
WITH item_words AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
patterns AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM item_words, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
doc_words AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
places AS (
  SELECT rid, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM doc_words, (SELECT DISTINCT k FROM patterns), unnest(range(1, len(w) - k + 2)) AS t(i)),
found AS (SELECT rid, i, k, item_id FROM places JOIN patterns USING (k, g)),
hits AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT DISTINCT rid, i, k FROM found), unnest(range(i, i + k)) AS t(p) GROUP BY rid),
items AS (SELECT rid, count(item_id) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT rid, item_id FROM found) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hits.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hits USING (rid) LEFT JOIN items USING (rid)
"""

WARC = """
WITH sized AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM sized)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM firsts
"""

_CRC_TABLE = r"""
crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) AS r(i))"""


def _crc32(text: str) -> str:
    """The unsigned crc32 of a text's UTF-8 bytes, with crc_table in the same FROM."""
    octets = f"list_transform(range(strlen({text})), lambda k: ('0x' || substr(hex(encode({text})), 2 * k + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


VARIANTS = rf"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
long_runs AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS named, run, count(*) AS times FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, times, {_crc32('named')} AS h FROM long_runs, crc_table),
spelled AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, times FROM hashed),
words AS (SELECT word, sum(times)::BIGINT AS n FROM spelled WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) AS t(i)),
pairs AS (
  SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word FROM cut c JOIN words w ON c.rest = w.word),
near AS (
  SELECT a AS word, count(*) AS n_near, arg_min(struct_pack(b, n), struct_pack(m := -n, b)) AS best
  FROM pairs JOIN words ON words.word = b GROUP BY a),
forms AS (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 10 * words.n THEN best.b END AS form, CASE WHEN best.n >= 10 * words.n THEN best.n END AS form_n
  FROM words LEFT JOIN near USING (word)),
follow AS (
  SELECT word, word AS node, 0 AS step FROM forms
  UNION ALL SELECT follow.word, forms.form, step + 1 FROM follow JOIN forms ON forms.word = follow.node WHERE forms.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, arg_max(node, step) AS root FROM follow GROUP BY word) USING (word)
"""

RUNS = rf"""
WITH {_CRC_TABLE},
plain AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> ''), []) AS w FROM documents),
hashed AS (SELECT rid, doc_id, w, len(w) AS n, {_crc32("doc_id::VARCHAR")} AS h FROM plain, crc_table),
placed AS (SELECT *, (h // 10) % n AS a FROM hashed),
docs AS (
  SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN
    list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END]) ELSE w END AS w FROM placed),
words AS (SELECT rid, n, unnest(range(n)) AS i, unnest(w) AS word FROM docs),
pairs AS (
  SELECT a.rid, a.i, b.i - a.i AS q FROM words a JOIN words b ON a.rid = b.rid AND a.word = b.word AND b.i > a.i AND 4 * (b.i - a.i) <= greatest(a.n, 4)),
often AS (SELECT rid, q FROM pairs GROUP BY rid, q HAVING count(*) >= greatest(6 - q, 3 * q)),
islands AS (
  SELECT rid, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM pairs SEMI JOIN often USING (rid, q))
  GROUP BY rid, q, island HAVING count(*) >= greatest(6 - q, 3 * q)),
runs AS (
  SELECT * FROM islands r ANTI JOIN islands s ON s.rid = r.rid AND s.q < r.q AND r.q % s.q = 0 AND s.start <= r.start AND s.start + s.length >= r.start + r.length),
listed AS (
  SELECT rid, count(*) AS n_runs, min(struct_pack(l := -length, start, q)) AS best, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines
  FROM runs GROUP BY rid),
gone AS (SELECT DISTINCT rid, unnest(range(start + q, start + length)) AS i FROM runs),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS collapsed FROM words ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, -best.l AS length, best.q AS period, (1000 * -best.l) // best.q AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM docs LEFT JOIN listed USING (rid) LEFT JOIN kept USING (rid)
"""
