"""Queries over source formats: CSV, spreadsheet cells, office packages, images, JSON, and ordered passes."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigrain.functions import cells, geometry, jsontext
from evigrain.functions.text import decoded
from evigrain.operators import folds
from evigrain.plans.registered import registry
from evigrain.plans.standins import frame, run, twin
from evigrain.runtime import spread
from evigrain.sources import csvtext, images, material, office

QUERIES, ORACLE_SQL, query = registry()

_CSV = """SELECT conv_id, turn, concat('id,note', chr(10), CAST(conv_id AS VARCHAR(20)), ',"', replace(text, '"', '""'), '"', chr(10), 'x', ';y,', role) AS body FROM conversations"""


@query("csv_cells", twin("""WITH c AS (SELECT concat(conv_id, '/', turn) AS name, conv_id, role, text, len(string_split(text, chr(10))) AS lines FROM conversations)
SELECT name, 1::BIGINT AS row_no, 1::BIGINT AS col_no, 'id' AS text FROM c UNION ALL SELECT name, 1, 2, 'note' FROM c UNION ALL SELECT name, 2, 1, conv_id::VARCHAR FROM c UNION ALL SELECT name, 2, 2, text FROM c UNION ALL SELECT name, 2 + lines, 1, 'x;y' FROM c UNION ALL SELECT name, 2 + lines, 2, role FROM c"""))
def csv_cells(spark, sf):
    files = run(spark, sf, _CSV).select(F.concat_ws("/", "conv_id", "turn").alias("name"), F.col("body").alias("text"))
    return csvtext.cells(files).filter("error IS NULL").drop("error")


@query("csv_delimiter", """SELECT conv_id, turn, CASE WHEN len(regexp_replace(l, '[^;]', '', 'g')) > len(regexp_replace(l, '[^,]', '', 'g')) THEN ';' ELSE ',' END AS delimiter FROM (SELECT conv_id, turn, string_split(concat(regexp_replace(replace(text, '"', ''), ' ', ';', 'g')), chr(10))[1] AS l FROM conversations)""")
def csv_delimiter(spark, sf):
    first = F.get(F.split(F.regexp_replace(F.replace("text", F.lit('"'), F.lit("")), " ", ";"), "\n"), 0)
    return frame(spark, sf, "conversations").select("conv_id", "turn", cells.delimiter(first).alias("delimiter"))


@query("cell_references", "SELECT p_partkey, p_partkey % 900 + 1 AS col_no, p_size::BIGINT AS row_no FROM part")
def cell_references(spark, sf):
    named = frame(spark, sf, "part").select("p_partkey", cells.reference(F.col("p_size"), F.col("p_partkey") % 900 + 1).alias("ref"))
    return named.select("p_partkey", cells.column_number(F.col("ref")).alias("col_no"), cells.row_number_of(F.col("ref")).alias("row_no"))


@query("serial_dates", """WITH s AS (SELECT l_orderkey, l_linenumber, (l_orderkey * 13) % 60000 + l_linenumber / 8.0::DOUBLE AS serial FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN serial >= 60 AND serial < 61 THEN NULL ELSE strftime(epoch_ms(CAST(-2209075200000 + (floor(serial) - CASE WHEN floor(serial) >= 61 THEN 1 ELSE 0 END) * 86400000 + floor((serial - floor(serial)) * 86400000 + 0.5) AS BIGINT)), '%Y-%m-%dT%H:%M:%S.%gZ') END AS iso FROM s""")
def serial_dates(spark, sf):
    serial = F.col("l_orderkey") * 13 % 60000 + F.col("l_linenumber") / 8
    return frame(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", cells.serial_to_iso(serial, F.lit(False)).alias("iso"))


_FORMATS = """SELECT p_partkey, p_size AS id, CASE p_partkey % 5 WHEN 0 THEN '0.00' WHEN 1 THEN 'yyyy-mm' WHEN 2 THEN '"day" 0' WHEN 3 THEN '[Red]0\\d' ELSE 'h:mm d' END AS code FROM part"""


@query("date_formats", "SELECT p_partkey, p_size IN (14, 15, 16, 17, 18, 19, 20, 21, 22, 27, 28, 29, 30, 31, 32, 33, 34, 35, 36, 50, 51, 52, 53, 54, 55, 56, 57, 58) OR p_partkey % 5 IN (1, 4) AS is_date FROM part")
def date_formats(spark, sf):
    code = F.element_at(F.array(*[F.lit(x) for x in ("0.00", "yyyy-mm", '"day" 0', "[Red]0\\d", "h:mm d")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return frame(spark, sf, "part").select("p_partkey", cells.is_date_format(F.col("p_size"), code).alias("is_date"))


@query("cell_typing", """SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5 WHEN 0 THEN CASE WHEN l_orderkey % 3 = 2 THEN NULL ELSE 'boolean' END WHEN 1 THEN 'number' WHEN 2 THEN CASE WHEN l_orderkey % 2 = 0 THEN 'string' END WHEN 3 THEN 'string' ELSE NULL END AS value_type,
CASE l_linenumber % 5 WHEN 0 THEN CASE l_orderkey % 3 WHEN 0 THEN 'false' WHEN 1 THEN 'true' END WHEN 1 THEN l_orderkey::VARCHAR WHEN 2 THEN CASE WHEN l_orderkey % 2 = 0 THEN l_returnflag END WHEN 3 THEN l_linestatus ELSE NULL END AS text FROM lineitem""")
def cell_typing(spark, sf):
    n, k = F.col("l_linenumber") % 5, F.col("l_orderkey")
    kind = F.when(n == 0, "b").when(n == 1, F.lit(None)).when(n == 2, "s").when(n == 3, "inlineStr").otherwise("e")
    raw = F.when(n == 0, (k % 3).cast("string")).otherwise(k.cast("string"))
    shared = F.when(k % 2 == 0, F.col("l_returnflag"))
    typed = cells.typed_cell(kind, raw, shared, F.col("l_linestatus"), F.lit(False), F.lit(False))
    return frame(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.inline(F.array(typed)))


_RANGES = "SELECT p_partkey % 40 AS sheet, p_size AS r1, p_partkey % 13 AS c1, p_size + p_partkey % 3 AS r2, p_partkey % 13 + p_partkey % 4 - 1 AS c2 FROM part"
_MERGED = "SELECT sheet, r1, c1, min(r2) AS r2, min(c2) AS c2 FROM (SELECT DISTINCT * FROM ranges WHERE r1 <= r2 AND c1 <= c2 AND NOT (r1 = r2 AND c1 = c2)) GROUP BY sheet, r1, c1 HAVING count(*) = 1"


def _merged_ranges(spark, sf):
    valid = run(spark, sf, _RANGES).filter("r1 <= r2 AND c1 <= c2 AND NOT (r1 = r2 AND c1 = c2)").distinct()
    return valid.groupBy("sheet", "r1", "c1").agg(F.count("*").alias("n"), F.min("r2").alias("r2"), F.min("c2").alias("c2")).filter("n = 1").drop("n")


@query("merged_ranges", twin(_MERGED, ranges=_RANGES))
def merged_ranges(spark, sf):
    return _merged_ranges(spark, sf)


_PLACES = "SELECT p_partkey, p_partkey % 40 AS sheet, (p_partkey * 7) % 52 AS r, (p_partkey * 3) % 15 AS c FROM part"


@query("merged_cells", twin(f"""SELECT p.p_partkey, m.r1, m.c1, p.r <> m.r1 OR p.c <> m.c1 AS covered FROM places p JOIN ({_MERGED}) m ON m.sheet = p.sheet AND p.r BETWEEN m.r1 AND m.r2 AND p.c BETWEEN m.c1 AND m.c2 QUALIFY row_number() OVER (PARTITION BY p.p_partkey ORDER BY m.r1, m.c1, m.r2, m.c2) = 1""", ranges=_RANGES, places=_PLACES))
def merged_cells(spark, sf):
    inside = run(spark, sf, _PLACES).join(_merged_ranges(spark, sf), "sheet").filter("r BETWEEN r1 AND r2 AND c BETWEEN c1 AND c2")
    first = inside.groupBy("p_partkey", "r", "c").agg(F.min(F.struct("r1", "c1", "r2", "c2")).alias("m"))
    return first.select("p_partkey", "m.r1", "m.c1", ((F.col("r") != F.col("m.r1")) | (F.col("c") != F.col("m.c1"))).alias("covered"))


def _image_bytes():
    k = F.col("page_id")
    side = lambda n, size: F.unhex(F.lpad(F.hex(n), size, "0"))
    png = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), side(k % 300, 8), side(k + 1, 8), F.col("html").cast("binary"))
    gif = F.concat(F.lit("GIF89a").cast("binary"), F.unhex(F.lpad(F.hex(k % 200 + 1), 2, "0")), F.unhex(F.lit("000200")), F.col("html").cast("binary"))
    return F.when(k % 3 == 0, png).when(k % 3 == 1, gif).otherwise(F.col("html").cast("binary"))


@query("magic_bytes", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/gif' END AS mime FROM pages")
def magic_bytes(spark, sf):
    return frame(spark, sf, "pages").select("page_id", cells.image_type(_image_bytes()).alias("mime"))


@query("image_sizes", "SELECT page_id, CASE WHEN page_id % 3 = 0 AND page_id % 300 > 0 THEN page_id % 300 WHEN page_id % 3 = 1 THEN page_id % 200 + 1 END AS width, CASE WHEN page_id % 3 = 0 AND page_id % 300 > 0 THEN page_id + 1 WHEN page_id % 3 = 1 THEN 2 END AS height FROM pages")
def image_sizes(spark, sf):
    return frame(spark, sf, "pages").select("page_id", images.size_of(_image_bytes()).alias("s")).select("page_id", "s.width", "s.height")


_DOCX = '<?xml version="1.0"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{}</w:body></w:document>'


@F.arrow_udf(T.BinaryType())
def _as_docx(texts: pa.Array) -> pa.Array:
    out = []
    for text in texts.to_pylist():
        box = io.BytesIO()
        with zipfile.ZipFile(box, "w", zipfile.ZIP_DEFLATED) as package:
            package.writestr("word/document.xml", _DOCX.format("".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in (text or "").split("\n"))))
        out.append(box.getvalue())
    return pa.array(out, pa.binary())


@query("docx_paragraphs", """WITH l AS (SELECT concat(conv_id, '/', turn) AS name, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM conversations) SELECT name, text, concat('paragraph:', n) AS locator, 'exact' AS precision FROM l WHERE trim(text) <> ''""")
def docx_paragraphs(spark, sf):
    files = frame(spark, sf, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("path"), _as_docx(F.col("text")).alias("content"))
    return office.chunks(files, kind="docx").filter("error IS NULL").select("name", "text", "locator", "precision")


_BOOK = {
    "xl/workbook.xml": '<workbook xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><workbookPr/><sheets><sheet name="Talk" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl/styles.xml": '<styleSheet><numFmts><numFmt numFmtId="164" formatCode="yyyy"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>',
}


def _zipped(parts: dict[str, str]) -> bytes:
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w", zipfile.ZIP_DEFLATED) as package:
        for name, body in parts.items():
            package.writestr(name, body)
    return box.getvalue()


@F.arrow_udf(T.BinaryType())
def _as_xlsx(texts: pa.Array, numbers: pa.Array) -> pa.Array:
    """A sheet: the text as an inline and as a shared string, a number, a date, a flag, an empty cell, and a merged range over two cells."""
    out = []
    for text, n in zip(texts.to_pylist(), numbers.to_pylist(), strict=True):
        own = escape(text or "")
        rows = f'<row r="1"><c t="inlineStr"><is><t>{own}</t></is></c><c t="s"><v>0</v></c><c><v>{n}</v></c></row><row r="4"><c r="B4" s="1"><v>{40000 + n % 1000}</v></c><c r="C4" t="b"><v>{n % 2}</v></c><c r="D4"/></row><row r="5"><c r="B5" t="str"><f>A1</f><v>kept</v></c><c r="C5" t="str"><v>covered</v></c></row>'
        sheet = f'<worksheet><sheetData>{rows}</sheetData><mergeCells><mergeCell ref="B5:C6"/><mergeCell ref="C9:B8"/></mergeCells></worksheet>'
        out.append(_zipped(_BOOK | {"xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": f"<sst><si><t>{own}</t></si></sst>"}))
    return pa.array(out, pa.binary())


def _workbooks(spark, sf):
    talks = spread(frame(spark, sf, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn")
    return talks.select(F.concat_ws("/", "conv_id", "turn").alias("name"), _as_xlsx(F.col("text"), F.col("conv_id") * 10 + F.col("turn")).alias("content"))


@query("sheet_cells", """WITH c AS (SELECT concat(conv_id, '/', turn) AS name, text, conv_id * 10 + turn AS n FROM conversations), v AS (
SELECT name, 1 AS row_no, 1 AS col_no, 'string' AS value_type, text, NULL AS formula, NULL AS merged_range FROM c UNION ALL SELECT name, 1, 2, 'string', text, NULL, NULL FROM c UNION ALL SELECT name, 1, 3, 'number', n::VARCHAR, NULL, NULL FROM c
UNION ALL SELECT name, 4, 2, 'date', strftime(TIMESTAMP '1899-12-30' + to_days((40000 + n % 1000)::INTEGER), '%Y-%m-%dT%H:%M:%S.%gZ'), NULL, NULL FROM c UNION ALL SELECT name, 4, 3, 'boolean', CASE WHEN n % 2 = 1 THEN 'true' ELSE 'false' END, NULL, NULL FROM c UNION ALL SELECT name, 5, 2, 'string', 'kept', 'A1', 'B5:C6' FROM c)
SELECT name, 'Talk' AS sheet, row_no::BIGINT AS row_no, col_no::BIGINT AS col_no, value_type, text, formula, merged_range, concat('sheet:Talk,row:', row_no, ',column:', col_no) AS locator FROM v WHERE text <> ''""")
def sheet_cells(spark, sf):
    return material.sheet_facts(_workbooks(spark, sf)).filter("error IS NULL").drop("error")


@query("sheet_texts", """SELECT concat(conv_id, '/', turn) AS name, 'Talk' AS sheet, concat(CASE WHEN text <> '' THEN concat(text, chr(9), text, chr(9)) ELSE '' END, n, chr(10), strftime(TIMESTAMP '1899-12-30' + to_days((40000 + n % 1000)::INTEGER), '%Y-%m-%dT%H:%M:%S.%gZ'), chr(9), CASE WHEN n % 2 = 1 THEN 'true' ELSE 'false' END, chr(10), 'kept') AS text FROM (SELECT *, conv_id * 10 + turn AS n FROM conversations)""")
def sheet_texts(spark, sf):
    return material.sheet_texts(material.sheet_facts(_workbooks(spark, sf)))


@F.arrow_udf(T.BinaryType())
def _as_pptx(decks: pa.Array) -> pa.Array:
    """A slide a text, the last one first, every fifth hidden; decks of four slides name one slide twice, so that their order is in doubt."""
    out = []
    for slides in decks.to_pylist():
        order = list(range(len(slides), 0, -1))
        named = order + order[:1] * (len(slides) == 4)
        ids = "".join(f'<p:sldId id="{256 + i}" r:id="r{n}"/>' for i, n in enumerate(named))
        parts = {"ppt/presentation.xml": f'<p:presentation xmlns:p="urn:p" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>'}
        parts["ppt/_rels/presentation.xml.rels"] = "<Relationships>" + "".join(f'<Relationship Id="r{n}" Target="slides/slide{n}.xml"/>' for n in order) + "</Relationships>"
        for n, text in enumerate(slides, 1):
            hidden = ' show="0"' if n % 5 == 0 else ""
            parts[f"ppt/slides/slide{n}.xml"] = f'<p:sld xmlns:p="urn:p" xmlns:a="urn:a"{hidden}><a:t>{escape(text or "")}</a:t><a:t>{n}</a:t></p:sld>'
        out.append(_zipped(parts))
    return pa.array(out, pa.binary())


@query("deck_texts", """WITH s AS (SELECT conv_id::VARCHAR AS name, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS slides FROM conversations)
SELECT name, concat(CASE WHEN text <> '' THEN concat(text, ' ') ELSE '' END, n) AS text, CASE WHEN slides = 4 THEN 'document' ELSE concat('slide:', row_number() OVER (PARTITION BY name ORDER BY n DESC)) END AS locator, CASE WHEN slides = 4 THEN 'document' ELSE 'exact' END AS precision FROM s WHERE slides = 4 OR n % 5 <> 0""")
def deck_texts(spark, sf):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"])
    decks = frame(spark, sf, "conversations").groupBy(F.col("conv_id").cast("string").alias("path")).agg(ordered.alias("slides"))
    return office.chunks(decks.select("path", _as_pptx(F.col("slides")).alias("content")), kind="pptx").filter("error IS NULL").select("name", "text", "locator", "precision")


@query("material_chunks", """WITH f AS (SELECT conv_id AS upload, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn_no FROM conversations), k AS (SELECT *, turn % 5 AS kind, concat('f', turn, ['.TXT', '.md', '.csv', '.gif', '.zip'][turn % 5 + 1]) AS name FROM f WHERE turn_no <= 12)
SELECT upload, name, text, concat('lines:1-', len(string_split(text, chr(10)))) AS locator, 'exact' AS precision, NULL AS value_type, NULL AS error FROM k WHERE kind IN (0, 1)
UNION ALL SELECT upload, name, 'true', 'row:1,column:1', 'exact', 'boolean', NULL FROM k WHERE kind = 2 UNION ALL SELECT upload, name, turn::VARCHAR, 'row:1,column:2', 'exact', 'number', NULL FROM k WHERE kind = 2
UNION ALL SELECT upload, name, concat('image-mime:image/gif;bytes:', 13 + strlen(text), ';width:', 7, ';height:', 2), 'image:metadata', 'exact', NULL, NULL FROM k WHERE kind = 3 UNION ALL SELECT upload, name, NULL, NULL, NULL, NULL, 'Unsupported material type: .zip' FROM k WHERE kind = 4""")
def material_chunks(spark, sf):
    kind = (F.col("turn") % 5).cast("int")
    ext = F.element_at(F.array(*[F.lit(e) for e in (".TXT", ".md", ".csv", ".gif", ".zip")]), kind + 1)
    gif = F.concat(F.unhex(F.lit("47494638396107000200000000")), F.col("text").cast("binary"))
    content = F.when(kind == 2, F.concat(F.lit("true,"), F.col("turn").cast("string")).cast("binary")).when(kind == 3, gif).otherwise(F.col("text").cast("binary"))
    files = frame(spark, sf, "conversations").select(F.col("conv_id").alias("upload"), F.col("turn").alias("ord"), F.concat(F.lit("f"), F.col("turn").cast("string"), ext).alias("name"), content.alias("content"), F.lit("application/octet-stream").alias("mime"))
    return material.chunks(files)


@query("page_titles", r"""SELECT page_id, CASE WHEN page_id % 7 <> 3 THEN concat(replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), chr(1078), chr(65 + (page_id % 20)::INTEGER), chr(128512), CASE WHEN page_id % 7 = 5 THEN '&amp' ELSE '&lt;' END) END AS title FROM pages""")
def page_titles(spark, sf):
    """Titles with numeric entities put behind them; in every seventh page one that is no XML entity."""
    number = F.concat(F.lit("&#"), (F.col("page_id") % 20 + 65).cast("string"), F.lit(";"))
    last = F.when(F.col("page_id") % 7 == 3, "&nbsp;").when(F.col("page_id") % 7 == 5, "&amp").otherwise("&amp;lt;")
    title = F.concat(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("&#x436;"), number, F.lit("&#x1F600;"), last)
    return frame(spark, sf, "pages").select("page_id", decoded(title).alias("title"))


@query("canonical_json", """SELECT event_id, concat('{"a":{"y":', event_id, ',"z":1},"k":', json_extract(props, '$.k'), '}') AS canonical FROM events""")
def canonical_json(spark, sf):
    text = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "a": {"z": 1.0, "y": '), F.col("event_id").cast("string"), F.lit("}}"))
    return frame(spark, sf, "events").select("event_id", jsontext.canonical_json(text).alias("canonical"))


@query("json_in_answer", """SELECT event_id, concat('{"k":', json_extract(props, '$.k'), '}') AS found FROM events""")
def json_in_answer(spark, sf):
    k = F.col("event_id") % 3
    text = F.when(k == 0, F.concat(F.lit("<think>{</think> so ```json\n"), F.col("props"), F.lit("\n``` done"))).when(k == 1, F.concat(F.lit("Result: "), F.col("props"), F.lit(" as asked"))).otherwise(F.col("props"))
    return frame(spark, sf, "events").select("event_id", jsontext.json_object(text).alias("found"))


@query("nfkc_text", r"SELECT doc_id, lower(trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g'))) AS normalized FROM documents")
def nfkc_text(spark, sf):
    from evigrain.functions.text import normalized

    return frame(spark, sf, "documents").select("doc_id", normalized(jsontext.nfkc(F.col("text"))).alias("normalized"))


_FIT_LINES = """RECURSIVE tries AS (SELECT slide_id, ord, text, s::DOUBLE AS size, w, h FROM elements, unnest(range(14, greatest(14, font_size::INTEGER) + 1)) AS t(s) WHERE type = 'text'),
words AS (SELECT slide_id, ord, size, h, list_filter(string_split(text, ' '), lambda x: x <> '') AS ws, greatest(4, floor(w / greatest(5.0::DOUBLE, size * 0.62::DOUBLE))::INTEGER) AS most FROM tries),
steps AS (SELECT slide_id, ord, size, h, ws, most, 0 AS k, 0 AS done, 0 AS now FROM words UNION ALL
SELECT slide_id, ord, size, h, ws, most, k + 1, done + CASE WHEN breaks THEN 1 ELSE 0 END + cut, CASE WHEN now > 0 AND NOT breaks THEN now + 1 ELSE 0 END + n - cut * most FROM (SELECT *, now > 0 AND now + 1 + n > most AS breaks, CASE WHEN n > most THEN (n - 1) // most ELSE 0 END AS cut FROM (SELECT *, length(ws[k + 1]) AS n FROM steps WHERE k < len(ws))))
SELECT slide_id, ord, coalesce(max(size) FILTER (WHERE greatest(1, done + CASE WHEN now > 0 THEN 1 ELSE 0 END) * size * 1.28::DOUBLE <= h), 14)::INTEGER AS size FROM steps WHERE k = len(ws) GROUP BY slide_id, ord"""


@query("fitting_font", twin(f"WITH {_FIT_LINES}"))
def fitting_font(spark, sf):
    """The largest size from the wanted one down to 14 at which a text fits its box."""
    sizes = F.sequence(F.lit(14), F.greatest(F.lit(14), F.col("font_size").cast("int")))
    tried = frame(spark, sf, "elements").filter("type = 'text'").select("slide_id", "ord", "text", "w", "h", F.explode(sizes).alias("size"))
    fits = geometry.text_height(F.col("text"), F.col("size").cast("double"), F.col("w")) <= F.col("h")
    return tried.groupBy("slide_id", "ord").agg(F.coalesce(F.max(F.when(fits, F.col("size"))), F.lit(14)).alias("size"))


_PANELS = """WITH RECURSIVE grouped AS (
SELECT slide_id AS layout_id, -1::BIGINT AS ord, NULL::STRUCT(x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE, n BIGINT)[] AS firsts FROM elements GROUP BY slide_id
UNION ALL
SELECT layout_id, next_ord, CASE WHEN met IS NULL THEN list_append(coalesce(firsts, []), {'x': x, 'y': y, 'w': w, 'h': h, 'n': 1::BIGINT})
 ELSE list_transform(range(1, len(firsts) + 1), lambda i: {'x': firsts[i].x, 'y': firsts[i].y, 'w': firsts[i].w, 'h': firsts[i].h, 'n': firsts[i].n + CASE WHEN i = met THEN 1 ELSE 0 END}) END
FROM (SELECT g.layout_id, g.firsts, e.ord AS next_ord, e.x, e.y, e.w, e.h, list_position(list_transform(coalesce(g.firsts, []), lambda q: abs(e.w - q.w) <= 0.08::DOUBLE * 960 AND abs(e.h - q.h) <= 0.08::DOUBLE * 540 AND (abs(e.y - q.y) <= 0.08::DOUBLE * 540 OR abs(e.x - q.x) <= 0.08::DOUBLE * 960)), true) AS met
 FROM grouped g JOIN (SELECT *, lag(ord, 1, -1) OVER (PARTITION BY slide_id ORDER BY ord) AS before FROM elements) e ON e.slide_id = g.layout_id AND e.before = g.ord))
SELECT layout_id, list_max(list_transform(arg_max(firsts, ord), lambda q: q.n)) AS largest FROM grouped GROUP BY layout_id"""


@query("panel_groups", twin(_PANELS))
def panel_groups(spark, sf):
    panels = frame(spark, sf, "elements").select(F.col("slide_id").alias("layout_id"), F.col("ord").cast("long").alias("ord"), "x", "y", "w", "h")
    return folds.like_panel_groups(panels, 960, 540)


_INHERIT = """WITH RECURSIVE slots AS (SELECT slide_id AS layout_id, ord::BIGINT AS ord, CASE WHEN ord % 3 <> 0 THEN (ord % 7)::VARCHAR END AS idx, CASE WHEN ord % 2 = 0 THEN 'body' END AS kind, lag(ord, 1, -1) OVER (PARTITION BY slide_id ORDER BY ord)::BIGINT AS before FROM elements),
taken AS (SELECT layout_id, -1::BIGINT AS ord, NULL::BIGINT AS parent_ord, list({'ord': ord, 'idx': idx, 'kind': kind} ORDER BY ord) FILTER (WHERE ord % 2 = 0) AS free FROM slots GROUP BY layout_id
UNION ALL SELECT layout_id, next_ord, found, list_filter(free, lambda q: found IS NULL OR q.ord <> found) FROM (SELECT t.layout_id, s.ord AS next_ord, t.free,
 list_filter(t.free, lambda q: coalesce(q.idx, '0') = coalesce(s.idx, '0') AND NOT (q.kind IS NOT NULL AND s.kind IS NOT NULL AND q.kind <> s.kind) AND ((q.idx IS NOT NULL AND s.idx IS NOT NULL) OR coalesce(q.kind, 'obj') = coalesce(s.kind, 'obj')))[1].ord AS found
 FROM taken t JOIN slots s ON s.layout_id = t.layout_id AND s.before = t.ord))
SELECT layout_id, ord, parent_ord FROM taken WHERE ord >= 0"""


@query("placeholder_inheritance", twin(_INHERIT))
def placeholder_inheritance(spark, sf):
    slots = frame(spark, sf, "elements").select(F.col("slide_id").alias("layout_id"), F.col("ord").cast("long").alias("ord"), F.when(F.col("ord") % 3 != 0, (F.col("ord") % 7).cast("string")).alias("idx"), F.when(F.col("ord") % 2 == 0, "body").alias("kind"))
    return folds.inherit_placeholders(slots, slots.filter("ord % 2 = 0"))


_CHOICE = """WITH RECURSIVE s AS (SELECT l_suppkey AS deck, l_orderkey AS slide_no, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS k, list({'score': floor(l_quantity / 10), 'layout': l_linenumber}) AS options FROM lineitem GROUP BY 1, 2),
r AS (SELECT DISTINCT deck, 0::BIGINT AS k, 0::BIGINT AS slide_no, 0::BIGINT AS layout_id, [0, 0, 0, 0, 0, 0, 0] AS uses FROM s
UNION ALL SELECT deck, k, slide_no, best, list_transform(range(1, 8), lambda i: uses[i] + CASE WHEN i = best THEN 1 ELSE 0 END)
FROM (SELECT s.deck, s.k, s.slide_no, r.uses, list_sort(list_transform(s.options, lambda o: {'a': -o.score, 'b': r.uses[o.layout], 'c': o.layout}))[1].c AS best FROM r JOIN s ON s.deck = r.deck AND s.k = r.k + 1))
SELECT deck, slide_no, layout_id FROM r WHERE k > 0"""


@query("layout_choice", _CHOICE)
def layout_choice(spark, sf):
    scores = frame(spark, sf, "lineitem").select(F.col("l_suppkey").alias("deck"), F.col("l_orderkey").alias("slide_no"), F.col("l_linenumber").alias("layout_id"), F.floor(F.col("l_quantity") / 10).cast("double").alias("score"))
    return folds.choose_layouts(scores)


_TRAVEL = """WITH RECURSIVE a AS (SELECT user_id AS variant, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, CASE event_type WHEN 'error' THEN 'undo' WHEN 'click' THEN 'redo' ELSE 'edit' END AS action, event_id::VARCHAR AS state FROM events),
r AS (SELECT DISTINCT variant, 0::BIGINT AS k, []::VARCHAR[] AS past, NULL::VARCHAR AS present, []::VARCHAR[] AS future FROM a
UNION ALL SELECT r.variant, a.k,
 CASE WHEN action = 'undo' AND len(past) > 0 THEN past[:len(past) - 1] WHEN action = 'redo' AND len(future) > 0 THEN list_append(past, present) WHEN action = 'edit' AND state IS DISTINCT FROM present AND present IS NOT NULL THEN list_append(past, present)[greatest(1, len(past) - 28):] ELSE past END,
 CASE WHEN action = 'undo' AND len(past) > 0 THEN past[len(past)] WHEN action = 'redo' AND len(future) > 0 THEN future[len(future)] WHEN action = 'edit' THEN state ELSE present END,
 CASE WHEN action = 'undo' AND len(past) > 0 THEN list_append(future, present) WHEN action = 'redo' AND len(future) > 0 THEN future[:len(future) - 1] WHEN action = 'edit' AND state IS DISTINCT FROM present THEN []::VARCHAR[] ELSE future END
 FROM r JOIN a ON a.variant = r.variant AND a.k = r.k + 1)
SELECT variant, nullif(arg_max(coalesce(present, ''), k), '') AS present FROM r GROUP BY variant"""


@query("history_travel", _TRAVEL)
def history_travel(spark, sf):
    kind = F.when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "click", "redo").otherwise("edit")
    return folds.travel_history(frame(spark, sf, "events").select(F.col("user_id").alias("variant"), F.col("event_id").alias("ord"), kind.alias("action"), F.col("event_id").cast("string").alias("state")))
