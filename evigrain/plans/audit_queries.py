"""Queries over slide canvases: geometry, colour, audit rules, decisions, findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigrain.functions import color, geometry
from evigrain.functions.geometry import Rect
from evigrain.operators import audit, fixes
from evigrain.plans.registered import registry
from evigrain.plans.standins import STANDINS, frame, run, twin

QUERIES, ORACLE_SQL, query = registry()

FONTS, COLORS = ["Georgia"], ["#112233", "#445566"]

_CHANNEL = "(CASE WHEN {0} <= 0.04045 THEN {0} / 12.92 ELSE pow(({0} + 0.055) / 1.055, 2.4) END)"


def _luminance(c: str) -> str:
    part = [_CHANNEL.format(f"(CAST(concat('0x', substr({c}, {at}, 2)) AS BIGINT) / 255.0::DOUBLE)") for at in (2, 4, 6)]
    return f"(0.2126::DOUBLE * {part[0]} + 0.7152::DOUBLE * {part[1]} + 0.0722::DOUBLE * {part[2]})"


def _contrast(a: str, b: str) -> str:
    x, y = _luminance(a), _luminance(b)
    return f"((greatest({x}, {y}) + 0.05::DOUBLE) / (least({x}, {y}) + 0.05::DOUBLE))"


_NEEDED = "(CASE WHEN font_size >= 24.0 OR (font_weight >= 700 AND font_size >= 56.0 / 3) THEN 3.0 ELSE 4.5 END)"


@query("contrast_check", twin(f"SELECT slide_id, ord, round({_contrast('color', 'fill')}, 6) AS ratio, {_contrast('color', 'fill')} >= {_NEEDED} AS enough FROM elements"))
def contrast_check(spark, sf):
    ratio = color.contrast(F.col("color"), F.col("fill"))
    return frame(spark, sf, "elements").select("slide_id", "ord", F.round(ratio, 6).alias("ratio"), (ratio >= color.required_contrast(F.col("font_size"), F.col("font_weight"))).alias("enough"))


_PALETTE = ["#112233", "#FFFFFF", "#CC0000", "#00AA55"]


@query("best_contrast", twin("WITH p AS (SELECT * FROM (VALUES (0, '#112233'), (1, '#FFFFFF'), (2, '#CC0000'), (3, '#00AA55')) AS t(turn, candidate)), r AS (SELECT slide_id, ord, candidate, turn, " + _contrast("candidate", "fill") + " AS ratio FROM elements, p) SELECT slide_id, ord, candidate AS best FROM r QUALIFY row_number() OVER (PARTITION BY slide_id, ord ORDER BY ratio DESC, turn) = 1"))
def best_contrast(spark, sf):
    return frame(spark, sf, "elements").select("slide_id", "ord", color.best_contrast(F.col("fill"), _PALETTE).alias("best"))


@query("palette_cycle", twin("SELECT slide_id, ord, ['#112233', '#FFFFFF', '#CC0000', '#00AA55'][(ord % 4) + 1] AS shade FROM elements"))
def palette_cycle(spark, sf):
    return frame(spark, sf, "elements").select("slide_id", "ord", color.palette_cycle(_PALETTE, F.col("ord")).alias("shade"))


@query("color_resolution", twin("SELECT slide_id, ord, coalesce(CASE WHEN regexp_full_match(direct, '#?[0-9A-Fa-f]{6}') THEN concat('#', upper(replace(direct, '#', ''))) END, CASE scheme WHEN 'accent1' THEN '#445566' WHEN 'dark1' THEN '#000000' END) AS resolved FROM raw_colors",
       raw_colors="SELECT slide_id, ord, CASE ord % 3 WHEN 0 THEN lower(color) WHEN 1 THEN substr(fill, 2, 6) ELSE 'window' END AS direct, CASE ord % 2 WHEN 0 THEN 'accent1' ELSE 'dark1' END AS scheme FROM elements"))
def color_resolution(spark, sf):
    raw = run(spark, sf, "SELECT slide_id, ord, CASE ord % 3 WHEN 0 THEN lower(color) WHEN 1 THEN substr(fill, 2, 6) ELSE 'window' END AS direct, CASE ord % 2 WHEN 0 THEN 'accent1' ELSE 'dark1' END AS scheme FROM elements")
    scheme = F.create_map(*[F.lit(x) for x in ("accent1", "#445566", "dark1", "#000000")])
    return raw.select("slide_id", "ord", F.coalesce(color.normalized_color(F.col("direct")), F.try_element_at(scheme, F.col("scheme"))).alias("resolved"))


@query("text_properties", twin("SELECT slide_id, ord, coalesce(nullif(trim(a), ''), nullif(trim(b), ''), nullif(trim(c), '')) AS font FROM (SELECT slide_id, ord, CASE WHEN ord % 2 = 0 THEN font ELSE ' ' END AS a, CASE WHEN ord % 3 = 0 THEN 'Aptos' END AS b, CASE WHEN ord % 5 <> 0 THEN 'Arial' END AS c FROM elements)"))
def text_properties(spark, sf):
    raw = run(spark, sf, "SELECT slide_id, ord, CASE WHEN ord % 2 = 0 THEN font ELSE ' ' END AS a, CASE WHEN ord % 3 = 0 THEN 'Aptos' END AS b, CASE WHEN ord % 5 <> 0 THEN 'Arial' END AS c FROM elements")
    return raw.select("slide_id", "ord", F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in "abc"]).alias("font"))


_PAIRS = "SELECT l.slide_id, l.ord AS l_ord, r.ord AS r_ord, l.x AS lx, l.y AS ly, l.w AS lw, l.h AS lh, r.x AS rx, r.y AS ry, r.w AS rw, r.h AS rh FROM elements l JOIN elements r ON l.slide_id = r.slide_id AND r.ord = l.ord + 1"


@query("rect_predicates", twin("""SELECT slide_id, l_ord, lx < rx + rw AND lx + lw > rx AND ly < ry + rh AND ly + lh > ry AS overlap, rx >= lx - 2 AND ry >= ly - 2 AND rx + rw <= lx + lw + 2 AND ry + rh <= ly + lh + 2 AS contained,
lx >= -1 AND ly >= -1 AND lx + lw <= 961 AND ly + lh <= 541 AS on_canvas, greatest(0, least(lx + lw, rx + rw) - greatest(lx, rx)) * greatest(0, least(ly + lh, ry + rh) - greatest(ly, ry)) AS shared,
round(sqrt(pow(lx + lw / 2 - rx - rw / 2, 2) + pow(ly + lh / 2 - ry - rh / 2, 2)), 6) AS distance, abs(lx - rx) + abs(ly - ry) + abs(lw - rw) + abs(lh - rh) AS l1 FROM pairs""", pairs=_PAIRS))
def rect_predicates(spark, sf):
    a, b = Rect("l"), Rect("r")
    return run(spark, sf, _PAIRS).select("slide_id", "l_ord", geometry.overlaps(a, b).alias("overlap"), geometry.contains(a, b).alias("contained"), geometry.inside_canvas(a, 960, 540).alias("on_canvas"), geometry.intersection_area(a, b).alias("shared"), F.round(geometry.center_distance(a, b), 6).alias("distance"), geometry.l1_distance(a, b).alias("l1"))


@query("artwork_overlap", twin("""SELECT slide_id, l_ord, max(greatest(0, least(lx + lw, rx + rw) - greatest(lx, rx)) * greatest(0, least(ly + lh, ry + rh) - greatest(ly, ry)) / least(lw * lh, rw * rh)) AS ratio FROM near GROUP BY slide_id, l_ord""",
       near="SELECT l.slide_id, l.ord AS l_ord, l.x AS lx, l.y AS ly, l.w AS lw, l.h AS lh, r.x AS rx, r.y AS ry, r.w AS rw, r.h AS rh FROM elements l JOIN elements r ON l.slide_id = r.slide_id AND r.type = 'image' AND l.type = 'text'"))
def artwork_overlap(spark, sf):
    near = run(spark, sf, "SELECT l.slide_id, l.ord AS l_ord, l.x AS lx, l.y AS ly, l.w AS lw, l.h AS lh, r.x AS rx, r.y AS ry, r.w AS rw, r.h AS rh FROM elements l JOIN elements r ON l.slide_id = r.slide_id AND r.type = 'image' AND l.type = 'text'")
    return near.groupBy("slide_id", "l_ord").agg(F.max(geometry.overlap_ratio(Rect("l"), Rect("r"))).alias("ratio"))


_RADIUS = "least(radius, lw / 2, lh / 2)"
_CORNERS = [(x, y) for y in ("ry", "ry + rh") for x in ("rx", "rx + rw")]


@query("shape_containment", twin("SELECT slide_id, l_ord, CASE WHEN shape = 'line' THEN false WHEN shape = 'rect' OR (shape = 'roundRect' AND " + _RADIUS + " = 0) THEN rx >= lx AND ry >= ly AND rx + rw <= lx + lw AND ry + rh <= ly + lh WHEN shape = 'ellipse' THEN "
       + " AND ".join(f"pow(({x} - lx - lw / 2) / (lw / 2), 2) + pow(({y} - ly - lh / 2) / (lh / 2), 2) <= 1" for x, y in _CORNERS) + " ELSE "
       + " AND ".join(f"pow({x} - greatest(lx + {_RADIUS}, least({x}, lx + lw - {_RADIUS})), 2) + pow({y} - greatest(ly + {_RADIUS}, least({y}, ly + lh - {_RADIUS})), 2) <= pow({_RADIUS}, 2)" for x, y in _CORNERS) + " END AS inside FROM nested",
       nested="SELECT slide_id, ord AS l_ord, shape, radius, x AS lx, y AS ly, w AS lw, h AS lh, x + w / 4 AS rx, y + h / (3 + ord % 4) AS ry, w / 3 AS rw, h / 3 AS rh FROM elements"))
def shape_containment(spark, sf):
    nested = run(spark, sf, "SELECT slide_id, ord AS l_ord, shape, radius, x AS lx, y AS ly, w AS lw, h AS lh, x + w / 4 AS rx, y + h / (3 + ord % 4) AS ry, w / 3 AS rw, h / 3 AS rh FROM elements")
    return nested.select("slide_id", "l_ord", geometry.shape_contains(F.col("shape"), F.col("radius"), Rect("l"), Rect("r")).alias("inside"))


@query("unit_conversion", twin("SELECT slide_id, ord, x * 12700 / 9525 AS px_from_emu, h * 96 / 72 AS px_from_pt, floor(w / 7 + 0.5) AS rounded, floor((x - 300) / 8 + 0.5) * 8 AS quantized, least(greatest(x, 20), 700) AS clamped FROM elements"))
def unit_conversion(spark, sf):
    c = F.col
    return frame(spark, sf, "elements").select("slide_id", "ord", geometry.emu_to_pixels(c("x") * 12700).alias("px_from_emu"), geometry.points_to_pixels(c("h")).alias("px_from_pt"), geometry.rounded(c("w") / 7).alias("rounded"), geometry.quantized(c("x") - 300, 8).alias("quantized"), geometry.clamped(c("x"), F.lit(20.0), F.lit(700.0)).alias("clamped"))


_CROPS = "SELECT slide_id, ord, CASE ord % 4 WHEN 0 THEN CAST(ord * 1000 AS VARCHAR(20)) WHEN 1 THEN '' WHEN 2 THEN '-5' END AS raw_crop, CASE WHEN ord % 3 = 0 THEN CAST((ord - 20) * 5400000 AS VARCHAR(20)) WHEN ord % 3 = 1 THEN 'x' END AS raw_turn FROM elements"


@query("crop_rotation", twin("SELECT slide_id, ord, CASE WHEN raw_crop IS NULL OR raw_crop = '' THEN 0.0 WHEN regexp_full_match(raw_crop, '[0-9]+') THEN CAST(raw_crop AS DOUBLE) / 1000 END AS crop, CASE WHEN regexp_full_match(raw_turn, '-?[0-9]+') THEN fmod(fmod(CAST(raw_turn AS DOUBLE) / 60000, 360) + 360, 360) END AS rotation FROM crops", crops=_CROPS))
def crop_rotation(spark, sf):
    return run(spark, sf, _CROPS).select("slide_id", "ord", geometry.crop(F.col("raw_crop")).alias("crop"), geometry.rotation(F.col("raw_turn")).alias("rotation"))


@query("aspect_distortion", twin("SELECT slide_id, ord, abs(ln((w / h) / ((100 + ord) / 60.0::DOUBLE))) > ln(1.1) AS distorted FROM elements"))
def aspect_distortion(spark, sf):
    return frame(spark, sf, "elements").select("slide_id", "ord", geometry.aspect_distorted(Rect(), F.col("ord") + 100, F.lit(60.0)).alias("distorted"))


@query("clipped_rects", twin("SELECT slide_id, ord, greatest(x, 0) AS x, greatest(y, 0) AS y, least(x + w, 960) - greatest(x, 0) AS w, least(y + h, 540) - greatest(y, 0) AS h FROM elements WHERE least(x + w, 960) > greatest(x, 0) AND least(y + h, 540) > greatest(y, 0)"))
def clipped_rects(spark, sf):
    found = frame(spark, sf, "elements").select("slide_id", "ord", geometry.clipped(Rect(), 960, 540).alias("c"))
    return found.filter(F.col("c").isNotNull()).select("slide_id", "ord", "c.*")


@query("line_in_rect", twin("SELECT slide_id, ord, CASE WHEN least(x + w, 900) > greatest(x, 60) AND 250 BETWEEN y AND y + h THEN least(x + w, 900) - greatest(x, 60) ELSE 0 END AS length FROM elements"))
def line_in_rect(spark, sf):
    return frame(spark, sf, "elements").select("slide_id", "ord", geometry.line_in_rect(F.lit(60.0), F.lit(250.0), F.lit(900.0), F.lit(250.0), Rect()).alias("length"))


@query("variant_widths", twin("SELECT slide_id, ord, factor, least(greatest(x + w / 2 - nw / 2, 0), 960 - nw) AS x, nw AS w FROM (SELECT slide_id, ord, x, w, factor, least(greatest(w * factor, 0.12::DOUBLE * 960), 0.82::DOUBLE * 960) AS nw FROM (SELECT *, CASE ord % 3 WHEN 0 THEN 1.08::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 0.82::DOUBLE END AS factor FROM elements))"))
def variant_widths(spark, sf):
    factor = F.when(F.col("ord") % 3 == 0, 1.08).when(F.col("ord") % 3 == 1, 1.0).otherwise(0.82)
    return frame(spark, sf, "elements").select("slide_id", "ord", factor.alias("factor"), geometry.variant_slot(Rect(), factor, 960).alias("s")).select("slide_id", "ord", "factor", "s.*")


@query("rect_margins", twin("SELECT slide_id, min(x) AS left_edge, min(y) AS top_edge, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, min(960 - x - w) AS right_margin FROM elements GROUP BY slide_id"))
def rect_margins(spark, sf):
    r = Rect()
    return frame(spark, sf, "elements").groupBy("slide_id").agg(F.min(r.x).alias("left_edge"), F.min(r.y).alias("top_edge"), (F.max(r.right) - F.min(r.x)).alias("w"), (F.max(r.bottom) - F.min(r.y)).alias("h"), F.min(geometry.margins(r, 960, 540)["right"]).alias("right_margin"))


@query("outside_canvas", twin("SELECT slide_id, ord, element_id, 'OUTSIDE_SLIDE' AS type, 'error' AS severity, 'Element extends outside the slide' AS message FROM elements WHERE x < 0 OR y < 0 OR x + w > 960 OR y + h > 540"))
def outside_canvas(spark, sf):
    return audit.outside(frame(spark, sf, "elements"))


#: The elements with tables for placeholders, and images of four kinds: a GIF, none, a PNG of 2 by 1, a link.
_CANVAS = """SELECT e.slide_id, e.ord, e.element_id, CASE WHEN e.type = 'placeholder' THEN 'table' ELSE e.type END AS type, e.x, e.y, e.w, e.h, e.z, e.text, e.font, e.font_size, e.font_weight, e.color, e.shape, e.fill, e.stroke, 0.0 AS radius, CAST((e.ord % 3) * 10 AS DOUBLE) AS crop_left FROM elements e"""
_DOT = "iVBORw0KGgoAAAANSUhEUgAAAAIAAAABCAAAAADRSSBWAAAAC0lEQVR4nGPgEgEAACsAH5dshyUAAAAASUVORK5CYII="


def _canvas(spark, sf):
    rows = run(spark, sf, _CANVAS)
    gif = F.concat(F.unhex(F.lit("474946383961")), F.unhex(F.lpad(F.hex(F.col("ord") + 1), 2, "0")), F.unhex(F.lit("0002000000003B")))
    url = F.element_at(F.array(F.concat(F.lit("data:image/gif;base64,"), F.base64(gif)), F.lit(None), F.lit(f"data:image/png;base64,{_DOT}"), F.lit("https://example.org/a.png")), (F.floor(F.col("ord") / 2) % 4 + 1).cast("int"))
    table = F.array(F.array(F.lit("Name"), F.lit("Value")), F.array(F.col("text"), F.col("ord").cast("string")))
    return rows.withColumn("data_url", F.when(F.col("type") == "image", url)).withColumn("rows", F.when(F.col("type") == "table", table))


_KNOWN = "('#112233', '#445566', '#FFFFFF')"
#: Lines of wrapped words for rows of (slide_id, ord, text, size, w).
_LINES = """RECURSIVE words AS (SELECT slide_id, ord, size, list_filter(string_split(text, ' '), lambda x: x <> '') AS ws, greatest(4, floor(w / greatest(5.0::DOUBLE, size * 0.62::DOUBLE))::INTEGER) AS most FROM {0}),
steps AS (SELECT slide_id, ord, size, ws, most, 0 AS k, 0 AS done, 0 AS now FROM words UNION ALL
SELECT slide_id, ord, size, ws, most, k + 1, done + CASE WHEN breaks THEN 1 ELSE 0 END + cut, CASE WHEN now > 0 AND NOT breaks THEN now + 1 ELSE 0 END + n - cut * most FROM (SELECT *, now > 0 AND now + 1 + n > most AS breaks, CASE WHEN n > most THEN (n - 1) // most ELSE 0 END AS cut FROM (SELECT *, length(ws[k + 1]) AS n FROM steps WHERE k < len(ws)))),
lines AS (SELECT slide_id, ord, size, greatest(1, done + CASE WHEN now > 0 THEN 1 ELSE 0 END) AS n FROM steps WHERE k = len(ws))"""
_SIZED = "SELECT slide_id, ord, text, font_size AS size, w FROM elements WHERE type = 'text'"
_TOO_TALL = "SELECT e.slide_id, e.ord, e.element_id, 'TEXT_OVERFLOW' AS type, 'error' AS severity, 'Text exceeds element bounds' AS message FROM elements e JOIN lines l ON l.slide_id = e.slide_id AND l.ord = e.ord WHERE e.type = 'text' AND l.n * e.font_size * 1.28::DOUBLE > e.h"
_PLAIN_RULES = rf"""SELECT slide_id, ord, element_id, 'OUTSIDE_SLIDE' AS type, 'error' AS severity, 'Element extends outside the slide' AS message FROM elements WHERE x < 0 OR y < 0 OR x + w > 960 OR y + h > 540
UNION ALL SELECT slide_id, ord, element_id, 'EMPTY_PLACEHOLDER', 'error', CASE WHEN trim(text) = '' THEN 'Text placeholder is empty' ELSE 'Text contains placeholder content' END FROM elements WHERE type = 'text' AND (trim(text) = '' OR contains(lower(text), 'lorem ipsum'))
UNION ALL SELECT slide_id, ord, element_id, 'SMALL_TEXT', 'warning', 'Text is smaller than 14 px' FROM elements WHERE type = 'text' AND font_size < 14
UNION ALL SELECT slide_id, ord, element_id, 'UNSUPPORTED_FONT', 'warning', 'Font is not declared by the template design system' FROM elements WHERE type = 'text' AND lower(font) NOT IN ('georgia', 'arial', 'calibri', 'aptos')
UNION ALL SELECT slide_id, ord, element_id, 'COLOR_OUTSIDE_DESIGN_SYSTEM', 'warning', 'Text color is outside the extracted design system' FROM elements WHERE type = 'text' AND upper(color) NOT IN {_KNOWN}
UNION ALL SELECT slide_id, ord, element_id, 'SMALL_MARGIN', 'warning', 'Text is too close to the slide edge' FROM elements WHERE type = 'text' AND NOT (y >= 540 * 0.9::DOUBLE AND h <= 540 * 0.1::DOUBLE) AND (x < 18.9::DOUBLE OR y < 18.9::DOUBLE OR x + w > 941.1::DOUBLE OR y + h > 521.1::DOUBLE)
UNION ALL SELECT slide_id, ord, element_id, 'COLOR_OUTSIDE_DESIGN_SYSTEM', 'info', 'Shape uses a color outside the extracted palette' FROM elements WHERE type = 'shape' AND upper(fill) NOT IN {_KNOWN} AND upper(stroke) NOT IN {_KNOWN}
UNION ALL SELECT slide_id, ord, element_id, type, severity, message FROM tall"""
_MEDIA_RULES = """UNION ALL SELECT slide_id, ord, element_id, 'EMPTY_PLACEHOLDER', 'error', 'Table cell at row 2, column 1 contains placeholder content' FROM elements WHERE type = 'placeholder' AND contains(lower(text), 'lorem ipsum')
UNION ALL SELECT slide_id, ord, element_id, 'INVALID_IMAGE_DATA', 'error', 'Image has missing or malformed embedded data' FROM elements WHERE type = 'image' AND (ord // 2) % 4 IN (1, 3)
UNION ALL SELECT slide_id, ord, element_id, 'IMAGE_ASPECT_DISTORTION', 'warning', 'Image frame materially changes the intrinsic aspect ratio' FROM elements WHERE type = 'image' AND (ord // 2) % 4 IN (0, 2) AND abs(ln((w / h) / ((CASE WHEN (ord // 2) % 4 = 0 THEN (ord + 1) / 2.0::DOUBLE ELSE 2.0::DOUBLE END) * (100 - (ord % 3) * 10) / 100.0::DOUBLE))) > ln(1.1::DOUBLE)"""
_LINE_PARTS = _LINES.format("sized").removeprefix("RECURSIVE ")
_RULES = f"SELECT slide_id, ord, element_id, type, severity FROM ({_PLAIN_RULES})"


def _with_lines(body: str, **own: str) -> str:
    """A twin whose body reads the table `tall`."""
    return twin(f"WITH RECURSIVE sized AS ({_SIZED}), {_LINE_PARTS}, tall AS ({_TOO_TALL}) {body}", **own)


@query("audit_issues", _with_lines(f"{_PLAIN_RULES} {_MEDIA_RULES}"))
def audit_issues(spark, sf):
    return audit.element_rules(_canvas(spark, sf), FONTS, COLORS)


@query("repeated_element_ids", twin("SELECT slide_id, ord, element_id FROM elements QUALIFY row_number() OVER (PARTITION BY slide_id, element_id ORDER BY ord) > 1"))
def repeated_element_ids(spark, sf):
    return audit.repeated_ids(frame(spark, sf, "elements")).select("slide_id", "ord", "element_id")


@query("dense_slides", twin("SELECT slide_id FROM elements GROUP BY slide_id HAVING count(*) > 49"))
def dense_slides(spark, sf):
    return audit.dense(frame(spark, sf, "elements"), 49).select("slide_id")


_OVERLAPS = """SELECT a.slide_id, a.ord, a.element_id, CASE WHEN a.type = 'text' AND b.type = 'text' THEN 'error' ELSE 'warning' END AS severity, concat('Element overlaps ', b.element_id) AS message
FROM elements a JOIN elements b ON a.slide_id = b.slide_id AND a.ord < b.ord WHERE NOT (a.type = 'shape' AND a.shape = 'line') AND NOT (b.type = 'shape' AND b.shape = 'line')
AND a.x < b.x + b.w AND a.x + a.w > b.x AND a.y < b.y + b.h AND a.y + a.h > b.y AND NOT (a.type = 'shape' AND b.type = 'shape')
AND NOT (a.type = 'shape' AND b.type = 'text' AND b.x >= a.x - 2 AND b.y >= a.y - 2 AND b.x + b.w <= a.x + a.w + 2 AND b.y + b.h <= a.y + a.h + 2)
AND NOT (b.type = 'shape' AND a.type = 'text' AND a.x >= b.x - 2 AND a.y >= b.y - 2 AND a.x + a.w <= b.x + b.w + 2 AND a.y + a.h <= b.y + b.h + 2)"""


@query("overlap_pairs", twin(_OVERLAPS))
def overlap_pairs(spark, sf):
    return audit.overlap_pairs(frame(spark, sf, "elements")).drop("type")


_BACKGROUNDS = """WITH met AS (SELECT t.slide_id, t.ord, t.z AS tz, l.z AS lz, l.ord AS lord, l.fill, l.type = 'shape' AND l.z < t.z AND CASE l.shape WHEN 'line' THEN false
WHEN 'ellipse' THEN pow((t.x - l.x - l.w / 2) / (l.w / 2), 2) + pow((t.y - l.y - l.h / 2) / (l.h / 2), 2) <= 1 AND pow((t.x + t.w - l.x - l.w / 2) / (l.w / 2), 2) + pow((t.y - l.y - l.h / 2) / (l.h / 2), 2) <= 1 AND pow((t.x - l.x - l.w / 2) / (l.w / 2), 2) + pow((t.y + t.h - l.y - l.h / 2) / (l.h / 2), 2) <= 1 AND pow((t.x + t.w - l.x - l.w / 2) / (l.w / 2), 2) + pow((t.y + t.h - l.y - l.h / 2) / (l.h / 2), 2) <= 1
ELSE t.x >= l.x AND t.y >= l.y AND t.x + t.w <= l.x + l.w AND t.y + t.h <= l.y + l.h END AS around
FROM elements t JOIN (SELECT *, least(radius, w / 2, h / 2) AS r FROM elements) l ON l.slide_id = t.slide_id AND t.type = 'text' AND l.type <> 'text' AND t.x < l.x + l.w AND t.x + t.w > l.x AND t.y < l.y + l.h AND t.y + t.h > l.y),
best AS (SELECT slide_id, ord, arg_max(fill, lz) FILTER (WHERE around) AS fill, max(lz) FILTER (WHERE around) AS z FROM met GROUP BY slide_id, ord),
amb AS (SELECT m.slide_id, m.ord, count(*) AS n FROM met m JOIN best b USING (slide_id, ord) WHERE m.lz >= b.z GROUP BY m.slide_id, m.ord)
"""
_BACKGROUND = "SELECT t.slide_id, t.ord, CASE WHEN b.slide_id IS NULL THEN '#FFFFFF' WHEN b.z IS NOT NULL AND a.n = 1 THEN b.fill END AS background FROM elements t LEFT JOIN best b ON b.slide_id = t.slide_id AND b.ord = t.ord LEFT JOIN amb a ON a.slide_id = t.slide_id AND a.ord = t.ord WHERE t.type = 'text'"


@query("text_background", twin(_BACKGROUNDS + _BACKGROUND))
def text_background(spark, sf):
    square = frame(spark, sf, "elements").withColumn("radius", F.lit(0.0))
    return audit.text_backgrounds(square).select("slide_id", "ord", "background")


@query("low_contrast", twin(_BACKGROUNDS.rstrip() + f", behind AS ({_BACKGROUND}) SELECT e.slide_id, e.ord, 'warning' AS severity FROM elements e JOIN behind b ON b.slide_id = e.slide_id AND b.ord = e.ord WHERE trim(e.text) <> '' AND background IS NOT NULL AND {_contrast('color', "coalesce(background, '#000000')")} < {_NEEDED}"))
def low_contrast(spark, sf):
    square = frame(spark, sf, "elements").withColumn("radius", F.lit(0.0))
    return audit.low_contrast(square).select("slide_id", "ord", "severity")


@query("text_overflow", _with_lines("SELECT slide_id, ord, severity FROM tall"))
def text_overflow(spark, sf):
    return audit.overflow(frame(spark, sf, "elements")).select("slide_id", "ord", "severity")


_SLIDES = "SELECT concat('deck-', CAST(slide_no % 3 AS VARCHAR(20))) AS deck, slide_id, slide_no AS ord, concat('Title ', CAST(slide_no % 4 AS VARCHAR(20))) AS title FROM elements GROUP BY slide_id, slide_no"
_REPORT = f"""{_PLAIN_RULES} {_MEDIA_RULES}
UNION ALL SELECT slide_id, ord, element_id, 'ELEMENT_OVERLAP', 'error', 'Two canvas elements share the same id' FROM (SELECT slide_id, ord, element_id FROM elements QUALIFY row_number() OVER (PARTITION BY slide_id, element_id ORDER BY ord) > 1)
UNION ALL SELECT slide_id, ord, element_id, 'ELEMENT_OVERLAP', severity, message FROM ({_OVERLAPS})
UNION ALL SELECT e.slide_id, e.ord, e.element_id, 'LOW_TEXT_CONTRAST', 'warning', concat('Text contrast is ', format('{{:.2f}}', {_contrast('color', "coalesce(background, '#000000')")}), ':1; WCAG 2.2 AA requires at least ', CASE WHEN {_NEEDED} = 3 THEN '3' ELSE '4.5' END, ':1') FROM elements e JOIN behind b ON b.slide_id = e.slide_id AND b.ord = e.ord WHERE trim(e.text) <> '' AND background IS NOT NULL AND {_contrast('color', "coalesce(background, '#000000')")} < {_NEEDED}
UNION ALL SELECT slide_id, NULL, NULL, 'DENSE_LAYOUT', 'warning', 'Slide has more than 70 editable objects' FROM elements GROUP BY slide_id HAVING count(*) > 70
UNION ALL SELECT slide_id, NULL, NULL, 'DUPLICATE_SLIDE', 'warning', concat('Substantive content matches ', first_id) FROM repeated"""
_SIGNED = """signed AS (SELECT s.deck, s.slide_id, s.ord, concat(s.title, '|', (SELECT string_agg(lower(trim(text)), '|' ORDER BY lower(trim(text))) FROM elements e WHERE e.slide_id = s.slide_id AND type = 'text' AND trim(text) <> '' AND NOT (y >= 540 * 0.9::DOUBLE AND h <= 540 * 0.1::DOUBLE)),
'#', (SELECT string_agg(concat(lower(trim(text)), '/', ord), '|' ORDER BY concat(lower(trim(text)), '/', ord)) FROM elements e WHERE e.slide_id = s.slide_id AND type = 'placeholder')) AS signature FROM slides s),
repeated AS (SELECT slide_id, first_value(slide_id) OVER w AS first_id, row_number() OVER w AS turn FROM signed WINDOW w AS (PARTITION BY deck, signature ORDER BY ord) QUALIFY turn > 1)"""
#: Slides that come again under other numbers, so that some repeat the content of others.
_TWICE = "SELECT * FROM elements_once UNION ALL SELECT concat(slide_id, '-again') AS slide_id, slide_no + 300000 AS slide_no, ord, element_id, type, x, y, w, h, z, text, font, font_size, font_weight, color, shape, fill, stroke, radius FROM elements_once WHERE slide_no % 2 = 0"


@query("audit_report", _with_lines(f", {_BACKGROUNDS.strip().removeprefix('WITH ')}, behind AS ({_BACKGROUND}), {_SIGNED} {_REPORT}", elements=_TWICE, elements_once=STANDINS["elements"], slides=_SLIDES))
def audit_report(spark, sf):
    """All rules, over slides of which every other one comes twice."""
    once = _canvas(spark, sf)
    number = F.regexp_extract("slide_id", "([0-9]+)$", 1).cast("long")
    again = once.filter(number % 2 == 0).withColumn("slide_id", F.concat("slide_id", F.lit("-again")))
    elements = once.unionByName(again)
    numbered = elements.select("slide_id").distinct().withColumn("slide_no", F.regexp_extract("slide_id", "^slide-([0-9]+)", 1).cast("long") + F.when(F.endswith("slide_id", F.lit("-again")), 300000).otherwise(0))
    slides = numbered.select(F.concat(F.lit("deck-"), (F.col("slide_no") % 3).cast("string")).alias("deck"), "slide_id", F.col("slide_no").alias("ord"), F.concat(F.lit("Title "), (F.col("slide_no") % 4).cast("string")).alias("title"))
    return audit.issues(elements, FONTS, COLORS, slides)


@query("safe_fixes")
def safe_fixes(spark, sf):
    design = fixes.Design(("Georgia",), ("Aptos",), tuple(_PALETTE))
    return fixes.safe_fixes(frame(spark, sf, "elements"), design)


@query("audit_summary", _with_lines(f", issues AS ({_RULES}) SELECT slide_id, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings, count(*) FILTER (WHERE severity = 'info') AS infos, count(*) FILTER (WHERE severity = 'error') = 0 AS passed FROM issues GROUP BY slide_id"))
def audit_summary(spark, sf):
    return audit.report(audit.element_rules(frame(spark, sf, "elements"), FONTS, COLORS))


_ISSUES = "SELECT concat('i', CAST(event_id % 400 AS VARCHAR(20))) AS issue_key, concat('s', CAST(user_id AS VARCHAR(20))) AS slide_id, event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'warning' ELSE 'info' END AS severity FROM events"
_DECISIONS = "SELECT concat('i', CAST(event_id % 700 AS VARCHAR(20))) AS issue_key, event_id AS ord, CASE event_id % 3 WHEN 0 THEN 'ignore' WHEN 1 THEN 'fix' ELSE 'restore' END AS action FROM events"


@query("effective_audit", twin("""SELECT i.issue_key, i.event_id, i.severity, coalesce(d.action = 'ignore', false) AS ignored FROM issues i LEFT JOIN (SELECT issue_key, action FROM decisions QUALIFY row_number() OVER (PARTITION BY issue_key ORDER BY ord DESC) = 1) d ON d.issue_key = i.issue_key""", issues=_ISSUES, decisions=_DECISIONS))
def effective_audit(spark, sf):
    return audit.effective(run(spark, sf, _ISSUES), run(spark, sf, _DECISIONS)).select("issue_key", "event_id", "severity", "ignored")


@query("effective_report", twin("""WITH e AS (SELECT i.slide_id, i.severity, coalesce(d.action = 'ignore', false) AS ignored FROM issues i LEFT JOIN (SELECT issue_key, action FROM decisions QUALIFY row_number() OVER (PARTITION BY issue_key ORDER BY ord DESC) = 1) d ON d.issue_key = i.issue_key)
SELECT slide_id, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings, count(*) FILTER (WHERE severity = 'info') AS infos, count(*) FILTER (WHERE severity = 'error' AND NOT ignored) = 0 AS passed FROM e GROUP BY slide_id""", issues=_ISSUES, decisions=_DECISIONS))
def effective_report(spark, sf):
    return audit.report(audit.effective(run(spark, sf, _ISSUES), run(spark, sf, _DECISIONS)))


@query("latest_decision", twin("SELECT issue_key, ord, action FROM decisions QUALIFY row_number() OVER (PARTITION BY issue_key ORDER BY ord DESC) = 1", decisions=_DECISIONS))
def latest_decision(spark, sf):
    return audit.latest_decisions(run(spark, sf, _DECISIONS))


_BEFORE = "SELECT concat('s', CAST(user_id % 50 AS VARCHAR(20))) AS slide_id, event_type AS type, CAST(event_id % 5 AS VARCHAR(20)) AS element_id FROM events WHERE value < 10"
_AFTER = "SELECT concat('s', CAST(user_id % 50 AS VARCHAR(20))) AS slide_id, event_type AS type, CAST(event_id % 5 AS VARCHAR(20)) AS element_id FROM events WHERE value > 6"


@query("unsafe_delta", twin("""SELECT a.slide_id, a.type, a.element_id, a.n - coalesce(b.n, 0) AS added FROM (SELECT slide_id, type, element_id, count(*) AS n FROM later GROUP BY ALL) a LEFT JOIN (SELECT slide_id, type, element_id, count(*) AS n FROM earlier GROUP BY ALL) b
ON a.slide_id = b.slide_id AND a.type = b.type AND a.element_id = b.element_id WHERE a.type <> 'view' AND a.n > coalesce(b.n, 0)""", earlier=_BEFORE, later=_AFTER))
def unsafe_delta(spark, sf):
    return audit.added_unsafe(run(spark, sf, _BEFORE), run(spark, sf, _AFTER), ("view",))


_FINDINGS = "SELECT o_orderkey - CASE WHEN o_orderkey % 50 = 0 THEN 1 ELSE 0 END AS finding_id, CASE WHEN o_orderkey % 13 = 0 THEN CAST(-1 AS BIGINT) ELSE o_custkey END AS artifact_id, o_orderkey % 4 AS slide_id, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey * 10 + o_orderkey % 7 END AS evidence_id FROM orders"
_KNOWN_SLIDES = "SELECT c_custkey AS artifact_id, c_custkey % 4 AS slide_id FROM customer UNION ALL SELECT c_custkey, (c_custkey + 1) % 4 FROM customer"
_KNOWN_EVIDENCE = "SELECT c_custkey * 10 + c_custkey % 7 AS evidence_id, c_custkey AS artifact_id, c_custkey % 4 AS slide_id FROM customer"


@query("semantic_findings", twin("""SELECT f.finding_id, CASE WHEN count(*) OVER (PARTITION BY f.finding_id) > 1 THEN 'duplicate_finding_id' WHEN f.artifact_id NOT IN (SELECT artifact_id FROM known_slides) THEN 'unknown_artifact_ref'
WHEN NOT EXISTS (SELECT 1 FROM known_slides k WHERE k.artifact_id = f.artifact_id AND k.slide_id = f.slide_id) THEN CASE WHEN f.slide_id IN (SELECT slide_id FROM known_slides) THEN 'inconsistent_slide_artifact_ref' ELSE 'unknown_slide_ref' END
WHEN f.evidence_id IS NOT NULL AND e.evidence_id IS NULL THEN 'unknown_evidence_ref' WHEN f.evidence_id IS NOT NULL AND (e.artifact_id <> f.artifact_id OR e.slide_id <> f.slide_id) THEN 'inconsistent_evidence_ref' END AS error
FROM findings f LEFT JOIN known_evidence e ON e.evidence_id = f.evidence_id""", findings=_FINDINGS, known_slides=_KNOWN_SLIDES, known_evidence=_KNOWN_EVIDENCE))
def semantic_findings(spark, sf):
    return audit.finding_errors(run(spark, sf, _FINDINGS), run(spark, sf, _KNOWN_SLIDES), run(spark, sf, _KNOWN_EVIDENCE))


@query("duplicate_first_seen", r"""WITH s AS (SELECT source AS deck, doc_id AS slide_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS signature FROM documents), f AS (SELECT deck, slide_id, first_value(slide_id) OVER w AS first_id, row_number() OVER w AS turn FROM s WINDOW w AS (PARTITION BY deck, signature ORDER BY slide_id)) SELECT deck, slide_id, first_id FROM f WHERE turn > 1""")
def duplicate_first_seen(spark, sf):
    from evigrain.functions.text import normalized

    slides = frame(spark, sf, "documents").select(F.col("source").alias("deck"), F.col("doc_id").alias("slide_id"), F.col("doc_id").alias("ord"), normalized(F.col("text")).alias("signature"))
    return audit.duplicate_slides(slides).select("deck", "slide_id", "first_id")
