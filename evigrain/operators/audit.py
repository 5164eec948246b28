"""Audits of slide canvases, decisions about issues, and checks of findings.

An element table has slide_id, ord, element_id, type, x, y, w, h, z, text, font,
font_size, font_weight, color, shape, fill, stroke, radius; where there are
tables and images, also rows (an array of arrays of cell texts), data_url and the
crop of each side in percent. Every rule gives rows of slide_id, ord, element_id,
type, severity and message.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigrain.functions import color, geometry, jsontext, text
from evigrain.functions.geometry import Rect
from evigrain.sources import images

WIDTH, HEIGHT, BACKGROUND = 960.0, 540.0, "#FFFFFF"
ALWAYS_FONTS = ("Arial", "Calibri", "Aptos")
SMALLEST_FONT, DENSE, MARGIN = 14, 70, 0.035


def _issues(rows: DataFrame, when: Column, kind: str, severity: str | Column, message: str | Column) -> DataFrame:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return rows.filter(when).select("slide_id", "ord", "element_id", F.lit(kind).alias("type"), as_column(severity).alias("severity"), as_column(message).alias("message"))


def is_footer(height: float = HEIGHT) -> Column:
    return (F.col("y") >= height * 0.9) & (F.col("h") <= height * 0.1)


def outside(elements: DataFrame, width: float = WIDTH, height: float = HEIGHT) -> DataFrame:
    r = Rect()
    return _issues(elements, (r.x < 0) | (r.y < 0) | (r.right > width) | (r.bottom > height), "OUTSIDE_SLIDE", "error", MESSAGES["outside"])


# The messages of the rules.
MESSAGES = {
    "outside": "Element extends outside the slide",
    "empty": "Text placeholder is empty",
    "placeholder": "Text contains placeholder content",
    "small": "Text is smaller than 14 px",
    "font": "Font is not declared by the template design system",
    "color": "Text color is outside the extracted design system",
    "overflow": "Text exceeds element bounds",
    "margin": "Text is too close to the slide edge",
    "shape": "Shape uses a color outside the extracted palette",
    "image": "Image has missing or malformed embedded data",
    "aspect": "Image frame materially changes the intrinsic aspect ratio",
    "same_id": "Two canvas elements share the same id",
    "dense": "Slide has more than 70 editable objects",
}


def _finding(when: Column, kind: str, severity: str, message: Column | str) -> Column:
    named = MESSAGES[message] if isinstance(message, str) else message
    return F.when(when, F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), (named if isinstance(named, Column) else F.lit(named)).alias("message")))


def _has(elements: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in elements.columns else F.lit(None).cast(kind)


def _cell_findings(rows: Column) -> Column:
    """A finding for each cell of a table with placeholder text."""
    of = lambda cell, r, c: _finding(text.is_placeholder(cell), "EMPTY_PLACEHOLDER", "error", F.format_string("Table cell at row %d, column %d contains placeholder content", r + 1, c + 1))
    return F.flatten(F.transform(rows, lambda row, r: F.array_compact(F.transform(row, lambda cell, c: of(cell, r, c)))))


def _aspect_off(elements: DataFrame, image: Column) -> Column:
    """Whether a frame distorts what the crop leaves of an image."""
    side = lambda name: F.coalesce(_has(elements, f"crop_{name}", "double"), F.lit(0.0))
    wide = image["width"] * (100 - side("left") - side("right")) / 100
    high = image["height"] * (100 - side("top") - side("bottom")) / 100
    # Frames or pictures without a side have no ratio.
    fits = (F.col("w") > 0) & (F.col("h") > 0) & (wide > 0) & (high > 0)
    return F.when(fits, geometry.aspect_distorted(Rect(), wide, high)).otherwise(False)


def element_rules(elements: DataFrame, fonts: list[str], colors: list[str], width: float = WIDTH, height: float = HEIGHT, background: str = BACKGROUND) -> DataFrame:
    """Rules that look at one element at a time, in one pass over the elements."""
    r, edge = Rect(), min(width, height) * MARGIN
    is_text, is_shape, is_image, is_table = (F.col("type") == t for t in ("text", "shape", "image", "table"))
    blank = text.trimmed(F.col("text")) == ""
    known_fonts = [f.lower() for f in (*fonts, *ALWAYS_FONTS)]
    known_colors = [c.upper() for c in (*colors, background)]
    near_edge = (r.x < edge) | (r.y < edge) | (r.right > width - edge) | (r.bottom > height - edge)
    seen = elements
    if "data_url" in elements.columns:
        seen = elements.withColumn("_image", images.embedded_images(F.when(is_image, F.col("data_url"))))
    image = _has(seen, "_image", "struct<valid:boolean,width:bigint,height:bigint>")
    checked = is_image & F.lit("data_url" in elements.columns)
    rules = [
        _finding((r.x < 0) | (r.y < 0) | (r.right > width) | (r.bottom > height), "OUTSIDE_SLIDE", "error", "outside"),
        _finding(is_text & blank, "EMPTY_PLACEHOLDER", "error", "empty"),
        _finding(is_text & ~blank & text.is_placeholder(F.col("text")), "EMPTY_PLACEHOLDER", "error", "placeholder"),
        _finding(is_text & (F.col("font_size") < SMALLEST_FONT), "SMALL_TEXT", "warning", "small"),
        _finding(is_text & ~F.lower("font").isin(*known_fonts), "UNSUPPORTED_FONT", "warning", "font"),
        _finding(is_text & ~F.upper("color").isin(*known_colors), "COLOR_OUTSIDE_DESIGN_SYSTEM", "warning", "color"),
        _finding(is_text & too_tall(), "TEXT_OVERFLOW", "error", "overflow"),
        _finding(is_text & ~is_footer(height) & near_edge, "SMALL_MARGIN", "warning", "margin"),
        _finding(is_shape & ~F.upper("fill").isin(*known_colors) & ~F.upper("stroke").isin(*known_colors), "COLOR_OUTSIDE_DESIGN_SYSTEM", "info", "shape"),
        _finding(checked & ~F.coalesce(image["valid"], F.lit(False)), "INVALID_IMAGE_DATA", "error", "image"),
        _finding(checked & F.coalesce(image["valid"], F.lit(False)) & _aspect_off(elements, image), "IMAGE_ASPECT_DISTORTION", "warning", "aspect"),
    ]
    found = F.array_compact(F.array(*rules))
    if "rows" in elements.columns:
        found = F.concat(found, F.when(is_table & F.col("rows").isNotNull(), _cell_findings(F.col("rows"))).otherwise(F.array().cast("array<struct<type:string,severity:string,message:string>>")))
    return seen.select("slide_id", "ord", "element_id", F.inline(found))


def too_tall() -> Column:
    return geometry.text_height(F.col("text"), F.col("font_size"), F.col("w")) > F.col("h")


def overflow(elements: DataFrame) -> DataFrame:
    return _issues(elements, (F.col("type") == "text") & too_tall(), "TEXT_OVERFLOW", "error", MESSAGES["overflow"])


def repeated_ids(elements: DataFrame) -> DataFrame:
    turn = F.row_number().over(Window.partitionBy("slide_id", "element_id").orderBy("ord"))
    return _issues(elements.withColumn("_turn", turn), F.col("_turn") > 1, "ELEMENT_OVERLAP", "error", MESSAGES["same_id"])


def dense(elements: DataFrame, most: int = DENSE) -> DataFrame:
    counted = elements.groupBy("slide_id").agg(F.count("*").alias("n")).withColumn("ord", F.lit(None).cast("long")).withColumn("element_id", F.lit(None).cast("string"))
    return _issues(counted, F.col("n") > most, "DENSE_LAYOUT", "warning", MESSAGES["dense"])


def _prefixed(rows: DataFrame, prefix: str, columns: list[str]) -> DataFrame:
    return rows.select("slide_id", *[F.col(c).alias(f"{prefix}{c}") for c in columns])


_BOX = ["ord", "element_id", "type", "x", "y", "w", "h"]


def overlap_pairs(elements: DataFrame) -> DataFrame:
    """Pairs of a slide's elements that overlap and may not: lines, shape pairs and text inside a shape may."""
    front = elements.filter((F.col("type") != "shape") | (F.col("shape") != "line"))
    a, b = Rect("a_"), Rect("b_")
    pairs = _prefixed(front, "a_", _BOX).join(_prefixed(front, "b_", _BOX), "slide_id").filter((F.col("a_ord") < F.col("b_ord")) & geometry.overlaps(a, b))
    a_shape, b_shape, a_text, b_text = (F.col(f"{p}_type") == t for t in ("shape", "text") for p in "ab")
    allowed = (a_shape & b_text & geometry.contains(a, b)) | (b_shape & a_text & geometry.contains(b, a)) | (a_shape & b_shape)
    found = pairs.filter(~allowed).withColumnsRenamed({"a_ord": "ord", "a_element_id": "element_id"})
    return _issues(found, F.lit(True), "ELEMENT_OVERLAP", F.when((F.col("a_type") == "text") & b_text, "error").otherwise("warning"), F.concat(F.lit("Element overlaps "), F.col("b_element_id")))


def text_backgrounds(elements: DataFrame, background: str = BACKGROUND) -> DataFrame:
    """The colour behind each text: the topmost lower shape around it, the canvas if nothing is there, null if that is unclear."""
    texts = _prefixed(elements.filter("type = 'text'"), "t_", ["ord", "z", *_BOX[3:]])
    layers = _prefixed(elements.filter("type <> 'text'"), "l_", ["ord", "z", "type", "shape", "fill", "radius", *_BOX[3:]])
    met = texts.join(layers, "slide_id").filter(geometry.overlaps(Rect("t_"), Rect("l_")))
    around = (F.col("l_type") == "shape") & (F.col("l_z") < F.col("t_z")) & geometry.shape_contains(F.col("l_shape"), F.col("l_radius"), Rect("l_"), Rect("t_")) & color.luminance(F.col("l_fill")).isNotNull()
    best = F.max(F.when(around, F.struct(F.col("l_z").alias("z"), (-F.col("l_ord")).alias("turn"), F.col("l_fill").alias("fill"))))
    gathered = met.groupBy("slide_id", "t_ord").agg(best.alias("best"), F.array_sort(F.collect_list(F.col("l_z"))).alias("levels"))
    above = F.size(F.filter("levels", lambda z: z >= F.col("best.z")))
    behind = gathered.select("slide_id", F.col("t_ord").alias("ord"), F.when(F.col("best").isNotNull() & (above == 1), F.col("best.fill")).alias("behind"), F.lit(True).alias("covered"))
    joined = elements.filter("type = 'text'").join(behind, ["slide_id", "ord"], "left")
    return joined.withColumn("background", F.when(F.col("covered").isNull(), background).otherwise(F.col("behind"))).drop("covered", "behind")


def low_contrast(elements: DataFrame, background: str = BACKGROUND) -> DataFrame:
    """Texts whose contrast to the colour behind them is below what their size needs."""
    rows = text_backgrounds(elements, background).withColumn("ratio", color.contrast(F.col("color"), F.col("background"))).withColumn("needed", color.required_contrast(F.col("font_size"), F.col("font_weight")))
    return _issues(rows, (text.trimmed(F.col("text")) != "") & (F.col("ratio") < F.col("needed")), "LOW_TEXT_CONTRAST", "warning", F.concat(F.format_string("Text contrast is %.2f:1; WCAG 2.2 AA requires at least ", F.col("ratio")), F.when(F.col("needed") == 3, "3").otherwise("4.5"), F.lit(":1")))


def duplicate_slides(slides: DataFrame) -> DataFrame:
    """For (deck, slide_id, ord, signature): later slides with the signature of an earlier one; null signatures are never equal."""
    within = Window.partitionBy("deck", "signature").orderBy("ord")
    return slides.filter(F.col("signature").isNotNull()).withColumn("first_id", F.first("slide_id").over(within)).withColumn("_turn", F.row_number().over(within)).filter("_turn > 1").drop("_turn")


def slide_signatures(slides: DataFrame, elements: DataFrame, height: float = HEIGHT) -> DataFrame:
    """slides (deck, slide_id, ord, title) with a signature of title, body texts and tables; null where there is no substance."""
    plain = lambda c: text.normalized(jsontext.nfkc(c))
    if "rows" not in elements.columns:
        elements = elements.withColumn("rows", F.lit(None).cast("array<array<string>>"))
    cells = F.transform("rows", lambda row: F.transform(row, lambda c: F.coalesce(c, F.lit(""))))
    read = elements.select("slide_id", F.when((F.col("type") == "text") & ~is_footer(height), F.col("text")).alias("body"), F.when(F.col("type") == "table", F.to_json(cells)).alias("cells"))
    lines = read.filter("body IS NOT NULL OR cells IS NOT NULL").select("slide_id", plain(F.col("body")).alias("body"), F.from_json(plain(F.col("cells")), "array<array<string>>").alias("rows"))
    tidy = F.transform("rows", lambda row: F.transform(row, text.trimmed))
    filled = F.exists(F.slice("rows", 2, F.greatest(F.size("rows"), F.lit(1))), lambda row: F.exists(row, lambda c: c != ""))
    own = lines.withColumn("rows", tidy).withColumn("cells", F.when(filled, F.to_json("rows"))).join(slides.select("slide_id", plain(F.col("title")).alias("_title")), "slide_id")
    gathered = own.groupBy("slide_id", "_title").agg(F.array_sort(F.collect_list(F.when((F.col("body") != "") & (F.col("body") != F.col("_title")), F.col("body")))).alias("bodies"), F.array_sort(F.collect_list("cells")).alias("tables"))
    signature = F.when((F.col("_title") != "") & ((F.size("bodies") > 0) | (F.size("tables") > 0)), F.to_json(F.struct("_title", "bodies", "tables")))
    return slides.join(gathered.select("slide_id", signature.alias("signature")), "slide_id", "left")


def issues(elements: DataFrame, fonts: list[str], colors: list[str], slides: DataFrame | None = None, background: str = BACKGROUND) -> DataFrame:
    """All issues of all rules; with slides (deck, slide_id, ord, title), also those that repeat an earlier one of their deck."""
    parts = [element_rules(elements, fonts, colors, background=background), repeated_ids(elements), low_contrast(elements, background), overlap_pairs(elements), dense(elements)]
    if slides is not None:
        repeated = duplicate_slides(slide_signatures(slides, elements))
        parts.append(_issues(repeated.withColumn("ord", F.lit(None).cast("long")).withColumn("element_id", F.lit(None).cast("string")), F.lit(True), "DUPLICATE_SLIDE", "warning", F.concat(F.lit("Substantive content matches "), F.col("first_id").cast("string"))))
    return reduce(DataFrame.unionByName, parts)


def report(issues: DataFrame) -> DataFrame:
    """Issues by severity for each slide, and whether it passes: no error that is not ignored."""
    open_issue = ~F.coalesce(F.col("ignored"), F.lit(False)) if "ignored" in issues.columns else F.lit(True)
    of = lambda s: F.count_if(F.col("severity") == s)
    return issues.groupBy("slide_id").agg(of("error").alias("errors"), of("warning").alias("warnings"), of("info").alias("infos"), (~F.bool_or((F.col("severity") == "error") & open_issue)).alias("passed"))


def latest_decisions(decisions: DataFrame, key: str = "issue_key", order: str = "ord") -> DataFrame:
    turn = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return decisions.withColumn("_turn", turn).filter("_turn = 1").drop("_turn")


def effective(issues: DataFrame, decisions: DataFrame) -> DataFrame:
    """Issues with whether their latest decision is to ignore them."""
    last = latest_decisions(decisions).select("issue_key", F.col("action").alias("_action"))
    return issues.join(last, "issue_key", "left").withColumn("ignored", F.coalesce(F.col("_action") == "ignore", F.lit(False))).drop("_action")


def issue_key() -> Column:
    """A JSON tuple of slide, type, element and message."""
    return F.to_json(F.array("slide_id", "type", F.coalesce("element_id", F.lit("")), "message"))


def added_unsafe(before: DataFrame, after: DataFrame, safe: tuple[str, ...]) -> DataFrame:
    """(slide_id, type, element_id) of which there are more unsafe issues after a change than before."""
    keys = ["slide_id", "type", "element_id"]
    counted = lambda rows, to: rows.filter(~F.col("type").isin(*safe)).groupBy(*keys).agg(F.count("*").alias(to))
    joined = counted(after, "now").join(counted(before, "old"), keys, "left")
    return joined.filter(F.col("now") > F.coalesce("old", F.lit(0))).select(*keys, (F.col("now") - F.coalesce("old", F.lit(0))).alias("added"))


def finding_errors(findings: DataFrame, slides: DataFrame, evidence: DataFrame) -> DataFrame:
    """The first error of findings (finding_id, artifact_id, slide_id, evidence_id) against known (artifact_id, slide_id) and (evidence_id, artifact_id, slide_id)."""
    artifacts = slides.select("artifact_id", F.lit(True).alias("has_artifact")).distinct()
    pairs = slides.select("artifact_id", "slide_id", F.lit(True).alias("has_pair")).distinct()
    anywhere = slides.select("slide_id", F.lit(True).alias("has_slide")).distinct()
    own = evidence.select("evidence_id", F.col("artifact_id").alias("e_artifact"), F.col("slide_id").alias("e_slide"))
    joined = findings.join(artifacts, "artifact_id", "left").join(pairs, ["artifact_id", "slide_id"], "left").join(anywhere, "slide_id", "left").join(own, "evidence_id", "left")
    repeated = F.count("*").over(Window.partitionBy("finding_id")) > 1
    named = F.col("evidence_id").isNotNull()
    error = (
        F.when(repeated, "duplicate_finding_id")
        .when(F.col("has_artifact").isNull(), "unknown_artifact_ref")
        .when(F.col("has_pair").isNull(), F.when(F.col("has_slide").isNull(), "unknown_slide_ref").otherwise("inconsistent_slide_artifact_ref"))
        .when(named & F.col("e_artifact").isNull(), "unknown_evidence_ref")
        .when(named & ((F.col("e_artifact") != F.col("artifact_id")) | (F.col("e_slide") != F.col("slide_id"))), "inconsistent_evidence_ref")
    )
    return joined.select("finding_id", error.alias("error"))
