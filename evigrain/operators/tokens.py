"""Design tokens and layouts: consolidation, recurrence, metrics, inheritance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigrain.functions.geometry import rounded


def consolidated(evidence: DataFrame, value: str = "value") -> DataFrame:
    """For (value, confidence, ord, sources): one row a value with the highest confidence, sources united in order, and the first ord.

    Each source of a value is one row before any are gathered, so that a frequent value is no large group.
    """
    each = evidence.select(value, "confidence", "ord", F.posexplode_outer("sources").alias("at", "source"))
    of_source = each.groupBy(value, "source").agg(F.max("confidence").alias("confidence"), F.min("ord").alias("ord"), F.min(F.struct("ord", "at")).alias("first"))
    named = F.array_sort(F.collect_list(F.when(F.col("source").isNotNull(), F.struct("first", "source"))))
    return of_source.groupBy(value).agg(F.max("confidence").alias("confidence"), F.transform(named, lambda r: r["source"]).alias("sources"), F.min("ord").alias("first_ord"))


def sorted_evidence(evidence: DataFrame, value: str = "value", most: int | None = None) -> DataFrame:
    """By value, then by the first source's key."""
    ordered = evidence.orderBy(value, F.get("sources", 0))
    return ordered if most is None else ordered.limit(most)


def _step(column: str, step: int) -> Column:
    return rounded(F.col(column) / step).cast("long").cast("string")


def recurring(elements: DataFrame, least: int = 2, most: int | None = 30) -> DataFrame:
    """Signatures of elements on a 40 px grid that recur, in order of first appearance, described by their last element."""
    signature = F.concat_ws(":", "type", *[_step(c, 40) for c in "xywh"], F.coalesce("fill", F.lit("")))
    described = F.concat("type", F.lit(" at "), rounded(F.col("x")).cast("long").cast("string"), F.lit(","), rounded(F.col("y")).cast("long").cast("string"))
    place = F.struct("slide_no", "ord")
    found = elements.groupBy(signature.alias("signature")).agg(F.count("*").alias("n"), F.max_by(described, place).alias("description"), F.min(place).alias("first")).filter(F.col("n") >= least)
    return (found if most is None else found.orderBy("first").limit(most)).select("signature", "n", "description")


def card_counts(elements: DataFrame) -> DataFrame:
    """The largest group of like panels (on a 20 px grid, by fill) of each slide; 0 without panels."""
    panel = (F.col("type") == "shape") & (F.col("w") > 100) & (F.col("h") > 60)
    signature = F.when(panel, F.concat_ws(":", _step("w", 20), _step("h", 20), F.coalesce("fill", F.lit("none"))))
    by_size = elements.select("slide_id", signature.alias("signature")).groupBy("slide_id", "signature").agg(F.count("signature").alias("n"))
    return by_size.groupBy("slide_id").agg(F.max("n").alias("card_count"))


def slot_metrics(elements: DataFrame) -> DataFrame:
    of = lambda *kinds: F.count_if(F.col("type").isin(*kinds))
    return elements.groupBy("slide_id").agg(of("text", "placeholder").alias("text_slots"), of("placeholder").alias("placeholders"), of("image", "chart", "table").alias("visual_slots"), of("line").alias("lines"), F.bool_or(F.col("type").isin("text", "placeholder") & (F.col("x") < 120)).alias("left_text"), F.bool_or(F.col("type").isin("text", "placeholder") & (F.col("x") > 360)).alias("right_text"))


def compositions(elements: DataFrame) -> DataFrame:
    """Slot metrics with the card count and the composition that follows from them."""
    both = slot_metrics(elements).join(card_counts(elements), "slide_id")
    kind = (
        F.when(F.col("card_count") >= 3, "cards")
        .when(F.col("lines") >= 2, "timeline")
        .when((F.col("visual_slots") > 0) & (F.col("text_slots") <= 3), "visual")
        .when(F.col("text_slots") <= 1, "title")
        .when(F.col("left_text") & F.col("right_text"), "split")
        .otherwise("text")
    )
    return both.withColumn("composition", kind)


def visual_patterns(layouts: DataFrame) -> DataFrame:
    """The patterns that any layout (composition, card_count, visual_slots, background) shows, each a row."""
    signs = {
        "Repeated card grid": F.col("card_count") >= 3,
        "Two-column composition": F.col("composition") == "split",
        "Timeline or connected sequence": F.col("composition") == "timeline",
        "Dedicated visual area": F.col("visual_slots") > 0,
        "Colored slide backgrounds": F.col("background").isNotNull() & (F.col("background") != "#FFFFFF"),
    }
    shown = F.array_compact(F.array(*[F.when(F.bool_or(sign), name) for name, sign in signs.items()]))
    return layouts.agg(shown.alias("patterns")).select(F.explode("patterns").alias("pattern"))


def gaps(elements: DataFrame, width: float = 960.0) -> DataFrame:
    """Rounded horizontal gaps between elements of one slide that stand in the same band."""
    side = lambda p: elements.select("slide_id", *[F.col(c).alias(f"{p}{c}") for c in ("ord", "x", "y", "w", "h")])
    gap = F.col("b_x") - F.col("a_x") - F.col("a_w")
    band = F.abs(F.col("a_y") - F.col("b_y")) < F.least("a_h", "b_h") * 0.45
    pairs = side("a_").join(side("b_"), "slide_id").filter((F.col("a_ord") != F.col("b_ord")) & band & (gap >= 0) & (gap <= width / 2))
    return pairs.groupBy(rounded(gap).alias("gap")).agg(F.count("*").alias("n"))


def layout_confidence(layouts: DataFrame) -> DataFrame:
    """For (layout_id, element_score, background_score, warnings, broken_relationship): a confidence of 0 to 1."""
    penalty = F.least(F.lit(0.55), F.col("warnings") * 0.08 + F.when(F.col("broken_relationship"), 0.2).otherwise(0.0))
    raw = 0.15 + 0.6 * F.coalesce("element_score", F.lit(0.15)) + 0.25 * F.coalesce("background_score", F.lit(0.15)) - penalty
    return layouts.withColumn("confidence", rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)) * 1000) / 1000)


def first_of_each(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row in order of each combination of keys."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("_turn", turn).filter("_turn = 1").drop("_turn")


def background_chain(slides: DataFrame, layouts: DataFrame, masters: DataFrame) -> DataFrame:
    """Each slide's own background, else its layout's, else its master's, else white; confidence loses a tenth at each step."""
    by_layout = layouts.join(masters.select("master_id", F.col("background").alias("m_background"), F.col("confidence").alias("m_confidence")), "master_id", "left")
    own = F.col("background").isNotNull()
    inherited = F.col("m_background").isNotNull()
    l_color = F.when(own, F.col("background")).when(inherited, F.col("m_background")).otherwise("#FFFFFF")
    l_score = F.when(own, F.col("confidence")).when(inherited, F.col("m_confidence") * 0.9).otherwise(0.15)
    effective = by_layout.select("layout_id", l_color.alias("l_background"), l_score.alias("l_confidence"))
    joined = slides.join(effective, "layout_id", "left")
    found = F.col("l_background").isNotNull()
    color = F.when(own, F.col("background")).when(found, F.col("l_background")).otherwise("#FFFFFF")
    score = F.when(own, F.col("confidence")).when(found, F.col("l_confidence") * 0.9).otherwise(0.15)
    return joined.select("slide_id", color.alias("background"), score.alias("confidence"))


def warning_layouts(warnings: DataFrame, layouts: DataFrame) -> DataFrame:
    """Warnings with the layout whose source file they name.

    The file is cut out of the message by its marks, so that the join is on equality.
    """
    named = F.regexp_extract("warning", r"(?:sourceFile=| for |XML part: )([^;\s]+)", 1)
    return warnings.withColumn("source_file", named).join(layouts, "source_file")
