"""Comparison of documents, page sets and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigrain.functions.geometry import quantized

VARIANTS = ("compact", "balanced", "visual")


def fingerprints(elements: DataFrame, step: float = 8) -> DataFrame:
    """Elements with a canonical text of their structure: type, order, geometry on a grid and style, not content."""
    q = lambda c: quantized(F.col(c), step).cast("long").cast("string")
    style = F.when(F.col("type") == "text", F.concat_ws("|", q("font_size"), F.col("font_weight").cast("string"))).when(F.col("type") == "shape", F.concat_ws("|", "shape", "fill", "stroke", q("radius"))).otherwise("")
    return elements.withColumn("fingerprint", F.concat_ws(";", "type", q("x"), q("y"), q("w"), q("h"), F.col("z").cast("string"), style))


def slide_digests(elements: DataFrame, keys: list[str]) -> DataFrame:
    """A digest of the sorted fingerprints of each slide, so that order does not count."""
    return elements.groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("fingerprint")), "\n"), 256).alias("digest"), F.count("*").alias("elements"))


def multiset_diff(left: DataFrame, right: DataFrame, keys: list[str], value: str = "fingerprint") -> DataFrame:
    """Per keys: elements only left, only right, all of both, their ratio. A side without rows of a key counts as missing.

    Counts of equal values are compared, so no pairs of elements are made.
    """
    count = lambda rows, to: rows.groupBy(*keys, value).agg(F.count("*").alias(to))
    both = count(left, "l").join(count(right, "r"), [*keys, value], "full_outer").fillna(0, ["l", "r"])
    found = both.groupBy(*keys).agg(F.sum(F.greatest(F.col("l") - F.col("r"), F.lit(0))).alias("left_only"), F.sum(F.greatest(F.col("r") - F.col("l"), F.lit(0))).alias("right_only"), F.sum(F.col("l") + F.col("r")).alias("total"))
    return found.withColumn("ratio", F.when(F.col("total") == 0, 0.0).otherwise((F.col("left_only") + F.col("right_only")) / F.col("total")))


def combined(distances: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of slide distances, and ratios of the sums."""
    found = distances.groupBy(*keys).agg(F.count("*").alias("slides"), F.count_if(F.col("left_only") + F.col("right_only") > 0).alias("different_slides"), *[F.sum(c).alias(c) for c in ("left_only", "right_only", "total")])
    return found.withColumn("slide_ratio", F.when(F.col("slides") == 0, 0.0).otherwise(F.col("different_slides") / F.col("slides"))).withColumn("element_ratio", F.when(F.col("total") == 0, 0.0).otherwise((F.col("left_only") + F.col("right_only")) / F.col("total")))


def variant_pairs(elements: DataFrame) -> DataFrame:
    """For elements with variant, slide_no and fingerprint: the distance of each pair of variants, in their declared order, per slide."""
    rank = lambda c: F.array_position(F.array(*[F.lit(v) for v in VARIANTS]), F.col(c))
    others = F.explode(F.array(*[F.lit(v) for v in VARIANTS]))
    marked = elements.select("variant", "slide_no", "fingerprint", others.alias("other")).filter(F.col("variant") != F.col("other"))
    first = rank("variant") < rank("other")
    named = marked.select(F.when(first, F.col("variant")).otherwise(F.col("other")).alias("left_variant"), F.when(first, F.col("other")).otherwise(F.col("variant")).alias("right_variant"), "slide_no", "fingerprint", first.alias("is_left"))
    keys = ["left_variant", "right_variant", "slide_no"]
    return multiset_diff(named.filter("is_left"), named.filter("NOT is_left"), keys)


def gates(pairs: DataFrame, title_slide: int = 0) -> DataFrame:
    """Per pair of variants: the combined distance, and whether a slide other than the title differs."""
    keys = ["left_variant", "right_variant"]
    beyond = pairs.groupBy(*keys).agg(F.count_if((F.col("slide_no") != title_slide) & (F.col("left_only") + F.col("right_only") > 0)).alias("differing_slides"))
    found = combined(pairs, keys).join(beyond, keys)
    return found.withColumn("verdict", F.when(F.col("different_slides") == 0, "identical").when(F.col("differing_slides") == 0, "only title differs").otherwise("distinct"))


def vector_diff(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Channel metrics of two equally long vectors: differing channels, largest, total and mean absolute difference."""
    diff = F.zip_with(left, right, lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    total = F.aggregate("_diff", F.lit(0.0), lambda s, x: s + x)
    found = pairs.withColumn("_diff", diff)
    return found.withColumns({"differing": F.size(F.filter("_diff", lambda x: x > 0)), "largest": F.array_max("_diff"), "total": total, "mean_abs": total / F.size("_diff")}).drop("_diff")


def page_sets(expected: DataFrame, current: DataFrame) -> DataFrame:
    """For (fixture, page, bytes, sha, w, h): why a current page does not match the expected one; null if it does."""
    own = current.select("fixture", "page", *[F.col(c).alias(f"c_{c}") for c in ("bytes", "sha", "w", "h")])
    differs = F.array_compact(F.array(*[F.when(F.col(c) != F.col(f"c_{c}"), name) for c, name in (("bytes", "byte-size"), ("sha", "sha256"), ("w", "width"), ("h", "height"))]))
    reason = F.when(F.col("c_sha").isNull(), "missing").when(F.size(differs) > 0, F.array_join(differs, ","))
    return expected.join(own, ["fixture", "page"], "left").select("fixture", "page", reason.alias("mismatch"))


def page_set_digest(pages: DataFrame) -> DataFrame:
    """SHA-256 of the JSON list of (page, bytes, sha, w, h) in page order, per fixture."""
    one = lambda r: F.concat(F.lit("["), r["page"].cast("string"), F.lit(","), r["bytes"].cast("string"), F.lit(',"'), r["sha"], F.lit('",'), r["w"].cast("string"), F.lit(","), r["h"].cast("string"), F.lit("]"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "bytes", "sha", "w", "h"))), one), ",")
    return pages.groupBy("fixture").agg(F.count("*").alias("pages"), F.sha2(F.concat(F.lit("["), listed, F.lit("]")), 256).alias("digest"))


def text_parity(canvas: DataFrame, exported: DataFrame, tolerances: dict[str, float]) -> DataFrame:
    """For boxes (text_id, x, y, w, h): which sides of the exported box are off by more than tolerated; 'missing' without a box."""
    own = exported.select("text_id", *[F.col(c).alias(f"e_{c}") for c in "xywh"])
    off = F.array_compact(F.array(*[F.when(F.abs(F.col(c) - F.col(f"e_{c}")) > t, c) for c, t in tolerances.items()]))
    return canvas.join(own, "text_id", "left").select("text_id", F.when(F.col("e_x").isNull(), "missing").when(F.size(off) > 0, F.array_join(off, ",")).alias("finding"))
