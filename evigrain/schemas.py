"""Contracts of the tables that operators take: columns, types and value rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLES = {
    "sources": "source_id string, name string, mime string, sha256 string, byte_size long",
    "chunks": "chunk_id string, source_id string, ord long, text string, precision string, locator string, merged_range string",
    "facts": "fact_id string, source_id string, chunk_id string, ord long, locator string, merged_range string, value_type string, value_num double, value_str string",
    "claims": "claim_id string, text string, chunk_ids array<string>, fact_ids array<string>, quote string",
    "elements": "slide_id string, ord long, element_id string, type string, x double, y double, w double, h double, z long, text string, font string, font_size double, font_weight int, color string, shape string, fill string, stroke string, radius double",
    "issues": "slide_id string, ord long, element_id string, type string, severity string, message string",
    "decisions": "issue_key string, ord long, action string",
    "requests": "key string, kind string, at long, seq long, busy boolean",
}

# What enumerations hold.
PRECISIONS = ("exact", "document")
VALUE_TYPES = ("string", "number", "boolean", "date")
ELEMENT_TYPES = ("text", "shape", "image", "table", "chart", "placeholder", "line")
SEVERITIES = ("info", "warning", "error")


def conformed(df: DataFrame, name: str) -> DataFrame:
    """df with exactly the contract's columns in its types: missing ones are null, others are left out."""
    wanted = df.sparkSession.createDataFrame([], TABLES[name]).schema
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])


def rules(name: str) -> dict[str, Column]:
    """Rules that hold for each row of a table, by name."""
    given = lambda *cs: {f"{c}_missing": F.col(c).isNotNull() for c in cs}
    return {
        "sources": given("source_id", "name") | {"sha256_malformed": F.col("sha256").rlike("^[0-9a-f]{64}$"), "byte_size_negative": F.col("byte_size") >= 0},
        "chunks": given("chunk_id", "source_id", "text") | {"precision_unknown": F.col("precision").isin(*PRECISIONS), "text_too_long": F.char_length("text") <= 50_000},
        "facts": given("fact_id", "chunk_id", "locator") | {"value_type_unknown": F.col("value_type").isin(*VALUE_TYPES), "value_missing": F.coalesce(F.col("value_num").cast("string"), F.col("value_str")).isNotNull()},
        "claims": given("claim_id", "text") | {"text_too_long": F.char_length("text") <= 280},
        "elements": given("slide_id", "element_id", "x", "y", "w", "h") | {"type_unknown": F.col("type").isin(*ELEMENT_TYPES), "size_not_positive": (F.col("w") > 0) & (F.col("h") > 0), "color_malformed": F.col("color").isNull() | F.col("color").rlike("^#[0-9A-Fa-f]{6}$")},
        "issues": given("slide_id", "type", "message") | {"severity_unknown": F.col("severity").isin(*SEVERITIES)},
        "decisions": given("issue_key", "action"),
        "requests": given("key", "kind", "at"),
    }[name]


def violations(df: DataFrame, name: str, key: str) -> DataFrame:
    """(key, rule): a row for each rule that a row breaks."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), rule) for rule, ok in rules(name).items()]))
    return df.select(F.col(key), F.explode(broken).alias("rule"))
