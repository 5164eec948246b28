"""Colours: luminance, contrast, palette choice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Font sizes (px) from which text counts as large: plain, and bold.
LARGE, LARGE_BOLD = 24.0, 14 * 96 / 72


def _channel(color: Column, at: int) -> Column:
    value = F.conv(F.substring(color, at, 2), 16, 10).cast("double") / 255.0
    return F.when(value <= 0.04045, value / 12.92).otherwise(F.pow((value + 0.055) / 1.055, F.lit(2.4)))


HEX = "^#[0-9A-Fa-f]{6}$"


def luminance(color: Column) -> Column:
    """WCAG relative luminance of #RRGGBB; null for anything else."""
    return F.when(color.rlike(HEX), 0.2126 * _channel(color, 2) + 0.7152 * _channel(color, 4) + 0.0722 * _channel(color, 6))


def luminance_of(color: str) -> float:
    """The same for a colour that is known beforehand."""
    values = [int(color[i : i + 2], 16) / 255.0 for i in (1, 3, 5)]
    red, green, blue = (v / 12.92 if v <= 0.04045 else ((v + 0.055) / 1.055) ** 2.4 for v in values)
    return 0.2126 * red + 0.7152 * green + 0.0722 * blue


def ratio(x: Column, y: Column) -> Column:
    """The contrast of two luminances; null if either is null."""
    return F.when(x.isNotNull() & y.isNotNull(), (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05))


def contrast(a: Column, b: Column) -> Column:
    """The WCAG contrast of two colours; null if either is none."""
    return F.when(a.rlike(HEX) & b.rlike(HEX), (F.greatest(luminance(a), luminance(b)) + 0.05) / (F.least(luminance(a), luminance(b)) + 0.05))


def required_contrast(font_size: Column, font_weight: Column) -> Column:
    return F.when((font_size >= LARGE) | ((font_weight >= 700) & (font_size >= LARGE_BOLD)), 3.0).otherwise(4.5)


def best_for(background_luminance: Column, palette: list[str]) -> Column:
    """Struct of ratio and color: the palette colour with the highest contrast to a luminance; the first of equals."""
    known = F.array(*[F.struct(F.lit(luminance_of(c)).alias("luminance"), F.lit(-i).alias("turn"), F.lit(c).alias("color")) for i, c in enumerate(palette)])
    ranked = F.array_max(F.transform(known, lambda p: F.struct(ratio(p["luminance"], background_luminance).alias("ratio"), p["turn"].alias("turn"), p["color"].alias("color"))))
    return F.when(ranked["ratio"].isNotNull(), ranked)


def best_contrast(background: Column, palette: list[str]) -> Column:
    """The palette colour with the highest contrast; the first of equals."""
    return best_for(luminance(background), palette)["color"]


def normalized_color(value: Column) -> Column:
    """#RRGGBB in capitals from six hex digits with or without '#'; else null."""
    return F.when(value.rlike("^#?[0-9A-Fa-f]{6}$"), F.concat(F.lit("#"), F.upper(F.regexp_replace(value, "^#", ""))))


def palette_cycle(palette: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(c) for c in palette]), F.pmod(index, F.lit(len(palette))).cast("int"))
