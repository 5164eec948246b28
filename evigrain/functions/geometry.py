"""Rectangles, lines, units and text boxes on a slide canvas. A rectangle is (x, y, w, h)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evigrain.functions.text import SPACES

EMU_PER_PIXEL = 9525
PIXELS_PER_POINT = 96 / 72
CHARACTER_WIDTH, LINE_HEIGHT, LEAST_CHARACTERS = 0.62, 1.28, 4


class Rect:
    """Columns of a rectangle, by prefix."""

    def __init__(self, prefix: str = ""):
        self.x, self.y, self.w, self.h = (F.col(f"{prefix}{c}") for c in "xywh")

    @property
    def right(self) -> Column:
        return self.x + self.w

    @property
    def bottom(self) -> Column:
        return self.y + self.h

    @property
    def area(self) -> Column:
        return self.w * self.h


def overlaps(a: Rect, b: Rect) -> Column:
    return (a.x < b.right) & (a.right > b.x) & (a.y < b.bottom) & (a.bottom > b.y)


def contains(outer: Rect, inner: Rect, slack: float = 2) -> Column:
    return (inner.x >= outer.x - slack) & (inner.y >= outer.y - slack) & (inner.right <= outer.right + slack) & (inner.bottom <= outer.bottom + slack)


def inside_canvas(r: Rect, width: float, height: float, slack: float = 1) -> Column:
    return (r.x >= -slack) & (r.y >= -slack) & (r.right <= width + slack) & (r.bottom <= height + slack)


def intersection_area(a: Rect, b: Rect) -> Column:
    wide = F.greatest(F.lit(0.0), F.least(a.right, b.right) - F.greatest(a.x, b.x))
    return wide * F.greatest(F.lit(0.0), F.least(a.bottom, b.bottom) - F.greatest(a.y, b.y))


def overlap_ratio(a: Rect, b: Rect) -> Column:
    """Shared area by the smaller rectangle's area."""
    return intersection_area(a, b) / F.nullif(F.least(a.area, b.area), F.lit(0.0))


def center_distance(a: Rect, b: Rect) -> Column:
    return F.hypot(a.x + a.w / 2 - b.x - b.w / 2, a.y + a.h / 2 - b.y - b.h / 2)


def _corners(r: Rect) -> list[tuple[Column, Column]]:
    return [(r.x, r.y), (r.right, r.y), (r.x, r.bottom), (r.right, r.bottom)]


def shape_contains(shape: Column, radius: Column, outer: Rect, inner: Rect) -> Column:
    """Whether all corners lie in a rect, roundRect or ellipse; a line contains nothing."""
    within = contains(outer, inner, 0)
    ellipse = rounded = F.lit(True)
    r = F.least(radius, outer.w / 2, outer.h / 2)
    for px, py in _corners(inner):
        ellipse &= F.pow((px - outer.x - outer.w / 2) / (outer.w / 2), F.lit(2.0)) + F.pow((py - outer.y - outer.h / 2) / (outer.h / 2), F.lit(2.0)) <= 1
        near_x = F.greatest(outer.x + r, F.least(px, outer.right - r))
        near_y = F.greatest(outer.y + r, F.least(py, outer.bottom - r))
        rounded &= F.pow(px - near_x, F.lit(2.0)) + F.pow(py - near_y, F.lit(2.0)) <= F.pow(r, F.lit(2.0))
    return F.when(shape == "line", False).when(shape == "rect", within).when(shape == "ellipse", ellipse).when(r == 0, within).otherwise(rounded)


def clipped(r: Rect, width: float, height: float) -> Column:
    """The part of a rectangle on the canvas; null if there is none."""
    left, top = F.greatest(r.x, F.lit(0.0)), F.greatest(r.y, F.lit(0.0))
    right, bottom = F.least(r.right, F.lit(float(width))), F.least(r.bottom, F.lit(float(height)))
    return F.when((right > left) & (bottom > top), F.struct(left.alias("x"), top.alias("y"), (right - left).alias("w"), (bottom - top).alias("h")))


def line_in_rect(x1: Column, y1: Column, x2: Column, y2: Column, r: Rect) -> Column:
    """Length of the part of a line inside a rectangle, by parametric clipping."""
    dx, dy = x2 - x1, y2 - y1

    def bounds(d: Column, at: Column, low: Column, high: Column) -> tuple[Column, Column]:
        inside = (at >= low) & (at <= high)
        a, b = (low - at) / F.nullif(d, F.lit(0.0)), (high - at) / F.nullif(d, F.lit(0.0))
        return F.when(d == 0, F.when(inside, 0.0).otherwise(2.0)).otherwise(F.least(a, b)), F.when(d == 0, F.when(inside, 1.0).otherwise(-1.0)).otherwise(F.greatest(a, b))

    ax, bx = bounds(dx, x1, r.x, r.right)
    ay, by = bounds(dy, y1, r.y, r.bottom)
    enter, leave = F.greatest(ax, ay, F.lit(0.0)), F.least(bx, by, F.lit(1.0))
    return F.when(leave > enter, (leave - enter) * F.hypot(dx, dy)).otherwise(0.0)


def rounded(x: Column) -> Column:
    """To the nearest whole number, halves upwards."""
    return F.floor(x + 0.5).cast("double")


def quantized(x: Column, step: float) -> Column:
    return rounded(x / step) * step


def clamped(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, low), high)


def emu_to_pixels(x: Column) -> Column:
    return x / EMU_PER_PIXEL


def points_to_pixels(x: Column) -> Column:
    return x * PIXELS_PER_POINT


def crop(raw: Column) -> Column:
    """A side's crop in percent from whole thousandths of a percent; missing is 0, anything else null."""
    return F.when(raw.isNull() | (raw == ""), 0.0).when(raw.rlike(r"^[0-9]+$"), raw.try_cast("double") / 1000.0)


def rotation(raw: Column) -> Column:
    """Degrees in [0, 360) from whole sixty-thousandths."""
    return F.when(raw.rlike(r"^-?[0-9]+$"), F.pmod(raw.try_cast("double") / 60000.0, F.lit(360.0)) + 0.0)


def aspect_distorted(frame: Rect, image_w: Column, image_h: Column, most: float = 0.1) -> Column:
    import math

    return F.abs(F.log((frame.w / frame.h) / (image_w / image_h))) > math.log(1 + most)


def variant_slot(r: Rect, factor: Column, width: float) -> Column:
    """A slot with its width scaled, kept in 12 to 82 percent of the canvas, about the same centre and on the canvas."""
    wide = clamped(r.w * factor, F.lit(0.12 * width), F.lit(0.82 * width))
    return F.struct(clamped(r.x + r.w / 2 - wide / 2, F.lit(0.0), F.lit(float(width)) - wide).alias("x"), wide.alias("w"))


def margins(r: Rect, width: float, height: float) -> Column:
    return F.struct(r.x.alias("left"), r.y.alias("top"), (F.lit(float(width)) - r.right).alias("right"), (F.lit(float(height)) - r.bottom).alias("bottom"))


def l1_distance(a: Rect, b: Rect) -> Column:
    return F.abs(a.x - b.x) + F.abs(a.y - b.y) + F.abs(a.w - b.w) + F.abs(a.h - b.h)


def text_lines(text: Column, font_size: Column, width: Column) -> Column:
    """Lines of greedily wrapped text: words longer than a line are cut, each line of the text takes one at least."""
    most = F.greatest(F.lit(LEAST_CHARACTERS), F.floor(width / F.greatest(F.lit(5.0), font_size * CHARACTER_WIDTH)).cast("int"))

    def step(state: Column, word: Column) -> Column:
        size, now = F.char_length(word), state["now"]
        breaks = (now > 0) & (now + 1 + size > most)
        now = F.when(breaks, 0).otherwise(now)
        cut = F.when(size > most, F.floor((size - 1) / most).cast("int")).otherwise(0)
        left = size - cut * most
        return F.struct((state["done"] + breaks.cast("int") + cut).alias("done"), F.when(now > 0, now + 1 + left).otherwise(left).alias("now"))

    def lines(line: Column) -> Column:
        words = F.filter(F.split(line, SPACES), lambda w: w != "")
        return F.aggregate(words, F.struct(F.lit(0).alias("done"), F.lit(0).alias("now")), step, lambda s: F.greatest(F.lit(1), s["done"] + (s["now"] > 0).cast("int")))

    return F.aggregate(F.transform(F.split(text, "\n"), lines), F.lit(0), lambda n, x: n + x)


def text_height(text: Column, font_size: Column, width: Column) -> Column:
    return text_lines(text, font_size, width) * font_size * LINE_HEIGHT
