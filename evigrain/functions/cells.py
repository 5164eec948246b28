"""Spreadsheet cells and file names: references, ranges, serial dates, formats, typing, media types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the formats.
DATE_FORMATS = (14, 15, 16, 17, 18, 19, 20, 21, 22, 27, 28, 29, 30, 31, 32, 33, 34, 35, 36, 50, 51, 52, 53, 54, 55, 56, 57, 58)
LAST_SERIAL = 2_958_465
DAY_MS = 86_400_000
MEDIA_TYPES = {
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".txt": "text/plain",
    ".md": "text/markdown",
    ".csv": "text/csv",
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".webp": "image/webp",
    ".gif": "image/gif",
}

_REFERENCE = r"(?i)^\$?([A-Z]+)\$?([0-9]+)$"


def column_number(reference: Column) -> Column:
    """The column of an A1 reference; null if it is none."""
    letters = F.upper(F.regexp_extract(reference, _REFERENCE, 1))
    digits = F.filter(F.split(letters, ""), lambda c: c != "")
    number = F.aggregate(digits, F.lit(0).cast("long"), lambda n, c: n * 26 + F.ascii(c) - 64)
    return F.when((number > 0) & (row_number_of(reference) > 0), number)


def row_number_of(reference: Column) -> Column:
    return F.regexp_extract(reference, _REFERENCE, 2).try_cast("long")


def reference(row: Column, column: Column) -> Column:
    """The A1 reference of a cell, for columns of three letters at most."""
    letter = lambda n: F.char(n + 65)
    one, two = column - 1, column - 27
    three = column - 703
    name = F.when(column <= 26, letter(one)).when(column <= 702, F.concat(letter(F.floor(two / 26)), letter(F.pmod(two, F.lit(26))))).otherwise(F.concat(letter(F.floor(three / 676)), letter(F.pmod(F.floor(three / 26), F.lit(26))), letter(F.pmod(three, F.lit(26)))))
    return F.concat(name, row.cast("string"))


def serial_to_iso(serial: Column, epoch_1904: Column) -> Column:
    """The UTC time of a serial day as ISO text with milliseconds; null outside the range and for the day that never was."""
    days = F.floor(serial)
    ms = F.floor((serial - days) * DAY_MS + 0.5)
    start = F.when(epoch_1904, F.lit(-2_082_844_800_000)).otherwise(F.lit(-2_209_075_200_000))
    counted = F.when(~epoch_1904 & (days >= 61), days - 1).otherwise(days)
    valid = (serial >= 0) & (serial <= LAST_SERIAL) & (epoch_1904 | (serial < 60) | (serial >= 61))
    return F.when(valid, F.date_format(F.timestamp_millis((start + counted * DAY_MS + ms).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def is_date_format(format_id: Column, code: Column) -> Column:
    """Whether a number format shows a date: a built-in one, or a code with y or d outside of literals, escapes and brackets."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(code, '"[^"]*"', ""), r"\\.", ""), r"\[[^\]]*\]", ""), "[_*].", ""))
    return format_id.isin(*DATE_FORMATS) | F.coalesce(bare.contains("y") | bare.contains("d"), F.lit(False))


def typed_cell(kind: Column, raw: Column, shared: Column, inline: Column, date_style: Column, epoch_1904: Column) -> Column:
    """value_type and text of a cell; both null where a cell gives no fact."""
    kind = F.lower(F.coalesce(kind, F.lit("n")))
    number, flag = raw.try_cast("double"), F.lower(raw)
    iso = serial_to_iso(number, epoch_1904)
    present = raw.isNotNull() & (raw != "")
    text = (
        F.when(kind == "inlinestr", F.when(inline != "", inline))
        .when(~present, None)
        .when(kind == "s", shared)
        .when(kind == "b", F.when(flag.isin("1", "true"), "true").when(flag.isin("0", "false"), "false"))
        .when(kind == "n", F.when(number.isNull() | F.isnan(number), raw).when(date_style, iso).otherwise(raw))
        .when(kind == "str", raw)
    )
    of = F.when(kind == "b", "boolean").when((kind == "n") & number.isNotNull(), F.when(date_style, "date").otherwise("number")).otherwise("string")
    return F.struct(F.when(text.isNotNull(), of).alias("value_type"), text.alias("text"))


def media_type(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(F.regexp_extract(name, r"(?<=[^/])(\.[^./]*)$", 1))), F.lit("application/octet-stream"))


def image_type(content: Column) -> Column:
    """The media type that an image's first bytes tell; else null."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "image/png")
        .when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("474946383761") | head.startswith("474946383961"), "image/gif")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
    )


def delimiter(first_line: Column) -> Column:
    """';' if it is more frequent than ',' outside of quotes, else ','."""
    parts = F.split(first_line, '"')
    outside = F.array_join(F.filter(parts, lambda _, i: F.pmod(i, F.lit(2)) == 0), "")
    return F.when(F.regexp_count(outside, F.lit(";")) > F.regexp_count(outside, F.lit(",")), ";").otherwise(",")
