"""Uploaded files of any known type to chunks, by extension."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigrain.functions import cells, text
from evigrain.runtime import record_batches, tuned
from evigrain.sources import csvtext, images, office

#: Bytes of one file, and files of one upload.
MOST_BYTES, MOST_FILES = 12 << 20, 12
TEXTS, PICTURES, OFFICE = ("txt", "md"), ("png", "jpg", "jpeg", "webp", "gif"), ("docx", "pptx")

_SHEET = [("name", pa.string()), ("sheet", pa.string()), ("row_no", pa.int64()), ("col_no", pa.int64()), ("kind", pa.string()), ("raw", pa.string()), ("format_id", pa.int64()), ("format_code", pa.string()), ("epoch_1904", pa.bool_()), ("formula", pa.string()), ("inline", pa.string()), ("shared", pa.string()), ("merged", pa.list_(pa.int64())), ("error", pa.string())]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def found(file: str, data: bytes) -> list[dict]:
        try:
            return [{k: c.get(k) for k, _ in _SHEET} | {"name": file} for c in office.sheet_cells(data)]
        except (office.Unreadable, ElementTree.ParseError, zipfile.BadZipFile) as wrong:
            return [{"name": file, "error": str(wrong)}]

    files = (file for batch in batches for file in zip(batch.column(0), batch.column(1), strict=True))
    yield from record_batches((cell for file, data in files for cell in found(file.as_py(), data.as_py() or b"")), pa.schema(_SHEET))


def _range(merged: Column) -> Column:
    return F.concat_ws(":", cells.reference(F.get(merged, 0), F.get(merged, 1)), cells.reference(F.get(merged, 2), F.get(merged, 3)))


def sheet_facts(files: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """(name, sheet, row_no, col_no, value_type, text, formula, merged_range, locator, error): typed cells of workbooks; covered and empty ones give none."""
    tuned(files.sparkSession)
    kinds = "name string, sheet string, row_no long, col_no long, kind string, raw string, format_id long, format_code string, epoch_1904 boolean, formula string, inline string, shared string, merged array<long>, error string"
    raw = files.selectExpr(f"CAST({name} AS STRING) AS name", f"{content} AS content").mapInArrow(_cells, kinds)
    typed = cells.typed_cell(F.col("kind"), F.col("raw"), F.col("shared"), F.col("inline"), F.coalesce(cells.is_date_format(F.col("format_id"), F.col("format_code")), F.lit(False)), F.coalesce("epoch_1904", F.lit(False)))
    locator = F.when(F.col("sheet").isNotNull(), F.format_string("sheet:%s,row:%d,column:%d", "sheet", "row_no", "col_no"))
    found = raw.select("*", F.inline(F.array(typed))).filter("error IS NOT NULL OR text <> ''")
    return found.select("name", "sheet", "row_no", "col_no", "value_type", text.limited(F.col("text")).alias("text"), "formula", F.when(F.col("merged").isNotNull(), _range(F.col("merged"))).alias("merged_range"), locator.alias("locator"), "error")


def sheet_texts(facts: DataFrame) -> DataFrame:
    """(name, sheet, text): each sheet's cells, joined by tabs in rows and by line breaks."""
    row = facts.filter("error IS NULL").groupBy("name", "sheet", "row_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_no", "text"))), lambda c: c["text"]), "\t").alias("line"))
    return row.groupBy("name", "sheet").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "line"))), lambda r: r["line"]), "\n").alias("text"))


def chunks(files: DataFrame) -> DataFrame:
    """(upload, name, text, locator, precision, value_type, error) of files (upload, ord, name, content, mime): by lower-case extension, pictures by their declared type too.

    Files over MOST_BYTES and of unknown types give an error row; of an upload the first MOST_FILES are read.
    """
    turn = F.row_number().over(Window.partitionBy("upload").orderBy("ord"))
    seen = files.withColumn("_turn", turn).filter(F.col("_turn") <= MOST_FILES).withColumn("file", F.concat_ws("/", "upload", "_turn")).withColumn("ext", F.lower(F.regexp_extract("name", r"(?<=[^/])\.([^./]*)$", 1)))
    fits = F.coalesce(F.octet_length("content"), F.lit(0)) <= MOST_BYTES
    picture = F.col("ext").isin(*PICTURES) | (~F.col("ext").isin(*TEXTS, "csv", "xlsx", *OFFICE) & F.coalesce(F.startswith(F.lower("mime"), F.lit("image/")), F.lit(False)))
    of = lambda when: seen.filter(fits & when)
    body = F.decode("content", "UTF-8")
    out = lambda rows, t, locator, precision, kind, error: rows.select("file", t.alias("text"), locator.alias("locator"), precision.alias("precision"), kind.alias("value_type"), error.alias("error"))
    none, exact = F.lit(None).cast("string"), F.lit("exact")
    plain = of(F.col("ext").isin(*TEXTS)).withColumn("body", F.coalesce(body, F.lit("")))
    table = csvtext.cells(of(F.col("ext") == "csv").select("file", F.coalesce(body, F.lit("")).alias("body")), "file", "body").withColumnRenamed("name", "file")
    sheets = sheet_facts(of(F.col("ext") == "xlsx"), "file").withColumnRenamed("name", "file")
    shown = of(picture).withColumn("found", cells.image_type(F.col("content"))).withColumn("size", images.size_of(F.col("content")))
    sized = F.when(F.col("size").isNotNull(), F.format_string(";width:%d;height:%d", "size.width", "size.height")).otherwise("")
    marks = F.concat(F.lit("image-mime:"), "found", F.lit(";bytes:"), F.octet_length("content").cast("string"), sized)
    packages = reduce_union([office.chunks(of(F.col("ext") == kind), "file", "content", kind).withColumnRenamed("name", "file") for kind in OFFICE])
    parts = [
        out(plain, text.limited(F.col("body")), text.line_locator(F.col("body")), exact, none, none),
        out(table, F.col("text"), F.format_string("row:%d,column:%d", "row_no", "col_no"), exact, F.when(F.col("error").isNull(), text.inferred(F.col("text"))["value_type"]), F.col("error")),
        out(sheets, F.col("text"), F.col("locator"), exact, F.col("value_type"), F.col("error")),
        out(shown, marks, F.lit("image:metadata"), exact, none, F.when(F.col("found").isNull(), F.concat("name", F.lit(" is not a supported PNG, JPG, JPEG, WebP, or GIF image")))),
        out(packages, F.col("text"), F.col("locator"), F.col("precision"), none, F.col("error")),
        out(seen.filter(~fits), none, none, none, none, F.concat("name", F.lit(" exceeds the 12 MB material limit"))),
        out(of(~picture & ~F.col("ext").isin(*TEXTS, "csv", "xlsx", *OFFICE)), none, none, none, none, F.concat(F.lit("Unsupported material type: "), F.when(F.col("ext") != "", F.concat(F.lit("."), "ext")).otherwise(""))),
    ]
    named = seen.select("file", "upload", "name")
    return reduce_union(parts).join(named, "file").select("upload", "name", F.when(F.col("error").isNull(), F.col("text")).alias("text"), F.when(F.col("error").isNull(), F.col("locator")).alias("locator"), F.when(F.col("error").isNull(), F.col("precision")).alias("precision"), F.when(F.col("error").isNull(), F.col("value_type")).alias("value_type"), "error")


def reduce_union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
