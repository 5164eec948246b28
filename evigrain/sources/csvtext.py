"""CSV text to cells with the physical line on which their row starts, which Spark's own reader can't give."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from evigrain.runtime import record_batches

TEXT_LIMIT = 50_000

_NEWLINE = re.compile(r"\r\n|\n|\r")


class MalformedCsv(ValueError):
    """A quote that is not closed, or that stands where none may."""


def sniff(text: str) -> str:
    """';' if the first line has more of it than of ',' outside of quotes, else ','."""
    outside = "".join(_NEWLINE.split(text, maxsplit=1)[0].split('"')[::2])
    return ";" if outside.count(";") > outside.count(",") else ","


def rows(text: str) -> Iterator[tuple[int, list[str]]]:
    """(physical line, cells) of each row. A field is quoted as a whole or has no quote at all."""
    text = text.removeprefix("﻿")
    mark = re.escape(sniff(text))
    field = re.compile(rf'(?:"((?:[^"]|"")*+)"|([^"{mark}\r\n]*+))({mark}|\r\n|\n|\r|\Z)')
    at, line, start, cells, found = 0, 1, 1, [], False
    while at < len(text) or cells or not found:
        match = field.match(text, at)
        if not match:
            closed = text[at] != '"' or re.compile(r'"(?:[^"]|"")*+"').match(text, at)
            raise MalformedCsv(f"Malformed CSV quote at line {line}" if closed else f"Unmatched CSV quote at line {start}")
        quoted, plain, end = match.groups()
        cells.append(plain if quoted is None else quoted.replace('""', '"'))
        line += len(_NEWLINE.findall(quoted or ""))
        at = match.end()
        if end == text[match.end() - len(end) : match.end()] and end and end not in "\r\n":
            if at < len(text):
                continue
            cells.append("")
        yield start, cells
        found = True
        line += 1
        start, cells = line, []


def cells(files: DataFrame, name: str = "name", text: str = "text") -> DataFrame:
    """(name, row_no, col_no, text, error): a row a cell; files that can't be read give one row with the error."""
    schema = pa.schema([("name", pa.string()), ("row_no", pa.int64()), ("col_no", pa.int64()), ("text", pa.string()), ("error", pa.string())])

    def found(file: str, content: str) -> list[dict]:
        try:
            return [{"name": file, "row_no": line, "col_no": c + 1, "text": cell} for line, row in rows(content[:TEXT_LIMIT]) for c, cell in enumerate(row)]
        except MalformedCsv as wrong:
            return [{"name": file, "error": str(wrong)}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = (file for batch in batches for file in zip(batch.column(0), batch.column(1), strict=True))
        yield from record_batches((cell for file, content in files for cell in found(file.as_py(), content.as_py() or "")), schema)

    return files.selectExpr(f"CAST({name} AS STRING) AS name", f"{text} AS text").mapInArrow(run, "name string, row_no long, col_no long, text string, error string")
