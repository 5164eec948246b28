"""Office packages (zip files of XML) to chunks: worksheets, documents, slide decks."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

from evigrain.runtime import record_batches

TEXT_LIMIT = 50_000
UNSAFE = re.compile(rb"<!DOCTYPE|<!ENTITY", re.IGNORECASE)
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
RELATIONS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

# Fixed values of the word-processing format: containers of paragraphs and of runs, and elements without text.
BLOCKS = ("tbl", "tr", "tc", "sdt", "sdtContent")
BLOCK_PROPERTIES = ("sectPr", "tblPr", "tblGrid", "trPr", "tcPr")
RUNS = ("r", "hyperlink", "ins", "smartTag", "sdt", "sdtContent")
RUN_PROPERTIES = ("pPr", "rPr", "bookmarkStart", "bookmarkEnd", "proofErr", "lastRenderedPageBreak")


class Unreadable(ValueError):
    """A part that is missing or unsafe."""


def _part(package: zipfile.ZipFile, name: str) -> ElementTree.Element:
    try:
        data = package.read(name)
    except KeyError:
        raise Unreadable(f"missing part {name}") from None
    if UNSAFE.search(data):
        raise Unreadable(f"unsafe XML declaration in {name}")
    return ElementTree.fromstring(data)


def _local(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def _all(element: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [e for e in element.iter() if _local(e) == name]


def texts(element: ElementTree.Element) -> list[str]:
    """Text of all t elements, depth first."""
    return [e.text for e in element.iter() if _local(e) == "t" and e.text]


def _targets(package: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Internal relationship targets of a part as package paths."""
    folder, name = posixpath.split(part)
    found = {}
    try:
        root = _part(package, f"{folder}/_rels/{name}.rels")
    except Unreadable:
        return found
    for r in _all(root, "Relationship"):
        target = r.get("Target", "")
        if r.get("TargetMode", "Internal") == "Internal":
            found[r.get("Id", "")] = target[1:] if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
    return found


_RANGE = re.compile(r"\$?([A-Z]+)\$?(\d+):\$?([A-Z]+)\$?(\d+)", re.IGNORECASE)
_CELL = re.compile(r"\$?([A-Z]+)\$?(\d+)", re.IGNORECASE)


def _column(letters: str) -> int:
    number = 0
    for c in letters.upper():
        number = number * 26 + ord(c) - 64
    return number


def merged_ranges(references: list[str]) -> list[tuple[int, int, int, int]]:
    """Ranges (row, column, last row, last column) in order; reversed and single cells are none, and ranges that share their first cell are both dropped."""
    found = set()
    for reference in references:
        if match := _RANGE.fullmatch(reference or ""):
            r1, c1, r2, c2 = int(match[2]), _column(match[1]), int(match[4]), _column(match[3])
            if 0 < r1 <= r2 and c1 <= c2 and (r1, c1) != (r2, c2):
                found.add((r1, c1, r2, c2))
    anchors = [r[:2] for r in found]
    return sorted(r for r in found if anchors.count(r[:2]) == 1)


def _formats(package: zipfile.ZipFile, names: set[str]) -> list[tuple[int, str | None]]:
    """Number format id and own code of each cell style."""
    if "xl/styles.xml" not in names:
        return []
    root = _part(package, "xl/styles.xml")
    codes = {f.get("numFmtId"): f.get("formatCode") for f in _all(root, "numFmt")}
    return [(int(x.get("numFmtId") or 0), codes.get(x.get("numFmtId"))) for own in _all(root, "cellXfs") for x in own if _local(x) == "xf"]


def sheet_cells(content: bytes) -> Iterator[dict]:
    """Raw cells of all worksheets that no merged range covers: sheet, place, type, value, number format, formula, inline and shared text, and the merged range that starts there."""
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        yield from package_cells(package)


def package_cells(package: zipfile.ZipFile, chosen: Callable[[int, str], bool] = lambda number, name: True) -> Iterator[dict]:
    """sheet_cells() of an open workbook; of sheets that are not chosen, by number and name, nothing is unpacked."""
    book = "xl/workbook.xml"
    root, targets = _part(package, book), _targets(package, book)
    sheets = [s for number, s in enumerate(_all(root, "sheet")) if chosen(number, s.get("name"))]
    if not sheets:
        return
    names = set(package.namelist())
    shared = ["".join(texts(item)) for item in _all(_part(package, "xl/sharedStrings.xml"), "si")] if "xl/sharedStrings.xml" in names else []
    formats = _formats(package, names)
    epoch = any(p.get("date1904") in ("1", "true") for p in _all(root, "workbookPr"))
    for sheet in sheets:
        data = _part(package, targets.get(sheet.get(f"{RELATIONS}id", ""), ""))
        merged = merged_ranges([m.get("ref") for m in _all(data, "mergeCell")])
        for row_no, row in enumerate(_all(data, "row"), 1):
            column = 1
            for cell in _all(row, "c"):
                own = _CELL.fullmatch(cell.get("r") or "")
                place = (int(own[2]), _column(own[1])) if own else (int(row.get("r", row_no)), column)
                column = max(column, place[1] + 1)
                range_of = next((m for m in merged if m[0] <= place[0] <= m[2] and m[1] <= place[1] <= m[3]), None)
                if range_of and range_of[:2] != place:
                    continue
                parts = {_local(p): p for p in cell}
                raw = parts["v"].text if "v" in parts else None
                index = int(raw) if cell.get("t") == "s" and raw and raw.isdecimal() else -1
                style = cell.get("s") or ""
                known = formats[int(style)] if style.isdecimal() and int(style) < len(formats) else (0, None)
                yield {
                    "sheet": sheet.get("name"), "ref": cell.get("r") or f"#{place[0]}:{place[1]}", "row_no": place[0], "col_no": place[1], "kind": cell.get("t"), "raw": raw, "style": cell.get("s"), "format_id": known[0], "format_code": known[1], "epoch_1904": epoch,
                    "formula": parts["f"].text if "f" in parts else None, "inline": "".join(texts(parts["is"])) if "is" in parts else None, "shared": shared[index] if 0 <= index < len(shared) else None, "merged": list(range_of) if range_of else None,
                }


def _paragraph(node: ElementTree.Element) -> str | None:
    """A paragraph's text; None if it has an element that is not understood."""
    out = []
    for child in node:
        name = _local(child)
        if not child.tag.startswith(WORD):
            return None
        if name in RUNS:
            inner = _paragraph(child)
            if inner is None:
                return None
            out.append(inner)
        elif name == "t":
            out.append(child.text or "")
        elif name in ("tab", "br", "cr"):
            out.append("\t" if name == "tab" else "\n")
        elif name not in RUN_PROPERTIES:
            return None
    return "".join(out)


def _paragraphs(node: ElementTree.Element) -> list[str] | None:
    out: list[str] = []
    for child in node:
        name = _local(child)
        found = [_paragraph(child)] if name == "p" else _paragraphs(child) if name in BLOCKS else [] if name in BLOCK_PROPERTIES else None
        if found is None or None in found or not child.tag.startswith(WORD):
            return None
        out += found
    return out


def document_chunks(content: bytes) -> Iterator[dict]:
    """Non-blank paragraphs, numbered with the blank ones, up to the text limit in all; the whole text if a part is not understood."""
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        body = _part(package, "word/document.xml").find(f"{WORD}body")
    found = None if body is None else _paragraphs(body)
    if found is None:
        whole = "" if body is None else "\n\n".join("".join(texts(p)) for p in _all(body, "p"))
        if whole.strip():
            yield {"text": whole[:TEXT_LIMIT], "locator": "document", "precision": "document"}
        return
    left = TEXT_LIMIT
    for number, text in enumerate(found, 1):
        if text.strip() and left > 0:
            yield {"text": text[:left], "locator": f"paragraph:{number}", "precision": "exact"}
            left -= len(text[:left])


def _slide_order(package: zipfile.ZipFile) -> list[str] | None:
    """Visible slides in the deck's order; None if the package leaves any doubt."""
    names = set(package.namelist())
    try:
        root, targets = _part(package, "ppt/presentation.xml"), _targets(package, "ppt/presentation.xml")
        ids = _all(root, "sldId")
        parts = [targets.get(i.get(f"{RELATIONS}id", ""), "") for i in ids]
        if not parts or len(set(parts)) < len(parts) or len({i.get("id") for i in ids}) < len(ids) or not set(parts) <= names:
            return None
        return [p for p in parts if _part(package, p).get("show") not in ("0", "false")]
    except (Unreadable, ElementTree.ParseError):
        return None


def deck_chunks(content: bytes) -> Iterator[dict]:
    """Text of each visible slide in order; of all slides by number, at document precision, if the order is in doubt."""
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        ordered = _slide_order(package)
        slides = [n for n in package.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n, re.IGNORECASE)]
        listed = ordered if ordered is not None else sorted(slides, key=lambda n: int(re.findall(r"\d+", n)[-1]))
        exact, empty = ordered is not None, True
        for number, name in enumerate(listed, 1):
            empty = False
            yield {"text": " ".join(texts(_part(package, name)))[:TEXT_LIMIT], "locator": f"slide:{number}" if exact else "document", "precision": "exact" if exact else "document"}
        if empty:
            yield {"text": "", "locator": "document", "precision": "document"}


_READERS = {"docx": document_chunks, "pptx": deck_chunks}


def chunks(files: DataFrame, name: str = "path", content: str = "content", kind: str | None = None) -> DataFrame:
    """(name, ord, text, locator, precision, error) of binary files, by kind or by the file's extension; unreadable files give an error row."""
    schema = pa.schema([("name", pa.string()), ("ord", pa.int64()), ("text", pa.string()), ("locator", pa.string()), ("precision", pa.string()), ("error", pa.string())])

    def found(file: str, data: bytes) -> list[dict]:
        reader = _READERS.get(kind or file.rpartition(".")[2].lower())
        try:
            if reader is None:
                raise Unreadable("unsupported file type")
            return [{"name": file, "ord": i, "error": None} | c for i, c in enumerate(reader(data))]
        except (Unreadable, ElementTree.ParseError, zipfile.BadZipFile) as wrong:
            return [{"name": file, "error": str(wrong)}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = (file for batch in batches for file in zip(batch.column(0), batch.column(1), strict=True))
        yield from record_batches((chunk for file, data in files for chunk in found(file.as_py(), data.as_py() or b"")), schema)

    return files.selectExpr(f"CAST({name} AS STRING) AS name", content).mapInArrow(run, "name string, ord long, text string, locator string, precision string, error string")
