"""Template packages and their parts (drawing XML) to rows: parts, relationships, theme tokens, elements, warnings."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

from evigrain.runtime import record_batches
from evigrain.sources.office import UNSAFE

MOST_BYTES, MOST_PACKAGE = 3 << 20, 50 << 20
EMU = 9525
#: How sure a token is that stands in the theme.
SURE = 0.99


def _local(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def color(value: str | None) -> str | None:
    return f"#{value.removeprefix('#').upper()}" if value and re.fullmatch("#?[0-9A-Fa-f]{6}", value) else None


def _root(data: bytes | None) -> ElementTree.Element | None:
    if not data or len(data) > MOST_BYTES or UNSAFE.search(data):
        return None
    try:
        return ElementTree.fromstring(data)
    except ElementTree.ParseError:
        return None


def theme_tokens(data: bytes | None) -> Iterator[dict]:
    """Colours, fonts of headings and bodies, sizes (px) and weights, depth first; scheme names the colour's slot."""
    root = _root(data)
    stack = [] if root is None else [(root, "", "")]
    while stack:
        node, parent, path = stack.pop()
        name = _local(node)
        here = f"{path}/{name}"
        found = []
        if name == "srgbClr":
            found.append(("color", color(node.get("val"))))
        elif name == "sysClr":
            found.append(("color", color(node.get("lastClr") or node.get("val"))))
        elif name == "latin":
            found.append(("heading_font" if re.search("majorFont|headFont", parent, re.IGNORECASE) else "body_font", node.get("typeface") or None))
        if (node.get("sz") or "").isdecimal() and int(node.get("sz")):
            found.append(("font_size", str(int(int(node.get("sz")) / 100 * 96 / 72 + 0.5))))
        if node.get("b") == "1":
            found.append(("font_weight", "700"))
        for kind, value in found:
            if value:
                yield {"kind": kind, "value": value, "path": here, "scheme": parent if name == "srgbClr" else None, "confidence": SURE}
        stack += [(child, name, here) for child in reversed(node)]


def _box(node: ElementTree.Element, *names: str) -> list[float] | None:
    """Numbers of off and ext children (or others), if all are there."""
    out = []
    for name in names:
        found = next((e for e in node if _local(e) == name), None)
        keys = ("x", "y") if name.endswith("ff") else ("cx", "cy")
        if found is None or not all(re.fullmatch("-?[0-9]+", found.get(k) or "") for k in keys):
            return None
        out += [float(found.get(k)) for k in keys]
    return out


def slide_elements(data: bytes | None, warnings: list[str] | None = None) -> Iterator[dict]:
    """Shapes, pictures, connectors and frames of a slide in document order, in pixels, through nested groups; z puts those without an id last.

    Groups that are turned, flipped or without extent are left out with all in them, and give a warning.
    """
    found = list(_elements(data, [] if warnings is None else warnings))
    known = sum(e["element_id"] is not None for e in found)
    with_id = without = 0
    for e in found:
        if e["element_id"] is None:
            e["z"], without = known + without, without + 1
        else:
            e["z"], with_id = with_id, with_id + 1
        yield e


def _elements(data: bytes | None, warnings: list[str]) -> Iterator[dict]:
    root = _root(data)
    tree = None if root is None else next((e for e in root.iter() if _local(e) == "spTree"), None)
    kinds = {"sp": "shape", "pic": "image", "cxnSp": "line", "graphicFrame": "frame"}
    order = 0

    def walk(node: ElementTree.Element, sx: float, sy: float, tx: float, ty: float, depth: int) -> Iterator[dict]:
        nonlocal order
        for child in node:
            name = _local(child)
            form = next((e for e in child.iter() if _local(e) == "xfrm"), None)
            if name == "grpSp":
                turned = form is not None and (form.get("rot") or form.get("flipH") or form.get("flipV"))
                box = None if form is None or turned else _box(form, "off", "ext", "chOff", "chExt")
                if not box or min(box[2], box[3], box[6], box[7]) <= 0:
                    warnings.append("Skipped turned or flipped group" if turned else "Skipped group without extent")
                else:
                    gx, gy = box[2] / box[6], box[3] / box[7]
                    yield from walk(child, sx * gx, sy * gy, sx * (box[0] - gx * box[4]) + tx, sy * (box[1] - gy * box[5]) + ty, depth + 1)
            elif name in kinds:
                box = None if form is None else _box(form, "off", "ext")
                words = " ".join(e.text for e in child.iter() if _local(e) == "t" and e.text)
                slot = next((e for e in child.iter() if _local(e) == "ph"), None)
                kind = "placeholder" if slot is not None else "text" if name == "sp" and words else kinds[name]
                own = next((e for e in child.iter() if _local(e) == "cNvPr"), None)
                place = [None] * 4 if box is None else [(sx * box[0] + tx) / EMU, (sy * box[1] + ty) / EMU, sx * box[2] / EMU, sy * box[3] / EMU]
                yield {"ord": order, "element_id": None if own is None else own.get("id"), "type": kind, "depth": depth, "text": words, **dict(zip("xywh", place, strict=True))}
                order += 1

    if tree is not None:
        yield from walk(tree, 1.0, 1.0, 0.0, 0.0, 0)


_TOKENS = pa.schema([("name", pa.string()), ("kind", pa.string()), ("value", pa.string()), ("path", pa.string()), ("scheme", pa.string()), ("confidence", pa.float64())])
_ELEMENTS = pa.schema([("name", pa.string()), ("ord", pa.int64()), ("element_id", pa.string()), ("type", pa.string()), ("depth", pa.int64()), ("text", pa.string()), *((c, pa.float64()) for c in "xywh"), ("z", pa.int64())])


def _rows(parts: DataFrame, reader, schema: pa.Schema, ddl: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = (file for batch in batches for file in zip(batch.column(0), batch.column(1), strict=True))
        yield from record_batches(({"name": name.as_py()} | row for name, data in files for row in reader(data.as_py())), schema)

    return parts.selectExpr("CAST(name AS STRING) AS name", "content").mapInArrow(run, ddl)


def tokens_of(parts: DataFrame) -> DataFrame:
    """Theme tokens of parts (name, content)."""
    return _rows(parts, theme_tokens, _TOKENS, "name string, kind string, value string, path string, scheme string, confidence double")


def elements_of(parts: DataFrame) -> DataFrame:
    """Slide elements of parts (name, content)."""
    return _rows(parts, slide_elements, _ELEMENTS, "name string, ord long, element_id string, type string, depth long, text string, x double, y double, w double, h double, z long")


def _warnings(data: bytes | None) -> Iterator[dict]:
    found: list[str] = []
    list(slide_elements(data, found))
    return ({"warning": w} for w in found)


def warnings_of(parts: DataFrame) -> DataFrame:
    """(name, warning): what elements_of left out of parts (name, content)."""
    return _rows(parts, _warnings, pa.schema([("name", pa.string()), ("warning", pa.string())]), "name string, warning string")


_ROLES = (("theme", r"ppt/theme/theme(\d+)\.xml"), ("master", r"ppt/slideMasters/slideMaster(\d+)\.xml"), ("layout", r"ppt/slideLayouts/slideLayout(\d+)\.xml"), ("slide", r"ppt/slides/slide(\d+)\.xml"), ("presentation", r"ppt/presentation\.xml"), ("media", r"ppt/media/[^/]+"))


def package_parts(content: bytes | None) -> Iterator[dict]:
    """Parts of a template by role, numbered within it, with their bytes and relationships; parts that can't be used have a warning instead of bytes, an unsafe package a single error."""
    data = content or b""
    if len(data) > MOST_PACKAGE:
        yield {"error": "PPTX template exceeds the 50 MB safety limit"}
        return
    out = []
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as package:
            names = package.namelist()
            for role, pattern in _ROLES:
                matches = [(int(m[1]) if m.re.groups else 0, m.string) for n in names if (m := re.fullmatch(pattern, n, re.IGNORECASE))]
                for number, (_, name) in enumerate(sorted(matches), 1):
                    body, warning = package.read(name), None
                    if role != "media":
                        if len(body) > MOST_BYTES:
                            body, warning = None, f"Skipped oversized XML part: {name}"
                        elif UNSAFE.search(body):
                            yield {"error": "Unsafe XML declaration in PPTX package"}
                            return
                        else:
                            try:
                                ElementTree.fromstring(body)
                            except ElementTree.ParseError:
                                body, warning = None, f"Could not parse XML part: {name}"
                    out.append({"role": role, "number": number, "part": name, "content": body, "warning": warning, "relations": _relations(package, names, name)})
            if not any(p["role"] == "presentation" for p in out):
                out.append({"role": "presentation", "number": 1, "part": "ppt/presentation.xml", "warning": "Missing XML part: ppt/presentation.xml", "relations": []})
    except zipfile.BadZipFile as wrong:
        out = [{"error": str(wrong)}]
    yield from out


def _relations(package: zipfile.ZipFile, names: list[str], part: str) -> list[dict]:
    folder, _, name = part.rpartition("/")
    rels = f"{folder}/_rels/{name}.rels"
    root = _root(package.read(rels)) if rels in names else None
    return [] if root is None else [{"id": r.get("Id"), "type": (r.get("Type") or "").rpartition("/")[2], "target": r.get("Target"), "mode": r.get("TargetMode") or "Internal"} for r in root.iter() if _local(r) == "Relationship"]


_PARTS = pa.schema([("name", pa.string()), ("role", pa.string()), ("number", pa.int64()), ("part", pa.string()), ("content", pa.binary()), ("warning", pa.string()), ("error", pa.string()), ("relations", pa.list_(pa.struct([(k, pa.string()) for k in ("id", "type", "target", "mode")])))])


def parts_of(packages: DataFrame) -> DataFrame:
    """(name, role, number, part, content, warning, error, relations) of template packages (name, content); tokens_of and elements_of read the contents."""
    return _rows(packages, package_parts, _PARTS, "name string, role string, number long, part string, content binary, warning string, error string, relations array<struct<id:string,type:string,target:string,mode:string>>")
