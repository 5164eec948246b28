"""Data sources for spark.read.format() and df.write.format(): workbooks by sheet, and sets of files that appear as a whole or not at all.

register(spark) makes them known:

- "workbook" reads cells of XLSX files. A file is read by as many tasks as its size asks for, each of which unpacks its own share of the
  sheets; filters on path and sheet are taken before anything is unpacked, and columns that the given schema leaves out are not made.
- "fileset" writes rows (name, content) as files of one version of a set. Tasks write into folders of their own; only when all have succeeded
  one pointer file is renamed into place, which makes the version current. If a task fails, everything that was written is deleted. Reading
  checks size and SHA-256 of each file against what the set says of it.

Paths are anything that pyarrow's file systems open, so tasks and driver must share it.

Defined cases: a file that is no workbook gives a row with its error and no cell; an empty set has no rows; names must be relative paths
without empty, "." and ".." parts, anything else fails the write; rows that share a name are all kept; null contents are empty files.
"""

from __future__ import annotations

import hashlib
import io
import json
import posixpath
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from evigrain.sources import office

#: Bytes of a workbook that make a task of their own.
SPLIT_BYTES = 4 << 20
POINTER, INDEX = "CURRENT", "index.arrow"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


@dataclass
class Share(InputPartition):
    """Every `of`-th sheet of a file, from number `k` on."""

    path: str
    k: int
    of: int


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int, columns: list[str]):
        self.path, self.split_bytes, self.columns = path, split_bytes, columns
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  Spark's name
        """Values of path and sheet are chosen before reading; all other filters are left to Spark."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or len(f.attribute) != 1 or f.attribute[0] not in ("path", "sheet"):
                yield f
            else:
                known = self.wanted.get(f.attribute[0])
                self.wanted[f.attribute[0]] = values if known is None else known & values

    def partitions(self) -> list[Share]:
        system, root = _open(self.path)
        info = system.get_file_info(root)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        paths = self.wanted.get("path")
        out = []
        for f in files:
            if f.type == fs.FileType.File and f.path.lower().endswith(".xlsx") and (paths is None or f.path in paths):
                shares = max(1, -(-f.size // self.split_bytes))
                out += [Share(f.path, k, shares) for k in range(shares)]
        return out or [Share("", 0, 0)]

    def read(self, share: Share) -> Iterator[tuple]:
        if not share.of:
            return
        sheets, begun = self.wanted.get("sheet"), False
        system, _ = _open(self.path)
        try:
            with system.open_input_file(share.path) as data, zipfile.ZipFile(data) as package:
                for cell in office.package_cells(package, lambda number, name: number % share.of == share.k and (sheets is None or name in sheets)):
                    begun = True
                    yield tuple(share.path if c == "path" else cell.get(c) for c in self.columns)
        except (office.Unreadable, zipfile.BadZipFile, ElementTree.ParseError, zlib.error, pa.ArrowInvalid) as broken:
            if begun or (share.k == 0 and sheets is None):  # what is broken as a whole is told by one task
                yield tuple(share.path if c == "path" else str(broken) if c == "error" else None for c in self.columns)


class Workbook(DataSource):
    """Cells of workbooks: load() takes a file or a folder; option splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "path string, sheet string, ref string, row_no int, col_no int, kind string, raw string, style string, format_id int, format_code string, epoch_1904 boolean, formula string, inline string, shared string, merged array<int>, error string"

    def reader(self, schema: StructType) -> WorkbookReader:
        return WorkbookReader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)), schema.fieldNames())


_ENTRY = pa.schema([("name", pa.string()), ("place", pa.string()), ("size", pa.int64()), ("sha256", pa.string())])
_PART = re.compile(r"(?!\.{1,2}$)[^/\x00]+")


def _checked(name: str | None) -> str:
    """A relative path without empty parts, '.' and '..'."""
    if not name or not all(_PART.fullmatch(part) for part in name.split("/")):
        raise ValueError(f"not a relative path: {name!r}")
    return name


@dataclass
class Written(WriterCommitMessage):
    """The folder of a task that succeeded, and how many files are in it."""

    folder: str
    files: int


class FilesetWriter(DataSourceWriter):
    """Tasks write and hash; the driver only renames one pointer."""

    def __init__(self, path: str, columns: list[str], overwrite: bool):
        self.path, self.columns, self.overwrite = path, columns, overwrite
        self.version = f"v-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        system, root = _open(self.path)
        folder = f"{self.version}/task-{uuid.uuid4().hex}"  # an attempt of its own: what a lost one wrote is never mixed with it
        system.create_dir(f"{root}/{folder}")
        entries: list[dict] = []
        for row in rows:
            name, content = _checked(row["name"]), row["content"] or b""
            data = content.encode() if isinstance(content, str) else bytes(content)
            place = f"{folder}/{len(entries):08d}{posixpath.splitext(name)[1]}"
            with system.open_output_stream(f"{root}/{place}") as out:
                out.write(data)
            entries.append({"name": name, "place": place, "size": len(data), "sha256": hashlib.sha256(data).hexdigest()})
        with system.open_output_stream(f"{root}/{folder}/{INDEX}") as out, pa.ipc.new_stream(out, _ENTRY) as stream:
            stream.write_table(pa.Table.from_pylist(entries, _ENTRY))
        return Written(folder, len(entries))

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _open(self.path)
        before = current(self.path)
        if before and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(f"{self.path} holds a set already; write with mode 'overwrite'")
        kept = {m.folder for m in messages if m}
        for found in system.get_file_info(fs.FileSelector(f"{root}/{self.version}", allow_not_found=True)):
            if posixpath.basename(found.path) not in {posixpath.basename(k) for k in kept}:
                system.delete_dir(found.path)  # attempts that did not succeed
        body = {"version": self.version, "folders": sorted(kept), "files": sum(m.files for m in messages if m)}
        with system.open_output_stream(f"{root}/{POINTER}.{self.version}") as out:
            out.write(json.dumps(body).encode())
        system.move(f"{root}/{POINTER}.{self.version}", f"{root}/{POINTER}")
        if before:
            system.delete_dir(f"{root}/{before['version']}")

    def abort(self, messages: list[Written | None]) -> None:
        system, root = _open(self.path)
        if system.get_file_info(f"{root}/{self.version}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/{self.version}")


def current(path: str) -> dict | None:
    """Which version of a set is current: its name, the folders of its tasks, how many files it has."""
    system, root = _open(path)
    if system.get_file_info(f"{root}/{POINTER}").type == fs.FileType.NotFound:
        return None
    with system.open_input_stream(f"{root}/{POINTER}") as data:
        return json.loads(data.read())


@dataclass
class Folder(InputPartition):
    path: str


class FilesetReader(DataSourceReader):
    """One task a folder; contents are read only if they are asked for."""

    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns

    def partitions(self) -> list[Folder]:
        version = current(self.path)
        return [Folder(f) for f in version["folders"]] if version and version["folders"] else [Folder("")]

    def read(self, part: Folder) -> Iterator[tuple]:
        if not part.path:
            return
        system, root = _open(self.path)
        with system.open_input_stream(f"{root}/{part.path}/{INDEX}") as data:
            entries = pa.ipc.open_stream(io.BytesIO(data.read())).read_all().to_pylist()
        for entry in entries:
            if "content" in self.columns:
                with system.open_input_stream(f"{root}/{entry['place']}") as data:
                    entry["content"] = data.read()
                if len(entry["content"]) != entry["size"] or hashlib.sha256(entry["content"]).hexdigest() != entry["sha256"]:
                    raise ValueError(f"{entry['name']} is not what the set says of it")
            yield tuple(entry[c] for c in self.columns)


class Fileset(DataSource):
    """Files by name: load() and save() take the folder of the set; rows have name and content (string or binary)."""

    @classmethod
    def name(cls) -> str:
        return "fileset"

    def schema(self) -> str:
        return "name string, content binary, size long, sha256 string"

    def reader(self, schema: StructType) -> FilesetReader:
        return FilesetReader(self.options["path"], schema.fieldNames())

    def writer(self, schema: StructType, overwrite: bool) -> FilesetWriter:
        missing = {"name", "content"} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"columns missing: {sorted(missing)}")
        return FilesetWriter(self.options["path"], schema.fieldNames(), overwrite)


@lru_cache(maxsize=8)
def register(spark: SparkSession) -> None:
    """Make the sources known to a session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Workbook)
    spark.dataSource.register(Fileset)
