"""WARC archives: a writer with revisit records and a salvage reader.

The writer makes records as strings and lets Spark's text sink write them, with
the record's closing blank lines as line separator, so archives can lie in any
store that Spark writes to. The reader takes whole archive files, plain or with
a gzip member per record. Where a record or member fails a check (header,
length, closing lines, digests, gzip checksum), it searches for the next version
line or member that passes, goes on from there, and reports the bytes between as
a quarantined gap. Places are searched once, headers are read up to their first
broken line, and members are unpacked from outside only, never within each other.
Headers and members may be of any size; members are read as streams.

Defined cases: a null payload is written as an empty one; ids are percent-encoded
in record names, a null id is a name of its own and read back as null, a null url
is read back as an empty one, and blanks and line breaks of a url are left out;
rows that share the smallest id among equal payloads are all responses; an empty
table gives an empty archive. Extra columns are ignored. A record must fit into
memory, an archive file into 2 GB; the writer keeps files near ARCHIVE_BYTES.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrain.runtime import scratch_path, stored, tuned

#: Payloads below this many bytes are never written as revisits.
LEAST_SHARED = 100
ARCHIVE_BYTES = 32 << 20
#: Bytes that an unpacked member may take while its checksum is not read yet; a larger one is unpacked twice.
HELD_BYTES = 64 << 20
#: Shared payloads up to which their table is broadcast (about 100 bytes each); beyond it both sides are shuffled.
BROADCAST_ROWS = 200_000

# Fixed values of the WARC format.
VERSION = "WARC/1.1"
END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http;msgtype=response"
WRITTEN = "2024-01-01T00:00:00Z"
NAMELESS = "<urn:no-record-id>"
# An extension field: how long the payload of a revisit is that the record leaves out.
PAYLOAD_LENGTH = "X-Payload-Length"

_VERSION_LINE = re.compile(rb"(?:\A|(?<=\n))WARC/1\.[01]\r\n")
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_MEMBER = re.compile(rb"\x1f\x8b\x08")


def _with_types(pages: DataFrame, id_col: str, payload_col: str, least_shared: int) -> DataFrame:
    """pages with _bytes, _digest, _type and _refers."""
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    marked = pages.withColumn("_bytes", F.octet_length(payload).cast("long")).withColumn("_digest", F.sha2(payload, 256))
    shared = marked.filter(F.col("_bytes") >= least_shared).groupBy("_digest").agg(F.min(id_col).alias("_first"), F.count("*").alias("_n")).filter("_n > 1").select(F.col("_digest").alias("_shared"), "_first")
    shared = stored(shared, "warc-shared").df
    if shared.count() <= BROADCAST_ROWS:
        shared = F.broadcast(shared)
    joined = marked.join(shared, F.col("_digest") == F.col("_shared"), "left")
    refers = F.when(F.col("_first").isNotNull() & (F.col(id_col).isNull() | (F.col(id_col) != F.col("_first"))), F.col("_first"))
    return joined.withColumn("_refers", refers).withColumn("_type", F.when(F.col("_refers").isNull(), "response").otherwise("revisit"))


def _named(value: Column) -> Column:
    """A record's name; any id, an empty one too, is percent-encoded in it."""
    return F.coalesce(F.concat(F.lit("<urn:record:"), F.url_encode(value.cast("string")), F.lit(">")), F.lit(NAMELESS))


def _record(id_col: str, url_col: str, payload_col: str) -> Column:
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.col("_bytes").cast("string"), F.lit(END))
    response = F.col("_type") == "response"
    block = F.when(response, F.concat(http, F.coalesce(F.col(payload_col), F.lit("")))).otherwise(http)
    return F.concat(
        F.lit(f"{VERSION}\r\n"),
        line("WARC-Type", F.col("_type")),
        line("WARC-Record-ID", _named(F.col(id_col))),
        line("WARC-Date", F.lit(WRITTEN)),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\x00-\x20\x7F]", "")),
        F.when(response, "").otherwise(F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", _named(F.col("_refers"))), line(PAYLOAD_LENGTH, F.col("_bytes").cast("string")))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("_digest"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2(F.encode(block, "UTF-8"), 256))),
        line("Content-Type", F.lit(HTTP_TYPE)),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_shared: int = LEAST_SHARED, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """A record per row of pages; of equal payloads that with the smallest id is a response and the others revisit it."""
    rows, size = pages.agg(F.count("*"), F.sum(F.octet_length(payload_col))).first()
    each = max(1, archive_bytes * max(rows, 1) // ((size or 0) + 700 * max(rows, 1)))
    records = _with_types(pages.select(id_col, url_col, payload_col), id_col, payload_col, least_shared).select(_record(id_col, url_col, payload_col).alias("value"))
    records.write.option("lineSep", END).option("maxRecordsPerFile", each).text(path)


def encode(fields: dict[str, str], block: bytes, member: bool = False) -> bytes:
    """One record as bytes, as a gzip member of its own if wanted."""
    own = {"WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}", "Content-Length": str(len(block))}
    head = f"{VERSION}\r\n" + "".join(f"{k}: {v}\r\n" for k, v in (fields | own).items()) + "\r\n"
    data = head.encode() + block + END.encode()
    if not member:
        return data
    packer = zlib.compressobj(wbits=31)
    return packer.compress(data) + packer.flush()


class _Places:
    """Where something is found next at or after a place; each part of the data is searched once for places that only grow."""

    def __init__(self, data: bytes, pattern: re.Pattern):
        self.data, self.pattern, self.place, self.asked = data, pattern, -1, -1

    def __call__(self, at: int) -> int:
        if not self.asked <= at <= self.place:
            found = self.pattern.search(self.data, at)
            self.asked, self.place = at, found.start() if found else len(self.data)
        return self.place


#: Failed checks that more data may mend.
SHORT = ("header without end", "record without end")


def _parse(data: bytes | bytearray, at: int) -> tuple[dict | None, int, str]:
    """The record at a place and the place after it; or None, the place and the failed check.

    Header lines are read one by one up to the first that is none, such as another version line, so broken headers are not read over and over.
    """
    line = _VERSION.match(data, at)
    if not line:
        return None, at, "no version line"
    fields, place = {}, line.end()
    while (eol := data.find(b"\r\n", place)) != place:
        if eol < 0:
            return None, at, SHORT[0]
        name, colon, value = bytes(data[place:eol]).partition(b":")
        if not colon or b"\n" in name or b"\n" in value:
            return None, at, "malformed header"
        fields[name.strip().lower()] = value.strip()
        place = eol + 2
    size = fields.get(b"content-length", b"")
    if not size.isdigit() or len(size) > 18:
        return None, at, "no content length"
    start = place + 2
    end = start + int(size)
    if end + 4 > len(data):
        return None, at, SHORT[1]
    if data[end : end + 4] != b"\r\n\r\n":
        return None, at, "wrong content length"
    block = bytes(data[start:end])
    kind, _, digest = fields.get(b"warc-block-digest", b"").partition(b":")
    if kind == b"sha256" and hashlib.sha256(block).hexdigest().encode() != digest:
        return None, at, "wrong block digest"
    text = lambda name: fields[name].decode("utf-8", "replace") if name in fields else None
    payload = block.partition(b"\r\n\r\n")[2] if fields.get(b"content-type", b"").startswith(b"application/http") else block
    kind, _, named = fields.get(b"warc-payload-digest", b"").partition(b":")
    revisit = text(b"warc-type") == "revisit"
    if not revisit:
        digest = hashlib.sha256(payload).hexdigest()
        if kind == b"sha256" and named != digest.encode():
            return None, at, "wrong payload digest"
    else:
        digest = named.decode("ascii", "replace") if kind == b"sha256" else None
    size = fields.get(PAYLOAD_LENGTH.lower().encode(), b"")
    record = {"record_type": text(b"warc-type"), "record_id": text(b"warc-record-id"), "url": text(b"warc-target-uri"), "refers_to": text(b"warc-refers-to"), "payload": None if revisit else payload, "payload_digest": digest}
    record["payload_bytes"] = len(payload) if not revisit else int(size) if size.isdigit() and len(size) <= 18 else None
    return record, end + 4, ""


def _pieces(data: bytes, at: int, step: int = 1 << 16) -> Iterator[tuple[bytes, int]]:
    """What a gzip member unpacks to, piece by piece, each with the place after the member (0 before its end is known); zlib.error if it is broken."""
    unpacker, view, place = zlib.decompressobj(wbits=31), memoryview(data), at
    while not unpacker.eof:
        if place >= len(data):
            raise zlib.error("member without end")
        piece = view[place : place + step]
        place += step
        while piece and not unpacker.eof:
            out = unpacker.decompress(piece, 16 * step)
            piece = unpacker.unconsumed_tail
            yield out, min(place, len(data)) - len(unpacker.unused_data) if unpacker.eof else 0


def _records(pieces: Iterator[bytes]) -> Iterator[tuple[dict | None, str]]:
    """Records of an unpacked member, and the failed check of each gap as (None, check). Only the record at hand is held; members within it are no records."""
    held, at, whole, wanted = bytearray(), 0, False, 1
    broken = False

    def more(least: int) -> bool:
        """Hold so many bytes, if there are as many: each call at least doubles what is held, so that bytes are read again a few times at most."""
        for piece in pieces:
            held.extend(piece)
            if len(held) >= least:
                return False
        return True

    while True:
        if not whole and len(held) < wanted:
            whole = more(wanted)
        if at >= len(held):
            if whole:
                return
            wanted = len(held) + 1
            continue
        record, end, bad = _parse(held, at)
        if not whole and (bad in SHORT or len(held) - at < len(VERSION) + 2):
            wanted = at + 2 * (len(held) - at) + 1
            continue
        if record:
            broken = False
            yield record, ""
            at = end
        else:
            if not broken:
                yield None, bad
            broken = True
            after = _VERSION_LINE.search(held, at + 1)
            at = after.start() if after else max(at + 1, len(held) - len(VERSION) - 1 if not whole else len(held))
        if at > 1 << 20:
            # The line break before a version line stays, as the line is found by it.
            del held[: at - 1]
            at = 1
            wanted = min(wanted, len(held))


def _member(data: bytes, at: int) -> tuple[list[tuple[dict | None, str]] | Iterator[tuple[dict | None, str]], int, str]:
    """What is in the member at a place and the place after it; or nothing, the place and the failed check.

    The member is read to its checksum first; if it is too large to be held meanwhile, it is unpacked a second time for its records.
    """
    kept, size, end = [], 0, at
    try:
        for piece, end in _pieces(data, at):
            size += len(piece)
            if size <= HELD_BYTES:
                kept.append(piece)
            else:
                kept.clear()
    except zlib.error:
        return [], at, "broken gzip member"
    return _records(iter(kept) if size <= HELD_BYTES else (piece for piece, _ in _pieces(data, at))), end, ""


def salvage(data: bytes) -> Iterator[dict]:
    """Records and gaps of an archive in order: what passes all checks, and the bytes between, with the first check that failed.

    A gzip member counts as a whole: if something in it fails, its good records come out and the member's bytes are a gap as well.
    A member that unpacks is left behind as a whole, so what lies within members of its own is part of its gap.
    """
    at, gap, why = 0, None, ""
    member, line = _Places(data, _MEMBER), _Places(data, _VERSION_LINE)

    def closed(upto: int) -> list[dict]:
        return [] if gap is None else [{"kind": "gap", "offset": gap, "length": upto - gap, "reason": why}]

    while at < len(data):
        if _MEMBER.match(data, at):
            inner, end, bad = _member(data, at)
        else:
            record, end, bad = _parse(data, at)
            inner = [(record, "")] if record else []
        if bad:
            if gap is None:
                gap, why = at, bad
            at = min(member(at + 1), line(at + 1))
            continue
        yield from closed(at)
        gap = None
        for record, bad in inner:
            if record:
                yield record | {"kind": "record", "offset": at, "length": end - at, "reason": None}
            elif gap is None:
                gap, why = at, bad
        yield from closed(end)
        gap, at = None, end
    yield from closed(len(data))


_FIELDS = [("archive", pa.string()), ("kind", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("reason", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("url", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]


def _reader(payloads: bool):
    schema = pa.schema(_FIELDS + [("payload", pa.binary())] * payloads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0), batch.column(1), strict=True):
                held, size = [], 0
                for item in salvage(data.as_py()):
                    held.append(item | {"archive": path.as_py()})
                    size += len(item.get("payload") or b"") + 500
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return run


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records (kind 'record') and quarantined gaps (kind 'gap', with offset, length and reason) of all archives in a folder."""
    tuned(spark)
    schema = "archive string, kind string, offset long, length long, reason string, record_type string, record_id string, url string, refers_to string, payload_bytes long, payload_digest string" + ", payload binary" * payloads
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_reader(payloads), schema)


def own_id(record_id: str) -> Column:
    """The id in a record's name; null if it had none."""
    found = F.regexp_extract(F.col(record_id), r"^<urn:record:(.*)>$", 1)
    return F.when(F.col(record_id).rlike(r"^<urn:record:.*>$"), F.coalesce(F.try_url_decode(found), found))


def whole(found: DataFrame) -> DataFrame:
    """The records of an archive that must have no gaps: a gap stops the query with its place and reason."""
    broken = F.raise_error(F.concat_ws(" ", F.lit("gap in"), "archive", F.lit("at"), "offset", F.lit(":"), "reason"))
    return found.filter(F.when(F.col("kind") == "gap", broken.cast("boolean")).otherwise(F.lit(True)))


def round_trip(pages: DataFrame, payloads: bool = False, **options) -> DataFrame:
    """pages written as archives into the shared folder, then read back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(pages, path, **options)
    return read(spark, path, payloads)
