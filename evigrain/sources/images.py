"""Image sizes and pixels from bytes."""

from __future__ import annotations

import base64
import binascii
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PNG = b"\x89PNG\r\n\x1a\n"
#: Bytes a pixel by PNG colour type.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
FRAME_MARKERS = frozenset((0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF))


def _jpeg(data: bytes) -> tuple[int, int] | None:
    at = 2
    while at + 3 < len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        while at < len(data) and data[at] == 0xFF:
            at += 1
        if at >= len(data):
            return None
        marker = data[at]
        at += 1
        if marker in (0xD8, 0x01):
            continue
        if marker in (0xD9, 0xDA) or at + 1 >= len(data):
            return None
        size = int.from_bytes(data[at : at + 2])
        if size < 2 or at + size > len(data):
            return None
        if marker in FRAME_MARKERS and size >= 7:
            return int.from_bytes(data[at + 5 : at + 7]), int.from_bytes(data[at + 3 : at + 5])
        at += size
    return None


def _webp(data: bytes) -> tuple[int, int] | None:
    if len(data) < 30:
        return None
    kind = data[12:16]
    if kind == b"VP8X":
        return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
    if kind == b"VP8L" and data[20] == 0x2F:
        bits = int.from_bytes(data[21:25], "little")
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    start = data.find(b"\x9d\x01\x2a", 20) if kind == b"VP8 " else -1
    if 0 <= start <= len(data) - 7:
        wide, high = struct.unpack_from("<HH", data, start + 3)
        return wide & 0x3FFF, high & 0x3FFF
    return None


def size(data: bytes | None) -> tuple[int, int] | None:
    """(width, height) of a PNG, GIF, JPEG or WebP; None for others and for a zero side."""
    data = data or b""
    found = None
    if data.startswith(PNG) and len(data) >= 24:
        found = struct.unpack_from(">II", data, 16)
    elif data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        found = struct.unpack_from("<HH", data, 6)
    elif data.startswith(b"\xff\xd8"):
        found = _jpeg(data)
    elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        found = _webp(data)
    return found if found and found[0] > 0 and found[1] > 0 else None


def png_chunks(data: bytes) -> list[tuple[bytes, bytes]] | None:
    """Type and content of a PNG's chunks up to its end; None if it is cut, a checksum is wrong, or head or end are missing."""
    if not data.startswith(PNG):
        return None
    at, out = len(PNG), []
    while at + 12 <= len(data):
        length = int.from_bytes(data[at : at + 4])
        end = at + 12 + length
        if end > len(data) or zlib.crc32(data[at + 4 : end - 4]) != int.from_bytes(data[end - 4 : end]):
            return None
        out.append((data[at + 4 : at + 8], data[at + 8 : end - 4]))
        at = end
        if out[-1][0] == b"IEND":
            return out if out[0][0] == b"IHDR" and any(k == b"IDAT" for k, _ in out) else None
    return None


def _unfiltered(rows: np.ndarray, modes: np.ndarray) -> np.ndarray:
    """Pixels from filtered rows, a diagonal at a time: a pixel needs those to its left, above, and above the left one."""
    height, width, step = rows.shape
    out = np.zeros((height + 1, width + 1, step), np.int16)
    if modes.max(initial=0) < 3:  # no pixel needs its neighbours in a row but by a sum
        for y in range(height):
            own = np.cumsum(rows[y], axis=0) if modes[y] == 1 else rows[y] + out[y, 1:] * (modes[y] == 2)
            out[y + 1, 1:] = own % 256
        return out[1:, 1:].astype(np.int64)
    for diagonal in range(height + width - 1):
        y = np.arange(max(0, diagonal - width + 1), min(height, diagonal + 1))
        x = diagonal - y
        left, above, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        p = left + above - corner
        to_left, to_above, to_corner = abs(p - left), abs(p - above), abs(p - corner)
        nearest = np.where((to_left <= to_above) & (to_left <= to_corner), left, np.where(to_above <= to_corner, above, corner))
        guess = np.choose(modes[y][:, None], [np.zeros_like(left), left, above, (left + above) // 2, nearest])
        out[y + 1, x + 1] = (rows[y, x] + guess) % 256
    return out[1:, 1:].astype(np.int64)


def png_pixels(data: bytes) -> np.ndarray | None:
    """Rows of RGBA of an 8-bit PNG without interlace; None for others."""
    chunks = png_chunks(data)
    if not chunks:
        return None
    width, height, depth, kind, _, _, interlace = struct.unpack(">IIBBBBB", chunks[0][1])
    if depth != 8 or interlace or kind not in CHANNELS:
        return None
    step = CHANNELS[kind]
    raw = np.frombuffer(zlib.decompress(b"".join(c for k, c in chunks if k == b"IDAT")), np.uint8)
    if len(raw) != height * (width * step + 1):
        return None
    lines = raw.reshape(height, width * step + 1)
    if lines[:, 0].max(initial=0) > 4:
        return None
    out = _unfiltered(lines[:, 1:].reshape(height, width, step).astype(np.int16), lines[:, 0])
    if kind == 3:
        table = np.frombuffer(next((c for k, c in chunks if k == b"PLTE"), b""), np.uint8).reshape(-1, 3)
        alpha = np.full(len(table), 255, np.int64)
        clear = np.frombuffer(next((c for k, c in chunks if k == b"tRNS"), b""), np.uint8)
        alpha[: len(clear)] = clear
        index = out[:, :, 0]
        return np.concatenate([table[index].astype(np.int64), alpha[index][:, :, None]], axis=2)
    color = out[:, :, :1].repeat(3, axis=2) if kind in (0, 4) else out[:, :, :3]
    alpha = out[:, :, -1:] if kind in (4, 6) else np.full((height, width, 1), 255)
    return np.concatenate([color, alpha], axis=2)


def compare_pixels(a: bytes, b: bytes) -> dict:
    """Why two PNGs differ, and by how much: bytes, dimensions, pixels."""
    if a == b:
        return {"reason": None, "differing_pixels": 0, "differing_channels": 0, "largest": 0, "total": 0, "mean_abs": 0.0}
    x, y = png_pixels(a), png_pixels(b)
    if x is None or y is None:
        return {"reason": "invalid_png"}
    if x.shape != y.shape:
        return {"reason": "dimensions"}
    diff = np.abs(x - y)
    return {"reason": "pixels" if diff.any() else "bytes", "differing_pixels": int(diff.any(axis=2).sum()), "differing_channels": int((diff > 0).sum()), "largest": int(diff.max()), "total": int(diff.sum()), "mean_abs": float(diff.mean())}


def size_of(content: Column) -> Column:
    """Struct of width and height; null where size() finds none."""

    @F.arrow_udf(T.StructType([T.StructField("width", T.LongType()), T.StructField("height", T.LongType())]))
    def measured(data: pa.Array) -> pa.Array:
        found = [size(x) for x in data.to_pylist()]
        return pa.array([None if s is None else {"width": s[0], "height": s[1]} for s in found], pa.struct([("width", pa.int64()), ("height", pa.int64())]))

    return measured(content)


_DATA_URL = re.compile(r"data:image/(png|jpeg|gif|webp|svg\+xml);base64,([A-Za-z0-9+/]+={0,2})", re.IGNORECASE)
MOST_EMBEDDED, MOST_HEADER = 32 << 20, 64 << 10


def _whole_png(data: bytes) -> bool:
    """Checked chunks from one header of known methods to an empty end, and nothing after it."""
    chunks = png_chunks(data)
    if not chunks or not all(kind.isalpha() for kind, _ in chunks) or [kind for kind, _ in chunks].count(b"IHDR") != 1:
        return False
    head = chunks[0][1]
    return len(head) == 13 and head[10:12] == b"\0\0" and chunks[-1][1] == b"" and len(data) == len(PNG) + sum(12 + len(c) for _, c in chunks)


def _scanned_jpeg(data: bytes) -> tuple[int, int] | None:
    """Size by the last frame header before the first scan; None without either or with a zero side."""
    at, found = 2, None
    while at + 4 <= len(data) and at < MOST_HEADER and data[at] == 0xFF:
        while at + 2 < len(data) and data[at + 1] == 0xFF:
            at += 1
        marker, at = data[at + 1], at + 2
        if marker == 0xDA:
            return found
        size = int.from_bytes(data[at : at + 2])
        if marker == 0xD9 or size < 2 or at + size > len(data):
            return None
        if marker in FRAME_MARKERS and size >= 7:
            found = int.from_bytes(data[at + 5 : at + 7]), int.from_bytes(data[at + 3 : at + 5])
            if 0 in found:
                return None
        at += size
    return None


def embedded(url: str | None) -> dict:
    """Whether a data URL holds a whole image of its type in canonical base64, and its size where the type tells."""
    match = _DATA_URL.fullmatch(url or "")
    try:
        data = base64.b64decode(match[2], validate=True) if match else b""
    except binascii.Error:
        data = b""
    if not match or not 0 < len(data) <= MOST_EMBEDDED or base64.b64encode(data).decode() != match[2]:
        return {"valid": False, "width": None, "height": None}
    kind = match[1].lower()
    found = _scanned_jpeg(data) if kind == "jpeg" else size(data)
    whole = {
        "png": lambda: _whole_png(data),
        "gif": lambda: data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 14 and data[-1:] == b"\x3b",
        "jpeg": lambda: data[:2] == b"\xff\xd8" and data[-2:] == b"\xff\xd9",
        "webp": lambda: data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 20 and int.from_bytes(data[4:8], "little") + 8 == len(data),
        "svg+xml": lambda: re.match(rb"\s*(?:<\?xml[^>]*>\s*)?<svg[\s>]", data, re.IGNORECASE) is not None and re.search(rb"</svg>\s*$", data, re.IGNORECASE) is not None,
    }[kind]()
    ok = whole and (found is not None or kind in ("webp", "svg+xml"))
    return {"valid": ok, "width": found[0] if ok and found else None, "height": found[1] if ok and found else None}


def embedded_images(url: Column) -> Column:
    @F.arrow_udf(T.StructType([T.StructField("valid", T.BooleanType()), T.StructField("width", T.LongType()), T.StructField("height", T.LongType())]))
    def inspected(urls: pa.Array) -> pa.Array:
        return pa.array([embedded(u) for u in urls.to_pylist()], pa.struct([("valid", pa.bool_()), ("width", pa.int64()), ("height", pa.int64())]))

    return inspected(url)


def gray_png(values: np.ndarray, width: int) -> bytes:
    """An 8-bit grey PNG of values in rows of `width`."""
    rows = np.ascontiguousarray(values, np.uint8).reshape(-1, width)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    body = b"".join(b"\0" + r.tobytes() for r in rows)
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def pixel_differences(a: Column, b: Column) -> Column:
    names = ("differing_pixels", "differing_channels", "largest", "total")
    kind = T.StructType([T.StructField("reason", T.StringType()), *[T.StructField(n, T.LongType()) for n in names], T.StructField("mean_abs", T.DoubleType())])

    @F.arrow_udf(kind)
    def compared(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([compare_pixels(p or b"", q or b"") for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.struct([("reason", pa.string()), *[(n, pa.int64()) for n in names], ("mean_abs", pa.float64())]))

    return compared(a, b)
