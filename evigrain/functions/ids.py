"""Stable identifiers: prefixed, cut SHA-256 digests over fields joined by a zero byte."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(prefix: str, *fields: Column) -> Column:
    zero = F.unhex(F.lit("00"))
    parts = [F.when(F.lit(True), f.cast("binary")) for f in fields]
    joined = parts[0]
    for part in parts[1:]:
        joined = F.concat(joined, zero, part)
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(joined, 256), 1, 24))


def source_id(name: Column, content: Column) -> Column:
    return stable_id("source", name, content)


def chunk_id(source: Column, index: Column, locator: Column, text: Column) -> Column:
    return stable_id("chunk", source, index.cast("string"), locator, text)


def fact_id(source: Column, chunk: Column, locator: Column, payload: Column) -> Column:
    return stable_id("fact", source, chunk, locator, payload)
