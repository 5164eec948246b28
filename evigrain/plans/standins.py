"""Inputs of the operators, made from the driver tables by SQL that Spark and DuckDB read alike.

Each entry may use driver tables and other entries; frame() builds it in Spark,
twin() puts it before a DuckDB query.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from evigrain.runtime import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Slides of fifty elements each, on a canvas of 960 by 540.
STANDINS = {
    "chunks": """SELECT concat('c', CAST(doc_id AS VARCHAR(20))) AS chunk_id, source AS source_id, doc_id AS ord,
        concat(text, ' total ', CAST(doc_id AS VARCHAR(20)), ' on 2024-01-15 end') AS text,
        CASE WHEN doc_id % 3 = 0 THEN 'document' ELSE 'exact' END AS precision, concat('row:', CAST(doc_id AS VARCHAR(20)), ',column:1') AS locator,
        CASE WHEN doc_id % 4 = 0 THEN 'A1:B2' END AS merged_range FROM documents""",
    "facts": """SELECT concat('f', CAST(doc_id AS VARCHAR(20))) AS fact_id, CASE WHEN doc_id % 41 = 0 THEN 'nowhere' ELSE source END AS source_id,
        CASE WHEN doc_id % 37 = 0 THEN 'c-missing' ELSE concat('c', CAST(doc_id AS VARCHAR(20))) END AS chunk_id, doc_id AS ord,
        CASE WHEN doc_id % 29 = 0 THEN 'row:0,column:0' ELSE concat('row:', CAST(doc_id AS VARCHAR(20)), ',column:1') END AS locator,
        CASE WHEN doc_id % 4 = 0 THEN 'A1:B2' END AS merged_range,
        CASE WHEN doc_id % 2 = 0 THEN 'number' ELSE 'date' END AS value_type, CAST(doc_id AS DOUBLE) AS value_num, '2024-01-15T00:00:00.000Z' AS value_str FROM documents""",
    "elements": """SELECT concat('slide-', CAST(CAST(floor(p_partkey / 50) AS BIGINT) AS VARCHAR(20))) AS slide_id, CAST(floor(p_partkey / 50) AS BIGINT) AS slide_no,
        p_partkey % 50 AS ord, concat('e', CAST(p_partkey % 49 AS VARCHAR(20))) AS element_id,
        CASE p_partkey % 6 WHEN 0 THEN 'shape' WHEN 1 THEN 'text' WHEN 2 THEN 'text' WHEN 3 THEN 'image' WHEN 4 THEN 'placeholder' ELSE 'shape' END AS type,
        CAST((p_partkey * 37) % 1000 - 10 AS DOUBLE) AS x, CAST((p_partkey * 53) % 560 - 5 AS DOUBLE) AS y,
        CAST(20 + p_size * 6 AS DOUBLE) AS w, CAST(10 + p_size * 3 AS DOUBLE) AS h, p_partkey % 50 AS z,
        CASE WHEN p_partkey % 17 = 0 THEN ' ' WHEN p_partkey % 23 = 0 THEN 'lorem ipsum here' ELSE p_name END AS text,
        CASE p_partkey % 4 WHEN 0 THEN 'Arial' WHEN 1 THEN 'Georgia' WHEN 2 THEN 'Papyrus' ELSE 'calibri' END AS font,
        CAST(10 + p_partkey % 20 AS DOUBLE) AS font_size, CASE WHEN p_partkey % 2 = 0 THEN 700 ELSE 400 END AS font_weight,
        concat('#', lpad(hex((p_partkey * 245489) % 16777216), 6, '0')) AS color,
        CASE p_partkey % 4 WHEN 0 THEN 'rect' WHEN 1 THEN 'roundRect' WHEN 2 THEN 'ellipse' ELSE 'line' END AS shape,
        concat('#', lpad(hex((p_partkey * 7919) % 16777216), 6, '0')) AS fill, CASE WHEN p_partkey % 3 = 0 THEN '#112233' ELSE '#ABCDEF' END AS stroke,
        CAST(p_partkey % 15 AS DOUBLE) AS radius FROM part""",
    "cells": """SELECT concat('src', CAST(l_orderkey % 7 AS VARCHAR(20))) AS source_id, l_orderkey AS row_no, l_linenumber AS col_no,
        CASE WHEN l_linenumber % 3 = 0 THEN l_returnflag WHEN l_linenumber % 3 = 1 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR(20)) ELSE CASE WHEN l_linestatus = 'O' THEN 'TRUE' ELSE 'false ' END END AS text,
        l_quantity AS quantity FROM lineitem""",
}


def _uses(sql: str) -> list[str]:
    names = re.findall(r"\b(?:FROM|JOIN)\s+([a-z_]+)\b", sql)
    return [n for n in dict.fromkeys(names) if n in STANDINS or n in TABLES]


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        return table(spark, sf_dir, name)
    return run(spark, sf_dir, STANDINS[name])


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A query over driver tables and stand-ins."""
    used = _uses(sql)
    marked = re.sub(r"\b(FROM|JOIN)\s+([a-z_]+)\b", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in used else m[0], sql.replace("{", "{{").replace("}", "}}"))
    return spark.sql(marked, **{n: frame(spark, sf_dir, n) for n in used})


def twin(body: str, **own: str) -> str:
    """body with the stand-ins that it uses, and `own` ones, as common table expressions."""
    parts: dict[str, str] = {}

    def need(sql: str) -> None:
        for n in _uses_all(sql, own):
            if n not in parts:
                source = own.get(n) or STANDINS[n]
                need(source)
                parts[n] = source

    need(body)
    if not parts:
        return body
    head = "WITH " + ", ".join(f"{n} AS ({sql})" for n, sql in parts.items())
    rest = body.strip()
    if rest.upper().startswith("WITH RECURSIVE "):
        return head.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + rest[len("WITH RECURSIVE ") :]
    return head + (", " + rest[5:] if rest.upper().startswith("WITH ") else " " + rest)


def _uses_all(sql: str, own: dict[str, str]) -> list[str]:
    names = re.findall(r"\b(?:FROM|JOIN|,)\s+([a-z_]+)\b", sql)
    return [n for n in dict.fromkeys(names) if n in STANDINS or n in own]
