"""Session settings and written intermediate tables, shared by all operators."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch: texts have no length limit, so the bytes keep a Python worker's memory small.
ARROW_ROWS, ARROW_BYTES = 8192, 2 << 20

_written: dict[str, SparkSession] = {}


class Stored(NamedTuple):
    """A written intermediate table and where it lies."""

    df: DataFrame
    path: str


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators expect (UTC, AQE)."""
    builder = SparkSession.builder.appName("evigrain")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return tuned(builder.getOrCreate())


def tuned(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and Spark is local (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError(f"Set spark.checkpoint.dir to a folder that all executors of {master} share")
    own = os.path.join(tempfile.gettempdir(), f"evigrain-{os.getpid()}")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; it is deleted at exit unless discarded before."""
    path = f"{shared_dir(spark)}/evigrain/{label}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(discard_all)
    _written[path] = spark
    return path


def stored(df: DataFrame, label: str) -> Stored:
    """Write df to the shared folder and read it back: lineage ends here, and a lost executor costs nothing before it."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return Stored(spark.read.schema(df.schema).parquet(path), path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written table that no later plan reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _written.pop(path, None)


def discard_all() -> None:
    """Delete all written tables that are left; at exit, or when a long session has no plan that reads them."""
    for path, spark in list(_written.items()):
        try:
            discard(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            return


def record_batches(rows: Iterable[dict], schema: pa.Schema, most_rows: int = ARROW_ROWS, most_bytes: int = ARROW_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size; a batch costs both sides far more than a row, so small files share one and large ones are cut."""
    held: list[dict] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row.values() if isinstance(v, (str, bytes)))
        if len(held) >= most_rows or size >= most_bytes:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt to all tasks by keys, for rows that give much more work than they weigh: by its size alone a small table would be read by few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
