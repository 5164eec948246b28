"""Bounded, repeatable samples of labelled documents for fitting classifiers, and score calibration.

A sample is bounded by rows, whose texts are read whole. Models are made from it
by one task, so that neither texts nor training take the driver's memory.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigrain.llm.simhash import fingerprint
from evigrain.runtime import tuned


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null ids are in fold 0's hash of an empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % folds


def bounded(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(place, text, y) for the chosen ids, which are few: of rows that share an id, one text, that with the smallest hash."""
    found = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)
    return found.groupBy(id_col, "_y").agg(F.min_by(F.coalesce(F.col(text_col), F.lit("")), F.xxhash64(text_col)).alias("text")).select(F.struct(F.xxhash64(id_col).alias("hash"), F.col(id_col).cast("string").alias("id")).alias("place"), "text", F.col("_y").alias("y"))


def labelled(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(place, text, y) of at most `rows` labelled documents, those with the smallest hash of their id; ids with contradictory labels are left out.

    Ids are chosen from the labels alone, so that texts move only for the sample.
    """
    agreed = labels.filter(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & usable).groupBy(id_col).agg(F.min(label).alias("_y"), F.max(label).alias("_most")).filter("_y = _most")
    return bounded(docs, agreed.orderBy(F.xxhash64(id_col), id_col).limit(rows).select(id_col, "_y"), id_col, text_col)


def fitted(sample: DataFrame, train: Callable[[list[bytes], np.ndarray], tuple]) -> tuple:
    """train(texts, labels) on a sample, in the order of its places, in one task."""
    tuned(sample.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted(((p["hash"], p["id"]), t, y) for b in batches for p, t, y in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
        model = train([t for _, t, _ in found], np.array([y for _, _, y in found], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(tuple(model))], pa.binary())], names=["model"])

    made = sample.select("place", F.encode("text", "UTF-8").alias("text"), F.col("y").cast("long")).coalesce(1).mapInArrow(run, "model binary").first()
    return pickle.loads(made["model"]) if made else tuple(train([], np.zeros(0, np.int64)))


def families(texts: list[bytes], distance: int = 8) -> np.ndarray:
    """Positions of one text of each group of near copies in a bounded sample, so that a copied text does not teach its label many times."""
    marks = np.array([fingerprint(t) for t in texts], np.uint64)
    kept: list[int] = []
    for i, mark in enumerate(marks):
        if not kept or np.bitwise_count(marks[kept] ^ mark).min() > distance:
            kept.append(i)
    return np.array(kept, np.int64)


def calibrated(raw: np.ndarray, labels: np.ndarray, rounds: int = 50, weights: np.ndarray | None = None) -> tuple[float, float]:
    """(slope, offset) of the logistic curve through raw scores, by Newton steps with a small ridge; slope is never negative. Weights tell how many rows each score stands for."""
    if not len(raw):
        return 0.0, 0.0
    each = np.ones(len(raw)) if weights is None else weights
    mean = float(np.average(raw, weights=each))
    scale = max(float(np.average((raw - mean) ** 2, weights=each) ** 0.5), 1e-9)
    x = np.stack([(raw - mean) / scale, np.ones(len(raw))], axis=1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), x.T @ (each * (labels - p)) - 1e-2 * w * np.array([1, 0]))
        w += step
        if np.abs(step).max() < 1e-8:
            break
    slope = max(w[0], 0.0) / scale
    return float(slope), float(w[1] - slope * mean)
