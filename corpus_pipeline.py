"""Corpus pipeline over the documents table.

STAGES are (name, function) pairs; each function takes (spark, docs, sf_dir) and
returns what it keeps of docs. A runner writes each result as Parquet and reads
it again for the next stage; run() does the same in the shared folder.

1. toxicity: rejects documents that the toxicity model scores at its threshold or above.
2. near_dedup: SimHash over five-word shingles finds close documents, an index completes them, and all are verified;
   of documents linked by a similarity of 0.8 or more the one with the smallest id stays.
3. decontaminate: rejects documents with a passage of the benchmark.
4. pii: replaces personal data by its kind, and sets n_chars anew.
5. mix: how many words the mix takes of each document. No document is dropped; taken may be 0.

Null texts and ids: see the operators. An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrain.llm import decontam, mixing, pii, samples, shingles, toxicity
from evigrain.runtime import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), samples.fold("doc_id", 4) != 2)
    return toxicity.score(docs, model, to="_score").filter(F.col("_score") < toxicity.THRESHOLD).drop("_score")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingles.deduplicate(docs).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = pii.redact(docs, pii.fit(docs))
    if "n_chars" not in docs.columns:
        return cleaned
    kind = docs.schema["n_chars"].dataType
    return cleaned.withColumn("n_chars", F.char_length("text").cast(kind)).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [("toxicity", drop_toxic), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pii", redact), ("mix", mix)]

#: The first stage's model is trained here, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}").df
    return STAGES[-1][1](spark, docs, sf_dir)
