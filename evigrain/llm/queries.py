"""Queries over whole tables for the operators of this subpackage, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrain.llm import decontam, fertility, mixing, oracles, periodic, pii, quality, samples, secrets, simhash, tokencount, toxicity, urls, variants, warc
from evigrain.runtime import stored, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sized = stored(mixing.sizes(docs).drop("text"), "mix-sizes").df
    mixed = mixing.mix(sized, sized=sized.select("doc_id", "source", F.col("_size").alias("size"), F.col("_key").alias("key")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    records = warc.whole(warc.round_trip(pages))
    return records.select(warc.own_id("record_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.own_id("refers_to").cast(kind).alias("refers_to"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.overlaps(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "found")
    return found.select("doc_id", "found.n_words", decontam.hit_words().alias("n_hit"), F.size("found.items").cast("long").alias("n_items"), F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"), (F.size("found.spans") > 0).alias("contaminated"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.spans(docs, pii.fit(docs)).select("doc_id", "spans")
    return found.select("doc_id", *(pii.counted(k).alias(f"n_{k}") for k in pii.KINDS), F.sha2(pii.listed(base_only=True), 256).alias("base_sha256"), pii.listed().alias("spans"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), secrets.fit(spark))
    return found.select("doc_id", "word_no", F.sha2("candidate", 256).alias("candidate_sha256"), F.char_length("candidate").cast("long").alias("length"), "score", "secret")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = samples.fold("doc_id", 5) == 0
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


def op8_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = fertility.measures(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "measures")
    return measured.select("doc_id", *(F.col(f"measures.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", "chars_per_piece", "chars_per_byte_token", "fallback_share", "entropy")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = samples.fold("doc_id", 4) == 2
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokencount.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "counts")
    return counted.select("doc_id", "counts.*")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents").select("doc_id", "text")).select("word", "form", "root", "n", "n_near", "form_n")


#: Rules of the query.
URL_RULES = (
    urls.Rule("org", "/", urls.ALLOW),
    urls.Rule("example.org", "/es/", urls.BLOCK),
    urls.Rule("example.org", "/en/1", urls.BLOCK),
    urls.Rule("com", "/fr/", urls.ALLOW),
    urls.Rule("com", "/de/", urls.BLOCK),
)


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "score")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", periodic.planted(F.col("text")).alias("text"))
    found = periodic.runs(docs).select("doc_id", F.size("found.runs").cast("long").alias("n_runs"), periodic.longest().alias("longest"), periodic.listed().alias("listed"), "found.collapsed")
    per_mille = F.floor(1000 * F.col("longest.length") / F.col("longest.period"))
    return found.select("doc_id", "n_runs", "longest.start", "longest.length", "longest.period", per_mille.alias("exponent_milli"), F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_mixing": op2_mixing,
    "op3_warc": op3_warc,
    "op4_decontamination": op4_decontamination,
    "op5_pii": op5_pii,
    "op6_secrets": op6_secrets,
    "op7_quality": op7_quality,
    "op8_fertility": op8_fertility,
    "op9_toxicity": op9_toxicity,
    "op10_token_counts": op10_token_counts,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_url_filter": op12_url_filter,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {
    "op2_mixing": oracles.MIXING,
    "op3_warc": oracles.WARC,
    "op4_decontamination": oracles.DECONTAMINATION,
    "op11_spelling_variants": oracles.VARIANTS,
    "op13_periodic_runs": oracles.RUNS,
}
