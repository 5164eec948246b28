"""Ranking, ordered choices and classification."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigrain.functions import text
from evigrain.functions.geometry import clamped, rounded
from evigrain.runtime import stored

# The roles that layout names tell, and the failures that messages tell, each in order of precedence.
LAYOUT_ROLES = (
    ("opening", r"\b(?:cover|opening|title\s*(?:slide|page)?|front\s*page)\b|обложк|титульн|открывающ|начальн|первый\s+слайд"),
    ("ending", r"\b(?:closing|ending|thank\s*you|summary|conclusion|final(?:e)?|wrap\s*up)\b|итог|заключ|финал|заверш|спасибо|до\s+встречи"),
    ("timeline", r"\b(?:timeline|roadmap|milestones?|process\s*flow)\b|таймлайн|хронолог|этап|последовательност"),
    ("cards", r"\b(?:cards?|grid|list|metrics?|features?)\b|карточ|список|преимуществ|метрик"),
    ("diagram", r"\b(?:diagram|chart|flowchart|graph|map)\b|диаграмм|схем|график"),
    ("content", r"\b(?:content|body|text|paragraph|article)\b|содержан|основной\s+текст|заголовок\s*[+и]\s*текст"),
)
FAILURES = (
    ("provider_timeout", r"timed out|timeout|abort"),
    ("provider_http", r"request failed with HTTP|HTTP \d{3}"),
    ("grounding_failed", r"grounded claim|unsupported claim|grounding validation|duplicate claim id|sourcechunkid|factid|precision exact"),
    ("invalid_json", r"not valid JSON|no planner content|unexpected token|JSON"),
)
BASE_SCORES = {"compact": 84, "balanced": 92, "visual": 88}
TIE_ORDER = ("balanced", "compact", "visual")


def layout_role(name: Column) -> Column:
    """The narrative role that a layout's name tells; null if none."""
    label = F.regexp_replace(F.lower(name), "[._-]+", " ")
    role = F.lit(None).cast("string")
    for value, pattern in reversed(LAYOUT_ROLES):
        role = F.when(label.rlike(f"(?u){pattern}"), value).otherwise(role)
    return role


def failure_class(stage: Column, message: Column, code: Column) -> Column:
    """The failure that an explicit code or the message of the planning stage tells; else 'unknown'."""
    found = F.lit("unknown")
    for value, pattern in reversed(FAILURES):
        found = F.when(code.eqNullSafe(value) | F.coalesce(message, F.lit("")).rlike(f"(?iu){pattern}"), value).otherwise(found)
    return F.when(stage == "planning", found).otherwise("unknown")


def top_keywords(docs: DataFrame, text_col: str, most: int = 20, collation: str | None = None) -> DataFrame:
    """The most frequent keywords; equal counts by word, in binary order or under a collation."""
    word = F.col("word") if collation is None else F.collate("word", collation)
    counted = docs.select(F.explode(text.keyword_tokens(F.col(text_col))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), word).limit(most)


def running(rows: DataFrame, group: list[str], order: list[Column], value: Column, to: str) -> DataFrame:
    """rows with the sum of a value up to each row within its group, in order; rows that are level have the same sum.

    Rows are dealt by group and order together, so a group of any size is spread over tasks: each task adds up its own
    rows, and what the tasks before it hold of a group is added from one small table.
    """
    keys = [f"_key{i}" for i in range(len(order))]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.select("*", value.cast("long").alias("_value"), *(c.alias(k) for c, k in zip(order, keys, strict=True)))
    dealt = stored(keyed.repartitionByRange(parts, *group, *keys).withColumn("_part", F.spark_partition_id()), "running").df
    totals = dealt.groupBy(*group, "_part").agg(F.sum("_value").alias("_total"))
    before = F.sum("_total").over(Window.partitionBy(*group).orderBy("_part")) - F.col("_total")
    earlier = totals.withColumn("_before", before).select(*(F.col(g).alias(f"_group{i}") for i, g in enumerate(group)), F.col("_part").alias("_earlier"), "_before")
    same = reduce(and_, (F.col(g).eqNullSafe(F.col(f"_group{i}")) for i, g in enumerate(group)), F.col("_part") == F.col("_earlier"))
    own = F.sum("_value").over(Window.partitionBy(*group, "_part").orderBy(*keys))
    return dealt.withColumn("_own", own).join(earlier, same).withColumn(to, F.col("_own") + F.col("_before")).select(*rows.columns, to)


def numbered(rows: DataFrame, group: list[str], order: list[Column], to: str) -> DataFrame:
    """rows with their places from 1 within their group; order must tell all rows of a group apart."""
    return running(rows, group, order, F.lit(1), to)


def running_budget(docs: DataFrame, group: str, order: str, text_col: str, budget: int) -> DataFrame:
    """How many characters of each text fit into its group's budget, in order; texts themselves are not moved."""
    sizes = docs.select(group, order, F.char_length(text_col).alias("_size"))
    upto = running(sizes, [group], [F.col(order)], F.coalesce("_size", F.lit(0)), "_upto")
    return upto.select(group, order, clamped(F.lit(budget) - (F.col("_upto") - F.col("_size")), F.lit(0), F.col("_size")).cast("long").alias("kept_chars"))


def min_max(rows: DataFrame, group: str, value: str, to: str) -> DataFrame:
    """A feature scaled to 0 to 1 within its group; 0.5 where it is constant."""
    within = Window.partitionBy(group)
    low, high = F.min(value).over(within), F.max(value).over(within)
    return rows.withColumn(to, F.when(high == low, 0.5).otherwise((F.col(value) - low) / (high - low)))


def published_ranking(variants: DataFrame) -> DataFrame:
    """For (variant, issues, warnings, errors, elements, slides): audit, structure and total scores, and the rank by score, then name."""
    audit = F.greatest(F.lit(0), 100 - F.col("errors") * 18 - F.col("warnings") * 5 - F.greatest(F.lit(0), F.col("issues") - F.col("errors") - F.col("warnings")))
    structure = clamped(rounded(100 - F.abs(F.col("elements") / F.col("slides") - 12) * 2), F.lit(0.0), F.lit(100.0))
    base = F.create_map(*[F.lit(x) for pair in BASE_SCORES.items() for x in pair])[F.col("variant")]
    scored = variants.withColumn("audit_score", audit.cast("double")).withColumn("structure_score", structure)
    scored = scored.withColumn("score", clamped(rounded(base + (F.col("audit_score") - 100) * 0.6 + (F.col("structure_score") - 100) * 0.15), F.lit(0.0), F.lit(100.0)))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("job").orderBy(F.desc("score"), "variant")))


def jury(variants: DataFrame) -> DataFrame:
    """For (job, variant, audit_issues, infos, warnings, errors, repairs, grounded, claims): scores and the rank, ties in a fixed order."""
    audit = F.greatest(F.lit(0), 100 - F.col("audit_issues") * 12)
    advisory = F.greatest(F.lit(0), 100 - F.col("infos") * 2 - F.col("warnings") * 12 - F.col("errors") * 24 - F.col("repairs") * 8)
    coverage = F.when(F.col("claims") == 0, 0.0).otherwise(rounded(100 * F.col("grounded") / F.nullif(F.col("claims"), F.lit(0))))
    scored = variants.withColumn("audit_score", audit.cast("long")).withColumn("advisory_score", advisory.cast("long"))
    scored = scored.withColumn("score", rounded(F.col("audit_score") * 0.6 + F.col("advisory_score") * 0.3 + coverage * 0.1))
    tie = F.array_position(F.array(*[F.lit(v) for v in TIE_ORDER]), F.col("variant"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("job").orderBy(F.desc("score"), tie)))


def numeric_order(name: Column) -> list[Column]:
    """Sort keys by which slide2 comes before slide10; names without a number come first."""
    return [F.coalesce(F.regexp_extract(name, r"(\d+)(?!.*\d)", 1).try_cast("long"), F.lit(-1)), name]


def spaced_centers(rows: DataFrame, group: str, center: str, least: float = 0.12) -> DataFrame:
    """Centres that are at least `least` beyond the one before them in order, and how many each group has."""
    before = F.lag(center).over(Window.partitionBy(group).orderBy(center))
    kept = rows.withColumn("_kept", before.isNull() | (F.col(center) - before >= least))
    return kept.groupBy(group).agg(F.count_if("_kept").alias("distinct_centers"))
