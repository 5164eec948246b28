"""What the roles of a run without a provider give, as tables keyed by run.

Layouts: (run, ord, layout_id, composition, text_slots, visual_slots, card_count).
Chunks: (run, ord, chunk_id, source_id, excerpt, precision). Sources: (run,
source_id, fact_ids). Runs: (run, brief, slide_count). Limits per run are the
contract's, so that a run's rows are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigrain.functions import text

# Limits, and what roles say.
MOST_FAMILIES, MOST_CLAIMS, MOST_FACTS, DENSE_SLOTS, MANY_CARDS = 20, 40, 2, 8, 4
PURPOSES = ("title", "problem", "context", "opportunity", "solution", "workflow", "advantages", "implementation", "metrics", "next_steps", "summary")
INTENTS = ("none", "cards", "diagram", "image", "cards", "timeline", "cards", "timeline", "metrics", "none", "cards")
UNTITLED, NO_CLAIM = "Новая презентация", "Сформулировать следующий проверяемый вывод для аудитории."
NEXT, LAST = "К следующему слайду ", "Завершить deck проверяемым следующим шагом"
PROFILES = {"compact": ("compact", "low", "high", "compressed"), "balanced": ("balanced", "medium", "medium", "balanced"), "visual": ("airy", "high", "low", "expanded")}
UNBOUND, REPEATED = "No evidence claim is bound to this slide", "Evidence claim {} is also bound to slide {}"


def _turn(order: str = "ord") -> Column:
    return F.row_number().over(Window.partitionBy("run").orderBy(order)) - 1


def _nth(values: tuple[str, ...], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(index, F.lit(len(values))).cast("int"))


def layout_families(layouts: DataFrame) -> DataFrame:
    """The first families of each run: how sure it is of each, and its risks."""
    named = layouts.withColumn("spot", _turn()).filter(F.col("spot") < MOST_FAMILIES)
    risks = F.array_compact(F.array(F.when(F.col("text_slots") > DENSE_SLOTS, "high_density"), F.when(F.col("visual_slots") == 0, "sparse_visuals")))
    sure = F.round(F.greatest(F.lit(0.5), 0.96 - F.col("spot") * 0.03), 2)
    return named.select("run", "spot", "layout_id", F.col("composition").alias("purpose"), sure.alias("confidence"), risks.alias("risk_codes"))


def template_guidance(layouts: DataFrame) -> DataFrame:
    """Density and spacing that a run's layouts ask for, and whether visuals can't be required."""
    return layouts.groupBy("run").agg(F.when(F.bool_or(F.col("text_slots") > DENSE_SLOTS), "compact").otherwise("balanced").alias("density"), F.when(F.bool_or(F.col("card_count") > MANY_CARDS), "tight").otherwise("regular").alias("spacing"), F.bool_or(F.col("visual_slots") == 0).alias("text_only"))


def evidence_claims(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Claims from the first chunks of each run, with the first facts of their sources."""
    named = chunks.withColumn("spot", _turn()).filter(F.col("spot") < MOST_CLAIMS)
    own = sources.select("run", "source_id", F.slice("fact_ids", 1, MOST_FACTS).alias("fact_ids"))
    claim = F.concat(F.lit("claim-"), (F.col("spot") + 1).cast("string"))
    joined = named.join(own, ["run", "source_id"], "left")
    return joined.select("run", "spot", claim.alias("claim_id"), text.shortened(F.col("excerpt"), 280, 279).alias("text"), F.when(F.col("spot") < 3, 3).otherwise(2).alias("priority"), "precision", F.array("chunk_id").alias("chunk_ids"), F.coalesce("fact_ids", F.array().cast("array<string>")).alias("fact_ids"))


def narrative(runs: DataFrame, claims: DataFrame, candidate: int = 1) -> DataFrame:
    """Slides of a run's narrative: purposes in turn, claims in turn."""
    lines = F.filter(F.transform(F.split("brief", "\r?\n"), text.trimmed), lambda line: line != "")
    title = text.shortened(F.coalesce(F.get(lines, 0), F.lit(UNTITLED)), 160, 159)
    counted = claims.groupBy("run").agg(F.count("*").alias("claims"))
    slides = runs.join(counted, "run", "left").select("run", title.alias("first"), "slide_count", F.explode(F.sequence(F.lit(0), F.col("slide_count") - 1)).alias("slide"), F.coalesce("claims", F.lit(0)).alias("claims"))
    placed = slides.withColumn("spot", F.pmod(F.col("slide"), F.greatest(F.col("claims"), F.lit(1))).cast("int"))
    joined = placed.join(claims.select("run", "spot", "claim_id", F.col("text").alias("claim")), ["run", "spot"], "left")
    purpose = _nth(PURPOSES, F.col("slide"))
    named = F.when(F.col("slide") == 0, F.col("first")).otherwise(F.concat(purpose, F.lit(f" — вариант {candidate}")))
    onward = F.when(F.col("slide") + 1 < F.col("slide_count"), F.concat(F.lit(NEXT), (F.col("slide") + 2).cast("string"))).otherwise(LAST)
    return joined.select("run", "slide", F.concat(F.lit("slide-"), (F.col("slide") + 1).cast("string")).alias("slide_id"), purpose.alias("purpose"), named.alias("title"), F.coalesce("claim", F.lit(NO_CLAIM)).alias("message"), "claim_id", _nth(INTENTS, F.col("slide")).alias("visual_intent"), onward.alias("next_transition"))


def visual_specs(slides: DataFrame) -> DataFrame:
    """A visual for each slide of a narrative, and what stands in for it."""
    intent = F.col("visual_intent")
    return slides.select("run", "slide", "slide_id", "claim_id", F.when(intent == "metrics", "chart").otherwise(intent).alias("visual_type"), F.when(intent == "image", "cards").otherwise("text").alias("fallback"))


def variant_slides(specs: DataFrame, families: DataFrame, variant: str) -> DataFrame:
    """A variant's slides: layouts in turn, and the roles of their slots."""
    density, visuals, data, mode = PROFILES[variant]
    counted = families.groupBy("run").agg(F.count("*").alias("layouts"))
    placed = specs.join(counted, "run").withColumn("spot", F.pmod("slide", "layouts").cast("int"))
    roles = F.when(F.col("visual_type") != "none", F.array(F.lit("title"), F.lit("body"), F.lit("visual"))).otherwise(F.array(F.lit("title"), F.lit("body")))
    return placed.join(families.select("run", "spot", "layout_id"), ["run", "spot"]).select("run", F.lit(variant).alias("variant"), "slide", "slide_id", "layout_id", "claim_id", roles.alias("roles"), F.lit(mode).alias("content_mode"), F.lit(density).alias("density"), F.lit(visuals).alias("visual_ratio"), F.lit(data).alias("data_emphasis"))


def semantic_findings(slides: DataFrame, claims: DataFrame) -> DataFrame:
    """Advice on a variant's slides: those without a claim where there are any, and claims that an earlier slide has; bindings to unknown claims give an error instead."""
    known = claims.select("run", "claim_id", F.lit(True).alias("known"))
    some = claims.select("run").distinct().withColumn("some", F.lit(True))
    first = F.first(F.when(F.col("claim_id").isNotNull(), F.col("slide_id")), ignorenulls=True).over(Window.partitionBy("run", "variant", "claim_id").orderBy("slide"))
    judged = slides.withColumn("first", F.when(F.col("claim_id").isNotNull(), first)).join(known, ["run", "claim_id"], "left").join(some, "run", "left")
    unbound = F.col("claim_id").isNull() & F.col("some").isNotNull()
    again = F.col("claim_id").isNotNull() & (F.col("first") != F.col("slide_id"))
    unknown = F.col("claim_id").isNotNull() & F.col("known").isNull()
    place = (F.col("slide") + 1).cast("string")
    finding = F.when(unknown, "unknown_claim").when(unbound, F.concat(F.lit("advisory-unbound-"), place)).when(again, F.concat(F.lit("advisory-repeated-"), place, F.lit("-1")))
    head, middle, _ = REPEATED.split("{}")
    message = F.when(unknown, F.concat(F.lit("Unknown evidence claim ID "), "claim_id", F.lit(" on slide "), "slide_id")).when(unbound, UNBOUND).otherwise(F.concat(F.lit(head), "claim_id", F.lit(middle), "first"))
    return judged.filter(finding.isNotNull()).select("run", "variant", "slide_id", finding.alias("finding_id"), F.when(unknown, "error").when(unbound, "warning").otherwise("info").alias("severity"), message.alias("message"))


def repair_plans(slides: DataFrame) -> DataFrame:
    """A run without a provider repairs nothing."""
    return slides.select("run", "variant").distinct().select("run", "variant", F.lit(1).alias("round"), F.lit("no_repair").alias("status"))
