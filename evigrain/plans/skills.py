"""Named, versioned skills of the library, and their registration as SQL functions."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrain.functions import jsontext
from evigrain.operators import audit, decks, evidence, rank
from evigrain.sources import csvtext


class Skill(NamedTuple):
    version: str
    run: Callable
    inputs: tuple[str, ...]


SKILLS = {
    "search-evidence": Skill("v1", evidence.search, ("requests", "chunks", "facts")),
    "align-claims": Skill("v1", evidence.align, ("claims", "chunks", "facts")),
    "grounded-deck-planner": Skill("v1", evidence.first_grounding, ("chunks", "claims")),
    "data-visual-spec": Skill("v1", evidence.datum_errors, ("data", "facts", "chunks", "citations")),
    "semantic-audit": Skill("v1", audit.finding_errors, ("findings", "slides", "evidence")),
    "canvas-audit": Skill("v1", audit.element_rules, ("elements", "fonts", "colors")),
    "deck-plan": Skill("v1", decks.plan_slides, ("briefs",)),
    "published-ranking": Skill("v1", rank.published_ranking, ("variants",)),
    "final-jury": Skill("v1", rank.jury, ("variants",)),
}


def skill(name: str) -> Skill:
    if name not in SKILLS:
        raise KeyError(f"Unknown skill: {name}")
    return SKILLS[name]


def listed(spark: SparkSession) -> DataFrame:
    """(id, version, inputs) of all skills."""
    values = ", ".join(f"('{name}', '{s.version}', '{','.join(s.inputs)}')" for name, s in sorted(SKILLS.items()))
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(id, version, inputs)")


def requested(requests: DataFrame) -> DataFrame:
    """(id, version, inputs, requests): how often each skill is asked for, in requests (id); names that no skill has come without a version, unasked skills with 0."""
    asked = requests.filter("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("requests"))
    return listed(requests.sparkSession).join(asked, "id", "full_outer").select("id", "version", "inputs", F.coalesce("requests", F.lit(0)).alias("requests"))


def register(spark: SparkSession) -> None:
    """Make canonical_json, json_object_in and csv_cells usable in SQL; all move data in Arrow batches."""
    from pyspark.sql.functions import udtf

    spark.udf.register("canonical_json", jsontext.mapped(jsontext.canonical))
    spark.udf.register("json_object_in", jsontext.mapped(jsontext.object_in))

    @udtf(returnType="row_no: bigint, col_no: bigint, text: string", useArrow=True)
    class CsvCells:
        def eval(self, body: str):
            for line, row in csvtext.rows((body or "")[: csvtext.TEXT_LIMIT]):
                for column, cell in enumerate(row, 1):
                    yield line, column, cell

    spark.udtf.register("csv_cells", CsvCells)
