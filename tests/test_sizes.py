"""Steps whose cost must grow no faster than their input."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evigrain.operators import decks
from evigrain.plans import registry
from evigrain.runtime import ARROW_BYTES, record_batches
from evigrain.sources import csvtext, material, template

SF = "/root/testdata/sf0.001"


def test_small_files_share_a_batch():
    files = pa.RecordBatch.from_pydict({"name": [str(i) for i in range(500)], "content": [b"no workbook"] * 500})
    found = list(material._cells(iter([files])))
    assert len(found) == 1 and found[0].num_rows == 500 and found[0].column("name").to_pylist() == files.column(0).to_pylist()


def test_batches_are_bounded_and_whole():
    schema = pa.schema([("name", pa.string()), ("content", pa.binary())])
    rows = [{"name": str(i), "content": b"x" * (1000 if i == 3 else 1)} for i in range(25)]
    found = list(record_batches(iter(rows), schema, most_rows=10, most_bytes=500))
    assert [b.num_rows for b in found] == [4, 10, 10, 1] and [r for b in found for r in b.to_pylist()] == rows
    assert list(record_batches(iter([]), schema)) == []


def test_parts_of_a_small_table_are_read_by_all_tasks(spark):
    for name in ("template_parts", "template_warnings", "template_elements", "theme_tokens"):
        assert registry.QUERIES[name](spark, SF).select(F.spark_partition_id()).distinct().count() == 4, name
    several = spark.createDataFrame([("a", "1,2\n3"), ("b", '"'), ("c", "")], "name string, text string")
    assert {(r["name"], r["row_no"], r["text"], r["error"] is None) for r in csvtext.cells(several).collect()} == {("a", 1, "1", True), ("a", 1, "2", True), ("a", 2, "3", True), ("b", None, None, False), ("c", 1, "", True)}
    assert template.elements_of(spark.createDataFrame([("a", None)], "name string, content binary")).count() == 0


def test_workbooks_reach_all_tasks(spark):
    assert registry.QUERIES["sheet_cells"](spark, SF).select(F.spark_partition_id()).distinct().count() == 4


def test_workbooks_are_read_in_small_batches_in_any_session(spark, monkeypatch):
    schema, name = pa.schema(material._SHEET), "spark.sql.execution.arrow.max{}PerBatch"
    kept = {name.format(k): spark.conf.get(name.format(k)) for k in ("Records", "Bytes")}

    def seen(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pylist([{"name": str(batch.nbytes), "row_no": batch.num_rows, "error": "seen"}], schema)

    try:
        spark.conf.set(name.format("Records"), "10000")
        spark.conf.set(name.format("Bytes"), "64m")
        monkeypatch.setattr(material, "_cells", seen)
        files = spark.range(0, 3000, 1, 1).select("id", F.repeat(F.lit("x"), 4000).cast("binary").alias("content"))
        found = material.sheet_facts(files, "id").collect()
        assert sum(r["row_no"] for r in found) == 3000 and max(int(r["name"]) for r in found) < 2 * ARROW_BYTES
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)


def test_lineage_gives_the_driver_nothing_to_broadcast(spark):
    jobs = spark.createDataFrame([(1, 0), (2, 1), (None, 0)], "job long, audit_errors int")
    found = decks.stage_lineage(decks.stage_trace(jobs))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    by_job = {r["job"]: r["count"] for r in found.groupBy("job").count().collect()}
    made = {name: len(artifacts) for name, _, artifacts in decks.STAGES}
    pairs = {name: made[name] * sum(made[p] for p in parents) for name, parents in decks.READS.items()}
    assert by_job == {1: sum(pairs.values()), 2: sum(n for name, n in pairs.items() if name not in ("critics", "repair-plans", "final-jury"))}


def test_times_are_rounded_to_milliseconds_as_sql_does(spark):
    import duckdb

    from evigrain.plans.state_queries import _millis

    times = ["2024-01-01 00:00:00.000499", "2024-01-01 00:00:00.0005", "2024-01-01 00:00:00.000999", "1969-12-31 23:59:59.9985", "1969-12-31 23:59:59.9996", "1969-12-31 23:59:59.9986", "1970-01-01 00:00:00.0005"]
    found = [r["at"] for r in spark.createDataFrame([(t,) for t in times], "t string").select(_millis(F.col("t").cast("timestamp")).alias("at")).collect()]
    assert found == [duckdb.execute("SELECT epoch_ms(CAST(? AS TIMESTAMP))", [t]).fetchone()[0] for t in times]


def test_only_templates_in_use_are_profiled(spark, monkeypatch):
    from evigrain.operators import layouts
    from evigrain.plans.layout_queries import _deck_inputs

    class Seen(Exception):
        pass

    def stop(df, label):
        raise Seen(sorted(r[0] for r in df.select("template_id").distinct().collect()))

    slides, items, known, elements = _deck_inputs(spark, SF)
    monkeypatch.setattr(layouts, "profiles", lambda own, parts: own.join(parts.select("template_id").distinct(), "template_id"))
    monkeypatch.setattr(layouts, "stored", stop)
    with pytest.raises(Seen) as seen:
        layouts.scores(slides.filter("template_id = 3"), items, known, elements)
    assert seen.value.args[0] == [3]


def test_lines_of_a_text_are_counted_once_for_all_widths(spark):
    from evigrain.operators import layouts
    from evigrain.operators.fixes import lines

    texts = ["", "a", "some words and a loooooooooooooooooooong one", "two\n\nlines of it  \n", " ".join("x" * (k % 9 + 1) for k in range(90)), "\n"]
    slides = spark.createDataFrame([("d", k, 9, 1, None, None, t) for k, t in enumerate(texts)], "deck string, slide_no int, slide_count int, template_id long, purpose string, intent string, title string")
    items = spark.createDataFrame([("d", 2, 0, "one, two"), ("d", 4, 0, "first of"), ("d", 4, 1, "several")], "deck string, slide_no int, item_no int, item string")
    found = {r["slide_no"]: r for r in layouts.measured(slides, items, 110).collect()}
    at = lambda text, most: text["counts"][min(most - 4, len(text["counts"]) - 1)]
    width = lambda most: (most + 0.5) * 14 * 0.62
    for k, text in enumerate(texts):
        assert [at(found[k]["title_text"], most) for most in range(4, 111)] == [lines(text, 14, width(most)) for most in range(4, 111)], text
    assert [len(found[4][c]) for c in ("item_texts", "part_texts", "tail_texts")] == [2, 2, 2] and [len(found[2][c]) for c in ("item_texts", "part_texts", "tail_texts")] == [1, 2, 1]
    assert at(found[4]["tail_texts"][0], 110) == 1 and at(found[4]["body_text"], 110) == 2 and found[0]["joined_text"]["empty"] and found[0]["item_texts"] == []


def test_scores_are_read_once_for_a_choice(spark):
    from evigrain.operators import folds

    scores = spark.createDataFrame([("d", 0, "b", 2.0), ("d", 0, "a", 2.0), ("d", 1, "a", 1.0), ("d", 1, "c", None), (None, 0, "a", 1.0)], "deck string, slide_no int, layout_id string, score double")
    found = folds.choose_layouts(scores)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["deck"], r["slide_no"], r["layout_id"]) for r in found.collect()) == [("d", 0, "a"), ("d", 1, "a")]


def test_only_chosen_layouts_are_profiled_for_slides(spark, monkeypatch):
    from evigrain.operators import materialize
    from evigrain.plans.layout_queries import _deck_inputs

    class Seen(Exception):
        pass

    def stop(*sides):
        raise Seen([sorted(r[0] for r in side.select("layout_id").distinct().collect()) for side in sides])

    monkeypatch.setattr(materialize, "profiles", stop)
    picks = spark.createDataFrame([(0, "compact", 0, 3), (0, "visual", 0, 5), (0, "visual", 1, 3)], "deck long, variant string, slide_no long, layout_id long")
    with pytest.raises(Seen) as seen:
        materialize.slides(picks, *_deck_inputs(spark, SF))
    assert seen.value.args[0] == [[3, 5], [3, 5]]
