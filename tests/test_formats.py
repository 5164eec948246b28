"""Workbooks and sets of files as data sources of Spark."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from evigrain.sources import formats, office

SHEET = '<worksheet><sheetData>{}</sheetData></worksheet>'


def workbook(path, sheets, rows=5):
    book = "".join(f'<sheet name="S{k}" r:id="r{k}"/>' for k in range(sheets))
    links = "".join(f'<Relationship Id="r{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(sheets))
    with zipfile.ZipFile(path, "w") as package:
        package.writestr("xl/workbook.xml", f'<workbook xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{book}</sheets></workbook>')
        package.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        for k in range(sheets):
            package.writestr(f"xl/worksheets/sheet{k}.xml", SHEET.format("".join(f'<row r="{r}"><c r="A{r}"><v>{k * 1000 + r}</v></c><c r="B{r}" t="str"><v>x{r}</v></c></row>' for r in range(1, rows + 1))))


@pytest.fixture
def books(spark, tmp_path):
    formats.register(spark)
    workbook(tmp_path / "large.xlsx", 7, rows=400)
    workbook(tmp_path / "small.xlsx", 1)
    (tmp_path / "broken.xlsx").write_bytes(b"nothing")
    (tmp_path / "other.txt").write_text("no workbook")
    return tmp_path


def test_workbooks_are_read_by_several_tasks(spark, books):
    cells = spark.read.format("workbook").option("splitBytes", "20000").load(str(books))
    assert cells.filter("path LIKE '%large%'").count() == 7 * 400 * 2 and cells.filter("path LIKE '%small%'").count() == 10
    by_task = cells.filter("path LIKE '%large%'").groupBy(F.spark_partition_id().alias("task")).agg(F.collect_set("sheet").alias("sheets")).collect()
    assert len(by_task) > 2 and sorted(s for r in by_task for s in r["sheets"]) == [f"S{k}" for k in range(7)]
    broken = cells.filter("error IS NOT NULL").collect()
    assert [os.path.basename(r["path"]) for r in broken] == ["broken.xlsx"] and broken[0]["raw"] is None
    content = (books / "large.xlsx").read_bytes()
    assert {(r["sheet"], r["ref"], r["raw"]) for r in cells.filter("path LIKE '%large%'").collect()} == {(c["sheet"], c["ref"], c["raw"]) for c in office.sheet_cells(content)}


def test_filters_and_columns_are_taken_before_reading(spark, books, monkeypatch):
    path = f"{books}/large.xlsx"
    reader = formats.WorkbookReader(str(books), 1 << 20, ["sheet", "raw"])
    left = list(reader.pushFilters([formats.EqualTo(("sheet",), "S3"), formats.In(("path",), (path, "x")), formats.EqualTo(("kind",), "str")]))
    assert [f.attribute for f in left] == [("kind",)] and [p.path for p in reader.partitions()] == [path]
    assert {r[0] for r in reader.read(reader.partitions()[0])} == {"S3"}
    narrow = spark.read.format("workbook").schema("sheet string, raw string").load(path).filter("sheet = 'S3'")
    assert narrow.columns == ["sheet", "raw"] and narrow.count() == 800
    assert spark.read.format("workbook").load(str(books)).filter("sheet = 'none'").count() == 0


def left(path):
    return sorted(os.listdir(path)) if os.path.isdir(path) else []


def test_sets_appear_as_a_whole(spark, tmp_path):
    formats.register(spark)
    path = str(tmp_path / "set")
    rows = spark.range(50).select(F.concat(F.lit("d/"), F.col("id"), F.lit(".txt")).alias("name"), F.col("id").cast("string").alias("content")).repartition(4)
    rows.write.format("fileset").mode("append").save(path)
    found = spark.read.format("fileset").load(path)
    assert {(r["name"], bytes(r["content"])) for r in found.collect()} == {(f"d/{i}.txt", str(i).encode()) for i in range(50)}
    assert found.select("sha256").distinct().count() == 50 and formats.current(path)["files"] == 50
    first = left(path)
    with pytest.raises(Exception, match="holds a set already"):
        rows.limit(3).write.format("fileset").mode("append").save(path)
    assert left(path) == first and spark.read.format("fileset").load(path).count() == 50
    rows.limit(3).write.format("fileset").mode("overwrite").save(path)
    assert spark.read.format("fileset").load(path).count() == 3 and len(left(path)) == 2


@pytest.mark.parametrize("bad", ["task", "../x", "/x", "a//b", "a/.", ""])
def test_a_failed_task_leaves_nothing(spark, tmp_path, bad):
    formats.register(spark)
    path = str(tmp_path / "set")
    spark.range(3).select(F.col("id").cast("string").alias("name"), F.lit("old").alias("content")).write.format("fileset").mode("append").save(path)
    before = left(path)
    name = F.when(F.col("id") == 70, F.lit(bad)).otherwise(F.col("id").cast("string")) if bad != "task" else F.col("id").cast("string")
    content = F.when(F.col("id") == 70, F.raise_error(F.lit("task is killed"))).otherwise(F.lit("new")) if bad == "task" else F.lit("new")
    rows = spark.range(0, 100, 1, 4).select(name.alias("name"), content.cast("string").alias("content"))
    with pytest.raises(Exception, match="task is killed|not a relative path"):
        rows.write.format("fileset").mode("overwrite").save(path)
    assert left(path) == before and {bytes(r["content"]) for r in spark.read.format("fileset").load(path).collect()} == {b"old"}


def test_attempts_that_were_lost_are_no_part_of_a_set(tmp_path):
    path = str(tmp_path)
    writer = formats.FilesetWriter(path, ["name", "content"], True)
    writer.write(iter([{"name": "a", "content": "lost"}]))
    message = writer.write(iter([{"name": "a", "content": "kept"}, {"name": "b", "content": None}]))
    writer.commit([message, None])
    reader = formats.FilesetReader(path, ["name", "content"])
    assert [r for p in reader.partitions() for r in reader.read(p)] == [("a", b"kept"), ("b", b"")]
    assert len(os.listdir(f"{path}/{writer.version}")) == 1
    entry = next(f for f in os.listdir(f"{path}/{message.folder}") if f.startswith("00000000"))
    with open(f"{path}/{message.folder}/{entry}", "wb") as out:
        out.write(b"KEPT")
    with pytest.raises(ValueError, match="not what the set says"):
        list(reader.read(reader.partitions()[0]))


def test_empty_sets(spark, tmp_path):
    formats.register(spark)
    assert spark.read.format("fileset").load(str(tmp_path)).count() == 0
    spark.range(0).select(F.lit("x").alias("name"), F.lit("y").alias("content")).write.format("fileset").mode("append").save(str(tmp_path / "e"))
    assert spark.read.format("fileset").load(str(tmp_path / "e")).count() == 0
