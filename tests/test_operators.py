"""Golden rows and invariants of operators that SQL can't express, or whose cases are easier to state as rows."""

import io
import random
import struct
import zipfile
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evigrain.functions import cells, color, jsontext, phrases, text
from evigrain.functions.geometry import text_lines
from evigrain.operators import evidence, folds, rank, state, visuals
from evigrain.sources import csvtext, images, office
from evigrain.streaming import windows
from evigrain.streaming.admission import admitted_stream


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


@pytest.mark.parametrize(("body", "expected"), [
    ("a,b\n1,2\n", [(1, ["a", "b"]), (2, ["1", "2"])]),
    ("﻿a;b;c,d\n", [(1, ["a", "b", "c,d"])]),
    ('x,"two\nlines"\ny,"q""q"', [(1, ["x", "two\nlines"]), (3, ["y", 'q"q'])]),
    ("a,\r\n\r\nb", [(1, ["a", ""]), (2, [""]), (3, ["b"])]),
    ("", [(1, [""])]),
    ("a,", [(1, ["a", ""])]),
])
def test_csv_rows(body, expected):
    assert list(csvtext.rows(body)) == expected


@pytest.mark.parametrize(("body", "message"), [('a,"b', "Unmatched"), ('a,b"c', "Malformed"), ('a,"b"c', "Malformed")])
def test_csv_errors(spark, body, message):
    with pytest.raises(csvtext.MalformedCsv, match=message):
        list(csvtext.rows(body))
    found = csvtext.cells(spark.createDataFrame([("f", body), ("g", None)], "name string, text string")).collect()
    assert {r["name"]: bool(r["error"]) for r in found} == {"f": True, "g": False}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text("ab \"',;\n\r", max_size=6), min_size=1, max_size=4), min_size=1, max_size=4))
def test_csv_round_trip(table):
    body = "\n".join(",".join('"' + c.replace('"', '""') + '"' for c in row) for row in table)
    if csvtext.sniff(body) == ",":
        assert [row for _, row in csvtext.rows(body)] == table


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body):
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
    return box.getvalue()


def test_docx_paragraphs():
    body = "<w:p><w:r><w:t>one</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    assert [(c["text"], c["locator"], c["precision"]) for c in office.document_chunks(docx(body))] == [("one\ttwo", "paragraph:1", "exact"), ("cell", "paragraph:3", "exact")]
    unknown = "<w:p><w:r><w:t>a</w:t></w:r></w:p><w:altChunk/>"
    assert [(c["locator"], c["precision"]) for c in office.document_chunks(docx(unknown))] == [("document", "document")]


def deck(order, hidden=(), rels=True):
    p, r = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("ppt/presentation.xml", f"<p:presentation {p} {r}><p:sldIdLst>" + "".join(f'<p:sldId id="{256 + n}" r:id="r{n}"/>' for n in order) + "</p:sldIdLst></p:presentation>")
        if rels:
            z.writestr("ppt/_rels/presentation.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{n}" Type="slide" Target="slides/slide{n}.xml"/>' for n in order) + "</Relationships>")
        for n in order:
            z.writestr(f"ppt/slides/slide{n}.xml", f'<p:sld {p} xmlns:a="urn:a"{" show=" + chr(34) + "0" + chr(34) if n in hidden else ""}><a:t>text {n}</a:t></p:sld>')
    return box.getvalue()


def test_pptx_order():
    assert [(c["text"], c["locator"]) for c in office.deck_chunks(deck([10, 2, 3], hidden=[3]))] == [("text 10", "slide:1"), ("text 2", "slide:2")]
    assert [(c["text"], c["precision"]) for c in office.deck_chunks(deck([10, 2], rels=False))] == [("text 2", "document"), ("text 10", "document")]


def test_xlsx_cells():
    m, r = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {m} {r}><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {m}><si><t>shared</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {m}><sheetData><row r="2"><c r="B2" t="s"><v>0</v></c><c t="b"><v>1</v></c><c r="D2"><f>1+1</f></c></row></sheetData><mergeCells><mergeCell ref="A1:C1"/></mergeCells></worksheet>')
    found = list(office.sheet_cells(box.getvalue()))
    assert [(c["ref"], c["kind"], c["raw"], c["shared"], c["formula"]) for c in found] == [("B2", "s", "0", "shared", None), ("#2:3", "b", "1", None, None), ("D2", None, None, None, "1+1")]
    assert [c["merged"] for c in found] == [None] * 3
    assert office.merged_ranges(["A1:C1", "B2:A1", "D4:D4", "F6:G7", "F6:H9", "x"]) == [(1, 1, 1, 3)]


def test_office_errors(spark):
    rows = [("a.docx", docx("<w:p><w:r><w:t>x</w:t></w:r></w:p>")), ("b.docx", b"no zip"), ("c.exe", b""), ("d.docx", None)]
    found = office.chunks(spark.createDataFrame(rows, "path string, content binary")).collect()
    assert {r["name"]: r["error"] is None for r in found} == {"a.docx": True, "b.docx": False, "c.exe": False, "d.docx": False}


def png(width, height, rows, kind=6, mode=0):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return images.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(bytes([mode]) + r for r in rows))) + chunk(b"IEND", b"")


def test_png_comparison():
    left = png(2, 1, [bytes([0, 0, 0, 255, 10, 20, 30, 255])])
    right = png(2, 1, [bytes([255, 255, 0, 255, 10, 20, 30, 255])])
    found = images.compare_pixels(left, right)
    assert found == {"reason": "pixels", "differing_pixels": 1, "differing_channels": 2, "largest": 255, "total": 510, "mean_abs": 63.75}
    assert images.compare_pixels(left, left)["reason"] is None
    assert images.compare_pixels(left, png(1, 1, [b"\0\0\0\0"]))["reason"] == "dimensions"
    assert images.compare_pixels(left, left[:-6])["reason"] == "invalid_png"


@pytest.mark.parametrize("mode", range(5))
def test_png_filters(mode):
    rng = random.Random(mode)
    width, height, step = 5, 4, 3
    pixels = [[rng.randrange(256) for _ in range(width * step)] for _ in range(height)]
    rows = []
    for y, line in enumerate(pixels):
        out = []
        for i, value in enumerate(line):
            a, b = line[i - step] if i >= step else 0, pixels[y - 1][i] if y else 0
            c = pixels[y - 1][i - step] if y and i >= step else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out.append((value - (0, a, b, (a + b) // 2, paeth)[mode]) % 256)
        rows.append(bytes(out))
    assert images.png_pixels(png(width, height, rows, kind=2, mode=mode))[:, :, :3].reshape(height, -1).tolist() == pixels


def test_image_sizes():
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x05\x00\x07\x01\x01\x11\x00\xff\xd9"
    assert images.size(jpeg) == (7, 5)
    webp = b"RIFF\x1a\0\0\0WEBPVP8X" + b"\0" * 8 + b"\x09\0\0\x04\0\0"
    assert images.size(webp) == (10, 5)
    assert images.size(b"GIF89a\x00\x00\x05\x00") is None and images.size(None) is None and images.size(b"") is None


@pytest.mark.parametrize(("brief", "count", "source"), [
    ("Make 12 slides", 12, "brief"), ("seven slides please", 7, "brief"), ("8 to 10 slides", 9, "selection"), ("slides: 6", 6, "brief"), ("Нужно двенадцать слайдов", 12, "brief"),
    ("the deck will be 20 slides", 9, "selection"), ("no count", 9, "selection"), ("slides should be 10", 10, "brief"), ("10 slides, that is ten slides", 10, "brief"),
])
def test_slide_counts(spark, brief, count, source):
    found = one(spark, phrases.effective_count(F.col("b"), F.lit(9)), b=brief)
    assert (found["slide_count"], found["count_source"]) == (count, source)


@pytest.mark.parametrize(("raw", "kind", "value"), [("TRUE ", "boolean", True), ("-0.5", "number", -0.5), ("+1", "string", "+1"), ("01", "string", "01"), ("1e3", "string", "1e3"), ("", "string", ""), ("2024-01-15", "string", "2024-01-15")])
def test_inference(spark, raw, kind, value):
    found = one(spark, text.inferred(F.col("x")), x=raw)
    assert found["value_type"] == kind and value in (found["value_bool"], found["value_num"], found["value_str"])


@pytest.mark.parametrize(("serial", "old", "iso"), [(1, False, "1900-01-01T00:00:00.000Z"), (60.5, False, None), (61, False, "1900-03-01T00:00:00.000Z"), (0, True, "1904-01-01T00:00:00.000Z"), (44927.5, False, "2023-01-01T12:00:00.000Z"), (2958466, False, None), (-1, False, None)])
def test_serials(spark, serial, old, iso):
    assert one(spark, cells.serial_to_iso(F.col("s"), F.lit(old)), s=float(serial)) == iso


def brute_wrap(value, width):
    total = 0
    for line in value.split("\n"):
        lines, now = 0, ""
        for word in line.split():
            if now and len(now) + 1 + len(word) > width:
                lines, now = lines + 1, ""
            while len(word) > width:
                lines, word = lines + 1, word[width:]
            now = f"{now} {word}" if now else word
        total += max(1, lines + bool(now))
    return total


def test_text_wrapping(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab  \n") for _ in range(rng.randrange(60))) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r[0] for r in df.select(text_lines(F.col("t"), F.lit(10.0), F.lit(50.0))).collect()]
    assert found == [brute_wrap(t, 8) for t in texts]


def test_contrast(spark):
    assert one(spark, F.round(color.contrast(F.col("a"), F.col("b")), 2), a="#000000", b="#FFFFFF") == 21.0
    assert one(spark, color.luminance(F.col("a")), a="red") is None
    assert one(spark, color.contrast(F.col("a"), F.col("b")), a="#000000", b="none") is None


def test_json():
    assert jsontext.canonical('{"b":1.0,"a":[{"d":1,"c":2.5}]}') == '{"a":[{"c":2.5,"d":1}],"b":1}'
    assert jsontext.object_in('<think>{"x"</think>see {"a": "}"} there') == '{"a":"}"}'
    assert jsontext.object_in("none") is None and jsontext.canonical(None) is None


def test_every_claim_reason(spark):
    chunks = spark.createDataFrame([("c1", 0, "Revenue was 42 units on 2024-01-15 in total.", "exact"), ("c2", 1, "Other text", "document")], "chunk_id string, ord int, text string, precision string")
    facts = spark.createDataFrame([("f1", "c1", "number", 42.0, None), ("f2", "c2", "number", 7.0, None), ("f3", "c1", "date", None, "2024-01-15T00:00:00.000Z"), ("n1", "c1", "number", 2024.0, None), ("n2", "c1", "number", 1.0, None), ("n3", "c1", "number", 15.0, None)], "fact_id string, chunk_id string, value_type string, value_num double, value_str string")
    rows = [
        ("missing_verifiable_evidence", "x", [], [], " "), ("missing_source_chunk", "x", [], ["f1"], ""), ("unknown_source_chunk_id", "x", ["c1", "c9"], [], "x"), ("missing_verbatim_evidence", "x", ["c1"], [], " "),
        ("verbatim_evidence_not_in_source_chunk", "x", ["c1"], [], "revenue was"), ("unknown_fact_id", "was", ["c1"], ["f9"], "was"), ("fact_not_owned_by_cited_source_chunk", "was", ["c1"], ["f2"], "was"),
        ("content_not_verbatim_evidence", "turnover", ["c1"], [], "was"), ("numeric_claim_not_supported_by_cited_facts", "was 42", ["c1"], [], "was 42 units"),
        ("date_claim_not_supported_by_cited_facts", "on 2024-01-15", ["c1"], ["n1", "n2", "n3"], "on 2024-01-15"), (None, "REVENUE  was 42", ["c1", "c2"], ["f1"], "Revenue was 42"),
    ]
    claims = spark.createDataFrame([(str(i), *r[1:]) for i, r in enumerate(rows)], "claim_id string, text string, chunk_ids array<string>, fact_ids array<string>, quote string")
    found = {int(r["claim_id"]): r for r in evidence.align(claims, chunks, facts).collect()}
    assert [found[i]["reason"] for i in range(len(rows))] == [r[0] for r in rows]
    assert found[10]["precision"] == "exact" and found[8]["rejected"] and not found[7]["rejected"]
    total = evidence.summary(evidence.align(claims, chunks, facts)).first()
    assert total["grounded"] + total["unsupported"] == total["total"] == len(rows)


def test_short_claims_and_first_chunk(spark):
    chunks = spark.createDataFrame([("late", 5, "say hello world again"), ("early", 1, "Hello  World")], "chunk_id string, ord int, text string")
    claims = spark.createDataFrame([("a", "hello world"), ("b", "lo wor"), ("c", "say hello world again"), ("d", " "), ("e", "absent here now"), ("f", "O"), ("g", "gai"), ("h", "zz")], "claim_id string, text string")
    found = {r["claim_id"]: r["chunk_id"] for r in evidence.first_grounding(chunks, claims).collect()}
    assert found == {"a": "early", "b": "early", "c": "late", "d": None, "e": None, "f": "early", "g": "late", "h": None}


def brute_admission(rows, caps, window):
    times, out = {}, {}
    for key, kind, at, seq, busy in sorted(rows, key=lambda r: (r[2], r[3])):
        kept = times.setdefault((key, kind), [])
        kept[:] = [t for t in kept if t > at - window]
        if len(kept) >= caps[kind]:
            out[seq] = 429
        else:
            kept.append(at)
            out[seq] = 503 if busy else 200
    return out


def test_admission_batch_and_stream(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.randrange(3), rng.choice(["generation", "export"]), t * 4000, i, rng.random() < 0.2) for i, t in enumerate(sorted(rng.randrange(200) for _ in range(300)))]
    schema = "key long, kind string, at long, seq long, busy boolean"
    caps = {"generation": 5, "export": 9}
    expected = brute_admission(rows, caps, 60_000)
    df = spark.createDataFrame(rows, schema)
    assert {r["seq"]: r["status"] for r in state.admitted(df, "key", "kind", "at", "seq", "busy", caps).collect()} == expected
    for part, chosen in enumerate((rows[:150], rows[150:])):
        spark.createDataFrame(chosen, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(part)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = admitted_stream(stream, caps).writeStream.format("memory").queryName("admitted").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert len(spark.table("admitted").collect()) == len(rows)


def test_request_sequence():
    guard = state.Admission(5)
    assert [guard(t, False)[0] for t in (0, 1, 2, 3, 4, 5)] == [200] * 5 + [429]
    assert guard(59_999, False) == (429, 1) and guard(60_000, False)[0] == 200 and guard(60_000, False)[0] == 429


def test_windowed_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    query = windows.windowed_counts(stream).writeStream.format("memory").queryName("counted").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    key = lambda r: (str(r[0]), r[1], r[2])
    assert sorted(map(key, spark.table("counted").collect())) == sorted(map(key, windows.windowed_counts(events).collect()))


def test_folds(spark):
    panels = spark.createDataFrame([("a", i, float(x), 0.0, 100.0, 50.0) for i, x in enumerate((0, 200, 400))] + [("a", 3, 0.0, 300.0, 400.0, 200.0)], "layout_id string, ord long, x double, y double, w double, h double")
    assert folds.like_panel_groups(panels, 960, 540).first()["largest"] == 3
    own = spark.createDataFrame([("l", 0, None, "title"), ("l", 1, "2", None), ("l", 2, "2", None), ("alone", 0, None, None)], "layout_id string, ord long, idx string, kind string")
    parents = spark.createDataFrame([("l", 7, "2", "body"), ("l", 8, None, "title"), ("other", 1, None, None)], "layout_id string, ord long, idx string, kind string")
    assert {(r["layout_id"], r["ord"]): r["parent_ord"] for r in folds.inherit_placeholders(own, parents).collect()} == {("l", 0): 8, ("l", 1): 7, ("l", 2): None, ("alone", 0): None}
    scores = spark.createDataFrame([("d", s, name, 1.0) for s in range(4) for name in ("x", "y")], "deck string, slide_no int, layout_id string, score double")
    assert [r["layout_id"] for r in folds.choose_layouts(scores).orderBy("slide_no").collect()] == ["x", "y", "x", "y"]
    steps = [("v", i, a, s) for i, (a, s) in enumerate([("edit", "a"), ("edit", "b"), ("edit", "c"), ("undo", ""), ("undo", ""), ("redo", ""), ("edit", "d"), ("redo", "")])]
    assert folds.travel_history(spark.createDataFrame(steps, "variant string, ord int, action string, state string")).first()["present"] == "d"


def test_closure_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)], "p long, c long")
    assert visuals.closure(chain, "p", "c").count() == 20 * 21 // 2


def test_results_do_not_depend_on_partitions(spark):
    from evigrain.operators import tokens
    from evigrain.plans.standins import frame

    elements = frame(spark, "/root/testdata/sf0.001", "elements")
    few = sorted(map(str, tokens.recurring(elements.coalesce(1), most=None).collect()))
    assert few == sorted(map(str, tokens.recurring(elements.repartition(7), most=None).collect()))


def test_plan_slides(spark):
    from evigrain.operators import decks

    briefs = spark.createDataFrame([(1, "\n  Topic \n", ["One. Two; three. Four", "Рекомендации: начать завтра"], 13), (2, "", [], 5)], "plan_id long, brief string, signals array<string>, slide_count int")
    found = {(r["plan_id"], r["slide_no"]): r for r in decks.plan_slides(briefs).collect()}
    assert len(found) == 18 and found[1, 1]["title"] == "Topic" and found[2, 1]["title"] == text.UNTITLED
    assert found[1, 10]["content"] == ["начать завтра"] and found[1, 5]["content"] == ["Рекомендации", "начать завтра", text.SUPPLEMENTS[1]]
    assert found[1, 13]["title"] == "Деталь 3" and len(found[2, 3]["content"]) == 3


def test_skills(spark):
    from evigrain.plans import skills

    skills.register(spark)
    assert spark.sql("SELECT canonical_json('{\"b\": 1, \"a\": 2}') AS j").first()["j"] == '{"a":2,"b":1}'
    assert [tuple(r) for r in spark.sql("SELECT * FROM csv_cells('a,b')").collect()] == [(1, 1, "a"), (1, 2, "b")]
    with pytest.raises(KeyError):
        skills.skill("none")


ELEMENT = "slide_id string, ord int, element_id string, type string, x double, y double, w double, h double, z int, text string, font string, font_size double, font_weight int, color string, shape string, fill string, stroke string, radius double"


def fixed(spark, *rows, design=None, **more):
    """Rows are changes to a plain text element in the middle of the canvas; gives the elements by order after all safe fixes."""
    from evigrain.operators import fixes

    plain = {"slide_id": "s", "element_id": None, "type": "text", "x": 100.0, "y": 100.0, "w": 300.0, "h": 40.0, "z": 1, "text": "fine", "font": "Arial", "font_size": 20.0, "font_weight": 400, "color": "#000000", "shape": "rect", "fill": "#FFFFFF", "stroke": "#FFFFFF", "radius": 0.0}
    made = [plain | {"ord": i, "element_id": f"e{i}"} | row for i, row in enumerate(rows)]
    kind = ELEMENT + (", locked boolean" if any("locked" in r for r in made) else "")
    names = [f.split()[0] for f in kind.split(", ")]
    elements = spark.createDataFrame([tuple(r.get(n) for n in names) for r in made], kind)
    found = fixes.safe_fixes(elements, design or fixes.Design(("Georgia",), ("Aptos",), ("#777777", "#112233", "#FFFFFF")))
    return [r.asDict() for r in found.orderBy("ord").collect()]


def test_safe_fixes_one_by_one(spark):
    from evigrain.operators import fixes

    box, font, heading = fixed(spark, {"x": -20.0, "y": 520.0, "w": 1200.0}, {"font": "Papyrus", "y": 200.0}, {"font": "Papyrus", "font_weight": 700, "y": 300.0})
    assert (box["x"], box["y"], box["w"], box["h"], box["fixed"]) == (0.0, 500.0, 960.0, 40.0, "OUTSIDE_SLIDE")
    assert (font["font"], font["fixed"]) == ("Aptos", "UNSUPPORTED_FONT") and (heading["font"], heading["fixed"]) == ("Georgia", "UNSUPPORTED_FONT")
    assert fixed(spark, {"font": "Papyrus"}, design=fixes.Design((), (), ()))[0]["fixed"] == ""


def test_safe_fixes_of_overflow(spark):
    long = "several words that need more than one line in a box of this width"
    assert [(r["h"], r["font_size"], r["fixed"]) for r in fixed(spark, {"text": long})] == [(pytest.approx(3 * 20 * 1.28), 20.0, "TEXT_OVERFLOW")]
    below = {"y": 165.0, "text": "near"}  # growing would meet it, so the font shrinks
    assert [(r["h"], r["font_size"], r["fixed"]) for r in fixed(spark, {"text": long, "h": 60.0}, below)] == [(60.0, 15.0, "TEXT_OVERFLOW"), (40.0, 20.0, "")]
    lows = [fixed(spark, {"text": long, "y": 495.0, "h": h})[0] for h in (40.0, 30.0)]  # the canvas has no room to grow
    assert [(r["h"], r["font_size"], r["fixed"]) for r in lows] == [(40.0, 14.0, "TEXT_OVERFLOW"), (30.0, 20.0, "")]
    locked = fixed(spark, {"text": long, "locked": True})[0]
    assert (locked["h"], locked["fixed"]) == (40.0, "")
    twins = fixed(spark, {"text": long, "element_id": "same"}, {"element_id": "same", "y": 300.0})
    assert [t["fixed"] for t in twins] == ["", ""] and twins[0]["h"] == 40.0


def test_safe_fixes_of_contrast(spark):
    # The first colour of the palette that is enough, not the best one.
    assert [(r["color"], r["fixed"]) for r in fixed(spark, {"color": "#EEEEEE"})] == [("#112233", "LOW_TEXT_CONTRAST")]
    assert [(r["color"], r["fixed"]) for r in fixed(spark, {"color": "#EEEEEE", "font_size": 24.0})] == [("#777777", "LOW_TEXT_CONTRAST")]
    dark = {"type": "shape", "x": 90.0, "y": 90.0, "w": 400.0, "h": 100.0, "z": 0, "fill": "#000000"}
    assert [(r["color"], r["fixed"]) for r in fixed(spark, dark, {})][1] == ("#777777", "LOW_TEXT_CONTRAST")
    unclear = fixed(spark, dark, {"color": "#111111"}, {"type": "image", "x": 95.0, "y": 95.0, "w": 50.0, "h": 50.0, "z": 2})
    assert (unclear[1]["color"], unclear[1]["fixed"]) == ("#111111", "")
    twins = fixed(spark, {"color": "#EEEEEE", "element_id": "same"}, {"element_id": "same", "y": 300.0})
    assert [t["color"] for t in twins] == ["#EEEEEE", "#000000"]


def test_safe_fixes_leave_less(spark):
    from evigrain.operators import audit, fixes
    from evigrain.plans.standins import frame

    elements = frame(spark, "/root/testdata/sf0.001", "elements")
    once = fixes.safe_fixes(elements, fixes.Design(("Georgia",), ("Aptos",), ("#000000", "#FFFFFF"))).drop("fixed").cache()
    assert once.columns == elements.columns and audit.outside(once).count() == 0
    assert audit.overflow(once).count() < audit.overflow(elements).count() and audit.low_contrast(once).count() <= audit.low_contrast(elements).count()
    assert fixes.safe_fixes(elements.limit(0), fixes.Design((), (), ())).count() == 0


def test_audit_finds_every_kind(spark):
    from evigrain.plans import registry

    kinds = {r["type"] for r in registry.QUERIES["audit_report"](spark, "/root/testdata/sf0.001").select("type").distinct().collect()}
    assert kinds == {"OUTSIDE_SLIDE", "EMPTY_PLACEHOLDER", "SMALL_TEXT", "UNSUPPORTED_FONT", "COLOR_OUTSIDE_DESIGN_SYSTEM", "TEXT_OVERFLOW", "SMALL_MARGIN", "INVALID_IMAGE_DATA", "IMAGE_ASPECT_DISTORTION", "ELEMENT_OVERLAP", "LOW_TEXT_CONTRAST", "DUPLICATE_SLIDE"}


def test_embedded_images_must_be_whole():
    import base64

    data = png(2, 1, [bytes([0, 0, 0, 255, 10, 20, 30, 255])])
    url = lambda d, kind="png": f"data:image/{kind};base64," + base64.b64encode(d).decode()
    chunk = lambda kind, body: len(body).to_bytes(4) + kind + body + zlib.crc32(kind + body).to_bytes(4)
    head, end = data.index(b"IHDR") - 4, data.index(b"IEND") - 4
    assert images.embedded(url(data)) == {"valid": True, "width": 2, "height": 1}
    broken = {
        "bytes after its end": data + b"x",
        "second header": data[:end] + data[head : head + 25] + data[end:],
        "long end": data[:end] + chunk(b"IEND", b"x"),
        "method": data[:head] + chunk(b"IHDR", data[head + 8 : head + 18] + b"\1" + data[head + 19 : head + 21]) + data[head + 25 :],
        "name of a chunk": data[:end] + chunk(b"a1bc", b"") + data[end:],
        "cut": data[:-1],
    }
    assert {k: images.embedded(url(d))["valid"] for k, d in broken.items()} == dict.fromkeys(broken, False)
    frame = b"\xff\xc0" + (11).to_bytes(2) + b"\x08\x00\x03\x00\x05" + b"\x01\x11\x00\x00"
    scan = b"\xff\xda\x00\x02" + b"data"
    assert images.embedded(url(b"\xff\xd8" + frame + scan + b"\xff\xd9", "jpeg")) == {"valid": True, "width": 5, "height": 3}
    assert not images.embedded(url(b"\xff\xd8" + frame + b"\xff\xd9", "jpeg"))["valid"] and not images.embedded(url(b"\xff\xd8" + scan + b"\xff\xd9", "jpeg"))["valid"]


@pytest.mark.parametrize("few", [20_000, 0])
def test_containment_equals_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(evidence, "BROADCAST_CLAIMS", few)
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 3)))
    chunks = [(str(i), i, " ".join(word() for _ in range(rng.randint(0, 12)))) for i in range(60)]
    claims = [(str(i), " ".join(word() for _ in range(rng.randint(1, 5)))) for i in range(60)]
    found = evidence.containing(spark.createDataFrame(chunks, "chunk_id string, ord int, text string"), spark.createDataFrame(claims, "claim_id string, text string"))
    assert sorted((r["claim_id"], r["chunk_id"]) for r in found.collect()) == sorted((c, k) for c, t in claims for k, _, body in chunks if t in body)
    assert "Cartesian" not in found._jdf.queryExecution().executedPlan().toString() and "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    empty = spark.createDataFrame(claims, "claim_id string, text string").limit(0)
    assert evidence.containing(spark.createDataFrame(chunks, "chunk_id string, ord int, text string"), empty).count() == 0


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from evigrain import runtime

    class Conf(dict):
        def set(self, key, value):
            self[key] = value

    class Fake:
        conf = Conf({"spark.master": "yarn"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.shared_dir(Fake())
    Fake.conf["spark.master"] = "local[4]"
    assert runtime.shared_dir(Fake())
    Fake.conf = Conf({"spark.master": "yarn", "spark.checkpoint.dir": "hdfs://x/y/"})
    assert runtime.shared_dir(Fake()) == "hdfs://x/y"


def test_running_sums_of_one_large_group_are_spread_over_tasks(spark):
    """Almost all rows are in one group, some are level; each task adds up its own part."""
    rng = random.Random(6)
    rows = [("hot" if i % 50 else f"g{i % 7}", rng.randrange(3000), rng.randrange(100)) for i in range(20_000)] + [(None, 1, 5), (None, 2, None), ("hot", None, 3)]
    df = spark.createDataFrame(rows, "g string, o int, v int")
    expected = Counter()
    for g, o, v in rows:
        expected[g, o] += v or 0
    upto, before = {}, Counter()
    for g, o in sorted(expected, key=lambda k: (str(k[0]), -1 if k[1] is None else k[1])):
        before[g] += expected[g, o]
        upto[g, o] = before[g]
    found = rank.running(df, ["g"], [F.col("o")], F.coalesce("v", F.lit(0)), "upto")
    assert Counter((r["g"], r["o"], r["v"], r["upto"]) for r in found.collect()) == Counter((g, o, v, upto[g, o]) for g, o, v in rows)
    assert rank.running(df.limit(0), ["g"], [F.col("o")], F.col("v"), "upto").count() == 0
    places = rank.numbered(df.withColumn("id", F.monotonically_increasing_id()), ["g"], [F.col("id")], "place").filter("g = 'hot'").agg(F.count_distinct("place"), F.max("place"), F.count("*")).first()
    assert len(set(places)) == 1


def test_histories_are_streamed_by_variant(spark):
    steps = [(v, k, "edit" if k % 5 else "undo", str(k)) for v in (1, 2, None) for k in range(2000)]
    found = folds.travel_history(spark.createDataFrame(steps, "variant int, ord int, action string, state string")).collect()
    assert sorted((str(r["variant"]), r["present"]) for r in found) == [("1", "1999"), ("2", "1999"), ("None", "1999")]


def test_links_of_any_length_and_cycles(spark):
    chain = [(f"c/{i}", f"c/{i + 1}") for i in range(1000)] + [("a", "b"), ("b", "a"), ("in", "a"), ("self", "self"), ("out", "../x"), ("abs", "/x"), ("two", "z"), ("two", "y"), (None, "x"), ("x", None)]
    links = spark.createDataFrame(chain, "path string, target string")
    paths = spark.createDataFrame([(p,) for p in ("c/0", "c/999", "a", "b", "in", "self", "out", "abs", "two", "plain", "../up", None)], "path string")
    found = {r["path"]: (r["resolved"], r["error"]) for r in state.resolved_paths(paths, links).collect()}
    assert found == {"c/0": ("c/1000", None), "c/999": ("c/1000", None), "a": (None, "cycle"), "b": (None, "cycle"), "in": (None, "cycle"), "self": (None, "cycle"), "out": ("../x", "escape"), "abs": ("/x", "escape"), "two": ("y", None), "plain": ("plain", None), "../up": ("../up", "escape")}
    assert state.resolved_paths(paths, links.limit(0)).filter("error IS NULL").count() == 10


def test_lone_ampersand_before_an_entity_is_text(spark):
    from evigrain.functions.text import decoded

    texts = ["the&&#x436;&amp;lt;", "une&amp&#72;;", "a&&amp;b; &nbsp", "a&lt;&nbsp;", "&b&lt;;", "&x&y;"]
    found = [r["d"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(decoded(F.col("t")).alias("d")).collect()]
    assert found == ["the&ж&lt;", "une&ampH;", "a&&b; &nbsp", None, "&b<;", None]
