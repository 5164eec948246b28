"""Slide decks as packages: relationships, groups, surfaces, placement, plans, publication."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigrain.functions import text
from evigrain.functions.geometry import Rect, contains, intersection_area
from evigrain.sources import images

# The slides of a plan in order, with their purpose, title, visual and content; {n} is the n-th signal and its fallback.
RECIPES = (
    ("title", None, "none", ("Краткий обзор темы и ключевой результат для аудитории.",), None),
    ("problem", "Почему тема требует внимания", "cards", 1, (0, "Определим исходную проблему, потребность и контекст.")),
    ("context", "Контекст и исходные данные", "diagram", 3, (1, "Соберём факты, ограничения и ожидания.")),
    ("opportunity", "Возможность", "image", 1, (2, "Покажем, какую ценность создаёт выбранный подход.")),
    ("solution", "Предлагаемое решение", "cards", 3, (3, "Опишем решение простыми, проверяемыми шагами.")),
    ("workflow", "Как это работает", "timeline", ("Входные данные", "Обработка и принятие решений", "Результат и обратная связь"), None),
    ("advantages", "Ключевые преимущества", "cards", 4, (4, "Выделим преимущества для пользователей и команды.")),
    ("implementation", "План реализации", "timeline", ("Подготовка", "Пилот и проверка", "Масштабирование"), None),
    ("metrics", "Как измерим результат", "metrics", ("Пользовательская ценность", "Качество процесса", "Скорость достижения цели"), None),
    ("next_steps", "Следующие шаги", "none", 0, (None, "Определить следующие действия на основании подтверждённых материалов.")),
    ("summary", "Главное", "cards", ("Тема понятна", "Подход воспроизводим", "Следующий шаг определён"), None),
)
DETAIL, DETAIL_FALLBACK = "Деталь ", "Дополнительный аспект, который помогает принять решение."
MOST_SLIDES = 15


def package_path(source: Column, target: Column) -> Column:
    """A relationship's target as a package path; null for external targets and for those above the root."""
    base = F.split(source, "/")
    parts = F.filter(F.split(target, "/"), lambda p: ~p.isin("", "."))
    start = F.struct(F.slice(base, 1, F.greatest(F.size(base) - 1, F.lit(0))).alias("at"), F.lit(False).alias("lost"))

    def step(state: Column, part: Column) -> Column:
        up = part == ".."
        rest = F.slice(state["at"], 1, F.greatest(F.size(state["at"]) - 1, F.lit(0)))
        return F.struct(F.when(up, rest).otherwise(F.concat(state["at"], F.array(part))).alias("at"), (state["lost"] | (up & (F.size(state["at"]) == 0))).alias("lost"))

    path = F.aggregate(parts, start, step, lambda s: F.when(~s["lost"] & (F.size(s["at"]) > 0), F.array_join(s["at"], "/")))
    return F.when(~target.rlike(r"(?i)^([a-z][a-z0-9+.-]*:|//)"), path)


def relationship_states(relations: DataFrame, files: DataFrame) -> DataFrame:
    """For (source_file, target): the resolved path and whether it is there, missing or external."""
    resolved = relations.withColumn("path", package_path(F.col("source_file"), F.col("target")))
    known = files.select(F.col("path"), F.lit(True).alias("_known")).distinct()
    state = F.when(F.col("path").isNull(), "external").when(F.col("_known").isNull(), "missing").otherwise("resolved")
    return resolved.join(known, "path", "left").withColumn("state", state).drop("_known")


def composed(path: Column) -> Column:
    """One transform (sx, sy, tx, ty) from the transforms on the way from the root."""
    start = F.struct(*[F.lit(v).alias(k) for k, v in (("sx", 1.0), ("sy", 1.0), ("tx", 0.0), ("ty", 0.0))])
    return F.aggregate(path, start, lambda p, t: F.struct((p["sx"] * t["sx"]).alias("sx"), (p["sy"] * t["sy"]).alias("sy"), (p["sx"] * t["tx"] + p["tx"]).alias("tx"), (p["sy"] * t["ty"] + p["ty"]).alias("ty")))


def surfaces(elements: DataFrame) -> DataFrame:
    """For each text, the fill of the smallest shape around it; of equals the topmost."""
    texts = elements.filter("type = 'text'").select("slide_id", F.col("ord").alias("t_ord"), *[F.col(c).alias(f"t_{c}") for c in "xywh"])
    shapes = elements.filter("type = 'shape'").select("slide_id", "z", "fill", F.col("ord").alias("s_ord"), *[F.col(c).alias(f"s_{c}") for c in "xywh"])
    met = texts.join(shapes, "slide_id").filter(contains(Rect("s_"), Rect("t_"), 0))
    return met.groupBy("slide_id", F.col("t_ord").alias("ord")).agg(F.min_by("fill", F.struct(Rect("s_").area, -F.col("z"), "s_ord")).alias("surface"))


def page_errors(rendered: DataFrame, declared: DataFrame) -> DataFrame:
    """For (deck, slide_no, bytes, sha): repeated slides, and those whose file differs from what is declared."""
    repeated = F.count("*").over(Window.partitionBy("deck", "slide_no")) > 1
    own = declared.select("deck", "slide_no", F.col("bytes").alias("d_bytes"), F.col("sha").alias("d_sha"))
    error = F.when(F.col("repeated"), "duplicate_slide").when(F.col("d_sha").isNull(), "undeclared").when((F.col("d_bytes") != F.col("bytes")) | (F.col("d_sha") != F.col("sha")), "metadata_mismatch")
    return rendered.withColumn("repeated", repeated).join(own, ["deck", "slide_no"], "left").select("deck", "slide_no", error.alias("error"))


def edge_routes(edges: DataFrame) -> DataFrame:
    """Segments of edges between box centres: one if they share a row or column, else down, across and down with the bend half way."""
    fx, fy = F.col("a_x") + F.col("a_w") / 2, F.col("a_y") + F.col("a_h") / 2
    tx, ty = F.col("b_x") + F.col("b_w") / 2, F.col("b_y") + F.col("b_h") / 2
    bend = F.floor((fy + ty) / 2 + 0.5).cast("double")
    part = lambda *p: F.struct(*[x.alias(n) for x, n in zip(p, ("x1", "y1", "x2", "y2"), strict=True)])
    straight = F.array(part(fx, fy, tx, ty))
    bent = F.array(part(fx, fy, fx, bend), part(fx, bend, tx, bend), part(tx, bend, tx, ty))
    return edges.select("edge_id", F.posexplode(F.when((fx == tx) | (fy == ty), straight).otherwise(bent)).alias("segment", "s")).select("edge_id", "segment", "s.*")


def edge_labels(edges: DataFrame, w: float, h: float, body: tuple[float, float, float, float]) -> DataFrame:
    """Boxes (x, y) of edge labels on a body: the first of centre, above, below, left and right of both boxes that meets neither; the centre if all do."""
    r = lambda x: F.floor(x + 0.5).cast("double")
    a, b = Rect("a_"), Rect("b_")
    cx, cy = (a.x + a.w / 2 + b.x + b.w / 2) / 2, (a.y + a.h / 2 + b.y + b.h / 2) / 2
    places = ((cx - w / 2, cy - h / 2), (cx - w / 2, F.least(a.y, b.y) - h - 4), (cx - w / 2, F.greatest(a.bottom, b.bottom) + 4), (F.least(a.x, b.x) - w - 4, cy - h / 2), (F.greatest(a.right, b.right) + 4, cy - h / 2))
    inside = lambda v, low, size, own: r(F.least(F.greatest(v, F.lit(low)), F.lit(low + size - own)))
    boxes = [F.struct(inside(x, body[0], body[2], w).alias("x"), inside(y, body[1], body[3], h).alias("y")) for x, y in places]
    meets = lambda p, o: (p["x"] < o.right) & (p["x"] + w > o.x) & (p["y"] < o.bottom) & (p["y"] + h > o.y)
    found = F.get(F.filter(F.array(*boxes), lambda p: ~meets(p, a) & ~meets(p, b)), 0)
    return edges.select("edge_id", F.coalesce(found, boxes[0]).alias("p")).select("edge_id", "p.*")


def grid_nodes(nodes: DataFrame, body: tuple[float, float, float, float], w: float, h: float) -> DataFrame:
    """For (graph_id, ord, node_id): nodes in reading order on a grid of ceil(sqrt(n)) columns, each in the middle of its cell."""
    within = Window.partitionBy("graph_id")
    counted = nodes.withColumn("n", F.count("*").over(within)).withColumn("at", F.row_number().over(within.orderBy("ord")) - 1)
    columns = F.ceil(F.sqrt(F.col("n")))
    rows = F.ceil(F.col("n") / columns)
    x = body[0] + (F.pmod(F.col("at"), columns) + 0.5) * body[2] / columns - w / 2
    y = body[1] + (F.floor(F.col("at") / columns) + 0.5) * body[3] / rows - h / 2
    return counted.select("graph_id", "node_id", x.alias("x"), y.alias("y"))


def _short(x: Column) -> Column:
    """Four decimals at most, without trailing zeros."""
    bare = F.regexp_replace(F.regexp_replace(F.format_string("%.4f", x), "0+$", ""), r"\.$", "")
    return F.when(bare == "-0", "0").otherwise(bare)


def sector_path(start: Column, end: Column, center: float = 50, radius: float = 48) -> Column:
    """The path of a pie sector; a whole circle is made of two arcs."""
    point = lambda a: F.concat(_short(center + F.cos(a) * radius), F.lit(" "), _short(center + F.sin(a) * radius))
    arc = lambda flag, to: F.concat(F.lit(f" A {radius:g} {radius:g} 0 "), flag, F.lit(" 1 "), to)
    head = F.concat(F.lit(f"M {center:g} {center:g} L "), point(start))
    whole = F.concat(head, arc(F.lit("0"), point(start + math.pi)), arc(F.lit("0"), point(start)), F.lit(" Z"))
    part = F.concat(head, arc(F.when(end - start > math.pi, "1").otherwise("0"), point(end)), F.lit(" Z"))
    return F.when(end - start >= 2 * math.pi - 1e-10, whole).otherwise(part)


def pdf_boxes(items: DataFrame, page_height: float, left: float = 0, bottom: float = 0) -> DataFrame:
    """Boxes of non-blank text items (x, baseline, width, height), with the origin at the top; ones without extent are errors."""
    flipped = F.lit(float(bottom)) + page_height - F.col("baseline") - F.col("height")
    bad = (F.col("width") <= 0) | (F.col("height") <= 0)
    return items.filter(text.trimmed(F.coalesce("text", F.lit(""))) != "").select("item_id", (F.col("x") - left).alias("x"), flipped.alias("y"), "width", "height", F.when(bad, "non-positive bounds").alias("error"))


def overlap_areas(slots: DataFrame, obstacles: DataFrame) -> DataFrame:
    """Total area that each slot shares with obstacles of its slide."""
    a = slots.select("slide_id", F.col("ord").alias("a_ord"), *[F.col(c).alias(f"a_{c}") for c in "xywh"])
    b = obstacles.select("slide_id", *[F.col(c).alias(f"b_{c}") for c in "xywh"])
    return a.join(b, "slide_id").groupBy("slide_id", F.col("a_ord").alias("ord")).agg(F.sum(intersection_area(Rect("a_"), Rect("b_"))).alias("area"))


def plan_slides(briefs: DataFrame) -> DataFrame:
    """For (plan_id, brief, signals, slide_count): the slides of a plan, from fixed recipes and then details, each with its content."""
    signals = F.col("signals")
    strings = lambda values: F.array(*[F.lit(v) for v in values])
    slides = []
    for i in range(MOST_SLIDES):
        if i < len(RECIPES):
            purpose, title, visual, content, signal = RECIPES[i]
            named = text.brief_title(F.col("brief")) if title is None else F.lit(title)
            if purpose == "next_steps":
                found = F.filter(F.transform(signals, text.next_steps), lambda s: s.isNotNull())
                body = F.array(F.coalesce(F.get(found, 0), F.lit(signal[1])))
            elif isinstance(content, tuple):
                body = strings(content)
            else:
                chosen = text.round_robin(signals, F.lit(signal[0]), F.lit(signal[1]))
                body = text.split_signal(chosen, content) if content > 1 else F.array(chosen)
        else:
            purpose, visual, named = "context", "cards", F.lit(f"{DETAIL}{i - len(RECIPES) + 2}")
            body = text.split_signal(text.round_robin(signals, F.lit(i), F.lit(DETAIL_FALLBACK)), 3)
        slides.append(F.struct(F.lit(i + 1).alias("slide_no"), F.lit(purpose).alias("purpose"), named.alias("title"), F.lit(visual).alias("visual"), body.alias("content")))
    return briefs.select("plan_id", F.inline(F.slice(F.array(*slides), F.lit(1), F.col("slide_count").cast("int"))))


def publishable(jobs: DataFrame, artifacts: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """For (job, status) and verified artifacts (job, kind, intact): the next status. A job is ready with all kinds intact, and fails with any broken or missing."""
    by_job = artifacts.groupBy("job").agg(F.collect_set(F.when(F.col("intact"), F.col("kind"))).alias("kinds"), F.bool_or(~F.col("intact")).alias("broken"))
    complete = reduce(lambda a, b: a & b, [F.array_contains("kinds", F.lit(k)) for k in required])
    state = F.when(F.col("status") != "generating", F.col("status")).when(F.coalesce(F.col("broken"), F.lit(False)), "failed").when(F.coalesce(complete, F.lit(False)), "ready").otherwise("failed")
    return jobs.join(by_job, "job", "left").select("job", state.alias("status"))


def partial_outputs(jobs: DataFrame, after: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(job, path) of artifacts (job, path) to delete: those of jobs that were generating and have failed."""
    failed = jobs.filter("status = 'generating'").select("job").join(after.filter("status = 'failed'").select("job"), "job")
    return artifacts.join(failed, "job", "left_semi").select("job", "path")


MOST_PAGE_BYTES = 32_000_000


def render_errors(rendered: DataFrame) -> DataFrame:
    """For (run, variant, page, content, bytes, sha): why a stored page is not the declared one, or no whole PNG; null if it is."""
    whole = images.embedded_images(F.concat(F.lit("data:image/png;base64,"), F.regexp_replace(F.base64("content"), "[\r\n]", "")))["valid"]
    error = (
        F.when(F.octet_length("content") > MOST_PAGE_BYTES, "too_large")
        .when(F.octet_length("content") != F.col("bytes"), "size_mismatch")
        .when(F.sha2("content", 256) != F.col("sha"), "digest_mismatch")
        .when(~whole, "not_a_png")
    )
    return rendered.select("run", "variant", "page", error.alias("error"))


def image_graph_errors(assets: DataFrame, placements: DataFrame) -> DataFrame:
    """Assets (source_file, relation, sha) that are never placed, placements without an asset, and ones with other bytes."""
    keys = ["source_file", "relation"]
    joined = assets.select(*keys, F.col("sha").alias("a_sha")).join(placements.select(*keys, "element_id", F.col("sha").alias("p_sha")), keys, "full_outer")
    error = F.when(F.col("a_sha").isNull(), "placement_without_asset").when(F.col("p_sha").isNull(), "asset_never_placed").when(F.col("a_sha") != F.col("p_sha"), "placement_differs")
    return joined.select(*keys, "element_id", error.alias("error")).filter(F.col("error").isNotNull())


VARIANTS = ("compact", "balanced", "visual")
# The stages of a dry run in order, with the agents of each and the artifacts that it makes.
STAGES = (
    ("inputs", (), ("inputs",)),
    ("specialists", ("template-analyst", "evidence-analyst"), ("analysis/template-analyst", "analysis/evidence-analyst")),
    ("narrative-candidates", ("narrative-architect",), ("planning/narrative-candidate-1", "planning/narrative-candidate-2")),
    ("narrative-selection", (), ("planning/narrative-selected",)),
    ("visual-direction", ("visual-director",), ("planning/visual-director",)),
    ("variant-design", tuple(f"variant-designer-{v}" for v in VARIANTS), tuple(f"variants/{v}" for v in VARIANTS)),
    ("render-audit", (), tuple(f"render-evidence/{v}" for v in VARIANTS) + tuple(f"audits/{v}" for v in VARIANTS)),
    ("critics", ("semantic-critic", "visual-critic"), tuple(f"critiques/{v}-{c}" for v in VARIANTS for c in ("semantic", "visual"))),
    ("repair-plans", ("repair-planner",), tuple(f"repairs/{v}-round-1" for v in VARIANTS)),
    ("final-jury", ("final-jury",), ("jury/ranking",)),
)
AUDIT_STAGE, FATAL = 7, "fatal_deterministic_audit"
#: Stages whose outputs each stage reads.
READS = {"specialists": ("inputs",), "narrative-candidates": ("specialists",), "narrative-selection": ("narrative-candidates",), "visual-direction": ("specialists", "narrative-selection"), "variant-design": ("specialists", "narrative-selection", "visual-direction"), "render-audit": ("variant-design",), "critics": ("specialists", "variant-design", "render-audit"), "repair-plans": ("variant-design", "render-audit", "critics"), "final-jury": ("specialists", "variant-design", "render-audit", "critics", "repair-plans")}


def stage_trace(jobs: DataFrame) -> DataFrame:
    """For (job, audit_errors): the stages that run in order, with agents, artifacts, status and error; a fatal audit blocks its stage and ends the run."""
    strings = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<string>")
    stages = F.array(*[F.struct(F.lit(i).alias("stage_no"), F.lit(name).alias("stage"), strings(agents).alias("agents"), strings(made).alias("artifacts")) for i, (name, agents, made) in enumerate(STAGES, 1)])
    fatal = F.col("audit_errors") > 0
    blocked = fatal & (F.col("stage_no") == AUDIT_STAGE)
    ran = jobs.select("job", "audit_errors", F.inline(stages)).filter(~fatal | (F.col("stage_no") <= AUDIT_STAGE))
    return ran.select("job", "stage_no", "stage", "agents", "artifacts", F.when(blocked, "blocked").otherwise("completed").alias("status"), F.when(blocked, FATAL).alias("error"))


def stage_lineage(trace: DataFrame) -> DataFrame:
    """(job, parent, artifact): which artifacts of earlier stages each artifact of a trace is made from.

    A job has few stages, so they meet within their job: joined as rows, a side that is small by its columns' share of a file would be broadcast with all that was made of it.
    """
    reads = F.create_map(*[x for stage, parents in READS.items() for x in (F.lit(stage), F.array(*[F.lit(p) for p in parents]))])
    own = F.struct("stage", "artifacts", reads[F.col("stage")].alias("needs"))
    runs = trace.filter("job IS NOT NULL").groupBy("job").agg(F.collect_list(own).alias("ran"))
    stages = runs.select("job", "ran", F.inline("ran")).filter("needs IS NOT NULL")
    read = F.flatten(F.transform(F.filter("ran", lambda s: F.array_contains("needs", s["stage"])), lambda s: F.coalesce(s["artifacts"], F.array().cast("array<string>"))))
    made = stages.select("job", read.alias("parents"), F.explode("artifacts").alias("artifact"))
    return made.select("job", F.explode("parents").alias("parent"), "artifact")


def published(jobs: DataFrame, slides: DataFrame, audits: DataFrame, bindings: DataFrame) -> DataFrame:
    """(job, error): why a published set can't be read back, null where it can.

    jobs (job, status); slides (job, kind, ord, slide_id) of kinds 'plan', each variant and 'audit-' with each variant;
    audits (job, variant, passed); bindings (job, intact): whether ranking and trace name the saved artifacts.
    """
    kinds = ("plan", *VARIANTS, *(f"audit-{v}" for v in VARIANTS))
    ordered = slides.groupBy("job", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "slide_id"))), lambda s: s["slide_id"]).alias("ids"))
    sets = ordered.groupBy("job").pivot("kind", list(kinds)).agg(F.first("ids"))
    passed = audits.groupBy("job").agg(F.count_distinct("variant").alias("audited"), F.bool_and("passed").alias("passed"))
    bound = bindings.groupBy("job").agg(F.bool_and("intact").alias("intact"))
    joined = jobs.join(sets, "job", "left").join(passed, "job", "left").join(bound, "job", "left")
    whole = reduce(lambda x, y: x & y, [F.col(f"`{k}`").isNotNull() for k in kinds]) & (F.col("audited") == len(VARIANTS))
    same = reduce(lambda x, y: x & y, [F.col(f"`{k}`") == F.col("plan") for k in kinds[1:]])
    error = (
        F.when(F.col("status") != "ready", "not_ready")
        .when(~F.coalesce(whole, F.lit(False)) | F.col("intact").isNull(), "incomplete_set")
        .when(~F.col("passed"), "failed_audit")
        .when(~F.col("intact"), "jury_references_differ")
        .when(~same, "slides_differ_from_plan")
    )
    return joined.select("job", error.alias("error"))


def variant_reference_errors(assignments: DataFrame, claims: DataFrame, layouts: DataFrame) -> DataFrame:
    """For (variant, slide_id, layout_id, slot_id, claim_id): the first reference that doesn't hold.

    claims has (slide_id, claim_id) of the plan, layouts has layout_id.
    """
    slides = claims.select("slide_id", F.lit(True).alias("_slide")).distinct()
    known = layouts.select("layout_id", F.lit(True).alias("_layout")).distinct()
    own = claims.select("slide_id", "claim_id", F.lit(True).alias("_claim")).distinct()
    joined = assignments.join(slides, "slide_id", "left").join(known, "layout_id", "left").join(own, ["slide_id", "claim_id"], "left")
    error = (
        F.when(F.col("_slide").isNull(), "missing_variant_slide_ref")
        .when(F.col("_layout").isNull(), "missing_layout_ref")
        .when(~F.startswith("slot_id", F.concat(F.col("slide_id").cast("string"), F.lit("-"))), "invalid_layout_ref")
        .when(F.col("_claim").isNull(), "missing_claim_ref")
    )
    return joined.select("variant", "slide_id", "slot_id", "claim_id", error.alias("error"))


def layout_terms(elements: DataFrame, width: float = 960, height: float = 540) -> DataFrame:
    """Terms of a layout's score that its elements decide: the featured image, a full-bleed picture, and lines that cross text."""
    area, r = width * height, Rect()
    on_canvas = (r.x >= 0) & (r.y >= 0) & (r.right <= width) & (r.bottom <= height)
    image = (F.col("type") == "image") & on_canvas
    featured = F.least(F.lit(0.7), F.coalesce(F.max(F.when(image, r.area)), F.lit(0.0)) / area) * 500
    texts = elements.filter("type IN ('text', 'placeholder')").select("slide_id", *[F.col(c).alias(f"t_{c}") for c in "xywh"])
    lines = elements.filter(F.col("type").isin("line", "shape", "image") & (F.col("w") >= width * 0.55) & (F.col("h") <= height * 0.025)).select("slide_id", *[F.col(c).alias(f"l_{c}") for c in "xywh"])
    t, cross = Rect("t_"), Rect("l_")
    crossed = texts.join(lines, "slide_id").filter((t.y < cross.y) & (t.bottom > cross.y) & (t.x < cross.right) & (t.right > cross.x)).select("slide_id").distinct().withColumn("_crossed", F.lit(True))
    terms = elements.groupBy("slide_id").agg(featured.alias("featured_image"), F.bool_or(image & (r.area / area >= 0.5)).alias("full_bleed"))
    return terms.join(crossed, "slide_id", "left").select("slide_id", "featured_image", "full_bleed", F.when(F.col("_crossed"), -40_000).otherwise(0).cast("long").alias("line_interference"))


def first_fit(slides: DataFrame, obstacles: DataFrame, widths: tuple[float, ...], starts: tuple[float, ...], tops: tuple[float, ...], height: float, canvas: float = 960) -> DataFrame:
    """For each slide the first of width, start and top, tried in this order, whose box keeps clear of all obstacles; no row where none does."""
    numbered = lambda values, name: F.posexplode(F.array(*[F.lit(float(v)) for v in values])).alias(f"{name}_no", name)
    boxes = obstacles.groupBy("slide_id").agg(F.collect_list(F.struct(*"xywh")).alias("taken"))
    tried = slides.select("slide_id").distinct().join(boxes, "slide_id", "left").select("*", numbered(widths, "width")).select("*", numbered(starts, "start")).select("*", numbered(tops, "top"))
    clear = ~F.exists("taken", lambda e: (e["x"] < F.col("start") + F.col("width")) & (e["x"] + e["w"] > F.col("start")) & (e["y"] < F.col("top") + height) & (e["y"] + e["h"] > F.col("top")))
    fits = (F.col("start") + F.col("width") <= canvas) & F.coalesce(clear, F.lit(True))
    first = F.min(F.struct("width_no", "start_no", "top_no", "width", "start", "top"))
    return tried.filter(fits).groupBy("slide_id").agg(first.alias("f")).select("slide_id", "f.width", "f.start", "f.top")
