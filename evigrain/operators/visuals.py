"""Tables, charts and diagrams from spreadsheet facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigrain.functions.geometry import Rect, overlaps
from evigrain.operators.rank import numbered

MOST_NODES, MOST_EDGES, LONGEST_LABEL = 12, 24, 160


def grid_tables(facts: DataFrame) -> DataFrame:
    """Complete two-row grids of (source_id, row_no, col_no, value_type, text): a text header, and in the two rows below a text label and a number.

    The header stands at (r, c + 1), labels at (r + 1..2, c) and values at (r + 1..2, c + 1). One equi-join a cell.
    """
    at = lambda prefix, down, right, kind: facts.filter(F.col("value_type") == kind).select("source_id", (F.col("row_no") - down).alias("row_no"), (F.col("col_no") - right).alias("col_no"), F.col("text").alias(prefix))
    keys = ["source_id", "row_no", "col_no"]
    found = at("header", 0, 1, "string")
    for prefix, down, right, kind in (("label_1", 1, 0, "string"), ("label_2", 2, 0, "string"), ("value_1", 1, 1, "number"), ("value_2", 2, 1, "number")):
        found = found.join(at(prefix, down, right, kind), keys)
    return found


def first_free_slot(elements: DataFrame, w: float, h: float, width: float = 960, height: float = 540, step: int = 20) -> DataFrame:
    """The first place, by rows, where a box of w by h overlaps none of a slide's elements; no row where there is none."""
    xs = F.sequence(F.lit(step), F.lit(int(width - step - w)), F.lit(step))
    ys = F.sequence(F.lit(step), F.lit(int(height - step - h)), F.lit(step))
    boxes = F.collect_list(F.struct("x", "y", "w", "h"))
    free = lambda x, y, taken: ~F.exists(taken, lambda e: (e["x"] < x + w) & (e["x"] + e["w"] > x) & (e["y"] < y + h) & (e["y"] + e["h"] > y))
    slides = elements.groupBy("slide_id").agg(boxes.alias("taken"))
    places = slides.select("slide_id", "taken", F.explode(ys).alias("slot_y")).select("slide_id", "taken", "slot_y", F.explode(xs).alias("slot_x"))
    return places.filter(free(F.col("slot_x"), F.col("slot_y"), F.col("taken"))).groupBy("slide_id").agg(F.min(F.struct("slot_y", "slot_x")).alias("slot")).select("slide_id", "slot.slot_y", "slot.slot_x")


def relation_edges(cells: DataFrame) -> DataFrame:
    """Edges of tables (source_id, row_no, source, target, relationship): tables with an incomplete row, a self-loop or a label too long give none."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    present = cells.filter(~(blank("source") & blank("target") & blank("relationship")))
    bad = blank("source") | blank("target") | (F.col("source") == F.col("target")) | (F.char_length("source") > LONGEST_LABEL) | (F.char_length("target") > LONGEST_LABEL)
    void = present.filter(F.coalesce(bad, F.lit(True))).select("source_id").distinct()
    return present.join(void, "source_id", "left_anti").select("source_id", "row_no", "source", "target", F.when(~blank("relationship"), F.col("relationship")).alias("relationship"))


def nodes_of(edges: DataFrame) -> DataFrame:
    """Distinct node labels of each table, numbered from 1 in order of first appearance."""
    ends = edges.select("source_id", (F.col("row_no") * 2).alias("place"), F.col("source").alias("label")).unionByName(edges.select("source_id", (F.col("row_no") * 2 + 1).alias("place"), F.col("target").alias("label")))
    first = ends.groupBy("source_id", "label").agg(F.min("place").alias("first"))
    return numbered(first, ["source_id"], [F.col("first")], "node_no").select("source_id", "label", "node_no")


def diagram_errors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Diagrams with a repeated node id, an edge to an unknown node, or too many of either; null error where fine."""
    repeated = nodes.groupBy("diagram", "node_id").agg(F.count("*").alias("n")).groupBy("diagram").agg((F.max("n") > 1).alias("repeated"), F.sum("n").alias("nodes"))
    ends = edges.select("diagram", F.explode(F.array("from_id", "to_id")).alias("node_id"))
    dangling = ends.join(nodes, ["diagram", "node_id"], "left_anti").select("diagram").distinct().withColumn("dangling", F.lit(True))
    counted = edges.groupBy("diagram").agg(F.count("*").alias("edges"))
    joined = repeated.join(dangling, "diagram", "left").join(counted, "diagram", "left")
    error = F.when(F.col("repeated"), "duplicate_node_id").when(F.col("dangling"), "unknown_node_id").when((F.col("nodes") > MOST_NODES) | (F.coalesce("edges", F.lit(0)) > MOST_EDGES), "too_large")
    return joined.select("diagram", error.alias("error"))


def grid_places(nodes: DataFrame, cell_w: float, cell_h: float) -> DataFrame:
    """Nodes on a square grid, by number: column and row, and the box's corner."""
    sides = nodes.groupBy("source_id").agg(F.ceil(F.sqrt(F.count("*"))).cast("int").alias("_side"))
    placed = nodes.join(sides, "source_id").withColumn("grid_col", F.pmod(F.col("node_no") - 1, F.col("_side"))).withColumn("grid_row", F.floor((F.col("node_no") - 1) / F.col("_side")))
    return placed.withColumn("x", F.col("grid_col") * cell_w).withColumn("y", F.col("grid_row") * cell_h).drop("_side")


def closure(edges: DataFrame, parent: str, child: str, most_rounds: int = 32) -> DataFrame:
    """(ancestor, descendant) of an acyclic parent table, doubling the reach of paths in each round.

    The result has a row for each ancestor of each node, so a graph should be small: those of one run have 256 artifacts
    at most. Any number of graphs is closed at once. Each round is written to the shared folder. Cycles end after
    most_rounds rounds.
    """
    from evigrain.runtime import discard, stored

    spark = edges.sparkSession
    now = stored(edges.select(F.col(parent).alias("ancestor"), F.col(child).alias("descendant")).distinct(), "closure")
    size = now.df.count()
    for _ in range(most_rounds):
        onward = now.df.select(F.col("ancestor").alias("descendant"), F.col("descendant").alias("_next"))
        longer = now.df.join(onward, "descendant").select("ancestor", F.col("_next").alias("descendant"))
        after = stored(now.df.unionByName(longer).distinct(), "closure")
        discard(spark, now.path)
        now, before, size = after, size, after.df.count()
        if size == before:
            break
    return now.df


def lineage_errors(records: DataFrame) -> DataFrame:
    """For (artifact_id, ord, parents): repeated ids, own or unknown parents, and parents that come later."""
    repeated = F.count("*").over(Window.partitionBy("artifact_id")) > 1
    marked = records.withColumn("repeated", repeated)
    known = records.groupBy(F.col("artifact_id").alias("parent")).agg(F.min("ord").alias("parent_ord"))
    linked = marked.select("artifact_id", "ord", "repeated", F.explode_outer("parents").alias("parent")).join(known, "parent", "left")
    error = (
        F.when(F.col("repeated"), "duplicate_artifact_id")
        .when(F.col("parent") == F.col("artifact_id"), "self_parent")
        .when(F.col("parent").isNotNull() & F.col("parent_ord").isNull(), "unknown_parent")
        .when(F.col("parent_ord") >= F.col("ord"), "parent_not_before_child")
    )
    return linked.groupBy("artifact_id", "ord").agg(F.min(error).alias("error"))


def pie_sectors(values: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Start and end angles of positive values, from the top; the last one closes the circle."""
    start, full = -1.5707963267948966, 6.283185307179586
    within = Window.partitionBy(group)
    upto = F.sum(value).over(within.orderBy(order))
    total, last = F.sum(value).over(within), F.max(F.when(F.col(value) > 0, F.col(order))).over(within)
    angle = lambda part: start + part / total * full
    return values.withColumn("start_angle", angle(upto - F.col(value))).withColumn("end_angle", F.when(F.col(order) == last, start + full).otherwise(angle(upto))).filter(F.col(value) > 0)


def bars(values: DataFrame, group: str, value: str, height: float) -> DataFrame:
    """Each value's bar between the baseline at zero and its end, scaled to the group's range with zero in it."""
    within = Window.partitionBy(group)
    low, high = F.least(F.lit(0.0), F.min(value).over(within)), F.greatest(F.lit(0.0), F.max(value).over(within))
    span = F.when(high == low, F.lit(1.0)).otherwise(high - low)
    ranged = values.withColumn("low", low).withColumn("high", high).withColumn("baseline", height * high / span)
    return ranged.withColumn("bar_top", F.least(height * (high - F.col(value)) / span, F.col("baseline"))).withColumn("bar_height", height * F.abs(F.col(value)) / span)


def line_segments(points: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Segments from each point to the next of its group."""
    onward = Window.partitionBy(group).orderBy(order)
    return points.withColumn("next_value", F.lead(value).over(onward)).withColumn("next_order", F.lead(order).over(onward)).filter(F.col("next_order").isNotNull())


def table_matrix(cells: DataFrame, group: str, row: str, column: str, value: str) -> DataFrame:
    """Values of each row as one array, in column order."""
    return cells.groupBy(group, row).agg(F.transform(F.array_sort(F.collect_list(F.struct(column, value))), lambda c: c[value]).alias("cells"))


def occupied(elements: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Elements that overlap a box."""
    x, y, w, h = box
    fixed = elements.withColumns({"_x": F.lit(float(x)), "_y": F.lit(float(y)), "_w": F.lit(float(w)), "_h": F.lit(float(h))})
    return fixed.filter(overlaps(Rect(), Rect("_"))).select(*elements.columns)
