"""Table grids and pages: rulings, line centres, cells, gates and side-by-side pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.language import script_of
from textloom.operators.layout import BEHAVIOUR

# Thin rectangles, shortest rulings, tolerances, render modes that leave text invisible.
THIN, SHORTEST = 1.25, 2.0
CENTRE_SHARE, LEAST_CENTRE = 0.55, 1.5
CELL_MARGIN, CELL_REACH, LABEL_LINES = 1.5, 2.0, 4
INVISIBLE_MODES = (3, 7)
SCAN_COVERAGE = 0.5
CID = r"\(cid:\d+\)"


def rulings(items: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, direction, x1, y1, x2, y2) of drawn items (O-133): ``shape`` rect or line, fill, stroke, width, and the
    corners x1, y1, x2, y2. A thin filled rectangle is one ruling; else each stroked edge that is straight and
    long enough is one."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    ruling = lambda d, *c: F.struct(F.lit(d).alias("direction"), *[v.cast("double").alias(n) for v, n in zip(c, ("x1", "y1", "x2", "y2"))])
    w, h, mx, my = x2 - x1, y2 - y1, (x1 + x2) / 2, (y1 + y2) / 2
    solid = (F.col("shape") == "rect") & F.col("fill") & (w > 0) & (h > 0)
    thin = F.when(solid & (h <= THIN) & (w >= SHORTEST), ruling("h", x1, my, x2, my)).when(solid & (w <= THIN) & (h >= SHORTEST), ruling("v", mx, y1, mx, y2))
    near, long = F.greatest(F.lit(0.75), F.col("width") * 2), F.greatest(F.lit(SHORTEST), F.col("width") * 3)

    def edge(a: Column, b: Column, c: Column, d: Column) -> Column:
        across, along = F.abs(d - b), F.abs(c - a)
        flat = ruling("h", F.least(a, c), (b + d) / 2, F.greatest(a, c), (b + d) / 2)
        steep = ruling("v", (a + c) / 2, F.least(b, d), (a + c) / 2, F.greatest(b, d))
        return F.when((across <= near) & (along >= long), flat).when((along <= near) & (across >= long), steep)

    around = F.array(edge(x1, y1, x2, y1), edge(x2, y1, x2, y2), edge(x2, y2, x1, y2), edge(x1, y2, x1, y1))
    edges = F.when(F.col("shape") == "rect", around).otherwise(F.array(edge(x1, y1, x2, y2)))
    found = F.when(thin.isNotNull(), F.array(thin)).when(F.col("stroke"), edges)
    return items.select(*keys, F.explode(found).alias("r")).where("r IS NOT NULL").select(*keys, "r.*")


def line_centres(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, centres): the mean centre of each line of a group's spans (cy, size) from below (O-130). A centre joins the
    line while it is near the mean of the line so far."""
    rows = spans.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.col("cy").cast("double"))).alias("cys"),
        F.greatest(F.median("size") * CENTRE_SHARE, F.lit(LEAST_CENTRE)).alias("tolerance"),
    )
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.expr("cast(array() as array<double>)").alias("done"))

    def step(s: Column, c: Column) -> Column:
        joins = (s["n"] > 0) & (F.abs(c - s["sum"] / s["n"]) <= F.col("tolerance"))
        closes = (s["n"] > 0) & ~joins
        return F.struct(
            F.when(joins, s["sum"] + c).otherwise(c).alias("sum"),
            F.when(joins, s["n"] + 1).otherwise(1).alias("n"),
            F.when(closes, F.array_append(s["done"], s["sum"] / s["n"])).otherwise(s["done"]).alias("done"),
        )

    last = lambda s: F.when(s["n"] > 0, F.array_append(s["done"], s["sum"] / s["n"])).otherwise(s["done"])
    return rows.select(*keys, F.aggregate("cys", start, step, last).alias("centres"))


def unreliable_cells(spans: DataFrame, page: str, lines: DataFrame) -> DataFrame:
    """(page, cell corners) of cells that are likely no cells (O-136): of two spans and more on four lines and more, with
    no horizontal ruling inside that goes from side to side. Spans have cell corners c_x1 .. c_y2, cy, size."""
    cell = [page, "c_x1", "c_y1", "c_x2", "c_y2"]
    many = spans.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    tall = line_centres(spans.join(many, cell, "left_semi"), cell).where(F.size("centres") >= LABEL_LINES).select(*cell)
    flat = lines.where("direction = 'h'").select(F.col(page).alias("__page"), F.col("x1").alias("l"), F.col("x2").alias("r"), F.col("y1").alias("y"))
    inside = (
        (F.col(page) == F.col("__page"))
        & (F.col("y") > F.col("c_y1") + CELL_MARGIN)
        & (F.col("y") < F.col("c_y2") - CELL_MARGIN)
        & (F.col("l") <= F.col("c_x1") + CELL_REACH)
        & (F.col("r") >= F.col("c_x2") - CELL_REACH)
    )
    return tall.join(flat, inside, "left_anti")


def compact_cells(spans: DataFrame, keys: list[str], height: str) -> DataFrame:
    """(keys, compact): whether a group of spans fits its cell's height and hangs together (O-146)."""
    cy = (F.col("y1") + F.col("y2")) / 2
    w = Window.partitionBy(*keys).orderBy("__cy")
    rows = spans.withColumn("__cy", cy).withColumn("__gap", F.col("__cy") - F.lag("__cy").over(w))
    found = rows.groupBy(*keys).agg(
        F.max(height).alias("h"),
        (F.max("y2") - F.min("y1")).alias("band"),
        F.coalesce(F.median(F.when(F.col("size") > 0, F.col("size"))), F.lit(10.0)).alias("font"),
        F.max("__gap").alias("gap"),
    )
    fits = (F.col("h") > 0) & (F.col("h") <= F.greatest(F.greatest(F.col("band"), F.lit(0.0)) * 3, F.col("font") * 5))
    near = F.coalesce(F.col("gap") <= F.greatest(F.col("font") * 2.8, F.lit(18.0)), F.lit(True))
    return found.select(*keys, (fits & near).alias("compact"))


def preserve_blocks(spans: DataFrame, page: str, block: str) -> DataFrame:
    """(page, block, preserved, number): blocks that stay as they are (O-142), and the numbers from 0 of the others on
    their page. Spans have label, text, visible, transparent, mode and kept."""
    table = F.create_map(*[F.lit(x) for pair in BEHAVIOUR.items() for x in pair])
    hidden = ~F.col("visible") | F.col("transparent") | F.col("mode").isin(*INVISIBLE_MODES)
    rows = spans.groupBy(page, block).agg(
        F.bool_or(F.col("text").rlike(CID)).alias("cid"),
        F.bool_or(F.coalesce(F.try_element_at(table, "label"), F.lit("layout")) == "preserve").alias("label"),
        F.bool_or(hidden).alias("hidden"),
        F.bool_and("kept").alias("kept"),
    )
    rows = rows.select(page, block, (F.col("cid") | F.col("label") | F.col("hidden") | F.col("kept")).alias("preserved"))
    w = Window.partitionBy(page, "preserved").orderBy(block)
    return rows.withColumn("number", F.when(~F.col("preserved"), F.row_number().over(w) - 1).cast("long"))


def scan_gate(spans: DataFrame, coverage: DataFrame, doc: str, page: str) -> DataFrame:
    """(doc, error): documents without a usable text layer (O-143), else null. A page mostly covered by images (``cover``)
    must have visible text and no invisible one; a document needs visible text at all."""
    shown = F.coalesce(F.trim("text") != "", F.lit(False))
    visible = F.col("visible") & ~F.col("mode").isin(*INVISIBLE_MODES)
    pages = spans.groupBy(doc, page).agg(F.bool_or(shown & visible).alias("seen"), F.bool_or(shown & ~visible).alias("unseen"))
    rows = coverage.join(pages, [doc, page], "left").fillna(False, ["seen", "unseen"])
    bad = (F.col("cover") >= SCAN_COVERAGE) & (~F.col("seen") | F.col("unseen"))
    found = rows.groupBy(doc).agg(F.bool_or(bad).alias("bad"), F.bool_or("seen").alias("any"))
    return found.select(doc, F.when(F.col("bad") | ~F.col("any"), "pdf_no_text_layer").alias("error"))


def side_by_side(left: DataFrame, right: DataFrame, doc: str, gutter: float) -> DataFrame:
    """(doc, page, width, height, left_y, right_x, right_y, error): a page with the source left and the translation right,
    each centred in height (O-157). Documents whose page counts differ, or without pages, have an error."""
    pages = left.select(doc, "page", F.col("width").alias("w1"), F.col("height").alias("h1")).join(
        right.select(doc, "page", F.col("width").alias("w2"), F.col("height").alias("h2")), [doc, "page"], "full"
    )
    odd = F.max(F.col("w1").isNull() | F.col("w2").isNull()).over(Window.partitionBy(doc))
    height = F.greatest("h1", "h2")
    fine = lambda c: F.when(F.col("error").isNull(), c)
    return pages.withColumn("error", F.when(odd, "pdf_bilingual_page_count_mismatch")).select(
        doc,
        "page",
        fine(F.col("w1") + gutter + F.col("w2")).alias("width"),
        fine(height).alias("height"),
        fine((height - F.col("h1")) / 2).alias("left_y"),
        fine(F.col("w1") + gutter).alias("right_x"),
        fine((height - F.col("h2")) / 2).alias("right_y"),
        "error",
    )


def translated_spans(spans: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, span_id, text): spans with their translations (O-150). A block with one answer for all (``marker`` null)
    has it in its first span that is not kept, and nothing in the others; else each span has its own answer, where
    one came, and a block of one span takes either. Kept spans and spans without an answer have null."""
    own = answers.where("marker IS NOT NULL").select(*keys, F.col("marker").alias("span_id"), F.col("text").alias("own"))
    whole = answers.where("marker IS NULL").groupBy(*keys).agg(F.max("text").alias("whole"))
    order = Window.partitionBy(*keys, "kept").orderBy("span_id")
    rows = spans.withColumn("place", F.row_number().over(order)).join(own, [*keys, "span_id"], "left").join(whole, keys, "left")
    spread = F.when(F.col("place") == 1, F.col("whole")).otherwise(F.when(F.col("whole").isNotNull(), F.lit("")))
    return rows.select(*keys, "span_id", F.when(~F.col("kept"), F.coalesce("own", spread)).alias("text"))


def characters(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, script, characters): the distinct visible characters of each script, sorted (O-155). Each text is reduced to
    its own distinct characters before anything is shuffled."""
    char = df.select(*keys, F.explode(F.array_distinct(F.split(text, ""))).alias("c")).where(~F.col("c").rlike(r"^[\x00-\x20]?$")).distinct()
    rows = char.withColumn("script", script_of(F.col("c")))
    return rows.groupBy(*keys, "script").agg(F.array_join(F.array_sort(F.collect_list("c")), "").alias("characters"))
