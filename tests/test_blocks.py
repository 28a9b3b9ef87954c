"""Block modes, stray fragments, tagged blocks, cells and columns on literal pages."""

import pytest
from pyspark.sql import functions as F

from textloom.operators import blocks, chunks, grids

SPAN = "page long, block long, place long, span_id long, x1 double, y1 double, x2 double, y2 double, text string, size double, textbox long, kept boolean, label string, source string"


def spans(spark, rows, page=0, **more):
    """Rows: (block, span_id, x1, y1, x2, y2, text, and what differs from size 10, no box, label text)."""
    full = []
    for place, (block, span_id, x1, y1, x2, y2, text, *other) in enumerate(rows):
        own = {"size": 10.0, "textbox": None, "kept": False, "label": "text"} | more | (other[0] if other else {})
        full.append((page, block, place, span_id, float(x1), float(y1), float(x2), float(y2), text, own["size"], own["textbox"], own["kept"], own["label"], "text"))
    return spark.createDataFrame(full, SPAN)


def mode(spark, rows, box, profile="balanced", **more):
    df = spans(spark, rows, **more).withColumns({"bx1": F.lit(float(box[0])), "bx2": F.lit(float(box[1]))})
    return blocks.block_modes(df, ["page", "block"], profile).first()["mode"]


THREE = [(0, i, 0, 80 - 20 * i, 180, 90 - 20 * i, t) for i, t in enumerate(("Line one", "Line two", "Line three"))]


@pytest.mark.parametrize(
    "rows, box, more, expected",
    [
        (THREE, (0, 200), {}, "block"),
        ([(0, 0, 0, 80, 30, 90, "1"), (0, 1, 80, 60, 110, 70, "2"), (0, 2, 150, 40, 180, 50, "3")], (0, 200), {}, "span"),
        (THREE[:1], (0, 200), {}, "span"),
        (THREE, (0, 200), {"label": "table"}, "span"),
        ([(0, 0, 0, 80, 30, 90, "1"), (0, 1, 80, 60, 110, 70, "2")], (0, 200), {"label": "reference"}, "block"),
        ([(*r[:6], r[6], {"size": 20.0 if r[1] == 1 else 10.0}) for r in THREE], (0, 200), {}, "span"),
        ([(0, 0, 0, 80, 180, 90, "[Pos. #1] first line"), (0, 1, 0, 68, 60, 78, "rest")], (0, 180), {}, "block"),
        ([(0, 0, 0, 80, 100, 90, "short lines of"), (0, 1, 60, 68, 120, 78, "one box here")], (0, 180), {"textbox": 5}, "block"),
        ([(0, 0, 0, 80, 100, 90, "short lines of"), (0, 1, 60, 68, 120, 78, "one box here")], (0, 180), {}, "span"),
        ([(0, i, x, 90 - 12 * i, x + 100, 100 - 12 * i, "two columns") for i, x in enumerate((0, 0, 90, 90))], (0, 190), {"label": "doc_title"}, "span"),
        (
            [
                (0, 0, 70.9, 119.1, 479.7, 133.4, "the decoder iteratively refines N object queries Q = {qi}N"),
                (0, 1, 474.5, 115.9, 485.4, 125.4, "i=1", {"size": 7.0}),
                (0, 2, 489.2, 119.1, 526.3, 133.4, "∈ R_N×d."),
                (0, 3, 70.5, 105.6, 524.6, 116.5, "The reading order is then derived from the refined query embeddings."),
                (0, 4, 70.9, 92.0, 252.2, 102.9, "through a Global Pointer Mechanism."),
            ],
            (70.5, 526.3),
            {},
            "block",
        ),
    ],
)
def test_block_modes(spark, rows, box, more, expected):
    assert mode(spark, rows, box, **more) == expected


def test_profiles_differ(spark):
    two = THREE[:2]
    assert mode(spark, two, (0, 200)) == "block" and mode(spark, two, (0, 200), "conservative") == "span"
    narrow = [(0, i, 0, 80 - 20 * i, 100, 90 - 20 * i, "half as wide as the block") for i in range(3)]
    assert mode(spark, narrow, (0, 200)) == "span" and mode(spark, narrow, (0, 200), "aggressive") == "block"
    assert mode(spark, narrow, (0, 200), label="doc_title") == "block"


def merged(spark, rows, **more):
    return {(r.block, r.span_id): r.into for r in blocks.merge_orphans(spans(spark, rows, **more), "page").collect()}


NOTE = [
    (0, 0, 316.85, 228.88, 502.05, 238.91, "[Pos. #1] Human intelligence is not general"),
    (0, 1, 316.85, 216.92, 381.22, 226.88, "meaningful way"),
    (1, 2, 506.0, 228.88, 532.38, 238.84, "in any"),
]


def test_a_fragment_joins_the_block_left_of_it(spark):
    assert merged(spark, NOTE) == {(0, 0): 0, (0, 1): 0, (1, 2): 0}
    after = [*NOTE, (2, 3, 536.0, 228.88, 550.0, 238.84, "at all")]
    assert merged(spark, after)[2, 3] == 0  # the block has grown to the first fragment


def test_fragments_that_stay(spark):
    cells = [(0, 0, 121, 220, 250, 229, "D950 OG HR LOOSE STRAIGHT"), (0, 1, 121, 207, 218, 216, "FL 000724448 Adopted"), (1, 2, 255, 220, 315, 229, "label")]
    assert merged(spark, cells, label="table")[1, 2] == 1
    for change in ({"size": 14.0}, {"kept": True}, {"label": "header"}):
        assert merged(spark, [*NOTE[:2], (*NOTE[2], change)])[1, 2] == 1, change
    assert merged(spark, [*NOTE[:2], (1, 2, 506.0, 228.88, 632.38, 238.84, "far longer than a fragment")])[1, 2] == 1
    assert merged(spark, [*NOTE[:2], (1, 2, 516.0, 228.88, 532.38, 238.84, "in any")])[1, 2] == 1
    assert merged(spark, [*NOTE[:2], (1, 2, 506.0, 240.0, 532.38, 250.0, "in any")])[1, 2] == 1


def tagged(spark, rows, mode="span", cells=None, **more):
    cells = cells or {}
    df = spans(spark, rows, **more).withColumn("mode", F.lit(mode))
    corner = [F.lit(None).cast("double")] * 4
    for (block, span_id), cell in cells.items():
        here = (F.col("block") == block) & (F.col("span_id") == span_id)
        corner = [F.when(here, float(v)).otherwise(c) for v, c in zip(cell, corner)]
    return blocks.tagged_blocks(df.withColumns(dict(zip(("c_x1", "c_y1", "c_x2", "c_y2"), corner))), "page")


def listed(df):
    return [(r.number, r.plain, [(s.text, s.block, s.span_id) for s in r.spans]) for r in df.orderBy("number").collect()]


def test_references_keep_their_lines(spark):
    rows = [(0, 0, 0, 40, 200, 50, "Author one"), (0, 1, 0, 20, 200, 30, "Author two")]
    assert listed(tagged(spark, rows, "block", label="reference_content")) == [(0, "Author one\nAuthor two", [])]
    assert listed(tagged(spark, rows, "block")) == [(0, "Author one Author two", [])]


def test_paragraphs_with_lists_keep_their_lines(spark):
    rows = [(0, 0, 0, 40, 200, 50, "1. one"), (0, 1, 0, 20, 200, 30, "2. two"), (1, 2, 0, 10, 200, 15, "no"), (1, 3, 0, 0, 200, 5, "list")]
    found = {r.block: r.text for r in blocks.paragraphs(spans(spark, rows), ["page", "block"]).collect()}
    assert found == {0: "1. one\n2. two", 1: "no list"}


def test_tables_go_by_cell(spark):
    one, two = (200, 40, 500, 60), (200, 20, 500, 40)
    rows = [(7, 0, 205, 52, 480, 58, "row1 line1"), (7, 1, 205, 43, 350, 49, "row1 line2"), (7, 2, 205, 32, 480, 38, "row2 line1"), (7, 3, 205, 23, 350, 29, "row2 line2")]
    df = tagged(spark, rows, cells={(7, 0): one, (7, 1): one, (7, 2): two, (7, 3): two}, label="table")
    assert listed(df) == [(0, None, [("row1 line1", 7, 0), ("row1 line2", 7, 1)]), (1, None, [("row2 line1", 7, 2), ("row2 line2", 7, 3)])]
    loose = [(3, 0, 0, 20, 80, 30, "left"), (3, 1, 100, 20, 180, 30, "right")]
    assert listed(tagged(spark, loose, label="table")) == [(0, None, [("left", 3, 0)]), (1, None, [("right", 3, 1)])]
    assert listed(tagged(spark, loose)) == [(0, None, [("left", 3, 0), ("right", 3, 1)])]
    assert listed(tagged(spark, loose, label="chart")) == [(0, None, [("left", 3, 0)]), (1, None, [("right", 3, 1)])]


def test_a_kept_span_ends_a_run(spark):
    cell = (0, 0, 200, 40)
    rows = [(3, i, 0, 30 - i, 80, 38 - i, t, {"kept": t == "kept"}) for i, t in enumerate(("a", "kept", "b", "(cid:3)", "c", "d"))]
    df = tagged(spark, rows, cells={(3, i): cell for i in range(6)}, label="table")
    assert [[s[0] for s in r[2]] for r in listed(df)] == [["a"], ["b"], ["c", "d"]]
    assert [[s[0] for s in r[2]] for r in listed(tagged(spark, rows))] == [["a", "b", "c", "d"]]


def test_a_cell_over_two_blocks_is_one_text(spark):
    cell = (90, 720, 250, 750)
    rows = [(10, 0, 94, 740, 238, 748, "销售商品、提供劳务收到的"), (11, 0, 94, 726, 118, 734, "现金")]
    df = tagged(spark, rows, cells={(10, 0): cell, (11, 0): cell}, label="table")
    assert listed(df) == [(0, "销售商品、提供劳务收到的现金", [("销售商品、提供劳务收到的", 10, 0), ("现金", 11, 0)])]
    shown = chunks.rendered(df.select(F.lit(0).alias("doc"), "page", F.col("number").alias("block"), "plain", "spans"), "doc")
    assert shown.first()["text"] == "[PAGE_0]\n[BLOCK_0]销售商品、提供劳务收到的现金"


def test_a_tall_cell_is_not_one_text(spark):
    cell = (15, 35, 776, 402)
    rows = [
        (10, 0, 19, 388, 95, 397, "Deborah McMullen", {"size": 9.0}), (10, 1, 19, 370, 468, 383, "1. Please help to add back POM P47", {"size": 13.0}),
        (11, 0, 19, 316, 95, 325, "Deborah McMullen", {"size": 9.0}), (11, 1, 19, 298, 185, 311, "1. POM P47 has been added", {"size": 13.0}),
    ]
    df = tagged(spark, rows, cells={(b, s): cell for b in (10, 11) for s in (0, 1)}, label="table")
    assert [(r[1], [s[1] for s in r[2]]) for r in listed(df)] == [(None, [10, 10]), (None, [11, 11])]


def rulings(spark, vertical, flat):
    rows = [(0, "v", float(x), float(a), float(x), float(b)) for x, a, b in vertical] + [(0, "h", float(a), float(y), float(b), float(y)) for y, a, b in flat]
    return spark.createDataFrame(rows, "page long, direction string, x1 double, y1 double, x2 double, y2 double")


def cell(spark, box, table, vertical, flat, size=None):
    df = spark.createDataFrame([(0, 0, *map(float, box), size, *map(float, table))], "page long, span_id long, x1 double, y1 double, x2 double, y2 double, size double, t_x1 double, t_y1 double, t_x2 double, t_y2 double")
    return grids.cell_boxes(df, rulings(spark, vertical, flat), "page").first()["cell"]


WALLS = [(0, 0, 100), (100, 0, 100), (200, 0, 100)]
FLOORS = [(0, 0, 200), (40, 0, 200), (70, 0, 200), (100, 0, 200)]


def test_the_cell_of_a_span(spark):
    assert tuple(cell(spark, (120, 50, 180, 60), (0, 0, 200, 100), WALLS, FLOORS)) == pytest.approx((102, 41, 198, 69))
    assert cell(spark, (120, 50, 180, 60), (0, 0, 200, 100), WALLS[1:2], FLOORS) is None
    assert cell(spark, (20, 50, 80, 60), (0, 0, 200, 100), [WALLS[0], WALLS[2]], FLOORS) is None
    short = [(40, 0, 150), *FLOORS[2:3]]  # a ruling that ends inside the column bounds no cell
    assert cell(spark, (120, 50, 180, 60), (0, 0, 200, 100), WALLS, short) is None
    many = [(x, 0, 100) for x in (0, 80, 100, 120, 140, 160, 180, 200)]
    assert cell(spark, (10, 50, 190, 60), (0, 0, 200, 100), many, FLOORS[1:3], 8.0) is None


def letters(text, x, y, step=5):
    return [(c, float(x + step * i), float(y), float(x + step * i + 4), float(y + 10)) for i, c in enumerate(text)]


def parts(spark, chars, vertical, table=(0, 0, 120, 100)):
    kind = "page long, span_id long, x1 double, y1 double, x2 double, y2 double, size double, t_x1 double, t_y1 double, t_x2 double, t_y2 double, chars array<struct<char:string,x1:double,y1:double,x2:double,y2:double>>"
    df = spark.createDataFrame([(0, 0, 10.0, 50.0, 116.0, 60.0, 8.0, *map(float, table), chars)], kind)
    flat = [(40, 0, 120), (70, 0, 120)]
    return grids.grid_split(df, rulings(spark, vertical, flat), "page").orderBy("part").collect()


def test_a_span_is_split_at_columns(spark):
    chars = letters("Mine", 10, 50) + letters("Method", 40, 50) + letters("2000", 82, 50, 4) + letters("2001", 102, 50, 4)
    got = parts(spark, chars, [(x, 0, 100) for x in (0, 80, 100, 120)])
    assert [(r.part, r.text, r.kept) for r in got] == [(0, "Mine Method", False), (1, "2000", True), (2, "2001", True)]
    assert (got[0].cell.x1, got[0].cell.x2) == pytest.approx((2.0, 78.0)) and got[1].x1 == 82.0
    assert parts(spark, letters("Mine", 10, 50), [(x, 0, 100) for x in (0, 80, 100, 120)]) == []
    off = letters("Mine", 10, 50) + letters("2000", 82, 20, 4)  # half of the characters have no cell
    assert parts(spark, off, [(x, 0, 100) for x in (0, 80, 100, 120)]) == []


def plain_merge(rows):
    """The block of each span of one page, with everything looked at anew for every fragment."""
    made = {}
    for r in rows:
        made.setdefault(r.block, []).append(r)
    kept = []
    for block, own in sorted(made.items(), key=lambda b: (-round(max(r.y2 for r in b[1]), 2), round(min(r.x1 for r in b[1]), 2), b[0])):
        target = None
        if len(own) == 1 and own[0].label != "table" and not own[0].kept and 0 < len(own[0].text.strip()) <= 24:
            one = own[0]
            for held in reversed(kept):
                first, all_ = held[0], [s for b in held for s in made[b]]
                right, sizes = max(s.x2 for s in all_), sorted(s.size for s in all_)
                middle = (sizes[(len(sizes) - 1) // 2] + sizes[len(sizes) // 2]) / 2
                ys = blocks.line_means([(s.x1, s.y1, s.x2, s.y2, s.size, s.text) for s in all_])
                near = min(abs(y - (one.y1 + one.y2) / 2) for y in ys) <= max(2.5, one.size * 0.6)
                if made[first][0].label == one.label and right <= one.x1 and one.x1 - right <= max(6.0, one.size * 0.9) and near and abs(middle - one.size) <= max(1.5, middle * 0.25):
                    target = held
                    break
        if target is None:
            kept.append([block])
        else:
            target.append(block)
    return {(r.block, r.span_id): held[0] for held in kept for b in held for r in made[b]}


def test_orphans_meet_the_plain_version(spark):
    from textloom.plans import block_plans

    made = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").where("l_orderkey < 400")
    rows = made.selectExpr(*block_plans._ITEM).selectExpr(*block_plans._ORPHAN).cache()
    got = blocks.merge_orphans(rows, "page").collect()
    pages = {}
    for r in rows.collect():
        pages.setdefault(r.page, []).append(r)
    expected = {p: plain_merge(own) for p, own in pages.items()}
    assert all(expected[r.page][r.block, r.span_id] == r.into for r in got) and len(got) == rows.count()
    assert sum(r.block != r.into for r in got) > 50


def test_orphans_cost_no_group_for_each_page(spark):
    """Pages that end inside a batch, at its edge and beyond it, in one walk through a partition."""
    page = [(0, 0, 0.0, 0.0, 50.0, 10.0), (1, 1, 52.0, 0.0, 60.0, 10.0), (2, 2, 90.0, 0.0, 99.0, 10.0)]
    made = spark.range(400).selectExpr("id AS page", "explode(sequence(0, 2)) AS i")
    box = [F.element_at(F.array(*[F.lit(p[k]) for p in page]), F.col("i") + 1) for k in range(2, 6)]
    rows = made.select("page", F.col("i").cast("long").alias("block"), F.col("i").cast("long").alias("span_id"), *[b.alias(n) for b, n in zip(box, ("x1", "y1", "x2", "y2"))],
                       F.when(F.col("i") < 2, 10.0).alias("size"), F.lit("word").alias("text"), F.lit(False).alias("kept"), F.lit("text").alias("source"), F.lit("text").alias("label"))
    merged_rows = blocks.merge_orphans(rows.coalesce(1), "page")
    assert "FlatMapGroups" not in merged_rows._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.page, r.block): r.into for r in merged_rows.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(p, b): 0 if b < 2 else 2 for p in range(400) for b in range(3)}


@pytest.mark.parametrize("name", ["cell_boxes", "grid_split"])
def test_axes_of_a_span_are_found_once(spark, name):
    from textloom.plans import block_plans

    plan = block_plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "aggregate(" not in plan


def test_spans_are_dealt_before_their_characters_are_made(spark, monkeypatch):
    """The split of spans shuffles the items once, as numbers, over tasks of bounded size; pages without rulings give nothing."""
    import re

    from textloom.operators import dealing
    from textloom.plans import block_plans

    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(dealing, "TASK_ROWS", spark.read.parquet(f"{sf}/lineitem.parquet").count() // 11)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = block_plans.QUERIES["grid_split"](spark, sf)
        assert found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    final = plan.split("Initial Plan")[0]
    assert set(re.findall(r"Exchange (\w+)\(.*?(\d+)\), (\w+)", final)) == {("hashpartitioning", "12", "REPARTITION_BY_NUM")}
    assert final.count("ReusedExchange") == 1 and final.count("Exchange hashpartitioning") == 2
    chars = letters("Mine", 10, 50) + letters("2000", 82, 50, 4)
    assert len(parts(spark, chars, [(x, 0, 100) for x in (0, 80, 100, 120)])) == 2 and parts(spark, chars, []) == []


def test_axes_of_a_batch_of_spans():
    import numpy as np

    row, at = grids.merged(np.array([2, 0, 0, 2, 0]), np.array([5.0, 10.0, 1.0, 6.0, 2.0]))
    assert row.tolist() == [0, 0, 2] and at.tolist() == [1.5, 10.0, 5.5]
    stretches = grids.intervals(row, at)
    assert [v.tolist() for v in stretches] == [[0], [1.5], [10.0]]
    low, high = grids._first(stretches, np.array([4.0, 4.0, 5.5]))
    assert (low[0], high[0]) == (1.5, 10.0) and np.isnan(low[1:]).all()


def test_lines_of_blocks_need_no_join(spark):
    """Spans go through the fold of their page whole: block modes deal the spans by page once and never again."""
    rows = [(p, i, 50.0, 700.0 - 12 * i, 200.0, 709.0 - 12 * i, 10.0, f"words {i}", i, "text", 50.0, 260.0) for p in range(20) for i in range(4)]
    df = spark.createDataFrame(rows, "page long, span_id long, x1 double, y1 double, x2 double, y2 double, size double, text string, textbox long, label string, bx1 double, bx2 double")
    found = blocks.block_modes(df, ["page"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert found.count() == 20
