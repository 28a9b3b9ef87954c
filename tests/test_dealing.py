"""Tasks of bounded size: rows dealt by key over as many tasks as they fill, Arrow batches bounded by bytes."""

import random
import re

import pytest
from pyspark.sql import functions as F

from textloom.operators import batches as bt
from textloom.operators import dealing
from textloom.operators import layout as lo
from textloom.operators import office as of
from textloom.operators import segments as sg
from textloom.plans import registry

SF = "/root/testdata/sf0.001"


def shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan, re.findall(r"Exchange (\w+)\(.*?(\d+)\), (\w+)", plan)


@pytest.mark.parametrize("name", ["axis_merge", "axis_intervals", "rect_union", "dominant_style", "preserve_blocks", "layout_filter", "table_flatten", "batch_calls"])
def test_tasks_grow_in_number_and_not_in_size(spark, monkeypatch, name):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    monkeypatch.setattr(dealing, "TASK_ROWS", rows // 11)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _, found = shuffles(registry.queries()[name](spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found and set(found) == {("hashpartitioning", "12", "REPARTITION_BY_NUM")}


def test_no_fewer_tasks_than_cores(spark):
    df = spark.range(100)
    assert dealing.dealt(df, "id", rows=100).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_segmentation_bounds_its_batches_by_bytes(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    had = spark.conf.get(name, None)
    spark.conf.unset(name)
    try:
        sg.segment_documents(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
        assert int(spark.conf.get(name)) <= dealing.BATCH_BYTES
    finally:
        if had is not None:
            spark.conf.set(name, had)


def gone_by_hand(boxes):
    area = lambda b: (b[4] - b[2]) * (b[5] - b[3])
    gone = set()
    for a in boxes:
        for b in boxes:
            if a[0] >= b[0] or a[0] in gone or b[0] in gone:
                continue
            inner = max(min(a[4], b[4]) - max(a[2], b[2]), 0) * max(min(a[5], b[5]) - max(a[3], b[3]), 0)
            share = inner / min(area(a), area(b))
            formulas = [x[0] for x in (a, b) if x[1] == "inline_formula"]
            kinds = {a[1], b[1]}
            stacked = len(kinds) == 2 and len(kinds & {"image", "table", "seal", "chart"}) >= (2 if "table" in kinds else 1)
            if share > 0.5 and formulas:
                gone |= set(formulas)
            elif share > 0.7 and not stacked:
                gone.add(b[0] if area(a) >= area(b) else a[0])
    return gone


def test_overlaps_by_hand(spark):
    dice = random.Random(5)
    pages = {}
    for page in range(60):
        corners = [(dice.randrange(40), dice.randrange(40)) for _ in range(9)]
        pages[page] = [
            (i, dice.choice(["text", "table", "image", "header", "inline_formula"]), float(x), float(y), float(x + dice.randrange(10, 60)), float(y + dice.randrange(10, 60)))
            for i, (x, y) in enumerate(corners)
        ]
    rows = [(page, *box) for page, boxes in pages.items() for box in boxes]
    df = spark.createDataFrame(rows, "page long, layout_id long, label string, x1 double, y1 double, x2 double, y2 double")
    kept = {(r.page, r.layout_id) for r in lo.filter_overlaps(df, "page", 600.0, 800.0).collect()}
    assert kept == {(page, b[0]) for page, boxes in pages.items() for b in boxes if b[0] not in gone_by_hand(boxes)}


@pytest.mark.parametrize("rows", [None, 500])
def test_nested_tables_by_hand(spark, rows):
    dice = random.Random(6)
    tables = []
    for doc in range(50):
        for t in range(10):
            parent = dice.choice([None, *range(t), 99, 9])
            tables.append((doc, t, parent, dice.randrange(5)))
    tables += [(50, 0, None, 1), (50, 0, None, 2), (50, 1, 0, 3), (None, 0, None, 4), (None, 1, 0, 4)]
    out, level = [], [(d, t, i, 0) for d, t, p, i in tables if p is None]
    for n in range(1, 4):
        out += level
        level = [(d, t, (e + 1) * 1000 + i, n) for d, t, p, i in tables for dd, pt, e, _ in level if p is not None and d is not None and (d, p) == (dd, pt)]
    out += level
    df = spark.createDataFrame(tables, "doc long, table_id long, parent long, idx long")
    key = lambda r: [(v is None, v or 0) for v in r]
    assert sorted(map(tuple, of.flatten_tables(df, rows=rows).collect()), key=key) == sorted(out, key=key)


def test_calls_by_hand(spark):
    rows = [
        (1, 0, "alpha beta same", "txt"), (1, 1, "  ", "txt"), (1, 2, "alpha beta other", "txt"), (1, 3, None, "txt"), (1, 4, "alpha beta stays", "txt"),
        (2, 0, "alpha beta same", "docx"), (3, 0, " ", "txt"), (4, 0, "x", None),
    ]
    df = spark.createDataFrame(rows, "batch long, index long, text string, hint string").withColumns({"source": F.lit("en"), "target": F.lit("fr")})
    first = lambda t: F.when(t.rlike("same|stays"), F.concat(F.lit(" "), t)).otherwise(F.concat(F.lit("T:"), t))
    again = lambda t: F.when(t.rlike("stays"), t).otherwise(F.concat(F.lit("R:"), t))
    got = bt.call_batches(df, "batch", first, again, lambda t: F.length(t).cast("long"))
    assert sorted(map(tuple, got.collect())) == [
        (1, 0, "R:alpha beta same", 0, True, 78), (1, 1, "  ", None, False, 78), (1, 2, "T:alpha beta other", 1, False, 78), (1, 3, None, None, False, 78),
        (1, 4, " alpha beta stays", 2, True, 78), (2, 0, " alpha beta same", 0, False, 15), (3, 0, " ", None, False, None), (4, 0, "T:x", 0, False, 1),
    ]
    plan, _ = shuffles(got)
    assert "Join" not in plan
