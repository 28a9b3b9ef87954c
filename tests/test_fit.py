"""Sizes at which texts fit their boxes."""

import pytest
from pyspark.sql import functions as F

from textloom.functions.language import PAGE_WIDTHS, visual_length
from textloom.operators import wrap as wp

TEXTS = ["hello world", "ppt skills for docs and slides", "x" * 90, "系统卡： Claude Mythos 预览", "", "one\ntwo and more words of a longer line\n\nthree"]


@pytest.mark.parametrize("height", [12.0, 40.0, 0.0])
def test_blocks_by_search_from_outside(spark, height):
    """The same halving with a plan for each size, over wrap alone."""
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    sized = lambda s: wp.fit_block(F.col("text"), F.lit(50.0), F.lit(height), F.lit(s), F.lit(4.0))
    got = {r.id: (r.f.size, r.f.lines) for r in df.select("id", sized(12.0).alias("f")).collect()}
    lines = lambda at: {r.id: r.l for r in df.join(spark.createDataFrame(list(at.items()), "id int, at double"), "id").select("id", wp.wrap(F.col("text"), F.lit(50.0), F.col("at")).alias("l")).collect()}
    ids = list(got)
    if not height:
        assert got == {i: (12.0, l) for i, l in lines(dict.fromkeys(ids, 12.0)).items()}
        return
    low, high, best = dict.fromkeys(ids, 4.0), dict.fromkeys(ids, 12.0), {}
    for _ in range(10):
        at = {i: (low[i] + high[i]) / 2 for i in ids}
        for i, own in lines(at).items():
            if own and len(own) * at[i] * 1.2 <= height + 0.1:
                low[i], best[i] = at[i], (at[i], own)
            else:
                high[i] = at[i]
    least = lines(dict.fromkeys(ids, 4.0))
    assert got == {i: best.get(i, (4.0, least[i])) for i in ids}


def line(unit, width, size, least, scaling, least_scale):
    floor, narrowest = min(max(least, 0.1), size), min(max(least_scale, 1.0), 100.0)
    if size <= 0 or width <= 0 or unit <= 0 or unit * size <= width * 1.02:
        return size, 100.0
    share = width / (unit * size)
    if not scaling:
        return max(size * share, floor), 100.0
    wanted = lambda s: width / (unit * s) * 100
    if share >= 0.85:
        s = max(size * share, floor)
        return s, min(100.0, max(wanted(s), narrowest)) if s <= floor and unit * s > width * 1.02 else 100.0
    s = max(size * max(share**0.5, floor / size), floor)
    if wanted(s) < narrowest and s > floor:
        s = max(s * wanted(s) / narrowest, floor)
    return s, min(100.0, max(wanted(s), narrowest))


def test_lines_meet_the_plain_rule(spark):
    cases = [(t, w, s, m, g, p) for t in TEXTS for w in (0.0, 20.0, 60.0, 400.0) for s in (0.0, 9.0) for m in (6.0, 8.7) for g in (True, False) for p in (80.0, 40.0)]
    df = spark.createDataFrame(cases, "text string, width double, size double, least double, scaling boolean, low double")
    fitted = wp.fit_line(*[F.col(c) for c in ("text", "width", "size", "least", "scaling", "low")])
    for r in df.withColumn("f", fitted).withColumn("unit", visual_length(F.col("text"), PAGE_WIDTHS)).collect():
        assert (r.f.size, r.f.scale) == pytest.approx(line(r.unit, r.width, r.size, r.least, r.scaling, r.low))


def test_what_fits_keeps_its_size(spark):
    fit = lambda t, w, g: tuple(spark.range(1).select(wp.fit_line(F.lit(t), F.lit(w), F.lit(9.0), F.lit(6.0), F.lit(g), F.lit(80.0)).alias("f")).first().f)
    assert fit("ppt", 120.0, True) == (9.0, 100.0)
    assert fit("ppt skills for docs and slides", 20.0, False) == (6.0, 100.0)
    size, scale = fit("ppt skills for docs and slides", 20.0, True)
    assert size == 6.0 and scale == 80.0


def test_long_texts_are_wrapped_in_one_walk(spark):
    """60,000 tokens in one text, one of them far wider than its line."""
    words = " ".join(f"word{i % 97}" for i in range(60_000)) + " " + "界x" * 20_000
    df = spark.createDataFrame([(words,), ("a\n\n b",), (None,), ("",), ("  \nend  ",)], "t string")
    got = [r.l for r in df.select(wp.wrap(F.col("t"), F.lit(100.0), F.lit(10.0)).alias("l")).collect()]
    assert "".join(got[0]).replace(" ", "") == words.replace(" ", "") and len(got[0]) > 20_000
    assert got[1:] == [["a", "", "b"], None, [""], ["end"]]


def test_widths_are_those_of_the_expression(spark):
    chars = [chr(p) for p in (*range(0x20, 0x600), *range(0x980, 0xA00), 0x1780, 0x1C80, 0x1E01, 0x2DE1, 0x3000, 0x3001, 0x3042, 0x31F1, 0x4E00, 0xA641, 0xAC00, 0xFF01, 0xFF66, 0xFFEF, 0x20001, 0x1F600)]
    rows = spark.createDataFrame([(c,) for c in chars], "c string").select("c", visual_length(F.col("c"), PAGE_WIDTHS).alias("w")).collect()
    assert [r.w for r in rows] == wp._units([r.c for r in rows])
