"""Operators without SQL twins, and scalar functions, on literal cases."""

import pytest
from pyspark.sql import functions as F

from textloom.functions import language as lg
from textloom.functions import markup as mk
from textloom.functions import text as tx
from textloom.operators import layout as lo
from textloom.operators import markdown as md


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_overlap_filter(spark):
    rows = [
        (1, 0, "text", 0.0, 0.0, 100.0, 100.0), (1, 1, "text", 5.0, 5.0, 60.0, 60.0), (1, 2, "inline_formula", 10.0, 10.0, 50.0, 50.0),
        (1, 3, "reference", 0.0, 0.0, 300.0, 300.0), (1, 4, "image", 0.0, 0.0, 90.0, 90.0), (1, 5, "text", 0.0, 0.0, 4.0, 90.0),
        (2, 0, "table", 0.0, 0.0, 100.0, 100.0), (2, 1, "text", 0.0, 0.0, 90.0, 90.0), (3, 0, "image", 0.0, 0.0, 600.0, 800.0),
    ]
    df = spark.createDataFrame(rows, "page long, layout_id long, label string, x1 double, y1 double, x2 double, y2 double")
    kept = {(r.page, r.layout_id) for r in lo.filter_overlaps(df, "page", 600.0, 800.0).collect()}
    assert kept == {(1, 0), (1, 4), (2, 0), (3, 0)}


def protected(spark, text):
    r = md.protect(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    return r.working, [(x.mark, x.content) for x in r.spans], r.context, r.restored


def restored(spark, working, pairs):
    spans = F.array(*[F.struct(F.lit(m).alias("mark"), F.lit(c).alias("content")) for m, c in pairs])
    return value(spark, md.restore(F.lit(working), spans))


def test_protection(spark):
    text = "---\ntitle: Keep\n---\n\n# Hello\n\nSee [docs](https://example.com/a_(b)) and `x`.\n\n```py\nprint('Keep')\n```\n"
    working, pairs, context, same = protected(spark, text)
    assert [m for m, _ in pairs] == [
        "%%PROTECTED_FRONT_MATTER_0000%%", "%%PROTECTED_CODE_BLOCK_0001%%", "%%PROTECTED_INLINE_CODE_0002%%", "%%PROTECTED_LINK_DEST_0003%%",
    ]
    assert pairs[3][1] == "https://example.com/a_(b)"
    assert context == ["--- title: Keep ---", "```py print('Keep') ```"]
    assert same and restored(spark, working, pairs) == text
    assert restored(spark, working.replace(pairs[1][0], ""), pairs) is None
    assert protected(spark, "[a](b")[1] == [] and protected(spark, r"[a](b\)c)")[1][0][1] == r"b\)c"


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("", []), (None, []), ("plain", []), ("[a](b) [c](d(e)f) [g](h", ["b", "d(e)f"]), (r"\[a](b\\) x", [r"b\\"]), ("[a](x](y) z) w", ["x](y) z"]),
        ("    code\n\tmore\ntext\n    again", ["    code\n\tmore\n", "    again"]), ("~~~\na\n~~~\n```\nb\n``` \n", ["~~~\na\n~~~\n", "```\nb\n``` \n"]),
        ("<div>\nx\n\ny", ["<div>"]), ("[ref]: http://x y\nz `c` `d`", ["[ref]: http://x y", "`c`", "`d`"]), ("---\nno end", []),
    ],
)
def test_protected_kinds(spark, text, expected):
    working, pairs, _, same = protected(spark, text)
    assert [c for _, c in pairs] == expected
    assert same == (not any("%%" in c for _, c in pairs))
    for mark, content in reversed(pairs):
        working = working.replace(mark, content)
    assert working == (text or "")


def test_protection_of_a_long_block(spark):
    text = "    code line\n" * 20_000 + "end"
    _, pairs, _, same = protected(spark, text)
    assert same and [len(c) for _, c in pairs] == [len(text) - 3]


@pytest.mark.parametrize(
    ("text", "fine"),
    [
        ("New (cid:1) York", True), ("Q(cid:1)1 Revenue", True), ("客户(cid:1)管理", True), ("A(cid:2)B", False),
        ("(cid:1)(cid:2)(cid:3)(cid:4)", False), ("plain", False),
    ],
)
def test_cid(spark, text, fine):
    assert value(spark, tx.recoverable_cid(F.lit(text))) is fine


@pytest.mark.parametrize(
    ("source", "translated", "sl", "tl", "retry"),
    [
        ("[PARA_3]<span>Receipt matters</span>", "[PARA_3]<span>Receipt matters</span>", "en", "zh-CN", True),
        ("卖方: Example Tech (SH) Co., Ltd.", "卖方: Example Tech (SH) Co., Ltd.", "en", "zh-CN", False),
        ("课题研究背景", "课题研究背景", "zh-CN", "en", True), ("Same text", "Other text", "en", "fr", False), ("Same text", "Same text", "fr", "fr", False),
    ],
)
def test_unchanged(spark, source, translated, sl, tl, retry):
    assert value(spark, lg.unchanged_needs_retry(F.lit(source), F.lit(translated), F.lit(sl), F.lit(tl))) is retry


@pytest.mark.parametrize(
    ("cell", "fine"),
    [
        ("产品", True), ("SKU-001", False), ("=SUM(B2,1)", False), ("10", False), ("https://x.y", False), ("a@b.co", False), ("C:\\x", False),
        ("/usr/bin", False), ("Total 10", True), ("  ", False), ("v1.2/b", False), ("Plain", True),
    ],
)
def test_cells(spark, cell, fine):
    assert value(spark, tx.translatable_cell(F.lit(cell), F.lit(False))) is fine


def test_slide_repair(spark):
    source = "<span>前半句</span><span><SPACE></span><span>后半句</span>"
    got = value(spark, mk.repair_slide(F.lit("Translated sentence."), F.lit(source)))
    assert got == "<span>Translated sentence.</span><span><SPACE></span><span></span>"
    assert value(spark, mk.repair_document(F.lit(""), F.lit("<span>a</span>"))) is None


def test_spacing(spark):
    text = "<span>Hello</span><span>world</span><span>,</span><span>中</span><span>文</span>"
    assert value(spark, mk.english_spacing(F.lit(text))) == "<span>Hello </span><span>world</span><span>,</span><span>中</span><span>文</span>"


def test_table_signature(spark):
    sig = value(spark, mk.table_signature(F.lit(r"| Alpha | A \| B |")))
    assert (sig.lead, sig.trail, sig.pipes) == (True, True, 3)
    assert value(spark, mk.table_signature(F.lit("a|b\nc"))) is None


@pytest.mark.parametrize(
    ("lang", "text", "font", "expected"),
    [("zh-CN", "中文", "SimSun", None), ("zh-CN", "中文", "Calibri", "Noto Sans SC"), ("fr", "été", "SimSun", "Calibri"),
     ("fr", "ete", "SimSun", None), ("en", "abc", "Wingdings", "Calibri"), ("ja", "漢字", "", "Yu Gothic"), ("xx", "abc", "", None)],
)
def test_fonts(spark, lang, text, font, expected):
    assert value(spark, lg.fallback_font(F.lit(lang), F.lit(text), F.lit(font))) == expected


def test_line_ends_and_names(spark):
    assert value(spark, tx.line_ending(F.lit("a\rb\r\n"))) == "\r\n"
    assert value(spark, tx.base_name(F.lit("C:\\in\\a.txt"))) == "a.txt"
    assert value(spark, tx.display_name(F.lit(".."))) == "document"
    assert value(spark, tx.output_name(F.lit("a.b.docx"), F.lit("zh CN"))) == "a.b.zh-CN.docx"


def test_labels_and_plain_forms(spark):
    assert value(spark, lg.target_label(F.lit("zh_TW"))) == "Traditional Chinese (Taiwan)"
    assert value(spark, lg.target_label(F.lit(" tlh "))) == "tlh"
    assert value(spark, lg.source_label(F.lit(None).cast("string"))) == "automatically identified language"
    assert value(spark, lg.source_label(F.lit("zh-HK"))) == "Chinese"
    assert value(spark, lg.nearly_identical(F.lit("A b\nC"), F.lit("ab c"))) is True
    assert value(spark, lg.span_text(F.lit(" so­ft  hy\n"))) == "soft hy"


def test_script_runs(spark):
    got = value(spark, lg.script_runs(F.lit(" 1 Hello, 世界! Привет")))
    assert [(r.text, r.script) for r in got] == [(" 1 Hello, ", "en"), ("世界! ", "zh"), ("Привет", "ru")]
    assert value(spark, lg.script_runs(F.lit(""))) == []


def test_script_runs_of_line_art_and_cyrillic(spark):
    runs = [tuple(r) for r in value(spark, lg.script_runs(F.lit("src \u251c\u2500 app \u2514\u2500 tests")))]
    assert runs == [("src ", "en"), ("\u251c\u2500 ", "zh"), ("app ", "en"), ("\u2514\u2500 ", "zh"), ("tests", "en")]
    assert [r.script for r in value(spark, lg.script_runs(F.lit("CPU память")))] == ["en", "ru"]
    assert [tuple(r) for r in value(spark, lg.script_runs(F.lit(" 12 память"), "en"))] == [(" 12 ", "en"), ("память", "ru")]
    assert [tuple(r) for r in value(spark, lg.script_runs(F.lit(" 12 память"), "ru"))] == [(" 12 память", "ru")]
