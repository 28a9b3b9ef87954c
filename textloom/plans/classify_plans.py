"""Queries of scalar classifiers: cells, numbers, languages, scripts, fonts and widths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import language as lg
from textloom.functions import text as tx


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Spreadsheet cells made from part rows, one kind per remainder.
_CELL = (
    "CASE p_partkey % 12 WHEN 0 THEN p_name WHEN 1 THEN concat('SKU-', p_partkey) WHEN 2 THEN concat('=SUM(A', p_size, ')') "
    "WHEN 3 THEN concat('https://x.example/', p_partkey) WHEN 4 THEN concat('user', p_partkey, '@mail.example.com') "
    "WHEN 5 THEN concat('/usr/', p_brand) WHEN 6 THEN concat('  ', p_size, '.50 % ') WHEN 7 THEN concat(p_type, ' ', p_size) "
    "WHEN 8 THEN '   ' WHEN 9 THEN concat('3f2504e0-4f89-41d3-9a0c-0305e82c3', 301 + p_partkey % 600) "
    "WHEN 10 THEN concat('v1.', p_size, '/beta') ELSE concat(p_size, ' 1/2') END"
)


def xlsx_translatable(spark: SparkSession, sf: str) -> DataFrame:
    cell = _table(spark, sf, "part").select("p_partkey", F.expr(_CELL).alias("cell"), (F.col("p_partkey") % 7 == 0).alias("formula"))
    return cell.select(
        "p_partkey", tx.translatable_cell(F.col("cell"), F.col("formula")).alias("translatable"),
        tx.only_marks(F.col("cell")).alias("only_marks"), tx.numeric_fragment(F.col("cell")).alias("numeric"),
    )


# Texts with glyph marks, by id.
_CID = (
    "CASE doc_id % 6 WHEN 0 THEN concat(substr(text, 1, 20), '(cid:', doc_id, ')', substr(text, 21)) "
    "WHEN 1 THEN concat('(cid:1)(cid:2)(CID:3)', CASE WHEN doc_id % 4 = 1 THEN 'ab' ELSE text END) WHEN 2 THEN concat('Q(cid:1)', doc_id, ' Revenue') "
    "WHEN 3 THEN concat('A(cid:2)', CASE WHEN doc_id % 4 = 1 THEN 'B' ELSE text END) WHEN 4 THEN '1⁄4' ELSE text END"
)


def cid_recovery(spark: SparkSession, sf: str) -> DataFrame:
    rows = _table(spark, sf, "documents").select("doc_id", F.expr(_CID).alias("span"))
    kept = tx.preserve_span(F.col("span"))
    return rows.select("doc_id", tx.recoverable_cid(F.col("span")).alias("recoverable"), kept["preserve"].alias("preserve"), F.md5(kept["text"].cast("binary")).alias("clean_md5"))


_NAMES = [n for names in lg.ALIASES.values() for n in names] + ["", "xx", " English ", "FR", "De"]


def lang_alias(spark: SparkSession, sf: str) -> DataFrame:
    """O-39 for one name per customer."""
    names = F.array(*[F.lit(n) for n in _NAMES])
    rows = _table(spark, sf, "customer").select("c_custkey", F.element_at(names, (F.col("c_custkey") % len(_NAMES) + 1).cast("int")).alias("name"))
    return rows.select("c_custkey", lg.language_code(F.col("name")).alias("code"))


_CODES = ("zh", "zh_TW", "EN", "fr ", "vi", "auto", "tlh", "zh-HK")


def prompt_labels(spark: SparkSession, sf: str) -> DataFrame:
    """O-40 for one code per customer."""
    codes = F.array(*[F.lit(n) for n in _CODES])
    code = F.element_at(codes, (F.col("c_custkey") % len(_CODES) + 1).cast("int"))
    return _table(spark, sf, "customer").select("c_custkey", lg.target_label(code).alias("target"), lg.source_label(code).alias("source"))


def span_forms(spark: SparkSession, sf: str) -> DataFrame:
    """O-148 and O-156: span texts, and whether a text equals itself in other clothes."""
    rows = _table(spark, sf, "conversations").select("conv_id", "turn", "text")
    other = F.lower(F.replace("text", F.lit(" "), F.lit("  ")))
    return rows.select("conv_id", "turn", F.md5(lg.span_text(F.col("text")).cast("binary")).alias("span_md5"), lg.nearly_identical(F.col("text"), other).alias("same"))


# Characters of other scripts put before the text, by id.
_SAMPLES = ("", "Привет мир ", "漢字かな ", "한국어 ", "বাংলা ", "ខ្មែរ ", "Tiếng Việt ", "∑αβ ", "├── ", "中文内容 ")
_MIXED = "concat(element_at(array(" + ", ".join(f"'{s}'" for s in _SAMPLES) + "), cast(doc_id % 10 as int) + 1), text)"
_MIXED_DUCK = "concat([" + ", ".join(f"'{s}'" for s in _SAMPLES) + "][doc_id % 10 + 1], text)"


def _mixed(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").select("doc_id", F.expr(_MIXED).alias("t"))


def infer_language(spark: SparkSession, sf: str) -> DataFrame:
    """O-42 and O-43 on mixed texts."""
    counts = lg.script_counts(F.col("t"))
    return _mixed(spark, sf).select(
        "doc_id",
        lg.infer_language(F.col("t")).alias("greedy"),
        lg.infer_language(F.col("t"), "majority").alias("majority"),
        *[counts[n].cast("long").alias(f"n_{n}") for n in (*lg.RANKED, "math")],
    )


def infer_corpus_language(spark: SparkSession, sf: str) -> DataFrame:
    """O-43 on whole documents against their language column."""
    rows = _table(spark, sf, "documents").select("lang", lg.infer_language(F.col("text")).alias("greedy"))
    return rows.groupBy("lang", "greedy").agg(F.count(F.lit(1)).alias("n"))


_TARGETS = ("zh-CN", "en", "fr", "ru", "ja", "ko", "bn", "km", "vi", "xx", "German")
_FONTS = ("", "SimSun", "Wingdings 2", "Calibri", "Yu Gothic UI", "Malgun Gothic", "Arial Unicode MS", "PMingLiU")
_FONT_ROWS = (
    f"element_at(array({', '.join(repr(t) for t in _TARGETS)}), cast(doc_id % {len(_TARGETS)} as int) + 1) AS target",
    f"element_at(array({', '.join(repr(t) for t in _FONTS)}), cast(doc_id % {len(_FONTS)} as int) + 1) AS font",
)


def font_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """O-45 and O-46."""
    rows = _table(spark, sf, "documents").select("doc_id", F.expr(_MIXED).alias("t"), *[F.expr(e) for e in _FONT_ROWS])
    return rows.select(
        "doc_id", lg.script_slot(F.col("target"), F.col("t")).alias("slot"),
        lg.fallback_font(F.col("target"), F.col("t"), F.col("font")).alias("fallback"),
    )


def weighted_len(spark: SparkSession, sf: str) -> DataFrame:
    """O-47 and O-48."""
    return _mixed(spark, sf).select(
        "doc_id", lg.visual_length(F.col("t"), lg.PAGE_WIDTHS).alias("page"), lg.visual_length(F.col("t"), lg.SLIDE_WIDTHS).alias("slide")
    )


def unchanged_qa(spark: SparkSession, sf: str) -> DataFrame:
    """O-38: half of the translations unchanged up to white space and marks."""
    rows = _mixed(spark, sf).select(
        "doc_id",
        F.concat(F.lit("[PARA_1]<span>"), "t", F.lit("</span>")).alias("source"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" <span>"), "t", F.lit(" </span>"))).otherwise("other").alias("out"),
        F.element_at(F.array(*[F.lit(x) for x in ("en", "", "zh")]), (F.col("doc_id") % 3 + 1).cast("int")).alias("sl"),
        F.element_at(F.array(*[F.lit(x) for x in ("zh-CN", "en", "fr", "ja", "vi")]), (F.col("doc_id") % 5 + 1).cast("int")).alias("tl"),
    )
    need = lg.unchanged_needs_retry(F.col("source"), F.col("out"), F.col("sl"), F.col("tl"))
    return rows.select("doc_id", need.alias("retry"))


def font_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """O-113 and O-151 on line items: quantity as size, key remainders as lengths."""
    rows = _table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("size"),
        (F.col("l_partkey") % 40).cast("double").alias("a"), (F.col("l_suppkey") % 90).cast("double").alias("b"),
    )
    size, a, b = F.col("size"), F.col("a"), F.col("b")
    return rows.groupBy("l_orderkey", "l_linenumber").agg(
        F.round(F.sum(F.when(a == 0, size).otherwise(lg.shrunk_size(size, a, b))), 4).alias("slide_size"),
        F.round(F.sum(F.when(a == 0, size).otherwise(lg.adjusted_size(size, F.greatest(a, F.lit(1.0)), b))), 4).alias("page_size"),
    )


_FONT_NAMES = ("ABCDEF+Arial-BoldMT", "/Times-Roman", "Heavy Sans", "abc+Demi", "Noto Sans", "ABCDE1+Regular", "", "SemiBold")


def bold_fonts(spark: SparkSession, sf: str) -> DataFrame:
    """O-49."""
    name = F.element_at(F.array(*[F.lit(x) for x in _FONT_NAMES]), (F.col("p_partkey") % len(_FONT_NAMES) + 1).cast("int"))
    return _table(spark, sf, "part").select("p_partkey", tx.bold_font(name).alias("bold"))


def script_runs(spark: SparkSession, sf: str) -> DataFrame:
    """O-28: the runs of one script in every document."""
    rows = _table(spark, sf, "documents").select("doc_id", F.posexplode(lg.script_runs(F.coalesce("text", F.lit("")))).alias("run", "r"))
    return rows.select("doc_id", F.col("run").cast("long").alias("run"), "r.script", F.md5(F.col("r.text").cast("binary")).alias("text_md5"))


QUERIES = {
    "script_runs": script_runs,
    "xlsx_translatable": xlsx_translatable,
    "cid_recovery": cid_recovery,
    "lang_alias": lang_alias,
    "prompt_labels": prompt_labels,
    "span_forms": span_forms,
    "infer_language": infer_language,
    "infer_corpus_language": infer_corpus_language,
    "font_fallback": font_fallback,
    "weighted_len": weighted_len,
    "unchanged_qa": unchanged_qa,
    "font_sizes": font_sizes,
    "bold_fonts": bold_fonts,
}


def _less(text: str, chars: str) -> str:
    return f"regexp_replace({text}, '[{chars.replace(chr(39), chr(39) * 2)}]', '', 'g')"


def _chain(table: str, classes: list[tuple[str, str]], text: str) -> tuple[str, str]:
    """CTEs that take one class after another out of ``text``; the name of the last."""
    out, last = [], table
    for i, (name, chars) in enumerate(classes):
        column = "rest" if i else text
        out.append(f"s{i} AS (SELECT * REPLACE ({_less(column, chars)} AS {column}), length({column}) - length({_less(column, chars)}) AS c{i} FROM {last})"
                   if i else f"s0 AS (SELECT *, {_less(text, chars)} AS rest, length({text}) - length({_less(text, chars)}) AS c0 FROM {last})")
        last = f"s{i}"
    return ", ".join(out), last


_CTES, _LAST = _chain("base", list(lg.SCRIPTS), "alnum")
_COUNT = {n: " + ".join(f"c{i}" for i, (m, _) in enumerate(lg.SCRIPTS) if m == n) for n in dict(lg.SCRIPTS)} | {"en": "length(rest)"}
_SCRIPT_SQL = (
    "WITH base AS (SELECT *, regexp_replace(t, '[^\\p{L}\\p{N}]', '', 'g') AS alnum FROM ({rows})), "
    + _CTES
    + ", counts AS (SELECT *, "
    + ", ".join(f"CAST({_COUNT[n]} AS BIGINT) AS n_{n}" for n in (*lg.RANKED, "math"))
    + f" FROM {_LAST}), named AS (SELECT *, CASE WHEN regexp_replace(t, '[\\r\\n]', '', 'g') = '' THEN 'zh' "
    + " ".join(f"WHEN n_{n} > 0 THEN '{n}'" for n in lg.GREEDY)
    + " ELSE 'en' END AS greedy FROM counts) "
)
_MOST = f"greatest({', '.join('n_' + n for n in lg.RANKED)})"
_TOTAL = f"greatest({' + '.join('n_' + n for n in lg.RANKED)}, 1)"
_MAJORITY = (
    f"CASE WHEN regexp_replace(t, '[\\r\\n]', '', 'g') = '' THEN 'zh' WHEN n_zh = {_MOST} THEN 'zh' WHEN n_en = {_MOST} THEN CASE "
    + " ".join(f"WHEN n_{n} / {_TOTAL} > 0.1 THEN '{n}'" for n in ("zh", "ja", "ko", "ru", "bn", "km", "vi"))
    + " ELSE 'en' END "
    + " ".join(f"WHEN n_{n} = {_MOST} THEN '{n}'" for n in lg.RANKED[2:])
    + " END"
)
_CODE = "CASE " + " ".join(
    f"WHEN lower(trim({{0}})) IN ({', '.join(repr(n) for n in names)}) THEN '{code}'" for code, names in lg.ALIASES.items()
) + " ELSE lower(trim({0})) END"
_HAN = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{20000}-\x{2CEAF}\x{30000}-\x{3134F}]"
_SLOT = rf"""CASE WHEN trim(t) = '' THEN NULL
    WHEN code IN ('zh-CN','zh-TW','zh-HK') THEN CASE WHEN regexp_matches(t, '{_HAN}') THEN 'east_asian' END
    WHEN code = 'ja' THEN CASE WHEN regexp_matches(t, '[\x{{3040}}-\x{{30FF}}\x{{31F0}}-\x{{31FF}}]|{_HAN}') THEN 'east_asian' END
    WHEN code = 'ko' THEN CASE WHEN regexp_matches(t, '[\x{{1100}}-\x{{11FF}}\x{{3130}}-\x{{318F}}\x{{AC00}}-\x{{D7AF}}]|{_HAN}') THEN 'east_asian' END
    WHEN code = 'ru' THEN CASE WHEN regexp_matches(t, '[\x{{400}}-\x{{52F}}\x{{2DE0}}-\x{{2DFF}}\x{{A640}}-\x{{A69F}}]') THEN 'latin' END
    WHEN code IN ('en','fr','de','es','vi') THEN CASE WHEN regexp_matches(t, '[A-Za-z\x{{C0}}-\x{{24F}}\x{{1E00}}-\x{{1EFF}}]') THEN 'latin' END
    WHEN code = 'bn' THEN CASE WHEN regexp_matches(t, '[\x{{980}}-\x{{9FF}}]') THEN 'complex_script' END
    WHEN code = 'km' THEN CASE WHEN regexp_matches(t, '[\x{{1780}}-\x{{17FF}}\x{{19E0}}-\x{{19FF}}]') THEN 'complex_script' END END"""
_ANY = lambda parts: "(" + " OR ".join(f"contains(lower(trim(font)), '{p}')" for p in parts) + ")"
_NEEDS = (
    f"CASE WHEN slot = 'latin' THEN trim(font) = '' OR {_ANY(lg.SYMBOL_FONTS)} OR (regexp_matches(t, "
    r"'[\x{C0}-\x{24F}\x{1E00}-\x{1EFF}\x{400}-\x{52F}\x{2DE0}-\x{2DFF}\x{A640}-\x{A69F}]') AND "
    f"{_ANY(lg.LIMITED_LATIN_FONTS)}) ELSE NOT (CASE "
    + " ".join(f"WHEN code = '{k}' THEN {_ANY(v)}" for k, v in lg.SCRIPT_FONTS.items())
    + " ELSE false END) END"
)
_PRESET = "CASE " + " ".join(f"WHEN code = '{k}' THEN '{v}'" for k, v in lg.FALLBACK_FONTS.items()) + " END"


def _width_sql(widths: tuple[tuple[str, float], ...], name: str) -> str:
    inner = "t"
    total = []
    for chars, width in widths:
        less = _less(inner, chars)
        total.append(f"(length({inner}) - length({less})) * {width}")
        inner = less
    return f"round(CAST({' + '.join(total)} + length({inner}) AS DOUBLE), 6) AS {name}"


_ROWS = f"SELECT doc_id, {_MIXED_DUCK} AS t FROM documents"
_CELL_DUCK = _CELL
_CID_DUCK = _CID
_WORD = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]"
_LABEL = "CASE k " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lg.TARGET_LABELS.items()) + " ELSE trim(c) END"
ORACLE = {
    "script_runs": f"""
        WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS k FROM documents WHERE text <> ''),
        d AS (SELECT c, CASE {" ".join(f"WHEN regexp_matches(c, '^[{chars}]$') THEN '{name}'" for name, chars in lg.SCRIPTS)} ELSE 'en' END AS own FROM (SELECT DISTINCT c FROM c)),
        s AS (SELECT doc_id, k, c, coalesce(last_value(nullif(own, 'common') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING), 'en') AS script FROM c JOIN d USING (c)),
        n AS (SELECT *, CASE WHEN lag(script) OVER (PARTITION BY doc_id ORDER BY k) <> script THEN 1 ELSE 0 END AS new FROM s),
        r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS run FROM n)
        SELECT doc_id, CAST(run AS BIGINT) AS run, any_value(script) AS script, md5(string_agg(c, '' ORDER BY k)) AS text_md5 FROM r GROUP BY doc_id, run""",
    "prompt_labels": f"""
        WITH n AS (SELECT c_custkey, {list(_CODES)!r}[c_custkey % {len(_CODES)} + 1] AS c FROM customer), m AS (SELECT *, replace(lower(trim(c)), '_', '-') AS k FROM n)
        SELECT c_custkey, {_LABEL} AS target, CASE WHEN k = 'auto' THEN 'automatically identified language' WHEN k LIKE 'zh%' THEN 'Chinese' ELSE {_LABEL} END AS source FROM m
    """,
    "span_forms": r"""
        SELECT conv_id, turn, md5(regexp_replace(regexp_replace(replace(text, chr(173), ''), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')) AS span_md5, true AS same FROM conversations
    """,
    "xlsx_translatable": rf"""
        WITH c AS (SELECT p_partkey, regexp_replace(cell, '^\s+|\s+$', '', 'g') AS core, cell, p_partkey % 7 = 0 AS formula
                   FROM (SELECT p_partkey, {_CELL_DUCK} AS cell FROM part))
        SELECT p_partkey,
               NOT formula AND core <> '' AND NOT starts_with(core, '=')
               AND NOT regexp_matches(core, '^(?i:https?://|www\.)') AND NOT regexp_matches(core, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}$')
               AND NOT regexp_matches(core, '^[A-Za-z]:\\') AND NOT regexp_matches(core, '^/[A-Za-z0-9._/\-]+$')
               AND NOT regexp_matches(core, '^[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[1-5][0-9a-fA-F]{{3}}-[89abAB][0-9a-fA-F]{{3}}-[0-9a-fA-F]{{12}}$')
               AND NOT (regexp_matches(core, '^[A-Za-z0-9._:/\\-]+$') AND regexp_matches(core, '[A-Za-z]') AND regexp_matches(core, '[0-9]') AND regexp_matches(core, '[._:/\\-]'))
               AND NOT regexp_matches(core, '^[\p{{N}}\p{{P}}\p{{S}}\s]*$') AS translatable,
               regexp_matches(cell, '^[\p{{N}}\p{{P}}\p{{S}}\s]*$') AS only_marks,
               core <> '' AND regexp_matches(regexp_replace(core, '\s+', '', 'g'), '^[\p{{N}}\p{{P}}\p{{S}}]+$') AS "numeric"
        FROM c
    """,
    "cid_recovery": rf"""
        WITH s AS (SELECT doc_id, {_CID_DUCK} AS span FROM documents),
        m AS (SELECT *, len(regexp_extract_all(span, '(?i)\(cid:[0-9]+\)')) AS n, regexp_replace(span, '(?i)\(cid:[0-9]+\)', ' ', 'g') AS clean0 FROM s),
        k AS (SELECT *, regexp_replace(clean0, '\s+', '', 'g') AS compact,
                     len(list_filter(string_split_regex(span, '(?i)\(cid:[0-9]+\)'), lambda p: regexp_replace(p, '\s+', '', 'g') <> '')) AS parts,
                     len(regexp_extract_all(clean0, '\p{{L}}{{3,}}')) AS words FROM m),
        c AS (SELECT *, length(regexp_replace(compact, '[^\p{{L}}]', '', 'g')) AS alpha, length(regexp_replace(compact, '[^\p{{L}}\p{{N}}]', '', 'g')) AS alnum FROM k),
        r AS (SELECT *, n > 0 AND compact <> '' AND n < greatest(3, alnum) AND (
                 (n <= 1 AND parts >= 2 AND CASE WHEN regexp_matches(compact, '{_WORD}') THEN length(compact) >= 3 ELSE alnum >= 4 END)
                 OR words >= 3 OR (alpha >= 12 AND n <= greatest(2, alpha // 8))) AS recoverable,
                 regexp_replace(span, '\s+', '', 'g') <> '' AND regexp_matches(regexp_replace(span, '\s+', '', 'g'), '^[\p{{N}}\p{{P}}\p{{S}}]+$') AS number FROM c)
        SELECT doc_id, recoverable, preserve, md5(clean) AS clean_md5 FROM (
        SELECT doc_id, recoverable, (n > 0 AND NOT recoverable) OR number OR span = '' AS preserve,
               CASE WHEN number THEN replace(CASE WHEN n > 0 AND recoverable THEN clean0 ELSE span END, '⁄', '/')
                    WHEN n > 0 AND recoverable THEN clean0 ELSE span END AS clean
        FROM r)
    """,
    "lang_alias": f"SELECT c_custkey, {_CODE.format('name')} AS code FROM (SELECT c_custkey, {_NAMES!r}[c_custkey % {len(_NAMES)} + 1] AS name FROM customer)",
    "infer_language": _SCRIPT_SQL.replace("{rows}", _ROWS)
    + f"SELECT doc_id, greedy, {_MAJORITY} AS majority, {', '.join('n_' + n for n in (*lg.RANKED, 'math'))} FROM named",
    "infer_corpus_language": _SCRIPT_SQL.replace("{rows}", "SELECT lang, text AS t FROM documents")
    + "SELECT lang, greedy, count(*) AS n FROM named GROUP BY lang, greedy",
    "font_fallback": f"""
        WITH r AS (SELECT doc_id, {_MIXED_DUCK} AS t, {list(_TARGETS)!r}[doc_id % {len(_TARGETS)} + 1] AS target, {list(_FONTS)!r}[doc_id % {len(_FONTS)} + 1] AS font FROM documents),
        c AS (SELECT *, {_CODE.format('target')} AS code FROM r), s AS (SELECT *, {_SLOT} AS slot FROM c)
        SELECT doc_id, slot, CASE WHEN slot IS NOT NULL AND {_NEEDS} THEN {_PRESET} END AS fallback FROM s
    """,
    "weighted_len": f"SELECT doc_id, {_width_sql(lg.PAGE_WIDTHS, 'page')}, {_width_sql(lg.SLIDE_WIDTHS, 'slide')} FROM ({_ROWS})",
    "unchanged_qa": rf"""
        WITH r AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(?i)\[(?:PARA|SLIDE|SHAPE|TABLE|CELL|ROW|NOTE|HEADER|FOOTER)[^\]]*\]', ' ', 'g'), '^\s+|\s+$', '', 'g') AS seen,
                          doc_id % 2 = 0 AS same, ['en', '', 'zh-CN'][doc_id % 3 + 1] AS sl, ['zh-CN', 'en', 'fr', 'ja', 'vi'][doc_id % 5 + 1] AS tl FROM ({_ROWS})),
        c AS (SELECT *, len(regexp_extract_all(seen, '{_WORD}')) AS cjk, len(regexp_extract_all(seen, '[A-Za-z]{{2,}}')) AS words FROM r)
        SELECT doc_id, seen <> '' AND same AND NOT (sl <> '' AND sl = tl)
               AND CASE WHEN tl = 'zh-CN' THEN cjk = 0 AND words >= 2 WHEN tl = 'en' THEN cjk >= 2
                        ELSE sl = 'en' AND tl IN ('fr', 'vi') AND words >= 2 END AS retry FROM c
    """,
    "font_sizes": """
        WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity AS size, CAST(l_partkey % 40 AS DOUBLE) AS a, CAST(l_suppkey % 90 AS DOUBLE) AS b FROM lineitem),
        s AS (SELECT *, greatest(8.0, round_even(size * greatest(greatest(8.0 / greatest(size, 1e-6), 0.75), least(1.0, sqrt(b_ratio))), 0)) AS small
              FROM (SELECT *, CASE WHEN b = 0 THEN 1.0 ELSE a / b END AS b_ratio FROM r)),
        p AS (SELECT *, CASE WHEN a < 1 OR b <= a OR small >= size THEN size ELSE small END AS ss,
                     CASE WHEN a = 0 OR b <= a THEN size ELSE greatest(size * a / b, greatest(size * CASE WHEN b / a <= 2 THEN 0.4 WHEN b / a >= 4 THEN 0.25
                          WHEN b / a >= 3 THEN 0.30 WHEN b / a >= 2.5 THEN 0.35 ELSE 0.38 END, 6.0)) END AS ps FROM s)
        SELECT l_orderkey, l_linenumber, round(sum(ss), 4) AS slide_size, round(sum(ps), 4) AS page_size FROM p GROUP BY l_orderkey, l_linenumber
    """,
    "bold_fonts": f"""
        SELECT p_partkey, regexp_matches(lower(regexp_replace(regexp_replace(name, '^/+', ''), '^[A-Za-z0-9]{{6}}\\+', '')),
               'extrabold|ultrabold|semibold|demibold|black|heavy|bold|demi') AS bold
        FROM (SELECT p_partkey, {list(_FONT_NAMES)!r}[p_partkey % {len(_FONT_NAMES)} + 1] AS name FROM part)
    """,
}
