"""Queries of runs, markers and cells of office documents, option texts and page chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.language import PAGE_WIDTHS, SCRIPTS
from textloom.operators import chunks as ck
from textloom.operators import jobs as jb
from textloom.operators import office as of
from textloom.operators import tables as tb
from textloom.operators import wrap as wp
from textloom.plans.classify_plans import _width_sql

#: Line items as runs: an order is a paragraph.
_RUN = {
    "para": "l_orderkey", "position": "l_linenumber", "text": "CASE WHEN l_partkey % 7 = 0 THEN '' ELSE concat('t', l_partkey) END", "format": "l_returnflag",
    "container": "l_linestatus", "complex": "l_suppkey % 5 = 0", "structural": "l_suppkey % 4 = 0",
}
_RUNS = f"(SELECT {', '.join(f'{v} AS {k}' for k, v in _RUN.items())} FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, max(l_returnflag) AS l_returnflag, max(l_linestatus) AS l_linestatus, max(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL))"


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    own = ("l_partkey", "l_returnflag", "l_linestatus", "l_suppkey")
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(*[F.max(c).alias(c) for c in own])
    return rows.selectExpr(*[f"{v} AS {k}" for k, v in _RUN.items()])


def slide_runs(spark: SparkSession, sf: str) -> DataFrame:
    """O-101."""
    return of.slide_runs(_runs(spark, sf), ["para"]).select("para", F.col("first").cast("long").alias("first"), "format", "text", "runs")


def structure_keys(spark: SparkSession, sf: str) -> DataFrame:
    """O-102."""
    key = of.structure_key(F.col("structural"), ["para"], "position")
    return _runs(spark, sf).select("para", "position", key.cast("long").alias("key"))


def token_projection(spark: SparkSession, sf: str) -> DataFrame:
    """O-103."""
    return of.token_projection(_runs(spark, sf), "para")


def sequential_parts(spark: SparkSession, sf: str) -> DataFrame:
    """O-112: the texts of each order over one to five runs."""
    rows = _runs(spark, sf).groupBy("para").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]).alias("parts"))
    return rows.select("para", F.array_join(of.sequential_parts(F.col("parts"), (F.col("para") % 5 + 1).cast("int")), "|").alias("runs"))


def markers(spark: SparkSession, sf: str) -> DataFrame:
    """O-104: paragraphs, rows of tables, and paragraphs on slides."""
    p = spark.read.parquet(f"{sf}/part.parquet")
    story = F.expr("element_at(array('body','header','footer','footnote','endnote'), cast(p_partkey % 5 + 1 as int))")
    scope = F.expr("element_at(array('shape','notes','table'), cast(p_partkey % 3 + 1 as int))")
    note = F.expr("CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN '' ELSE cast(p_size as string) END")
    path = F.expr("CASE WHEN p_size % 2 = 0 THEN array(p_size, 1, 2) ELSE array(p_size) END")
    return p.select(
        "p_partkey",
        of.paragraph_marker(story, F.col("p_size"), note, F.col("p_partkey")).alias("paragraph"),
        of.table_marker(F.col("p_size"), F.col("p_partkey")).alias("row"),
        of.slide_marker(F.col("p_size"), scope, path, F.col("p_size"), F.col("p_partkey"), F.col("p_size")).alias("slide"),
    )


def unique_cells(spark: SparkSession, sf: str) -> DataFrame:
    """O-106: a cell is repeated in the columns that it was merged over."""
    cells = _runs(spark, sf).selectExpr("para AS row", "position AS col", "position div 3 AS cell_id")
    return of.unique_cells(cells, ["row"])


def option_texts(spark: SparkSession, sf: str) -> DataFrame:
    """O-168: written options."""
    p = spark.read.parquet(f"{sf}/part.parquet")
    kind = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'docx' WHEN 1 THEN 'pptx' WHEN 2 THEN 'pdf' END")
    flag = lambda n: F.when(F.col("p_size") % n != 0, F.col("p_size") % 2 == 0)
    return p.select("p_partkey", jb.options_text(kind, {"translate_tables": flag(3), "translate_notes": flag(4), "bilingual": flag(5)}).alias("options"))


def page_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """O-54: orders as pages of documents, line items as blocks, small chunks."""
    lines = _runs(spark, sf).selectExpr("para div 10 AS doc", "para AS page", "position AS block", "concat('[BLOCK_', position, ']', repeat('w ', cast(position * 2 as int)), text) AS line")
    return ck.page_chunks(lines, "doc", 24)


def font_characters(spark: SparkSession, sf: str) -> DataFrame:
    """O-155: the distinct characters of each language's documents by script, sorted."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return tb.characters(docs, ["lang"], "text")


def wrapped_lines(spark: SparkSession, sf: str) -> DataFrame:
    """O-29 and O-153: turns in boxes of 20 to 100 points at a size of 10."""
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", F.col("text").alias("t"), ((F.col("conv_id") % 5 + 1) * 20.0).alias("width"))
    lines = wp.wrap(F.col("t"), F.col("width"), F.lit(10.0))
    return rows.select("conv_id", "turn", F.posexplode(lines).alias("line", "text")).withColumn("line", F.col("line").cast("long"))


def fitted_lines(spark: SparkSession, sf: str) -> DataFrame:
    """O-153: turns on one line of 100 to 3000 points, half of them narrowed."""
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    width, size = ((F.col("conv_id") % 30 + 1) * 100).cast("double"), (F.col("turn") % 3 + 9).cast("double")
    fit = wp.fit_line(F.col("text"), width, size, F.lit(6.0), F.col("conv_id") % 2 == 0, F.lit(80.0))
    return rows.select("conv_id", "turn", fit.alias("f")).select("conv_id", "turn", F.round("f.size", 6).alias("size"), F.round("f.scale", 6).alias("scale"))


QUERIES = {f.__name__: f for f in (fitted_lines, slide_runs, structure_keys, token_projection, sequential_parts, markers, unique_cells, option_texts, page_chunks, font_characters, wrapped_lines)}

_SHAPE = "p_size || CASE WHEN p_size % 2 = 0 THEN '.1.2' ELSE '' END"
_TOKENS = r"len(regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]'))"
ORACLE = {
    "slide_runs": f"""
        WITH r AS (SELECT * FROM {_RUNS} WHERE text <> ''),
        n AS (SELECT *, CASE WHEN lag(format) OVER w = format AND NOT complex AND NOT lag(complex) OVER w AND position - lag(position) OVER w = 1 THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY para ORDER BY position)),
        g AS (SELECT *, sum(new) OVER (PARTITION BY para ORDER BY position) AS run FROM n)
        SELECT para, min(position) AS first, any_value(format) AS format, string_agg(text, '' ORDER BY position) AS text, count(*) AS runs FROM g GROUP BY para, run""",
    "structure_keys": f"SELECT a.para, a.position, (SELECT count(*) FROM {_RUNS} b WHERE b.para = a.para AND b.position < a.position AND b.structural) * 2 + CASE WHEN a.structural THEN 1 ELSE 0 END AS key FROM {_RUNS} a",
    "token_projection": f"""
        WITH r AS (SELECT * FROM {_RUNS} WHERE text <> '' AND NOT structural),
        n AS (SELECT *, CASE WHEN lag(format) OVER w = format AND lag(container) OVER w = container THEN text ELSE CASE WHEN lag(text) OVER w IS NULL THEN '' ELSE '</span>' END || '<span>' || text END AS t FROM r WINDOW w AS (PARTITION BY para ORDER BY position))
        SELECT para, '[PARA_' || para || ']' || string_agg(t, '' ORDER BY position) || '</span>' AS projection FROM n GROUP BY para""",
    "sequential_parts": f"""
        WITH p AS (SELECT para, list(text ORDER BY position) AS parts, para % 5 + 1 AS n FROM {_RUNS} GROUP BY para)
        SELECT para, array_to_string(list_transform(range(1, n + 1), lambda i: CASE WHEN i < n THEN coalesce(parts[i], '') ELSE array_to_string(parts[n:], '') END), '|') AS runs FROM p""",
    "markers": f"""
        WITH p AS (SELECT *, CASE p_partkey % 5 WHEN 0 THEN 'BODY' WHEN 1 THEN 'HEADER' WHEN 2 THEN 'FOOTER' WHEN 3 THEN 'FOOTNOTE' ELSE 'ENDNOTE' END AS story FROM part)
        SELECT p_partkey, '[' || CASE WHEN story = 'BODY' THEN '' WHEN story IN ('HEADER', 'FOOTER') THEN story || '_' || p_size || '_' ELSE story || '_' || CASE WHEN p_size % 3 = 2 THEN CAST(p_size AS VARCHAR) ELSE 'UNKNOWN' END || '_' END || 'PARA_' || p_partkey || ']' AS paragraph,
               '[TABLE_' || p_size || '][ROW_' || p_partkey || ']' AS row,
               '[SLIDE_' || p_size || ']' || CASE p_partkey % 3 WHEN 0 THEN '[SHAPE_' || {_SHAPE} || ']' WHEN 1 THEN '[NOTES]' ELSE '[TABLE_' || {_SHAPE} || '][CELL_' || p_size || '_' || p_partkey || ']' END || '[PARA_' || p_size || ']' AS slide FROM p""",
    "unique_cells": f"SELECT para AS row, position // 3 AS cell_id, min(position) AS col FROM {_RUNS} GROUP BY ALL",
    "option_texts": """
        WITH p AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'docx' WHEN 1 THEN 'pptx' WHEN 2 THEN 'pdf' END AS kind, CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END AS v, p_size AS n FROM part)
        SELECT p_partkey, '{' || CASE WHEN n % 5 <> 0 THEN '"bilingual": ' || v || ', ' ELSE '' END || '"kind": "' || kind || '"' || CASE WHEN n % 4 <> 0 THEN ', "translate_notes": ' || v ELSE '' END || CASE WHEN n % 3 <> 0 THEN ', "translate_tables": ' || v ELSE '' END || '}' AS options FROM p""",
    "page_chunks": f"""
        WITH RECURSIVE l AS (SELECT para // 10 AS doc, para AS page, position AS block, '[BLOCK_' || position || ']' || repeat('w ', position * 2) || text AS line FROM {_RUNS}),
        n AS (SELECT *, {_TOKENS.format('line')} AS t, 24 - {_TOKENS.format("'[PAGE_' || page || ']'")} AS room, row_number() OVER (PARTITION BY page ORDER BY block) AS rn FROM l),
        f AS (SELECT doc, page, block, line, rn, 0 AS chunk, t AS total FROM n WHERE rn = 1
              UNION ALL
              SELECT n.doc, n.page, n.block, n.line, n.rn, CASE WHEN total + t > room THEN chunk + 1 ELSE chunk END, CASE WHEN total + t > room THEN t ELSE total + t END FROM f JOIN n ON n.page = f.page AND n.rn = f.rn + 1)
        SELECT doc, page, CAST(chunk AS BIGINT) AS chunk, '[PAGE_' || page || ']' || chr(10) || string_agg(line, chr(10) ORDER BY block) AS text FROM f GROUP BY doc, page, chunk""",
    "font_characters": f"""
        WITH c AS (SELECT DISTINCT lang, unnest(string_split(text, '')) AS c FROM documents)
        SELECT lang, CASE {" ".join(f"WHEN regexp_matches(c, '^[{chars}]$') THEN '{name}'" for name, chars in SCRIPTS)} ELSE 'en' END AS script, string_agg(c, '' ORDER BY c) AS characters
        FROM c WHERE NOT regexp_matches(c, '^[\\x{{00}}-\\x{{20}}]?$') GROUP BY ALL""",
    "fitted_lines": f"""
        WITH c AS (SELECT conv_id, turn, text AS t, CAST((conv_id % 30 + 1) * 100 AS DOUBLE) AS w, CAST(turn % 3 + 9 AS DOUBLE) AS s FROM conversations),
        u AS (SELECT *, CAST(u AS DOUBLE) AS unit FROM (SELECT *, {_width_sql(PAGE_WIDTHS, 'u')} FROM c)),
        v AS (SELECT *, w / (unit * s) AS share, unit <= 0 OR unit * s <= w * 1.02::DOUBLE AS asis FROM u),
        a AS (SELECT *, greatest(s * share, 6) AS one, greatest(s * greatest(sqrt(share), 6 / s), 6) AS root FROM v),
        b AS (SELECT *, CASE WHEN w / (unit * root) * 100 < 80 AND root > 6 THEN greatest(root * (w / (unit * root) * 100) / 80, 6) ELSE root END AS two FROM a)
        SELECT conv_id, turn, round(CASE WHEN asis THEN s WHEN conv_id % 2 = 1 OR share >= 0.85 THEN one ELSE two END, 6) AS size,
               round(CASE WHEN asis OR conv_id % 2 = 1 THEN 100 WHEN share < 0.85 THEN least(100, greatest(w / (unit * two) * 100, 80))
                          WHEN one <= 6 AND unit * one > w * 1.02::DOUBLE THEN least(100, greatest(w / (unit * one) * 100, 80)) ELSE 100 END, 6) AS scale FROM b""",
    "wrapped_lines": f"""
        WITH RECURSIVE c AS (SELECT conv_id, turn, text, (conv_id % 5 + 1) * 20.0 AS width FROM conversations),
        p AS (SELECT conv_id, turn, width, unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS par, generate_subscripts(string_split(regexp_replace(text, '\\n$', ''), chr(10)), 1) AS k FROM c),
        k AS (SELECT conv_id, turn, width, k, unnest(toks) AS t, generate_subscripts(toks, 1) AS i FROM (SELECT *, CASE WHEN par = '' THEN [''] ELSE regexp_extract_all(par, '(?s)(?:{wp.WORD.replace("'", "''")}|\\S)[\\s{wp.STAYING}]*') END AS toks FROM p)),
        w AS (SELECT *, {_width_sql(PAGE_WIDTHS, 'u')} FROM k),
        b AS (SELECT *, u * 10 > width * 1.05 AND length(t) > 1 AS broken FROM w),
        x AS (SELECT conv_id, turn, width, k, i, 0 AS j, t FROM b WHERE NOT broken UNION ALL SELECT conv_id, turn, width, k, i, unnest(range(1, length(t) + 1)), unnest(string_split(t, '')) FROM b WHERE broken),
        y AS (SELECT *, {_width_sql(PAGE_WIDTHS, 'u')}, row_number() OVER (PARTITION BY conv_id, turn ORDER BY k, i, j) AS rn FROM x),
        f AS (SELECT conv_id, turn, rn, k, 0 AS line, t, CAST(u * 10 AS DOUBLE) AS w FROM y WHERE rn = 1
              UNION ALL
              SELECT y.conv_id, y.turn, y.rn, y.k, CASE WHEN y.k <> f.k OR (f.t <> '' AND f.w + y.u * 10 > width * 1.01) THEN line + 1 ELSE line END,
                     CASE WHEN y.k <> f.k OR (f.t <> '' AND f.w + y.u * 10 > width * 1.01) THEN y.t ELSE f.t || y.t END,
                     CASE WHEN y.k <> f.k OR (f.t <> '' AND f.w + y.u * 10 > width * 1.01) THEN y.u * 10 ELSE f.w + y.u * 10 END
              FROM f JOIN y ON y.conv_id = f.conv_id AND y.turn = f.turn AND y.rn = f.rn + 1)
        SELECT conv_id, turn, line, regexp_replace(arg_max(t, rn), '\\s+$', '') AS text FROM f GROUP BY conv_id, turn, line""",
}
