"""Queries of Markdown and office structure, derived from conversations and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import markdown as md
from textloom.operators import office as of
from textloom.operators.dealing import dealt

# One line of each turn as Markdown, by its place.
_LINE = """concat_ws('\n', CASE turn % 3 WHEN 0 THEN concat('# ', role) WHEN 1 THEN concat('- [x] ', role) ELSE concat('> ', role) END,
    CASE WHEN turn % 2 = 0 THEN '' ELSE concat('| ', role, ' | b |') END, CASE WHEN turn % 4 = 1 THEN '|---|---|' WHEN turn % 4 = 3 THEN '|---|' ELSE 'plain' END,
    CASE WHEN turn % 5 < 3 THEN '| x \\\\| y | z |' ELSE 'tail' END, text, '')"""
_LINE_DUCK = _LINE.replace("'\n'", "chr(10)").replace("\\\\|", "\\|")


def _markdown(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select(F.col("conv_id").alias("doc_id"), "turn", F.expr(_LINE).alias("piece"))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("turn", "piece"))), lambda x: x["piece"])
    return rows.groupBy("doc_id").agg(F.array_join(pieces, "\n").alias("text"))


def md_line_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """O-23 to O-26."""
    return md.line_kinds(_markdown(spark, sf)).select("doc_id", F.col("line").cast("long").alias("line"), "kind", F.col("prefix").cast("long").alias("prefix"))


def md_segments(spark: SparkSession, sf: str) -> DataFrame:
    """O-23 and O-27."""
    return md.segments(_markdown(spark, sf)).select("doc_id", "seg_order", "kind", F.md5(F.col("source_text").cast("binary")).alias("text_md5"))


def md_protect(spark: SparkSession, sf: str) -> DataFrame:
    """O-85 to O-89 on texts with code, links and front matter."""
    code = F.concat(F.lit("---\na: b\n---\n"), "text", F.lit("\n```py\nx\n```\n[l](http://e.x/a_(b)) and `code`\n"))
    found = md.protect(_markdown(spark, sf).withColumn("text", code))
    return found.select("doc_id", F.size("spans").cast("long").alias("protected"), F.array_join("context", "|").alias("context"), "restored")


def run_merge(spark: SparkSession, sf: str) -> DataFrame:
    """O-100: turns as runs, the role as format."""
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", F.expr("CASE WHEN length(text) % 3 = 0 THEN 'bold' ELSE 'plain' END").alias("fmt"), F.col("text").alias("t"))
    return of.merge_runs(rows, ["conv_id"], "turn", "fmt", "t").select("conv_id", F.col("run").cast("long").alias("run"), "fmt", "t", "runs")


def a1_refs(spark: SparkSession, sf: str) -> DataFrame:
    """O-108 and O-104: cell references and markers of parts as cells."""
    rows = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_size", (F.col("p_partkey") % 800 + 1).cast("long").alias("c"))
    ref = of.cell_reference(F.col("p_size"), F.col("c"))
    return rows.select("p_partkey", ref.alias("ref"), F.concat(F.lit("[SHEET_1][CELL_"), ref, F.lit("]")).alias("marker"))


def merged_skip(spark: SparkSession, sf: str) -> DataFrame:
    """O-13 and O-108: references of merged cells that are not the first."""
    ranges = spark.read.parquet(f"{sf}/part.parquet").select(
        "p_partkey", F.col("p_brand").alias("sheet"), F.col("p_size").alias("row1"), (F.col("p_size") + F.col("p_partkey") % 2).cast("int").alias("row2"),
        (F.col("p_partkey") % 20 + 1).cast("int").alias("col1"), (F.col("p_partkey") % 20 + 1 + F.col("p_partkey") % 3).cast("int").alias("col2"),
    )
    return of.merged_children(ranges)


def table_header_rename(spark: SparkSession, sf: str) -> DataFrame:
    """O-109."""
    rows = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey")
    names = F.array(*[F.lit(n) for n in ("A", "B", "C")])
    update = lambda i, n: F.struct((i % 5).cast("int").alias("index"), n.alias("name"))
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    updates = F.array(
        update(key, F.when(cust % 3 == 0, "B").otherwise(" x  y ")), update(key + 1, F.when(cust % 2 == 0, "").otherwise("z"))
    )
    return rows.select("o_orderkey", F.array_join(of.rename_headers(names, updates), ",").alias("names"))


def structure_signatures(spark: SparkSession, sf: str) -> DataFrame:
    """O-110: signatures before and after a change of every tenth order's tax; how many stay equal."""
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_tax")
    after = rows.withColumn("l_tax", F.when(F.col("l_orderkey") % 10 == 0, F.col("l_tax") + 1).otherwise(F.col("l_tax")))
    keys, order, columns = ["l_orderkey"], ["l_linenumber", "l_partkey"], ["l_tax"]
    both = of.signature(rows, keys, order, columns).join(of.signature(after, keys, order, columns).withColumnRenamed("signature", "after"), keys)
    return both.groupBy((F.col("signature") == F.col("after")).alias("same")).agg(F.count(F.lit(1)).alias("n"))


def run_write_back(spark: SparkSession, sf: str) -> DataFrame:
    """O-111 and O-150: span texts on the first run of each group."""
    runs = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", (F.col("turn") % 3).alias("run"), F.col("turn").alias("position"))
    spans = runs.select("conv_id", "run").distinct().withColumn("span", F.concat(F.lit("S"), F.col("run").cast("string")))
    return of.write_back(runs, spans, ["conv_id"]).select("conv_id", "position", "text")


def table_flatten(spark: SparkSession, sf: str) -> DataFrame:
    """O-105: line items as nested tables, each below the one before it."""
    items = spark.read.parquet(f"{sf}/lineitem.parquet")
    n = items.count()
    tables = dealt(items.select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber", rows=n).distinct().select(
        F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("table_id"), (F.col("l_linenumber") % 4).alias("idx"),
        F.when(F.col("l_linenumber") > 1, F.col("l_linenumber") - 1).alias("parent"),
    )
    return of.flatten_tables(tables, rows=n).select("doc", "table_id", "effective", F.col("level").cast("long").alias("level"))


def cell_markup(spark: SparkSession, sf: str) -> DataFrame:
    """O-106, O-107 and O-114."""
    rows = spark.read.parquet(f"{sf}/conversations.parquet").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("t")))).alias("p"))
    paragraphs = F.transform("p", lambda x: F.when(x["turn"] % 4 == 3, F.expr("cast(array() as array<string>)")).otherwise(F.array(x["t"])))
    return rows.select("conv_id", of.marked_cell(paragraphs).alias("markup"), of.bilingual(F.col("p")[0]["t"], F.lit("T")).alias("bilingual"))


QUERIES = {f.__name__: f for f in (
    md_line_kinds, md_segments, md_protect, run_merge, a1_refs, merged_skip, table_header_rename, structure_signatures, run_write_back, table_flatten, cell_markup,
)}

_SIG = r"regexp_replace(regexp_replace(content, '^[ \t]+|[ \t]+$', '', 'g'), '\\.', '__', 'g')"
_KINDS = rf"""
    WITH docs AS (SELECT conv_id AS doc_id, string_agg({_LINE_DUCK}, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
    l AS (SELECT doc_id, u.i AS line, u.t AS content FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda t, i: {{'t': t, 'i': i - 1}})) AS u FROM docs)),
    g AS (SELECT *, regexp_replace(content, '^\s+|\s+$', '', 'g') AS core, {_SIG} AS bare FROM l),
    p AS (SELECT *, length(bare) - length(replace(bare, '|', '')) AS pipes,
                 length(bare) - length(replace(bare, '|', '')) + 1 - CAST(starts_with(bare, '|') AS INT) - CAST(bare LIKE '%|' AS INT) AS cells,
                 regexp_matches(core, '^\s*\|?(?:\s*:?-+:?\s*\|)+\s*:?-+:?\s*\|?\s*$') AS separator FROM g),
    v AS (SELECT *, coalesce(separator AND lag(pipes) OVER w > 0 AND lag(cells) OVER w = cells, false) AS valid FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
    t AS (SELECT *, max(CASE WHEN valid THEN line END) OVER u AS ls, max(CASE WHEN pipes = 0 THEN line END) OVER u AS lp, lead(valid) OVER w AS header
          FROM v WINDOW w AS (PARTITION BY doc_id ORDER BY line), u AS (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING)),
    k AS (SELECT *, CASE WHEN core = '' OR separator THEN 'break' WHEN coalesce(line > ls AND coalesce(lp, -1) < ls, false) OR coalesce(header, false) THEN 'table_row'
                         WHEN regexp_matches(content, '^#{{1,6}}[ \t]+') THEN 'heading' WHEN regexp_matches(content, '^(?:>[ \t]*)+') THEN 'blockquote'
                         WHEN regexp_matches(content, '^\s*(?:[-+*]|\d+\.)\s+(?:\[[ xX]\]\s+)?') THEN 'list_item' ELSE 'paragraph' END AS kind FROM t),
    f AS (SELECT *, CASE kind WHEN 'heading' THEN length(regexp_extract(content, '^#{{1,6}}[ \t]+')) WHEN 'blockquote' THEN length(regexp_extract(content, '^(?:>[ \t]*)+'))
                         WHEN 'list_item' THEN length(regexp_extract(content, '^\s*(?:[-+*]|\d+\.)\s+(?:\[[ xX]\]\s+)?')) ELSE 0 END AS prefix FROM k)"""
_LETTERS = "CASE WHEN c > 702 THEN chr(CAST(65 + (c - 703) // 676 AS INT)) || chr(CAST(65 + ((c - 703) // 26) % 26 AS INT)) WHEN c > 26 THEN chr(CAST(64 + (c - 1) // 26 AS INT)) ELSE '' END || chr(CAST(65 + (c - 1) % 26 AS INT))"
ORACLE = {
    "md_line_kinds": _KINDS + " SELECT doc_id, line, kind, CAST(prefix AS BIGINT) AS prefix FROM f",
    "md_segments": _KINDS + r"""
        , i AS (SELECT *, sum(CASE WHEN kind <> 'paragraph' OR coalesce(pk, '') <> 'paragraph' OR pl + 1 <> line THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS island
                FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY line) AS pk, lag(line) OVER (PARTITION BY doc_id ORDER BY line) AS pl FROM f WHERE kind <> 'break')),
        s AS (SELECT doc_id, island, min(kind) AS kind, CASE WHEN min(kind) = 'paragraph' THEN regexp_replace(string_agg(content, chr(10) ORDER BY line), '^\s+|\s+$', '', 'g')
                     ELSE substr(min(content), CAST(max(prefix) AS BIGINT) + 1) END AS body FROM i GROUP BY doc_id, island)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY island) - 1 AS seg_order, kind, md5(body) AS text_md5 FROM s WHERE regexp_matches(body, '\S')""",
    "run_merge": """
        WITH r AS (SELECT conv_id, turn, CASE WHEN length(text) % 3 = 0 THEN 'bold' ELSE 'plain' END AS fmt, text AS t FROM conversations),
        n AS (SELECT *, CASE WHEN fmt = lag(fmt) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS new FROM r),
        g AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS run FROM n)
        SELECT conv_id, CAST(run AS BIGINT) AS run, min(fmt) AS fmt, string_agg(t, '' ORDER BY turn) AS t, count(*) AS runs FROM g GROUP BY conv_id, run""",
    "a1_refs": f"SELECT p_partkey, {_LETTERS} || p_size AS ref, '[SHEET_1][CELL_' || {_LETTERS} || p_size || ']' AS marker FROM (SELECT *, p_partkey % 800 + 1 AS c FROM part)",
    "merged_skip": f"""
        WITH c AS (SELECT p_brand AS sheet, p_size AS row1, p_partkey % 20 + 1 AS col1, unnest(range(p_size, p_size + p_partkey % 2 + 1)) AS row, p_partkey FROM part),
        d AS (SELECT *, unnest(range(col1, col1 + p_partkey % 3 + 1)) AS c FROM c)
        SELECT DISTINCT sheet, {_LETTERS} || row AS ref FROM d WHERE row <> row1 OR c <> col1""",
    "table_header_rename": """
        WITH u AS (SELECT o_orderkey, o_orderkey % 5 AS i1, CASE WHEN o_custkey % 3 = 0 THEN 'B' ELSE 'x y' END AS n1, (o_orderkey + 1) % 5 AS i2, CASE WHEN o_custkey % 2 = 0 THEN '' ELSE 'z' END AS n2 FROM orders),
        o AS (SELECT o_orderkey, CASE WHEN i1 <= i2 THEN [{'i': i1, 'n': n1}, {'i': i2, 'n': n2}] ELSE [{'i': i2, 'n': n2}, {'i': i1, 'n': n1}] END AS u FROM u),
        a AS (SELECT *, CASE WHEN u[1].i BETWEEN 1 AND 3 AND u[1].n <> '' AND NOT (u[1].n = 'B' AND u[1].i <> 2) THEN list_transform(['A', 'B', 'C'], lambda x, k: CASE WHEN k = u[1].i THEN u[1].n ELSE x END) ELSE ['A', 'B', 'C'] END AS s FROM o)
        SELECT o_orderkey, array_to_string(CASE WHEN u[2].i BETWEEN 1 AND 3 AND u[2].n <> '' AND len(list_filter(s, lambda x, k: k <> u[2].i AND x = u[2].n)) = 0
               THEN list_transform(s, lambda x, k: CASE WHEN k = u[2].i THEN u[2].n ELSE x END) ELSE s END, ',') AS names FROM a""",
    "structure_signatures": """
        WITH s AS (SELECT l_orderkey, list(l_tax ORDER BY l_linenumber, l_partkey, l_tax) AS a, list(CASE WHEN l_orderkey % 10 = 0 THEN l_tax + 1 ELSE l_tax END ORDER BY l_linenumber, l_partkey, l_tax) AS b FROM lineitem GROUP BY l_orderkey)
        SELECT a = b AS same, count(*) AS n FROM s GROUP BY ALL""",
    "run_write_back": "SELECT conv_id, turn AS position, CASE WHEN row_number() OVER (PARTITION BY conv_id, turn % 3 ORDER BY turn) = 1 THEN 'S' || (turn % 3) ELSE '' END AS text FROM conversations",
    "table_flatten": """
        WITH RECURSIVE t AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS id, l_linenumber % 4 AS idx FROM lineitem),
        f AS (SELECT doc, id AS table_id, CAST(idx AS BIGINT) AS effective, CAST(0 AS BIGINT) AS level FROM t WHERE id = 1
              UNION ALL SELECT t.doc, t.id, (f.effective + 1) * 1000 + t.idx, f.level + 1 FROM f JOIN t ON t.doc = f.doc AND t.id = f.table_id + 1 WHERE f.level < 3)
        SELECT doc, table_id, effective, level FROM f""",
    "cell_markup": """
        WITH p AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN '<span></span>' ELSE '<span>' || text || '</span>' END AS b, text AS t FROM conversations)
        SELECT conv_id, CASE WHEN count(*) > 1 THEN string_agg('<p>' || b || '</p>', '' ORDER BY turn) ELSE min(b) END AS markup, arg_min(t, turn) || chr(10) || 'T' AS bilingual FROM p GROUP BY conv_id""",
}
