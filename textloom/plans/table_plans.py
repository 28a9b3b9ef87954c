"""Queries of table grids, pages, batches of calls, and job lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import language as lg
from textloom.operators import batches as bt
from textloom.operators import chunks as ck
from textloom.operators import inventory as inv
from textloom.operators import jobs as jb
from textloom.operators import layout as lo
from textloom.operators import tables as tb
from textloom.operators.dealing import dealt
from textloom.plans.jobs_plans import _C, _current
from textloom.plans.layout_plans import _BASE, _boxes


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def line_centres(spark: SparkSession, sf: str) -> DataFrame:
    """O-130."""
    rows = _boxes(spark, sf).select("page", "size", ((F.col("y1") + F.col("y2")) / 2).alias("cy"))
    out = tb.line_centres(rows, ["page"]).select("page", F.posexplode("centres").alias("line", "centre"))
    return out.select("page", F.col("line").cast("long").alias("line"), F.round("centre", 6).alias("centre"))


def attached_lines(spark: SparkSession, sf: str) -> DataFrame:
    """O-128 and O-129."""
    rows = _boxes(spark, sf).select("page", "span_id", "x1", "x2", "size", "text", ((F.col("y1") + F.col("y2")) / 2).alias("cy"))
    return lo.reading_order(lo.attached_lines(rows, ["page"]), ["page"]).select("page", "span_id", "line", "place")


_ITEM = (
    "l_orderkey AS page", "CASE WHEN l_linenumber % 3 = 0 THEN 'line' ELSE 'rect' END AS shape", "l_returnflag = 'A' AS fill", "l_linestatus = 'F' AS stroke",
    "l_linenumber * CAST(0.25 AS DOUBLE) AS width", "CAST(l_partkey % 500 AS DOUBLE) AS x1", "CAST(l_suppkey % 700 AS DOUBLE) AS y1",
    "CAST(l_partkey % 500 AS DOUBLE) + CASE l_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 40 WHEN 2 THEN 3 ELSE 0 END AS x2",
    "CAST(l_suppkey % 700 AS DOUBLE) + CASE l_suppkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 25 END AS y2",
)


def table_rulings(spark: SparkSession, sf: str) -> DataFrame:
    """O-133."""
    return tb.rulings(_table(spark, sf, "lineitem").selectExpr(*_ITEM), ["page"])


def unreliable_cells(spark: SparkSession, sf: str) -> DataFrame:
    """O-136: every page's spans in cells of a third of its width, and a ruling through each third page."""
    left = F.floor(F.col("x1") / 250) * 250.0
    spans = _boxes(spark, sf).select(
        "page", "size", ((F.col("y1") + F.col("y2")) / 2).alias("cy"), left.alias("c_x1"), F.lit(0.0).alias("c_y1"), (left + 250.0).alias("c_x2"), F.lit(800.0).alias("c_y2")
    )
    flat = spans.where("page % 3 = 0").select("page").distinct().select("page", F.lit("h").alias("direction"), F.lit(-1.0).alias("x1"), F.lit(600.0).alias("x2"), F.lit(400.0).alias("y1"))
    return tb.unreliable_cells(spans, "page", flat).select("page", "c_x1")


def compact_cells(spark: SparkSession, sf: str) -> DataFrame:
    """O-146."""
    rows = _boxes(spark, sf).withColumns({"cell": F.col("span_id") % 3, "height": (F.col("page") % 9) * 80.0})
    return tb.compact_cells(rows, ["page", "cell"], "height")


_MARKED = {
    "block": "span_id % 3",
    "label": "CASE (page + span_id % 3) % 7 WHEN 0 THEN 'number' WHEN 1 THEN 'header' ELSE 'text' END",
    "seen": "CASE WHEN span_id % 53 = 0 THEN '(cid:7)x' WHEN span_id % 5 = 0 THEN ' ' ELSE text END",
    "visible": "span_id % 47 <> 0",
    "transparent": "span_id % 43 = 0",
    "mode": "CASE span_id % 41 WHEN 0 THEN 3 WHEN 1 THEN 7 ELSE 0 END",
    "kept": "colour <> 'N'",
}
_MARKED_SQL = ", ".join(f"{v} AS {k}" for k, v in _MARKED.items())


def _marked(spark: SparkSession, sf: str) -> DataFrame:
    return _boxes(spark, sf).selectExpr("page", "span_id", *[f"{v} AS {k}" for k, v in _MARKED.items()]).withColumnRenamed("seen", "text")


def preserve_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """O-142."""
    return tb.preserve_blocks(_marked(spark, sf), "page", "block")


def scan_gate(spark: SparkSession, sf: str) -> DataFrame:
    """O-143: pages in documents of up to 20."""
    spans = _marked(spark, sf).withColumn("doc", F.floor(F.col("page") / 20).cast("long"))
    cover = spans.select("doc", "page").distinct().withColumn("cover", (F.col("page") % 10) / 14.0)
    return tb.scan_gate(spans, cover, "doc", "page")


def translated_spans(spark: SparkSession, sf: str) -> DataFrame:
    """O-150: blocks with one answer, with one for each span, and without."""
    spans = _marked(spark, sf).select("page", "block", "span_id", "kept")
    whole = spans.where("block = 0").select("page", "block").distinct().select("page", "block", F.lit(None).cast("long").alias("marker"), F.concat(F.lit("W"), F.col("page")).alias("text"))
    own = spans.where("block = 1 AND span_id % 4 <> 0").select("page", "block", F.col("span_id").alias("marker"), F.concat(F.lit("T"), F.col("span_id")).alias("text"))
    return tb.translated_spans(spans, whole.unionByName(own), ["page", "block"])


_SIDE = "SELECT l_orderkey AS doc, l_linenumber AS page, CAST(max(400 + l_quantity) AS DOUBLE) AS width, CAST(max(600 + l_suppkey % 90) AS DOUBLE) AS height FROM lineitem GROUP BY 1, 2"


def side_by_side(spark: SparkSession, sf: str) -> DataFrame:
    """O-157: some translations lack a page, others have one more."""
    items = _table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"), "l_quantity", "l_suppkey")
    left = items.groupBy("doc", "page").agg((F.max(400 + F.col("l_quantity"))).cast("double").alias("width"), F.max(600 + F.col("l_suppkey") % 90).cast("double").alias("height"))
    right = left.where("NOT (doc % 7 = 0 AND page = 1)").select("doc", F.when(F.col("doc") % 11 == 0, F.col("page") + 1).otherwise(F.col("page")).alias("page"), (F.col("width") + 10).alias("width"), (F.col("height") - 30).alias("height"))
    return tb.side_by_side(left, right, "doc", 24.0)


def font_languages(spark: SparkSession, sf: str) -> DataFrame:
    """O-44 over the names it knows, in the given and other letter case, and over names it does not know."""
    names = F.array(*[F.lit(n) for names in lg.FONT_LANGUAGES.values() for n in names], F.lit("klingon"), F.lit(""))
    rows = _table(spark, sf, "part").select("p_partkey", F.element_at(names, (F.col("p_partkey") % F.size(names) + 1).cast("int")).alias("name"))
    shown = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), F.upper("name"))).otherwise(F.col("name"))
    return rows.select("p_partkey", lg.font_language(shown).alias("language"))


def indexed_answers(spark: SparkSession, sf: str) -> DataFrame:
    """O-65 and O-66 with each batch's own size: which answers are kept by either rule."""
    rows = _table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("batch"), (F.col("l_partkey") % 5 - 1).alias("index"), (F.col("l_orderkey") % 3 + 1).alias("n"),
        (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("arrival"), F.col("l_suppkey").cast("string").alias("text"),
    ).groupBy("batch", "index", "n", "arrival").agg(F.max("text").alias("text"))
    once = bt.indexed_once(rows, "batch", "index", "n").select("batch", "index", "text", F.lit("once").alias("rule"))
    strict = bt.indexed_strictly(rows, "batch", "index", "n", "arrival", "text").select("batch", "index", "text", F.lit("strict").alias("rule"))
    return once.unionByName(strict)


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    items = _table(spark, sf, "lineitem")
    rows = dealt(items.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_orderkey", rows=items.count())
    rows = rows.withColumn("index", (F.row_number().over(order) - 1).cast("long"))
    text = F.when(F.col("l_partkey") % 6 == 0, "   ").otherwise(F.concat(F.lit("alpha beta "), F.col("l_partkey").cast("string")))
    hint = F.when(F.col("l_orderkey") % 4 == 0, "docx").otherwise("txt")
    return rows.select(F.col("l_orderkey").alias("batch"), "index", text.alias("text"), F.lit("en").alias("source"), F.lit("fr").alias("target"), hint.alias("hint"))


def batch_calls(spark: SparkSession, sf: str) -> DataFrame:
    """O-60: a translator that leaves half of the texts unchanged, and some of them again; answers and usage."""
    first = lambda t: F.when(t.rlike("[0-4]$"), t).otherwise(F.concat(F.lit("T:"), t))
    again = lambda t: F.when(t.rlike("[02]$"), t).otherwise(F.concat(F.lit("R:"), t))
    return bt.call_batches(_requests(spark, sf), "batch", first, again, lambda t: F.length(t).cast("long"))


def call_attempts(spark: SparkSession, sf: str) -> DataFrame:
    """O-61: calls of up to seven possible outcomes, two retries."""
    rows = _table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("call"), (F.col("l_linenumber") - 1).alias("attempt")).agg(F.max("l_partkey").alias("k"))
    rows = rows.select("call", "attempt", (F.col("k") % 3 == 0).alias("ok"), (F.col("k") % 5 != 0).alias("retryable"))
    return bt.attempts(rows, "call", 2, 0.5)


def ordered_commits(spark: SparkSession, sf: str) -> DataFrame:
    """O-56: the groups of each order settle in another order; some never do."""
    rows = _table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("job"), F.col("l_linenumber").cast("long").alias("grp")).agg(F.max("l_partkey").alias("k"))
    at = F.when(F.col("k") % 29 != 0, F.col("k"))
    return bt.committed(rows.withColumn("settled", at), "job", "grp", "settled")


def concurrency(spark: SparkSession, sf: str) -> DataFrame:
    """O-57 over numbers, other JSON values and nulls, and O-58: requests of types of events over the slots."""
    value = F.expr("CASE event_id % 6 WHEN 0 THEN 'true' WHEN 1 THEN cast(event_id % 40 as string) WHEN 2 THEN '-3' WHEN 3 THEN '2.5' WHEN 4 THEN NULL ELSE '99999999999' END")
    rows = _table(spark, sf, "events").select(F.col("event_type").alias("provider"), (F.col("user_id") % 3).alias("model"), "event_id", value.alias("value"))
    limits = rows.select("provider", "model").distinct().where("model > 0").withColumn("slots", F.when(F.col("model") == 1, 4).otherwise(50))
    dealt = bt.model_slots(rows.select("provider", "model", "event_id"), limits, ["provider", "model"], "event_id")
    return dealt.join(rows.select("event_id", bt.job_concurrency(F.col("value")).cast("long").alias("in_flight")), "event_id")


def create_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """O-160: half of the requests are new."""
    orders = _table(spark, sf, "orders")
    name = F.concat(F.lit("Report "), F.col("o_orderkey").cast("string")).alias("source_name")
    jobs = orders.where("o_orderkey % 3 <> 0").select(
        F.col("o_orderkey").alias("id"), name, F.lit("running").alias("status"), F.lit(7).cast("long").alias("progress"), F.lit("t0").alias("created_at"), F.lit("t0").alias("updated_at")
    )
    requests = orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), name)
    return jb.create(jobs, requests, F.lit("t1"))


def upsert_front(spark: SparkSession, sf: str) -> DataFrame:
    """O-197: a list of nations, to which regions come in with ids of some of them."""
    jobs = _table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_nationkey").cast("long").alias("place"), F.col("n_name").alias("name"))
    fresh = _table(spark, sf, "region").select((F.col("r_regionkey").cast("long") * 7 % 13 + 20).alias("id"), F.col("r_regionkey").cast("long").alias("place"), F.col("r_name").alias("name"))
    return jb.upsert_front(jobs, "id", "place", fresh)


_KINDS = "CASE p_partkey % 5 WHEN 0 THEN 'docx' WHEN 1 THEN 'pptx' WHEN 2 THEN 'pdf' WHEN 3 THEN 'xlsx' ELSE 'txt' END"


def document_options(spark: SparkSession, sf: str) -> DataFrame:
    """O-169: options that are missing, of the document's kind, or of another."""
    rows = _table(spark, sf, "part").select("p_partkey", F.expr(_KINDS).alias("kind"), "p_size")
    given = F.expr("CASE p_size % 3 WHEN 0 THEN kind WHEN 1 THEN 'docx' END")
    flag = lambda n: F.when(F.col("p_size") % n == 0, None).otherwise(F.col("p_size") % (n + 1) == 0)
    options, error = jb.document_options(F.col("kind"), given, {"translate_tables": flag(4), "bilingual": flag(5), "translate_notes": flag(6)})
    return rows.select("p_partkey", "kind", *[v.alias(k) for k, v in options.items()], error.alias("error"))


def model_list(spark: SparkSession, sf: str) -> DataFrame:
    """O-186."""
    return inv.listed(_current(spark, sf).select("provider", "model_id", "enabled"))


_WORDS = "CASE span_id % 6 WHEN 0 THEN '报告' WHEN 1 THEN 'alpha beta' WHEN 2 THEN ',' WHEN 3 THEN '（' WHEN 4 THEN '第' ELSE text END"


def cell_texts(spark: SparkSession, sf: str) -> DataFrame:
    """O-147, cells."""
    spans = _boxes(spark, sf).selectExpr("page", "span_id % 2 AS cell", "span_id", f"{_WORDS} AS text")
    return ck.cell_text(spans, ["page", "cell"], ["span_id"])


def line_texts(spark: SparkSession, sf: str) -> DataFrame:
    """O-147, lines."""
    spans = _boxes(spark, sf).selectExpr("page", "span_id % 2 AS line", "span_id", "x1", "x1 + size * (span_id % 9) AS x2", "size", f"{_WORDS} AS text")
    return ck.line_text(spans, ["page", "line"])


def rendered_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """O-149: documents of eight pages, blocks with a text, with spans and with neither."""
    spans = _boxes(spark, sf).selectExpr("page div 8 AS doc", "page", "span_id % 3 AS block", "span_id", "text")
    named = F.transform(F.array_sort(F.collect_list(F.struct("span_id", "text"))), lambda x, i: F.struct(F.format_string("SPAN_%d", i).alias("name"), x["text"].alias("text")))
    rows = spans.groupBy("doc", "page", "block").agg(named.alias("spans")).withColumn("plain", F.when(F.col("block") == 0, F.concat(F.lit("p"), F.col("page").cast("string"))))
    rows = rows.withColumn("spans", F.when(F.col("block") != 0, F.when(F.col("page") % 5 != 0, F.col("spans"))))
    return ck.rendered(rows.withColumn("spans", F.coalesce("spans", F.expr("cast(array() as array<struct<name:string,text:string>>)"))), "doc")


_CHUNK = """concat('[PAGE_', conv_id, ']\n[BLOCK_0]', role, '\n[BLOCK_1]<SPAN_0>', role, '</SPAN_0><SPAN_1>', turn, '</SPAN_1>\n[PAGE_', conv_id + 1, ']\n[BLOCK_0]', replace(left(text, 30), '\n', ' '))"""
_BROKEN = """CASE (conv_id + turn) % 9 WHEN 0 THEN c WHEN 1 THEN replace(c, '<SPAN_1>', '') WHEN 2 THEN replace(c, 'SPAN_1', 'SPAN_0') WHEN 3 THEN concat('x\n', c) WHEN 4 THEN replace(c, '[BLOCK_1]', '[BLOCK_2]')
    WHEN 5 THEN replace(c, concat('[BLOCK_0]', role), concat('[BLOCK_0]<SPAN_2>a</SPAN_2> <SPAN_7>b</SPAN_7>')) WHEN 6 THEN replace(c, concat('<SPAN_0>', role), '<SPAN_0> ') WHEN 7 THEN replace(c, '\n[BLOCK_1]', '\n\n [BLOCK_1]')
    ELSE replace(c, '</SPAN_0><SPAN_1>', '</SPAN_1><SPAN_0>') END"""


def chunk_answers(spark: SparkSession, sf: str) -> DataFrame:
    """O-80 and O-81: answers with faults against their sources."""
    rows = _table(spark, sf, "conversations").select("conv_id", "turn", "role", F.expr(_CHUNK).alias("c")).withColumn("answer", F.expr(_BROKEN))
    source, answer = ck.parse_chunk(F.col("c")), ck.parse_chunk(F.col("answer"))
    rows = rows.select("conv_id", "turn", F.explode(F.array(F.struct(source.alias("s"), answer.alias("a")))).alias("p"))
    return rows.select(
        "conv_id", "turn", F.coalesce(F.size("p.s.blocks"), F.lit(0)).cast("long").alias("source_blocks"), F.coalesce(F.size("p.a.blocks"), F.lit(0)).cast("long").alias("answer_blocks"),
        ck.fits(F.col("p.s"), F.col("p.a")).alias("fits"),
    )


QUERIES = {f.__name__: f for f in (
    cell_texts, line_texts, rendered_blocks, chunk_answers, attached_lines, line_centres, table_rulings, unreliable_cells, compact_cells, preserve_blocks, scan_gate, translated_spans, side_by_side, font_languages, indexed_answers,
    batch_calls, call_attempts, ordered_commits, concurrency, create_jobs, upsert_front, document_options, model_list,
)}

_CENTRES = lambda source, keys: f"""t AS (SELECT {keys}, greatest(median(size) * 0.55, 1.5) AS tol FROM {source} GROUP BY {keys}),
    n AS (SELECT {source}.*, tol, row_number() OVER (PARTITION BY {keys} ORDER BY cy, span_id) AS rn FROM {source} JOIN t USING ({keys})),
    f AS (SELECT {keys}, rn, 0 AS line, CAST(cy AS DOUBLE) AS total, 1 AS many FROM n WHERE rn = 1
          UNION ALL
          SELECT {keys}, n.rn, CASE WHEN abs(n.cy - total / many) <= n.tol THEN line ELSE line + 1 END, CASE WHEN abs(n.cy - total / many) <= n.tol THEN total + n.cy ELSE n.cy END,
                 CASE WHEN abs(n.cy - total / many) <= n.tol THEN many + 1 ELSE 1 END
          FROM f JOIN n USING ({keys}) WHERE n.rn = f.rn + 1)"""  # noqa: E731
_M = f", m AS (SELECT page, span_id, {_MARKED_SQL} FROM s)"
_HIDDEN = "(NOT visible OR transparent OR mode IN (3, 7))"
_NAMES = "[" + ", ".join(f"'{n}'" for names in lg.FONT_LANGUAGES.values() for n in names) + ", 'klingon', '']"
_LANGUAGES = " ".join(f"WHEN n IN ({', '.join(repr(n) for n in names)}) THEN '{code}'" for code, names in lg.FONT_LANGUAGES.items())
_EDGE = lambda a, b, c, d: f"SELECT page, width, {a} AS a, {b} AS b, {c} AS c, {d} AS d FROM k WHERE NOT thin AND stroke"
ORACLE = {
    "line_centres": _BASE + ", c AS (SELECT page, span_id, size, (y1 + y2) / 2 AS cy FROM s), " + _CENTRES("c", "page") + " SELECT page, CAST(line AS BIGINT) AS line, round(max_by(total / many, many), 6) AS centre FROM f GROUP BY page, line",
    "table_rulings": f"""
        WITH i AS (SELECT {', '.join(_ITEM)} FROM lineitem), k AS (SELECT *, shape = 'rect' AND fill AND x2 > x1 AND y2 > y1 AND ((y2 - y1 <= 1.25 AND x2 - x1 >= 2) OR (x2 - x1 <= 1.25 AND y2 - y1 >= 2)) AS thin FROM i),
        e AS ({_EDGE('x1', 'y1', 'x2', 'y1')} AND shape = 'rect' UNION ALL {_EDGE('x2', 'y1', 'x2', 'y2')} AND shape = 'rect' UNION ALL {_EDGE('x2', 'y2', 'x1', 'y2')} AND shape = 'rect'
              UNION ALL {_EDGE('x1', 'y2', 'x1', 'y1')} AND shape = 'rect' UNION ALL {_EDGE('x1', 'y1', 'x2', 'y2')} AND shape = 'line'),
        g AS (SELECT *, CASE WHEN abs(d - b) <= greatest(0.75, width * 2) AND abs(c - a) >= greatest(2, width * 3) THEN 'h' WHEN abs(c - a) <= greatest(0.75, width * 2) AND abs(d - b) >= greatest(2, width * 3) THEN 'v' END AS direction FROM e)
        SELECT page, 'h' AS direction, x1, (y1 + y2) / 2 AS y1, x2, (y1 + y2) / 2 AS y2 FROM k WHERE thin AND y2 - y1 <= 1.25 AND x2 - x1 >= 2
        UNION ALL SELECT page, 'v', (x1 + x2) / 2, y1, (x1 + x2) / 2, y2 FROM k WHERE thin AND NOT (y2 - y1 <= 1.25 AND x2 - x1 >= 2)
        UNION ALL SELECT page, 'h', least(a, c), (b + d) / 2, greatest(a, c), (b + d) / 2 FROM g WHERE direction = 'h'
        UNION ALL SELECT page, 'v', (a + c) / 2, least(b, d), (a + c) / 2, greatest(b, d) FROM g WHERE direction = 'v'""",
    "unreliable_cells": _BASE + ", c AS (SELECT page, span_id, size, (y1 + y2) / 2 AS cy, CAST(floor(x1 / 250) * 250 AS DOUBLE) AS c_x1 FROM s), " + _CENTRES("c", "page, c_x1") + " SELECT page, c_x1 FROM f WHERE page % 3 <> 0 GROUP BY page, c_x1 HAVING count(*) > 1 AND max(line) >= 3",
    "compact_cells": _BASE + """
        , c AS (SELECT *, span_id % 3 AS cell, (page % 9) * 80.0 AS height, (y1 + y2) / 2 AS cy FROM s), g AS (SELECT *, cy - lag(cy) OVER (PARTITION BY page, cell ORDER BY cy) AS gap FROM c)
        SELECT page, cell, max(height) > 0 AND max(height) <= greatest((max(y2) - min(y1)) * 3, median(size) * 5) AND coalesce(max(gap) <= greatest(median(size) * 2.8, 18), true) AS compact FROM g GROUP BY page, cell""",
    "preserve_blocks": _BASE + _M + f"""
        , b AS (SELECT page, block, bool_or(seen LIKE '%(cid:7)%') OR bool_or(label = 'number') OR bool_or({_HIDDEN}) OR bool_and(kept) AS preserved FROM m GROUP BY page, block)
        SELECT page, block, preserved, CASE WHEN NOT preserved THEN count(*) OVER (PARTITION BY page, preserved ORDER BY block) - 1 END AS number FROM b""",
    "scan_gate": _BASE + _M + """
        , p AS (SELECT page // 20 AS doc, page, (page % 10) / 14.0 AS cover, bool_or(trim(seen) <> '' AND visible AND mode NOT IN (3, 7)) AS shown, bool_or(trim(seen) <> '' AND NOT (visible AND mode NOT IN (3, 7))) AS unseen FROM m GROUP BY ALL)
        SELECT doc, CASE WHEN bool_or(cover >= 0.5 AND (NOT shown OR unseen)) OR NOT bool_or(shown) THEN 'pdf_no_text_layer' END AS error FROM p GROUP BY doc""",
    "translated_spans": _BASE + _M + """
        SELECT page, block, span_id, CASE WHEN kept THEN NULL WHEN block = 1 AND span_id % 4 <> 0 THEN 'T' || span_id
               WHEN block = 0 THEN CASE WHEN span_id = min(span_id) FILTER (NOT kept) OVER (PARTITION BY page, block) THEN 'W' || page ELSE '' END END AS text FROM m""",
    "side_by_side": f"""
        WITH a AS ({_SIDE}), b AS (SELECT doc, CASE WHEN doc % 11 = 0 THEN page + 1 ELSE page END AS page, width + 10 AS width, height - 30 AS height FROM a WHERE NOT (doc % 7 = 0 AND page = 1)),
        p AS (SELECT coalesce(a.doc, b.doc) AS doc, coalesce(a.page, b.page) AS page, a.width AS w1, a.height AS h1, b.width AS w2, b.height AS h2 FROM a FULL JOIN b ON a.doc = b.doc AND a.page = b.page),
        q AS (SELECT *, bool_or(w1 IS NULL OR w2 IS NULL) OVER (PARTITION BY doc) AS odd FROM p)
        SELECT doc, page, CASE WHEN NOT odd THEN w1 + 24 + w2 END AS width, CASE WHEN NOT odd THEN greatest(h1, h2) END AS height, CASE WHEN NOT odd THEN (greatest(h1, h2) - h1) / 2 END AS left_y,
               CASE WHEN NOT odd THEN w1 + 24 END AS right_x, CASE WHEN NOT odd THEN (greatest(h1, h2) - h2) / 2 END AS right_y, CASE WHEN odd THEN 'pdf_bilingual_page_count_mismatch' END AS error FROM q""",
    "font_languages": f"""
        WITH p AS (SELECT p_partkey, lower(trim(CASE WHEN p_partkey % 2 = 0 THEN ' ' || upper(name) ELSE name END)) AS n FROM (SELECT p_partkey, ({_NAMES})[p_partkey % len({_NAMES}) + 1] AS name FROM part))
        SELECT p_partkey, CASE {_LANGUAGES} ELSE 'zh' END AS language FROM p""",
    "indexed_answers": """
        WITH a AS (SELECT l_orderkey AS batch, l_partkey % 5 - 1 AS index, l_orderkey % 3 + 1 AS n, l_linenumber * 1000000 + l_partkey AS arrival, max(CAST(l_suppkey AS VARCHAR)) AS text FROM lineitem GROUP BY ALL),
        o AS (SELECT batch, index, any_value(text) AS text, any_value(n) AS n FROM a GROUP BY batch, index HAVING count(*) = 1),
        l AS (SELECT batch, index, arg_max(text, arrival) AS text, any_value(n) AS n FROM a GROUP BY batch, index),
        w AS (SELECT batch FROM l GROUP BY batch HAVING list_sort(list(index)) = range(any_value(n)))
        SELECT batch, index, text, 'once' AS rule FROM o WHERE index >= 0 AND index < n UNION ALL SELECT batch, index, text, 'strict' FROM l JOIN w USING (batch)""",
    "batch_calls": """
        WITH r AS (SELECT l_orderkey AS batch, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS index, CASE WHEN l_partkey % 6 = 0 THEN '   ' ELSE 'alpha beta ' || l_partkey END AS source, l_partkey % 6 = 0 AS blank, l_partkey % 10 AS d FROM lineitem),
        x AS (SELECT *, NOT blank AND batch % 4 <> 0 AND d < 5 AS retried FROM r)
        SELECT batch, index, CASE WHEN blank THEN source WHEN d >= 5 THEN 'T:' || source WHEN retried AND d NOT IN (0, 2) THEN 'R:' || source ELSE source END AS text,
               CASE WHEN NOT blank THEN count(*) FILTER (NOT blank) OVER (PARTITION BY batch ORDER BY index) - 1 END AS position, retried,
               CAST(sum(CASE WHEN blank THEN NULL WHEN retried THEN 2 * length(source) ELSE length(source) END) OVER (PARTITION BY batch) AS BIGINT) AS usage FROM x""",
    "call_attempts": """
        WITH o AS (SELECT l_orderkey AS call, l_linenumber - 1 AS attempt, max(l_partkey) % 3 = 0 AS ok, max(l_partkey) % 5 <> 0 AS retryable FROM lineitem GROUP BY 1, 2),
        t AS (SELECT call, coalesce(min(attempt) FILTER (ok OR NOT retryable), max(attempt)) AS used, min(attempt) FILTER (ok) AS good FROM o WHERE attempt <= 2 GROUP BY call)
        SELECT call, used + 1 AS attempts, CAST((2 ** used - 1) * 0.5 AS DOUBLE) AS waited, coalesce(good = used, false) AS done FROM t""",
    "ordered_commits": """
        WITH g AS (SELECT l_orderkey AS job, l_linenumber AS grp, CASE WHEN max(l_partkey) % 29 <> 0 THEN max(l_partkey) END AS settled FROM lineitem GROUP BY 1, 2)
        SELECT job, grp, (SELECT CASE WHEN count(*) = count(settled) THEN max(settled) END FROM g b WHERE b.job = g.job AND b.grp <= g.grp) AS at FROM g""",
    "concurrency": """
        WITH e AS (SELECT event_type AS provider, user_id % 3 AS model, event_id, CASE WHEN event_id % 6 = 1 THEN greatest(event_id % 40, 1) ELSE 1 END AS in_flight, row_number() OVER (PARTITION BY event_type, user_id % 3 ORDER BY event_id) - 1 AS place FROM events),
        b AS (SELECT *, CASE model WHEN 0 THEN 15 WHEN 1 THEN 4 ELSE 32 END AS bound FROM e)
        SELECT event_id, provider, model, CAST(place % bound AS BIGINT) AS slot, CAST(place // bound AS BIGINT) AS wave, in_flight FROM b""",
    "create_jobs": """
        SELECT o_orderkey AS id, 'Report ' || o_orderkey AS source_name, CASE WHEN o_orderkey % 3 <> 0 THEN 'running' ELSE 'queued' END AS status, CASE WHEN o_orderkey % 3 <> 0 THEN 7 ELSE 0 END AS progress,
               CASE WHEN o_orderkey % 3 <> 0 THEN 't0' ELSE 't1' END AS created_at, CASE WHEN o_orderkey % 3 <> 0 THEN 't0' ELSE 't1' END AS updated_at FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0""",
    "upsert_front": """
        WITH f AS (SELECT r_regionkey * 7 % 13 + 20 AS id, r_name AS name, r_regionkey AS n FROM region), k AS (SELECT id, name, 0 AS side, -n AS o FROM f UNION ALL SELECT n_nationkey, n_name, 1, n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT id FROM f))
        SELECT id, name, row_number() OVER (ORDER BY side, o) - 1 AS place FROM k""",
    "document_options": f"""
        WITH p AS (SELECT p_partkey, {_KINDS} AS kind, p_size FROM part), g AS (SELECT *, CASE p_size % 3 WHEN 0 THEN kind WHEN 1 THEN 'docx' END AS given FROM p),
        w AS (SELECT *, coalesce(given <> kind OR (given IS NOT NULL AND kind IN ('xlsx', 'txt')), false) AS wrong FROM g)
        SELECT p_partkey, kind, CASE WHEN wrong OR kind NOT IN ('docx', 'pptx') THEN NULL WHEN given IS NULL OR p_size % 4 = 0 THEN true ELSE p_size % 5 = 0 END AS translate_tables,
               CASE WHEN wrong OR kind NOT IN ('docx', 'pdf') THEN NULL WHEN given IS NULL OR p_size % 5 = 0 THEN false ELSE p_size % 6 = 0 END AS bilingual,
               CASE WHEN wrong OR kind <> 'pptx' THEN NULL WHEN given IS NULL OR p_size % 6 = 0 THEN true ELSE p_size % 7 = 0 END AS translate_notes, CASE WHEN wrong THEN 'invalid_document_options' END AS error FROM w""",
    "model_list": f"SELECT provider, model_id, enabled, row_number() OVER (PARTITION BY provider ORDER BY enabled DESC, model_id) AS place FROM ({_C})",
    "cell_texts": _BASE + f"""
        , a AS (SELECT page, span_id % 2 AS cell, span_id, {_WORDS} AS t FROM s), b AS (SELECT *, lag(t) OVER (PARTITION BY page, cell ORDER BY span_id) AS o FROM a WHERE t <> ''),
        c AS (SELECT *, right(o, 1) AS l, left(t, 1) AS r FROM b WHERE o IS NULL OR o <> t)
        SELECT page, cell, string_agg(CASE WHEN o IS NULL OR (l IN ('告', '第') AND r IN ('报', '第')) OR r = ',' OR l = '（' THEN t ELSE ' ' || t END, '' ORDER BY span_id) AS text FROM c GROUP BY page, cell""",
    "line_texts": _BASE + f"""
        , a AS (SELECT page, span_id % 2 AS line, span_id, x1, x1 + size * (span_id % 9) AS x2, {_WORDS} AS t, median(size) OVER (PARTITION BY page, span_id % 2) * 0.35 AS wide FROM s),
        b AS (SELECT *, coalesce(x1 - lag(x2) OVER (PARTITION BY page, line ORDER BY x1, span_id) > wide, false) AS gap FROM a)
        SELECT page, line, trim(string_agg(CASE WHEN gap THEN ' ' || t ELSE t END, '' ORDER BY x1, span_id)) AS text FROM b GROUP BY page, line""",
    "rendered_blocks": _BASE + """
        , a AS (SELECT page // 8 AS doc, page, span_id % 3 AS block, text, row_number() OVER (PARTITION BY page, span_id % 3 ORDER BY span_id, text) - 1 AS i FROM s),
        b AS (SELECT doc, page, block, count(*) AS n, any_value(text) AS one, string_agg('<SPAN_' || i || '>' || text || '</SPAN_' || i || '>', '' ORDER BY i) AS many FROM a GROUP BY doc, page, block),
        c AS (SELECT doc, page, block, '[BLOCK_' || block || ']' || CASE WHEN block = 0 THEN 'p' || page WHEN n = 1 THEN one ELSE many END AS line FROM b WHERE block = 0 OR page % 5 <> 0),
        d AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY doc, page ORDER BY block) = 1 THEN '[PAGE_' || page || ']' || chr(10) || line ELSE line END AS l FROM c)
        SELECT doc, string_agg(l, chr(10) ORDER BY page, block) AS text FROM d GROUP BY doc""",
    "attached_lines": _BASE + """
        , t AS (SELECT page, median(size) AS m FROM s GROUP BY page),
        n AS (SELECT s.page, span_id, x1, x2, size, length(text) AS letters, (y1 + y2) / 2 AS cy, m, row_number() OVER (PARTITION BY s.page ORDER BY -(y1 + y2) / 2, x1, span_id) AS rn FROM s JOIN t USING (page)),
        f AS (SELECT page, span_id, x1, rn, 0 AS line, 1 AS many, CAST(cy AS DOUBLE) AS mean, CAST(x1 AS DOUBLE) AS lft, CAST(x2 AS DOUBLE) AS rgt FROM n WHERE rn = 1
              UNION ALL
              SELECT page, span_id, x1, rn, CASE WHEN j THEN line ELSE line + 1 END, CASE WHEN j THEN many + 1 ELSE 1 END, CASE WHEN j THEN (mean * many + cy) / (many + 1) ELSE cy END,
                     CASE WHEN j THEN least(lft, x1) ELSE x1 END, CASE WHEN j THEN greatest(rgt, x2) ELSE x2 END
              FROM (SELECT n.*, line, many, mean, lft, rgt, abs(n.cy - mean) <= greatest(2, 0.4 * m) OR (n.size <= 0.92 * m AND abs(n.cy - mean) <= greatest(2, 0.8 * m) AND n.x1 <= rgt + greatest(10, 1.2 * m)
                           AND n.x2 >= lft - greatest(10, 1.2 * m) AND (letters BETWEEN 1 AND 18 OR n.size <= 0.8 * m)) AS j FROM f JOIN n ON n.page = f.page AND n.rn = f.rn + 1))
        SELECT page, span_id, CAST(line AS BIGINT) AS line, row_number() OVER (PARTITION BY page ORDER BY line, x1, span_id) AS place FROM f""",
}
