"""Queries of blocks and grids: line items as the spans, rulings and characters of pages (orders)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import blocks as bl
from textloom.operators import grids as gr
from textloom.operators.dealing import dealt

# Expressions that Spark and DuckDB read alike. An item has its page, number n on it, and numbers p, s, q to draw from.
_ITEM = (
    "l_orderkey AS page", "l_partkey AS p", "l_suppkey AS s", "CAST(l_quantity AS INT) AS q",
    "CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS BIGINT) AS n",
)
# Six kinds of blocks: paragraphs, axis labels, notes, two columns, short texts of one box, uneven lines.
_BLOCK_SPAN = (
    "page", "n AS span_id",
    "CAST(CASE page % 6 WHEN 0 THEN 50 WHEN 1 THEN 50 + 60 * n WHEN 2 THEN 50 WHEN 3 THEN 50 + 100 * (n % 2) WHEN 4 THEN 50 + q ELSE 50 + p % 90 END AS DOUBLE) AS x1",
    "CAST(700 - 12 * n - CASE page % 6 WHEN 5 THEN p % 9 ELSE 0 END AS DOUBLE) AS y1",
    "CAST(CASE page % 6 WHEN 0 THEN 200 + q WHEN 1 THEN 80 + 60 * n WHEN 2 THEN CASE n WHEN 1 THEN 230 ELSE 100 + q END WHEN 3 THEN 200 + 50 * (n % 2) WHEN 4 THEN 120 + q ELSE 150 + p % 90 END AS DOUBLE) AS x2",
    "CAST(709 - 12 * n AS DOUBLE) AS y2",
    "CAST(CASE WHEN p % 11 = 0 THEN 19 WHEN p % 5 = 0 THEN 7 ELSE 10 END AS DOUBLE) AS size",
    "CASE page % 6 WHEN 1 THEN CAST(n AS STRING) WHEN 2 THEN concat(CASE n WHEN 1 THEN '[Note] ' ELSE '' END, 'words ', CAST(p AS STRING)) WHEN 4 THEN concat('box ', CAST(p AS STRING)) ELSE concat('some words of ', CAST(p AS STRING)) END AS text",
    "CASE page % 6 WHEN 4 THEN CAST(7 AS BIGINT) ELSE n END AS textbox",
    "CASE CAST(floor(page / 6) AS BIGINT) % 5 WHEN 0 THEN 'doc_title' WHEN 1 THEN 'reference' WHEN 2 THEN CASE page % 2 WHEN 0 THEN 'table' ELSE 'footnote' END ELSE 'text' END AS label",
    "CAST(50 AS DOUBLE) AS bx1", "CAST(260 AS DOUBLE) AS bx2",
)
_GRID_SPAN = (
    "page", "n AS span_id", "CAST((p * 3) % 360 AS DOUBLE) AS x1", "CAST((s * 11) % 280 AS DOUBLE) AS y1",
    "CAST((p * 3) % 360 + 4 + q * CASE page % 3 WHEN 0 THEN 5 ELSE 1 END AS DOUBLE) AS x2", "CAST((s * 11) % 280 + 8 + q % 5 AS DOUBLE) AS y2",
    "CASE WHEN q % 4 = 0 THEN NULL ELSE CAST(8 + q % 5 AS DOUBLE) END AS size",
    "CAST(0 AS DOUBLE) AS t_x1", "CAST(0 AS DOUBLE) AS t_y1", "CAST(400 AS DOUBLE) AS t_x2", "CAST(300 AS DOUBLE) AS t_y2",
    "concat(CAST(p AS STRING), CASE WHEN s % 3 = 0 THEN ' of ' ELSE ' ' END, CAST(s AS STRING)) AS text",
)
_WALL = ("page", "'v' AS direction", "CAST(p % 400 AS DOUBLE) AS x1", "CAST(s % 60 AS DOUBLE) AS y1", "CAST(p % 400 AS DOUBLE) AS x2", "CAST(220 + s % 80 AS DOUBLE) AS y2")
_FLOOR = (
    "page", "'h' AS direction", "CAST(CASE WHEN s % 3 = 0 THEN 100 ELSE 0 END AS DOUBLE) AS x1", "CAST((p * 7) % 300 AS DOUBLE) AS y1",
    "CAST(CASE WHEN s % 5 = 0 THEN 250 ELSE 400 END AS DOUBLE) AS x2", "CAST((p * 7) % 300 AS DOUBLE) AS y2",
)
_FRAME = tuple(
    ("page", f"'{d}' AS direction", *(f"CAST({v} AS DOUBLE) AS {k}" for k, v in zip(("x1", "y1", "x2", "y2"), box)))
    for d, box in (("v", (0, 0, 0, 300)), ("v", (400, 0, 400, 300)), ("h", (0, 0, 400, 0)), ("h", (0, 300, 400, 300)))
)
# Spans of tables, charts and paragraphs; a cell of a table may lie in two blocks.
_TAG_SPAN = (
    "CAST(floor(page / 4) AS BIGINT) AS page", "(page % 4) * 2 + CASE WHEN q % 3 = 0 THEN 1 ELSE 0 END AS block", "n AS place", "n AS span_id",
    "CAST(p % 200 AS DOUBLE) AS x1", "CAST(700 - 12 * n AS DOUBLE) AS y1", "CAST(p % 200 + 40 AS DOUBLE) AS x2", "CAST(709 - 12 * n AS DOUBLE) AS y2", "CAST(10 AS DOUBLE) AS size",
    "CASE p % 13 WHEN 0 THEN '(cid:3)' WHEN 1 THEN '  ' WHEN 2 THEN '- ' ELSE concat(' w', CAST(p % 7 AS STRING), ' ', CASE WHEN s % 2 = 0 THEN '价' ELSE 'x,' END) END AS text",
    "s % 9 = 0 AS kept", "CASE page % 4 WHEN 0 THEN 'Table ' WHEN 1 THEN 'chart' WHEN 2 THEN 'reference' ELSE 'text' END AS label",
    "CASE WHEN page % 4 = 2 OR page % 8 = 3 THEN 'block' ELSE 'span' END AS mode",
    *(f"CASE WHEN s % 4 < 3 THEN CAST({v} AS DOUBLE) END AS c_{k}" for k, v in (("x1", "(s % 4) * 50"), ("y1", "690 - 30 * (s % 4)"), ("x2", "(s % 4) * 50 + 50"), ("y2", "CASE WHEN page % 16 = 0 THEN 990 ELSE 720 END - 30 * (s % 4)"))),
)
# Eight orders on a page, each on a line of its own.
_ORPHAN = (
    "page DIV 8 AS page", "page * 10 + n AS block", "n AS span_id", "cast(n * 60 AS double) AS x1", "cast(700 - 14 * (page % 8) + p % 3 AS double) AS y1",
    "cast(n * 60 + 50 + s % 9 AS double) AS x2", "cast(710 - 14 * (page % 8) + p % 3 AS double) AS y2", "cast(10 + q % 3 AS double) AS size",
    "concat('part ', p) AS text", "s % 11 = 0 AS kept", "CASE WHEN s % 13 = 0 THEN 'table' ELSE 'text' END AS label", "'text' AS source",
)


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr(*_ITEM)


def _dealt_items(spark: SparkSession, sf: str) -> DataFrame:
    """The items, dealt by page while they are a few numbers each. Pages get their name above the window that counts, so that
    Spark knows them as dealt and sorted, and what is drawn on them is not dealt again."""
    items = spark.read.parquet(f"{sf}/lineitem.parquet")
    own = items.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return dealt(own, "l_orderkey", rows=items.count()).selectExpr("l_orderkey", *_ITEM[1:]).withColumnRenamed("l_orderkey", "page")


def _rulings(items: DataFrame) -> DataFrame:
    own = [f"struct({', '.join(e[1:])})" for e in (_WALL, _FLOOR)]
    frame = [f"struct({', '.join(e[1:])})" for e in _FRAME]
    return items.selectExpr("page", f"inline(IF(n = 1, array({', '.join(own + frame)}), array({', '.join(own)})))")


def block_modes(spark: SparkSession, sf: str) -> DataFrame:
    """O-141: each order as a block."""
    return bl.block_modes(_items(spark, sf).selectExpr(*_BLOCK_SPAN), ["page"])


def orphan_merge(spark: SparkSession, sf: str) -> DataFrame:
    """O-138: eight orders as a page; items that end near each other's start are fragments of one line."""
    rows = _items(spark, sf).selectExpr(*_ORPHAN)
    return bl.merge_orphans(rows, "page")


def tagged_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """O-145: four orders as a page."""
    found = bl.tagged_blocks(_items(spark, sf).selectExpr(*_TAG_SPAN), "page")
    spans = F.array_join(F.transform("spans", lambda s: F.concat(s["name"], F.lit("="), s["block"].cast("string"), F.lit("/"), s["span_id"].cast("string"), F.lit("="), s["text"])), "|")
    return found.select("page", "number", "block", F.coalesce("plain", F.lit("")).alias("plain"), spans.alias("spans"))


def cell_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """O-134: the cells of spans over several axes."""
    items = _items(spark, sf)
    found = gr.cell_boxes(items.selectExpr(*_GRID_SPAN), _rulings(items), "page")
    return found.select("page", "span_id", *[F.round(f"cell.{k}", 6).alias(k) for k in ("x1", "y1", "x2", "y2")])


def grid_split(spark: SparkSession, sf: str) -> DataFrame:
    """O-135: spans over several columns, with a gap after five characters."""
    items = _dealt_items(spark, sf)
    spans = items.selectExpr(*_GRID_SPAN).withColumn("w", (F.col("x2") - F.col("x1")) / F.length("text"))

    def char(c, i):
        left = F.col("x1") + (i + F.when(i >= 5, 2).otherwise(0)) * F.col("w")
        return F.struct(c.alias("char"), left.alias("x1"), F.col("y1"), (left + F.col("w") * 0.8).alias("x2"), F.col("y2"))

    found = gr.grid_split(spans.withColumn("chars", F.transform(F.split("text", ""), char)), _rulings(items), "page")
    return found.select("page", "span_id", "part", "text", "kept", F.round("x1", 6).alias("x1"), F.round("x2", 6).alias("x2"), F.round("cell.x1", 6).alias("left"), F.round("cell.y2", 6).alias("top"))


QUERIES = {f.__name__: f for f in (block_modes, orphan_merge, tagged_blocks, cell_boxes, grid_split)}

_I = f"i AS (SELECT {', '.join(_ITEM)} FROM lineitem)"
_PAD = "CASE WHEN rt - {x} > lf + {x} AND tp - {y} > bt + {y} THEN {a} ELSE {b} END"
_X, _Y = "least(2, greatest((rt - lf) * 0.03::DOUBLE, 0.5))", "least(1, greatest((tp - bt) * 0.05::DOUBLE, 0.2))"
_SIDE = lambda a, b: _PAD.format(x=_X, y=_Y, a=a.format(x=_X, y=_Y), b=b)


def _axis(name: str, source: str, value: str) -> str:
    """Merged positions of a span's rulings and the stretches between them."""
    part = "PARTITION BY page, span_id"
    return f"""{name}_n AS (SELECT page, span_id, {value} AS v, CASE WHEN {value} - lag({value}) OVER ({part} ORDER BY {value}) > 1.5 THEN 1 ELSE 0 END AS new FROM {source}),
        {name}_p AS (SELECT page, span_id, run, avg(v) AS pos FROM (SELECT *, sum(new) OVER ({part} ORDER BY v) AS run FROM {name}_n) GROUP BY ALL),
        {name}_i AS (SELECT page, span_id, pos AS lo, lead(pos) OVER ({part} ORDER BY pos) AS up, count(*) OVER ({part}) AS many FROM {name}_p)"""


_GRID = f"""
    WITH {_I}, sp AS (SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, greatest(2, (y2 - y1) * 0.35::DOUBLE) AS reach FROM (SELECT {', '.join(_GRID_SPAN)} FROM i)),
    ru AS (SELECT {', '.join(_WALL)} FROM i UNION ALL SELECT {', '.join(_FLOOR)} FROM i {' '.join(f"UNION ALL SELECT {', '.join(f)} FROM i WHERE n = 1" for f in _FRAME)}),
    vr AS (SELECT s.page, s.span_id, r.x1 AS x FROM sp s JOIN ru r ON r.page = s.page AND direction = 'v' AND r.y1 <= cy + reach AND r.y2 >= cy - reach AND r.x1 BETWEEN -2 AND 402),
    {_axis('v', 'vr', 'x')}"""
#: Lines of blocks by the fold of attached fragments, one page a block.
_LINES = """
    t AS (SELECT page, median(size) AS m FROM s GROUP BY page),
    n AS (SELECT s.*, length(regexp_replace(text, '\\s', '', 'g')) AS letters, (y1 + y2) / 2 AS cy, m, row_number() OVER (PARTITION BY s.page ORDER BY -(y1 + y2) / 2, x1, span_id) AS rn FROM s JOIN t USING (page)),
    f AS (SELECT page, span_id, rn, 0 AS line, 1 AS many, CAST(cy AS DOUBLE) AS mean, x1 AS lft, x2 AS rgt FROM n WHERE rn = 1
          UNION ALL
          SELECT page, span_id, rn, CASE WHEN j THEN line ELSE line + 1 END, CASE WHEN j THEN many + 1 ELSE 1 END, CASE WHEN j THEN (mean * many + cy) / (many + 1) ELSE cy END,
                 CASE WHEN j THEN least(lft, x1) ELSE x1 END, CASE WHEN j THEN greatest(rgt, x2) ELSE x2 END
          FROM (SELECT n.*, line, many, mean, lft, rgt, abs(n.cy - mean) <= greatest(2, 0.4 * m) OR (n.size <= 0.92 * m AND abs(n.cy - mean) <= greatest(2, 0.8 * m) AND n.x1 <= rgt + greatest(10, 1.2 * m)
                       AND n.x2 >= lft - greatest(10, 1.2 * m) AND (letters BETWEEN 1 AND 18 OR n.size <= 0.8 * m)) AS j FROM f JOIN n ON n.page = f.page AND n.rn = f.rn + 1))"""
_NORM = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
ORACLE = {
    "block_modes": f"""
        WITH RECURSIVE {_I}, s AS (SELECT {', '.join(_BLOCK_SPAN)} FROM i), {_LINES},
        sl AS (SELECT n.*, line FROM n JOIN f USING (page, span_id)),
        l AS (SELECT page, line, min(x1) AS x1, min(y1) AS y1, max(x2) - min(x1) AS w, (min(y1) + max(y2)) / 2 AS cy, length(trim(string_agg(text, '' ORDER BY x1, span_id))) AS chars FROM sl GROUP BY page, line),
        lw AS (SELECT *, row_number() OVER d AS k, greatest(lag(y1) OVER d - y1, 0) AS gap, lag(y1) OVER d AS up, x1 - lag(x1) OVER a AS st, row_number() OVER a - 1 AS lf
               FROM l WINDOW d AS (PARTITION BY page ORDER BY cy DESC, line), a AS (PARTITION BY page ORDER BY x1, line)),
        b AS (SELECT page, count(*) AS lines, median(w) AS med, avg(CASE WHEN w < 84 THEN 1 ELSE 0 END) AS short, stddev_pop(x1) AS spread,
                     coalesce(coalesce(stddev_pop(gap) FILTER (up IS NOT NULL), 0) / nullif(avg(gap) FILTER (up IS NOT NULL), 0), 0) AS var, max(st) AS st, arg_min(lf, (-st, lf)) FILTER (st IS NOT NULL) AS lf,
                     sum(chars) AS chars, min(chars) AS least_chars, max(w / 210) AS widest, max(w / 210) FILTER (k = 1) AS first, min(w / 210) FILTER (k > 1) AS rest, bool_or(chars <= 2 AND w / 210 < 0.25) AS tiny,
                     max(cy) AS top FROM lw GROUP BY page),
        h AS (SELECT page, any_value(label) AS label, count(*) AS spans, count(DISTINCT textbox) AS boxes, max(size) / min(size) AS ratio,
                     trim(string_agg(text, '' ORDER BY -sl.cy, x1, span_id) FILTER (abs(sl.cy - top) <= 2.5)) AS head FROM sl JOIN b USING (page) GROUP BY page),
        z AS (SELECT *, label = 'doc_title' AS ti FROM b JOIN h USING (page))
        SELECT page, CASE WHEN label = 'table' OR spans < 2 THEN 'span' WHEN label = 'reference' THEN 'block' WHEN lines < 2 THEN 'span'
            WHEN lines BETWEEN 2 AND 4 AND ((regexp_matches(head, '^\\[[^\\]]+\\]') AND first >= 0.75 AND rest >= 0.18) OR (boxes = 1 AND chars BETWEEN 20 AND 140 AND widest >= 0.45 AND least_chars > 1)) THEN 'block'
            WHEN med / 210 < CASE WHEN ti THEN 0.35 ELSE 0.55 END OR short > CASE WHEN ti THEN 0.6 ELSE 0.35 END OR spread / 210 > CASE WHEN ti THEN 0.15 ELSE 0.08 END OR var > CASE WHEN ti THEN 0.9 ELSE 0.6 END
                 OR (lines >= 3 AND st >= 52.5 AND lf >= 2 AND lines - lf >= 2) OR ratio > 1.8 OR tiny THEN 'span' ELSE 'block' END AS mode FROM z""",
    "tagged_blocks": f"""
        WITH {_I}, s0 AS (SELECT {', '.join(_TAG_SPAN)} FROM i),
        s AS (SELECT * EXCLUDE (label), lower(trim(label)) AS label, (y1 + y2) / 2 AS cy, {_NORM} AS t, CASE WHEN c_x1 IS NOT NULL THEN concat(c_x1, ' ', c_y1, ' ', c_x2, ' ', c_y2) END AS cell FROM s0),
        sp AS (SELECT *, NOT kept AND t <> '' AND NOT contains(t, '(cid:') AS fine FROM s WHERE mode = 'span'),
        cc AS (SELECT *, cy - lag(cy) OVER (PARTITION BY page, cell ORDER BY cy) AS gap FROM sp WHERE label = 'table' AND fine AND cell IS NOT NULL),
        ok AS (SELECT page, cell FROM cc GROUP BY page, cell HAVING count(DISTINCT block) > 1 AND max(c_y2 - c_y1) <= greatest(3 * (max(y2) - min(y1)), 50) AND coalesce(max(gap), 0) <= 28),
        sh AS (SELECT cc.*, row_number() OVER (PARTITION BY page, cell ORDER BY -cy, x1, block, span_id) - 1 AS nth FROM cc JOIN ok USING (page, cell)),
        pr AS (SELECT *, lag(t) OVER (PARTITION BY page, cell ORDER BY nth) AS b FROM sh),
        sg AS (SELECT page, cell, arg_min(block, nth) AS block, arg_min(place, nth) AS pos,
                      string_agg(CASE WHEN b IS NULL THEN t WHEN (right(b, 1) = '价' AND left(t, 1) = '价') OR left(t, 1) IN (',', ')') THEN t ELSE ' ' || t END, '' ORDER BY nth) FILTER (b IS NULL OR b <> t) AS plain,
                      string_agg('SPAN_' || nth || '=' || block || '/' || span_id || '=' || t, '|' ORDER BY nth) AS spans FROM pr GROUP BY page, cell),
        w AS (SELECT sp.*, fine AND sh.nth IS NULL AS alone FROM sp LEFT JOIN (SELECT page, block, span_id, nth FROM sh) sh USING (page, block, span_id)),
        k AS (SELECT *, CASE WHEN NOT alone THEN NULL WHEN label = 'table' AND cell IS NOT NULL THEN cell WHEN label IN ('table', 'chart') THEN 'span ' || span_id ELSE 'block' END AS key FROM w WHERE alone OR label = 'table'),
        r AS (SELECT *, sum(new) OVER (PARTITION BY page, block ORDER BY place, span_id, x1, t) AS run FROM (SELECT *, CASE WHEN lag(key) OVER (PARTITION BY page, block ORDER BY place) = key THEN 0 ELSE 1 END AS new FROM k)),
        nm AS (SELECT *, row_number() OVER (PARTITION BY page, block, run ORDER BY place) - 1 AS j FROM r WHERE key IS NOT NULL),
        rg AS (SELECT page, block, min(place) AS pos, '' AS plain, string_agg('SPAN_' || j || '=' || block || '/' || span_id || '=' || t, '|' ORDER BY j) AS spans FROM nm GROUP BY page, block, run),
        bl AS (SELECT page, block, 0 AS pos, CASE WHEN any_value(label) = 'reference' THEN string_agg(t, chr(10) ORDER BY cy DESC) ELSE string_agg(t, ' ' ORDER BY cy DESC) END AS plain, '' AS spans FROM s WHERE mode = 'block' AND NOT kept AND t <> '' GROUP BY page, block),
        al AS (SELECT page, block, pos, plain, spans FROM sg UNION ALL SELECT page, block, pos, plain, spans FROM rg UNION ALL SELECT page, block, pos, plain, spans FROM bl)
        SELECT page, row_number() OVER (PARTITION BY page ORDER BY block, pos) - 1 AS number, block, plain, spans FROM al""",
    "cell_boxes": _GRID + f""",
        x AS (SELECT s.*, lo AS lf, up AS rt, many FROM sp s JOIN v_i USING (page, span_id) WHERE up - lo > 1.5 AND cx BETWEEN lo - 1.5 AND up + 1.5 QUALIFY row_number() OVER (PARTITION BY page, span_id ORDER BY lo) = 1),
        hr AS (SELECT x.page, x.span_id, r.y1 AS y FROM x JOIN ru r ON r.page = x.page AND direction = 'h' AND r.x1 <= lf + 2 AND r.x2 >= rt - 2 AND r.y1 BETWEEN -2 AND 302),
        {_axis('h', 'hr', 'y')},
        y AS (SELECT x.*, lo AS bt, up AS tp, x2 - x1 AS wide, greatest(lf - x1, 0) AS be, greatest(x2 - rt, 0) AS af, greatest((rt - lf) * 0.35::DOUBLE, coalesce(size, y2 - y1) * 1.5, 2) AS al,
                     (SELECT count(*) FROM v_p a WHERE a.page = x.page AND a.span_id = x.span_id AND pos > x1 + 1.5 AND pos < x2 - 1.5) AS crossed
              FROM x JOIN h_i USING (page, span_id) WHERE up - lo > 1.5 AND cy BETWEEN lo - 1.5 AND up + 1.5 QUALIFY row_number() OVER (PARTITION BY page, span_id ORDER BY lo) = 1),
        z AS (SELECT * FROM y WHERE many >= 3 AND rt - lf > 1 AND tp > bt AND NOT (be + af > al AND ((be > al AND af > al) OR wide > 2 * (rt - lf) OR (crossed >= 2 AND wide > 1.35::DOUBLE * (rt - lf)))))
        SELECT sp.page, sp.span_id, round({_SIDE('lf + {x}', 'lf')}, 6) AS x1, round({_SIDE('bt + {y}', 'bt')}, 6) AS y1, round({_SIDE('rt - {x}', 'rt')}, 6) AS x2, round({_SIDE('tp - {y}', 'tp')}, 6) AS y2
        FROM sp LEFT JOIN (SELECT page, span_id, lf, rt, bt, tp FROM z) USING (page, span_id)""",
    "grid_split": _GRID + f""",
        hr AS (SELECT s.page, s.span_id, r.y1 AS y FROM sp s JOIN ru r ON r.page = s.page AND direction = 'h' AND r.x1 <= cx + 2 AND r.x2 >= cx - 2 AND r.y1 BETWEEN -2 AND 302),
        {_axis('h', 'hr', 'y')},
        x AS (SELECT s.*, lo AS bt, up AS tp, (x2 - x1) / length(text) AS w FROM sp s JOIN h_i USING (page, span_id) WHERE up - lo > 1.5 AND cy BETWEEN lo - 1.5 AND up + 1.5 QUALIFY row_number() OVER (PARTITION BY page, span_id ORDER BY lo) = 1),
        c0 AS (SELECT *, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) - 1 AS k FROM x),
        c AS (SELECT *, x1 + (k + CASE WHEN k >= 5 THEN 2 ELSE 0 END) * w AS l, x1 + (k + CASE WHEN k >= 5 THEN 2 ELSE 0 END) * w + w * 0.8::DOUBLE AS r FROM c0),
        a AS (SELECT c.page, c.span_id, k, c, l, r, w, size, bt, tp, lo AS lf, up AS rt FROM c JOIN v_i USING (page, span_id) WHERE many >= 3 AND up - lo > 1.5 AND (l + r) / 2 BETWEEN lo - 1.5 AND up + 1.5 QUALIFY row_number() OVER (PARTITION BY page, span_id, k ORDER BY lo) = 1),
        e AS (SELECT page, span_id FROM (SELECT page, span_id, count(DISTINCT lf) AS columns, count(*) FILTER (c <> ' ') AS found FROM a GROUP BY ALL)
              JOIN (SELECT page, span_id, count(*) FILTER (c <> ' ') AS every FROM c GROUP BY ALL) USING (page, span_id) WHERE columns >= 2 AND found >= 0.8 * every),
        d AS (SELECT a.*, dense_rank() OVER (PARTITION BY page, span_id ORDER BY lf) - 1 AS part FROM a JOIN e USING (page, span_id)),
        g AS (SELECT *, CASE WHEN l - lag(r) OVER q > greatest(0.64::DOUBLE * w, coalesce(size, 0) * 0.22::DOUBLE, 1.2) AND lag(c) OVER q <> ' ' THEN ' ' || c ELSE c END AS piece FROM d WINDOW q AS (PARTITION BY page, span_id, part ORDER BY k)),
        o AS (SELECT page, span_id, part, trim(string_agg(piece, '' ORDER BY k)) AS text, min(l) AS x1, max(r) AS x2, any_value(lf) AS lf, any_value(rt) AS rt, any_value(bt) AS bt, any_value(tp) AS tp FROM g GROUP BY page, span_id, part),
        n AS (SELECT *, count(*) OVER (PARTITION BY page, span_id) AS parts FROM o WHERE text <> '')
        SELECT page, span_id, part, text, regexp_full_match(replace(text, ' ', ''), '[\\p{{N}}\\p{{P}}\\p{{S}}]+') AS kept, round(x1, 6) AS x1, round(x2, 6) AS x2, round({_SIDE('lf + {x}', 'lf')}, 6) AS left, round({_SIDE('tp - {y}', 'tp')}, 6) AS top
        FROM n WHERE parts >= 2""",
}
