"""Queries of page geometry: orders as pages, line items as spans and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import layout as lo
from textloom.operators.dealing import dealt

_LABELS = "('text','table','image','header','number','reference','reference_content','inline_formula')"
_SPAN = (
    "l_orderkey AS page", "l_linenumber * 100000 + l_partkey AS span_id", "cast(l_partkey % 500 as double) AS x1", "cast(l_suppkey * 7 % 700 as double) AS y1",
    "cast(l_partkey % 500 as double) + l_quantity * 3 + 5 AS x2", "cast(l_suppkey * 7 % 700 as double) + 8 + l_quantity % 12 AS y2",
    "8 + l_quantity % 5 AS size", "l_returnflag AS colour", "l_linestatus AS face", "cast(l_partkey % 13 as string) AS text",
)
_REGION = (
    "l_orderkey AS page", "l_linenumber * 100000 + l_suppkey AS layout_id",
    "element_at(array{labels}, cast((l_partkey + l_linenumber) % 8 as int) + 1) AS label",
    "cast(l_suppkey * 3 % 300 as double) AS x1", "cast(l_partkey * 5 % 400 as double) AS y1",
    "cast(l_suppkey * 3 % 300 as double) + 100 + l_quantity * 8 AS x2", "cast(l_partkey * 5 % 400 as double) + 60 + l_quantity * 9 AS y2",
    "0.4 + (l_partkey % 60) / 100.0D AS score",
)


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    return dealt(rows.selectExpr(*_SPAN), "page", rows=rows.count())


def _regions(spark: SparkSession, sf: str) -> DataFrame:
    exprs = [e.replace("{labels}", _LABELS) for e in _REGION]
    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    return dealt(rows.selectExpr(*exprs), "page", rows=rows.count())


def overlap_match(spark: SparkSession, sf: str) -> DataFrame:
    """O-120, O-122, O-125."""
    found = lo.match_spans(_boxes(spark, sf), _areas(spark, sf), "page")
    return found.withColumn("cover", F.round("cover", 9))


# One row per key, so that repeated line items do not make ties. Pages are dealt first: no step after it shuffles.
def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    return _spans(spark, sf).groupBy("page", "span_id").agg(*[F.min(c).alias(c) for c in ("x1", "y1", "x2", "y2", "size", "colour", "face", "text")])


def _areas(spark: SparkSession, sf: str) -> DataFrame:
    return _regions(spark, sf).groupBy("page", "layout_id").agg(*[F.min(c).alias(c) for c in ("label", "x1", "y1", "x2", "y2", "score")])


def detection_filter(spark: SparkSession, sf: str) -> DataFrame:
    """O-124 and O-127."""
    return lo.detections(_areas(spark, sf), 600.0, 800.0).select("page", "layout_id", "label", "x1", "y1", "x2", "y2")


def container_prune(spark: SparkSession, sf: str) -> DataFrame:
    """O-126."""
    return lo.prune_containers(_areas(spark, sf), "page").select("page", "layout_id", "label")


def axis_merge(spark: SparkSession, sf: str) -> DataFrame:
    """O-131."""
    return lo.merge_axis(_boxes(spark, sf).select("page", "x1"), ["page"], "x1", 12.0).withColumn("position", F.round("position", 6))


def axis_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """O-132 and O-134: the columns that hold each span's centre."""
    boxes = _boxes(spark, sf)
    axis = lo.merge_axis(boxes.select("page", "x1"), ["page"], "x1", 12.0).select("page", "position")
    points = boxes.select("page", "span_id", ((F.col("x1") + F.col("x2")) / 2).alias("cx"))
    found = lo.axis_interval(points, axis, ["page"], "cx", 2.0)
    return found.select("page", "span_id", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"))


def rect_union(spark: SparkSession, sf: str) -> DataFrame:
    """O-144, and the coverage of O-143 without its text gate."""
    area = lo.union_area(_areas(spark, sf).select("page", "x1", "y1", "x2", "y2"), ["page"])
    return area.select("page", F.round("area", 3).alias("area"), (F.col("area") / (600.0 * 800.0) >= 0.5).alias("covered"))


def dominant_style(spark: SparkSession, sf: str) -> DataFrame:
    """O-139 and O-140: colour by text weight, face by count."""
    boxes = _boxes(spark, sf)
    weight = F.greatest(F.length(F.trim("text")), F.lit(1))
    colour = lo.weighted_mode(boxes, ["page"], "colour", weight, "span_id")
    return colour.join(lo.weighted_mode(boxes, ["page"], "face", F.lit(1), "span_id"), "page")


def median_fonts(spark: SparkSession, sf: str) -> DataFrame:
    """O-152."""
    return _boxes(spark, sf).groupBy("page", "colour").agg(F.round(F.median("size"), 6).alias("median_size"))


def distinct_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Part of O-155: distinct texts of a page with where each is first seen, without characters per script."""
    return _boxes(spark, sf).groupBy("page", "text").agg(F.min("span_id").alias("first_span"))


def line_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """O-128 to O-130 (without attachment of inline fragments)."""
    rows = _boxes(spark, sf).select("page", "span_id", "x1", "size", ((F.col("y1") + F.col("y2")) / 2).alias("cy"))
    return lo.reading_order(lo.line_clusters(rows, ["page"]), ["page"]).select("page", "span_id", "line", "place")


def layout_filter(spark: SparkSession, sf: str) -> DataFrame:
    """O-123."""
    areas = _areas(spark, sf)
    return lo.filter_overlaps(areas, "page", 600.0, 800.0).select("page", "layout_id", "label")


def block_groups(spark: SparkSession, sf: str) -> DataFrame:
    """O-137: blocks of spans by region, their bounds and texts in order."""
    found = lo.match_spans(_boxes(spark, sf), _areas(spark, sf), "page").select("page", "span_id", "layout_id", "label")
    rows = _boxes(spark, sf).join(found, ["page", "span_id"])
    return rows.groupBy("page", "layout_id", F.coalesce("label", F.lit("zzz_none")).alias("label")).agg(
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_id", "text"))), lambda s: s["text"]), " ").alias("texts"),
    )


QUERIES = {f.__name__: f for f in (
    overlap_match, detection_filter, container_prune, axis_merge, axis_intervals, rect_union, dominant_style, median_fonts,
    distinct_texts, line_clusters, layout_filter, block_groups,
)}

_DUCK_SPAN = ", ".join(e.replace(" as string)", " AS VARCHAR)") for e in _SPAN)
_DUCK_REGION = ", ".join(
    e.replace("element_at(array{labels}, cast((l_partkey + l_linenumber) % 8 as int) + 1)", "['text','table','image','header','number','reference','reference_content','inline_formula'][(l_partkey + l_linenumber) % 8 + 1]").replace("100.0D", "CAST(100 AS DOUBLE)").replace("0.4 +", "CAST(0.4 AS DOUBLE) +")
    for e in _REGION
)
_BASE = f"""
    WITH RECURSIVE s AS (SELECT page, span_id, min(x1) AS x1, min(y1) AS y1, min(x2) AS x2, min(y2) AS y2, min(size) AS size, min(colour) AS colour, min(face) AS face, min(text) AS text
                         FROM (SELECT {_DUCK_SPAN} FROM lineitem) GROUP BY page, span_id),
    r AS (SELECT page, layout_id, min(label) AS label, min(x1) AS x1, min(y1) AS y1, min(x2) AS x2, min(y2) AS y2, min(score) AS score FROM (SELECT {_DUCK_REGION} FROM lineitem) GROUP BY page, layout_id)"""
_TIER = "CASE WHEN label IN ('table', 'image') THEN 1 WHEN label = 'number' THEN 2 ELSE 0 END"
_COVER = "greatest(least(s.x2, r.x2) - greatest(s.x1, r.x1), 0) * greatest(least(s.y2, r.y2) - greatest(s.y1, r.y1), 0) / ((s.x2 - s.x1) * (s.y2 - s.y1))"
_MATCH = f""", m AS (SELECT s.page, s.span_id, r.layout_id, r.label, {_TIER.replace('label', 'r.label')} AS tier, {_COVER} AS cover
                     FROM s JOIN r ON r.page = s.page WHERE {_COVER} >= 0.3 QUALIFY row_number() OVER (PARTITION BY s.page, s.span_id ORDER BY tier, cover DESC, r.layout_id) = 1)"""
_AXIS = """, o AS (SELECT page, x1, CASE WHEN x1 - lag(x1) OVER (PARTITION BY page ORDER BY x1) > 12 THEN 1 ELSE 0 END AS n FROM s),
           a AS (SELECT page, x1, sum(n) OVER (PARTITION BY page ORDER BY x1 RANGE UNBOUNDED PRECEDING) AS run FROM o),
           ax AS (SELECT page, run, avg(x1) AS position, count(*) AS n FROM a GROUP BY page, run)"""
_MODE = lambda value, weight: f"(SELECT page, {value} FROM (SELECT page, {value}, sum({weight}) AS w, min(span_id) AS o FROM s GROUP BY page, {value}) QUALIFY row_number() OVER (PARTITION BY page ORDER BY w DESC, o) = 1)"
ORACLE = {
    "overlap_match": _BASE + _MATCH + " SELECT s.page, s.span_id, layout_id, label, tier, round(cover, 9) AS cover FROM s LEFT JOIN m USING (page, span_id)",
    "detection_filter": _BASE + """
        , k AS (SELECT *, least(greatest(round_even(x1, 0), 0), 600) AS a1, least(greatest(round_even(x2, 0), 0), 600) AS a2, least(greatest(round_even(y1, 0), 0), 800) AS b1, least(greatest(round_even(y2, 0), 0), 800) AS b2
                FROM r WHERE score > 0.5 AND score >= CASE label WHEN 'table' THEN 0.7 WHEN 'reference' THEN 0.8 WHEN 'number' THEN 0.7 ELSE 0.5 END)
        SELECT page, layout_id, label, a1 / 2 AS x1, (800 - b2) / 2 AS y1, a2 / 2 AS x2, (800 - b1) / 2 AS y2 FROM k""",
    "container_prune": _BASE + """
        SELECT page, layout_id, label FROM r WHERE NOT (label = 'reference' AND (SELECT count(*) FROM r c WHERE c.page = r.page AND c.label = 'reference_content'
            AND greatest(least(c.x2, r.x2) - greatest(c.x1, r.x1), 0) * greatest(least(c.y2, r.y2) - greatest(c.y1, r.y1), 0) / ((c.x2 - c.x1) * (c.y2 - c.y1)) >= 0.9) >= 2)""",
    "axis_merge": _BASE + _AXIS + " SELECT page, CAST(run AS BIGINT) AS run, round(position, 6) AS position, n FROM ax",
    "axis_intervals": _BASE + _AXIS + """
        , i AS (SELECT page, position AS lower, lead(position) OVER (PARTITION BY page ORDER BY position) AS upper FROM ax)
        SELECT s.page, s.span_id, round(lower, 6) AS lower, round(upper, 6) AS upper FROM s JOIN i ON i.page = s.page AND upper - lower > 2
            AND (x1 + x2) / 2 BETWEEN lower - 2 AND upper + 2 QUALIFY row_number() OVER (PARTITION BY s.page, s.span_id ORDER BY lower, upper) = 1""",
    "rect_union": _BASE + """
        , e AS (SELECT DISTINCT page, unnest([x1, x2]) AS l FROM r), sl AS (SELECT page, l, lead(l) OVER (PARTITION BY page ORDER BY l) AS rt FROM e),
        p AS (SELECT sl.page, l, rt, y1, y2 FROM sl JOIN r ON r.page = sl.page AND x1 <= l AND x2 >= rt WHERE rt IS NOT NULL),
        q AS (SELECT *, max(y2) OVER (PARTITION BY page, l ORDER BY y1, y2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM p)
        SELECT page, round(sum(greatest(y2 - greatest(coalesce(top, y1), y1), 0) * (rt - l)), 3) AS area, sum(greatest(y2 - greatest(coalesce(top, y1), y1), 0) * (rt - l)) / 480000.0 >= 0.5 AS covered FROM q GROUP BY page""",
    "dominant_style": _BASE + f" SELECT page, colour, face FROM {_MODE('colour', 'greatest(length(trim(text)), 1)')} JOIN {_MODE('face', '1')} USING (page)",
    "median_fonts": _BASE + " SELECT page, colour, round(median(size), 6) AS median_size FROM s GROUP BY page, colour",
    "distinct_texts": _BASE + " SELECT page, text, min(span_id) AS first_span FROM s GROUP BY page, text",
    "line_clusters": _BASE + """
        , t AS (SELECT page, greatest(2.0, median(size) * 0.4) AS tol FROM s GROUP BY page),
        n AS (SELECT s.page, span_id, x1, (y1 + y2) / 2 AS cy, tol, row_number() OVER (PARTITION BY s.page ORDER BY -(y1 + y2) / 2, x1, span_id) AS rn FROM s JOIN t USING (page)),
        f AS (SELECT page, span_id, x1, rn, 0 AS line, 1 AS cnt, CAST(cy AS DOUBLE) AS mean FROM n WHERE rn = 1
              UNION ALL
              SELECT n.page, n.span_id, n.x1, n.rn, CASE WHEN abs(cy - mean) <= tol THEN line ELSE line + 1 END, CASE WHEN abs(cy - mean) <= tol THEN cnt + 1 ELSE 1 END,
                     CASE WHEN abs(cy - mean) <= tol THEN (mean * cnt + cy) / (cnt + 1) ELSE cy END
              FROM f JOIN n ON n.page = f.page AND n.rn = f.rn + 1)
        SELECT page, span_id, CAST(line AS BIGINT) AS line, row_number() OVER (PARTITION BY page ORDER BY line, x1, span_id) AS place FROM f""",
    "layout_filter": _BASE + """
        , k AS (SELECT *, count(*) OVER (PARTITION BY page) AS many, (x2 - x1) * (y2 - y1) AS area FROM r WHERE label <> 'reference'),
        fit AS (SELECT * FROM k WHERE x2 - x1 >= 6 AND y2 - y1 >= 6 AND NOT (label = 'image' AND many > 1 AND area > 0.93 * 480000)),
        o AS (SELECT a.page, a.layout_id AS i, b.layout_id AS j, a.label AS p, b.label AS q, a.area AS u, b.area AS v,
                     greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) / least(a.area, b.area) AS share
              FROM fit a JOIN fit b ON a.page = b.page AND a.layout_id < b.layout_id),
        l AS (SELECT page, i, j, CASE WHEN share > 0.5 AND 'inline_formula' IN (p, q) THEN list_filter([CASE WHEN p = 'inline_formula' THEN i END, CASE WHEN q = 'inline_formula' THEN j END], lambda x: x IS NOT NULL)
                     WHEN share > 0.7 AND NOT (p <> q AND len(list_intersect([p, q], ['image', 'table', 'seal', 'chart'])) >= CASE WHEN 'table' IN (p, q) THEN 2 ELSE 1 END) THEN CASE WHEN u >= v THEN [j] ELSE [i] END END AS losers FROM o),
        n AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY i, j) AS rn FROM l WHERE losers IS NOT NULL),
        f AS (SELECT DISTINCT page, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS gone FROM n
              UNION ALL SELECT f.page, n.rn, CASE WHEN list_contains(gone, i) OR list_contains(gone, j) THEN gone ELSE gone || losers END FROM f JOIN n ON n.page = f.page AND n.rn = f.rn + 1),
        z AS (SELECT page, arg_max(gone, rn) AS gone FROM f GROUP BY page)
        SELECT fit.page, layout_id, label FROM fit LEFT JOIN z USING (page) WHERE gone IS NULL OR NOT list_contains(gone, layout_id)""",
    "block_groups": _BASE + _MATCH + """
        SELECT s.page, layout_id, coalesce(label, 'zzz_none') AS label, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, string_agg(text, ' ' ORDER BY span_id, text) AS texts
        FROM s LEFT JOIN m USING (page, span_id) GROUP BY s.page, layout_id, coalesce(label, 'zzz_none')""",
}
