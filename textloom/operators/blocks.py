"""Blocks of a page: whether a block is translated whole or span by span, stray fragments, and tagged blocks."""

from __future__ import annotations

import functools
import itertools
import operator
from collections.abc import Iterator
from statistics import median

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.language import span_text
from textloom.functions.text import strip
from textloom.operators import layout
from textloom.operators.chunks import cell_text, line_text
from textloom.operators.layout import attached_lines
from textloom.operators.tables import compact_cells

# Regions whose blocks may be translated whole, titles, references, regions of separate rows.
PARAGRAPHS = ("text", "footnote", "paragraph_title", "doc_title", "figure_title", "abstract", "reference", "reference_content", "header", "footer")
TITLES, REFERENCES, ROWS = ("paragraph_title", "doc_title", "figure_title"), ("reference", "reference_content"), ("chart",)
# Least lines and median width, most short lines, spread of left edges, variation of gaps.
PROFILES = {
    "conservative": (3, 0.65, 0.25, 0.06, 0.50),
    "balanced": (2, 0.55, 0.35, 0.08, 0.60),
    "aggressive": (2, 0.45, 0.45, 0.12, 0.80),
    "title": (2, 0.35, 0.60, 0.15, 0.90),
}
# Shares of the block's width and sizes of the other rules of block modes.
SHORT_LINE, FONT_RATIO, TINY_CHARS, TINY_WIDTH, COLUMN_GAP = 0.4, 1.8, 2, 0.25, 0.25
NOTE_LINES, NOTE_FIRST, NOTE_REST, NOTE_REACH, NOTE = (2, 4), 0.75, 0.18, 2.5, r"^\[[^\]]+\]"
BOX_CHARS, BOX_WIDTH = (20, 140), 0.45
# Fixed values of fragments: most characters; least and share of the size for baselines, gaps, sizes.
ORPHAN_CHARS, BASELINE, GAP, SIZES = 24, (2.5, 0.6), (6.0, 0.9), (1.5, 0.25)
LIST_LINE = r"^(?:\d+[.)]|[-•·])(?U)\s+"


def _centre() -> Column:
    return (F.col("y1") + F.col("y2")) / 2


def _lined(spans: DataFrame, keys: list[str]) -> DataFrame:
    """``spans`` with their centre ``cy`` and their line from the top. They go through the fold of their page whole, so that
    they stay dealt by page and all that follows needs no shuffle."""
    known = functools.reduce(operator.and_, [F.col(c).isNotNull() for c in (*keys, "span_id")])
    rows = spans.where(known).withColumn("cy", _centre())
    rest = F.struct(*[c for c in rows.columns if c not in keys]).alias("rest")
    lines = attached_lines(rows.select(*keys, "span_id", "x1", "x2", "cy", F.coalesce("size", F.lit(0.0)).alias("size"), "text", rest), keys, ("rest",))
    return lines.select(*keys, "rest.*", "line")


def _ordered(text: str, *order: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.coalesce(text, F.lit("")).alias("t")))), lambda s: s["t"]), "")


def block_modes(spans: DataFrame, keys: list[str], profile: str = "balanced", labels: tuple[str, ...] = PARAGRAPHS) -> DataFrame:
    """(keys, mode): ``block`` where a block's lines look like one paragraph, else ``span`` (O-141). Spans have span_id, box,
    size, text, textbox, the block's label and its sides bx1, bx2. Lines are scored by the spread of their widths, left
    edges and gaps; a wide step between left edges with two lines on both sides is a second column. Notes that start
    with a bracket and short texts of one box are whole whatever their lines look like."""
    rows = _lined(spans, keys).withColumn("down", -F.col("cy"))
    sized = F.when(F.col("size") > 0, F.col("size"))
    lines = rows.groupBy(*keys, "line").agg(
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("y2").alias("y2"), F.max("x2").alias("x2"),
        F.length(strip(_ordered("text", "x1", "span_id"))).alias("chars"),
        F.collect_list(F.struct("down", "x1", "span_id", F.coalesce("text", F.lit("")).alias("t"))).alias("own"),
        F.max("label").alias("label"), F.count(F.lit(1)).alias("spans"), F.collect_set("textbox").alias("boxes"),
        F.max(sized).alias("largest"), F.min(sized).alias("smallest"), F.max("bx2").alias("bx2"), F.min("bx1").alias("bx1"),
    )
    block, down, across = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(F.desc("cy"), "line"), Window.partitionBy(*keys).orderBy("x1", "line")
    lines = lines.withColumns({"cy": _centre(), "width": F.greatest(F.col("x2") - F.col("x1"), F.lit(0.0))})
    lines = lines.withColumns(
        {
            "number": F.row_number().over(down),
            "gap": F.when(F.lag("y1").over(down).isNotNull(), F.greatest(F.lag("y1").over(down) - F.col("y1"), F.lit(0.0))),
            "step": F.struct((F.col("x1") - F.lag("x1").over(across)).alias("by"), (1 - F.row_number().over(across)).alias("left")),
            "wide": F.greatest(F.max("bx2").over(block) - F.min("bx1").over(block), F.lit(0.0)),
            "first_cy": F.max("cy").over(block),
        }
    )
    lines = lines.withColumn("own", F.filter("own", lambda s: F.abs(-s["down"] - F.col("first_cy")) <= NOTE_REACH))
    share = F.col("width") / F.nullif("wide", F.lit(0.0))
    found = lines.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("lines"),
        F.median("width").alias("median"),
        F.avg((F.col("width") < F.col("wide") * SHORT_LINE).cast("double")).alias("short"),
        F.stddev_pop("x1").alias("spread"),
        (F.coalesce(F.stddev_pop("gap"), F.lit(0.0)) / F.nullif(F.avg("gap"), F.lit(0.0))).alias("variation"),
        F.max(F.when(F.col("step.by").isNotNull(), F.col("step"))).alias("step"),
        F.sum("chars").alias("chars"),
        F.min("chars").alias("least_chars"),
        F.max(share).alias("widest"),
        F.max(F.when(F.col("number") == 1, share)).alias("first"),
        F.min(F.when(F.col("number") > 1, share)).alias("rest"),
        F.bool_or((F.col("chars") <= TINY_CHARS) & (share < TINY_WIDTH)).alias("tiny"),
        F.max("wide").alias("wide"),
        F.max("label").alias("label"),
        F.sum("spans").alias("spans"),
        F.size(F.array_distinct(F.flatten(F.collect_list("boxes")))).alias("boxes"),
        (F.max("largest") / F.min("smallest")).alias("ratio"),
        strip(F.array_join(F.transform(F.array_sort(F.flatten(F.collect_list("own"))), lambda s: s["t"]), "")).alias("head"),
    )
    c = F.col
    few = c("lines").between(*NOTE_LINES)
    note = few & c("head").rlike(NOTE) & (c("first") >= NOTE_FIRST) & (c("rest") >= NOTE_REST)
    boxed = few & (c("boxes") == 1) & c("chars").between(*BOX_CHARS) & (c("widest") >= BOX_WIDTH) & (c("least_chars") > 1)
    left = -c("step.left")
    columns = (c("lines") >= 3) & (c("step.by") >= c("wide") * COLUMN_GAP) & (left >= 2) & (c("lines") - left >= 2)
    of = lambda i: F.when(c("label").isin(*TITLES), PROFILES["title"][i]).otherwise(PROFILES[profile][i])
    loose = (
        (c("lines") < of(0))
        | (c("median") / c("wide") < of(1))
        | (c("short") > of(2))
        | (c("spread") / c("wide") > of(3))
        | (F.coalesce("variation", F.lit(0.0)) > of(4))
    )
    mode = (
        F.when(~F.coalesce(c("label").isin(*labels), F.lit(False)) | (c("spans") < 2), "span")
        .when(c("label").isin(*REFERENCES), "block")
        .when((c("lines") < 2) | (c("wide") <= 0), "span")
        .when(note | boxed, "block")
        .when(loose | columns | (F.coalesce("ratio", F.lit(1.0)) > FONT_RATIO) | c("tiny"), "span")
        .otherwise("block")
    )
    return found.select(*keys, mode.alias("mode"))


def line_means(spans: list[tuple]) -> list[float]:
    """Centres of the boxes of the lines of (x1, y1, x2, y2, size, text) in a row's fold, by the rule of ``attached_lines``."""
    sizes = [s[4] for s in spans if s[4]]
    middle = median(sizes) if sizes else 10.0
    near = max(layout.LEAST_LINE, middle * layout.LINE_SHARE)
    further, beside = max(near, middle * layout.FRAGMENT_SHARE), max(layout.LEAST_GAP, middle * layout.GAP_SHARE)
    lines: list[list[tuple]] = []
    mean = 0.0
    for span in sorted(spans, key=lambda s: (-(s[1] + s[3]) / 2, s[0])):
        centre, size = (span[1] + span[3]) / 2, span[4] or middle
        joins = bool(lines) and abs(centre - mean) <= near
        if lines and not joins and size <= middle * layout.SMALL_SHARE and abs(centre - mean) <= further:
            line = lines[-1]
            letters = len("".join((span[5] or "").split()))
            short = 0 < letters <= layout.FRAGMENT_CHARS or size <= middle * layout.TINY_SHARE
            joins = short and span[0] <= max(s[2] for s in line) + beside and span[2] >= min(s[0] for s in line) - beside
        if joins:
            lines[-1].append(span)
            mean += (centre - mean) / len(lines[-1])
        else:
            lines.append([span])
            mean = centre
    return [(min(s[1] for s in line) + max(s[3] for s in line)) / 2 for line in lines]


class _Anchor:
    """A block that may take fragments in; its lines and sizes are looked at again only after it did."""

    __slots__ = ("block", "right", "spans", "lines", "size")

    def __init__(self, block: int, spans: list[tuple]):
        self.block, self.spans = block, spans
        self.right = spans[0][2] if len(spans) == 1 else max(s[2] for s in spans)
        self.lines: list[float] | None = None
        self.size: float | None = None

    def takes(self, span: tuple) -> bool:
        """Whether a span that begins close by is at the height of a line and set alike."""
        if self.lines is None and len(self.spans) == 1:
            one = self.spans[0]
            self.lines, self.size = [(one[1] + one[3]) / 2], one[4] or None
        elif self.lines is None:
            sizes = [s[4] for s in self.spans if s[4]]
            self.lines, self.size = line_means(self.spans), median(sizes) if sizes else None
        size = span[4] or 0.0
        off = min(abs(y - (span[1] + span[3]) / 2) for y in self.lines)
        alike = self.size is None or abs(self.size - size) <= max(SIZES[0], self.size * SIZES[1])
        return off <= max(BASELINE[0], size * BASELINE[1]) and alike

    def add(self, span: tuple) -> None:
        self.spans.append(span)
        self.right, self.lines = max(self.right, span[2]), None


def _merged_page(made: dict[int, list[tuple]]) -> dict[int, int]:
    """The block that each block of a page goes to; ``made`` has the spans of each block by id."""
    corner = lambda own: (own[0][3], own[0][0]) if len(own) == 1 else (max(s[3] for s in own), min(s[0] for s in own))
    places = sorted((-round(top, 2), round(left, 2), block) for block, (top, left) in ((block, corner(own)) for block, own in made.items()))
    anchors: dict[tuple, list[_Anchor]] = {}  # those of each kind, the last one last
    into = {}
    for *_, block in places:
        own = made[block]
        span = own[0]
        left, size, words, kept, source, label = span[0], span[4], *span[5:]
        known = anchors.setdefault((source, label), [])
        taken = None
        if len(own) == 1 and not kept and 0 < len((words or "").strip()) <= ORPHAN_CHARS and (label or "").strip().lower() != "table":
            gap = max(GAP[0], (size or 0.0) * GAP[1])
            for anchor in reversed(known):
                if anchor.right <= left <= anchor.right + gap and anchor.takes(span):
                    taken = anchor
                    break
        if taken is None:
            known.append(_Anchor(block, own))
            into[block] = block
        else:
            taken.add(span)
            into[block] = taken.block
    return into


def _listed(column: pa.Array) -> list:
    plain = column.null_count == 0 and not pa.types.is_string(column.type)
    return column.to_numpy(zero_copy_only=False).tolist() if plain else column.to_pylist()


#: Rows of a batch that the fold of fragments gives back.
FOLD_ROWS = 10_000


def merge_orphans(spans: DataFrame, page: str) -> DataFrame:
    """(page, span_id, block, into): the block that each span belongs to once short fragments have gone to the block
    left of them on the same line (O-138). Spans have block, box, size, text, kept, source and label. Blocks come from the
    top, then from the left; a block of one short span looks for the last block before it that ends close by, has
    a line at its height and is set alike; that block then ends where the fragment does and may take in the next. So a
    page is a fold over its blocks. Pages lie in their partition one after the other, and the fold walks through them:
    a group of its own for each page costs more than its fold."""

    names = (page, "block", "span_id", "x1", "y1", "x2", "y2", "size", "text", "kept", "source", "label")
    kinds = {f.name: f.dataType for f in spans.schema.fields}
    schema = T.StructType([T.StructField(n, kinds[n]) for n in (page, "span_id", "block")] + [T.StructField("into", kinds["block"])])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made_of: pa.Schema | None = None
        out: tuple[list, ...] = ([], [], [], [])

        def emit() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, made_of)], schema.names)
            for v in out:
                v.clear()
            return batch

        def rows() -> Iterator[tuple]:
            nonlocal made_of
            for batch in batches:
                kind = batch.schema.field
                made_of = [kind(n).type for n in (page, "span_id", "block", "block")]
                yield from zip(*(_listed(batch.column(n)) for n in names))

        for key, group in itertools.groupby(rows(), operator.itemgetter(0)):
            made: dict[int, list[tuple]] = {}
            held = []
            for _, block, span_id, *span in group:
                made.setdefault(block, []).append(tuple(span))
                held.append((span_id, block))
            into = _merged_page(made)
            out[0].extend([key] * len(held))
            out[1].extend(s for s, _ in held)
            out[2].extend(b for _, b in held)
            out[3].extend(into[b] for _, b in held)
            if len(out[0]) >= FOLD_ROWS:
                yield emit()
        if out[0]:
            yield emit()

    nan = F.lit(float("nan"))
    boxed = spans.withColumns({**{n: F.coalesce(F.col(n).cast("double"), nan) for n in ("x1", "y1", "x2", "y2")}, "size": F.nanvl("size", F.lit(None).cast("double"))})
    return boxed.select(*names).repartition(page).sortWithinPartitions(page, "block", "span_id").mapInArrow(walk, schema)


def paragraphs(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text): spans that are not kept as lines of text (O-147): joined by line feeds for references and where a line
    is a list's, else by spaces. ``label`` is the block's."""
    rows = _lined(spans.where(~F.col("kept")), keys)
    lines = line_text(rows, [*keys, "line"]).where("text <> ''")
    labels = spans.groupBy(*keys).agg(F.max("label").alias("label"))
    found = lines.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s["text"]).alias("lines")).join(labels, keys)
    listed = F.exists("lines", lambda t: strip(t).rlike(LIST_LINE))
    broken = F.col("label").isin(*REFERENCES) | listed
    return found.select(*keys, F.when(broken, F.array_join("lines", "\n")).otherwise(F.array_join("lines", " ")).alias("text"))


def _cell_key() -> Column:
    corners = [F.round(f"c_{n}", 2).alias(n) for n in ("x1", "y1", "x2", "y2")]
    return F.when(F.col("c_x1").isNotNull(), F.struct(*corners))


def _whole(spans: DataFrame, page: str) -> DataFrame:
    """Blocks that go as one text: place, block, plain, no spans."""
    own = spans.where("mode = 'block'")
    text = paragraphs(own, [page, "block"]).join(own.groupBy(page, "block").agg(F.max("label").alias("label")), [page, "block"])
    flat = lambda t: strip(F.regexp_replace(t, r"(?U)\s+", " "))
    lines = F.array_join(F.filter(F.transform(F.split("text", "\n"), flat), lambda t: t != ""), "\n")
    plain = F.when(F.col("label").isin(*REFERENCES), lines).otherwise(flat(F.col("text")))
    return text.select(page, "block", F.lit(0).cast("long").alias("at"), plain.alias("plain"), F.expr("cast(array() as array<struct<name:string,text:string,block:bigint,span_id:bigint>>)").alias("spans")).where("plain <> ''")


def _shared_cells(rows: DataFrame, page: str) -> DataFrame:
    """Spans of cells whose text lies in several blocks: page, cell, block, place, span_id, and their order in the cell."""
    cells = rows.where("label = 'table' AND fine AND cell IS NOT NULL")
    several = cells.groupBy(page, "cell").agg(F.count_distinct("block").alias("blocks")).where("blocks > 1").select(page, "cell")
    cells = cells.join(several, [page, "cell"]).withColumn("high", F.col("c_y2") - F.col("c_y1"))
    compact = compact_cells(cells, [page, "cell"], "high").where("compact").select(page, "cell")
    order = Window.partitionBy(page, "cell").orderBy(-_centre(), "x1", "block", "span_id")
    return cells.join(compact, [page, "cell"]).withColumn("nth", F.row_number().over(order).cast("long") - 1)


def tagged_blocks(spans: DataFrame, page: str) -> DataFrame:
    """(page, number, block, plain, spans): the numbered texts of a page that are translated (O-145). Spans have block, place (in
    their block), span_id, box, size, text, kept, label, mode and the corners c_x1 .. c_y2 of their cell, if any. A block
    in mode ``block`` is one text; else the spans of a table fall into runs of the same cell, those of a chart stand
    alone, and all others of a block are one group. A cell whose spans lie in several blocks and hang together is
    one group, with its text joined, where its first span stands; its other spans end the run that they stand in."""
    t = span_text(F.coalesce("text", F.lit("")))
    rows = spans.where("mode = 'span'").withColumn("t", t).withColumn("label", F.lower(F.trim(F.coalesce("label", F.lit("")))))
    rows = rows.withColumns({"fine": ~F.col("kept") & (F.col("t") != "") & ~F.contains("t", F.lit("(cid:")), "cell": _cell_key()})
    shared = _shared_cells(rows, page)
    rows = rows.join(shared.select(page, "block", "span_id", F.lit(True).alias("shared")), [page, "block", "span_id"], "left")
    alone = F.col("fine") & F.col("shared").isNull()
    key = (
        F.when((F.col("label") == "table") & F.col("cell").isNotNull(), F.to_json("cell"))
        .when(F.col("label").isin("table", *ROWS), F.concat(F.lit("span "), F.col("span_id").cast("string")))
        .otherwise(F.lit("block"))
    )
    walk = Window.partitionBy(page, "block").orderBy("place")
    # in a table every span counts for the runs; elsewhere those that are not translated are passed over
    rows = rows.where(alone | (F.col("label") == "table")).withColumn("key", F.when(alone, key))
    new = F.coalesce(F.lag("key").over(walk) != F.col("key"), F.lit(True))
    rows = rows.withColumn("run", F.sum(new.cast("int")).over(walk)).where("key IS NOT NULL")
    named = lambda many: F.transform(many, lambda s, i: F.struct(F.concat(F.lit("SPAN_"), i.cast("string")).alias("name"), s["t"].alias("text"), s["block"].cast("long").alias("block"), s["span_id"].cast("long").alias("span_id")))
    runs = rows.groupBy(page, "block", "run").agg(F.min("place").cast("long").alias("at"), F.array_sort(F.collect_list(F.struct("place", "t", "block", "span_id"))).alias("many"))
    runs = runs.select(page, "block", "at", F.lit(None).cast("string").alias("plain"), named(F.col("many")).alias("spans"))
    joined = cell_text(shared.select(page, "cell", "nth", "text"), [page, "cell"], ["nth"])
    cells = shared.groupBy(page, "cell").agg(
        F.min_by("block", "nth").alias("block"), F.min_by("place", "nth").cast("long").alias("at"), F.array_sort(F.collect_list(F.struct("nth", "t", "block", "span_id"))).alias("many")
    )
    cells = cells.join(joined, [page, "cell"]).select(page, "block", "at", F.col("text").alias("plain"), named(F.col("many")).alias("spans"))
    found = runs.unionByName(cells).unionByName(_whole(spans, page))
    number = F.row_number().over(Window.partitionBy(page).orderBy("block", "at")).cast("long") - 1
    return found.select(page, number.alias("number"), "block", "plain", "spans")
