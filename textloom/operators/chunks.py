"""Chunks of tagged pages: their grammar, whether an answer fits its source, and how their texts are joined.

A chunk is bounded by its token budget, so it is parsed in its row by a fold over its lines; texts are joined
from rows of spans with windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.arrays import let
from textloom.functions.language import span_text
from textloom.functions.text import strip, tokens_words
from textloom.operators.segments import pack_greedy

# The lines and tags of a chunk, characters that take no space, lines of lists.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\x{2028}\x{2029}]"
PAGE_LINE, BLOCK_LINE = r"^\[PAGE_(\d+)\]$", r"^\[(BLOCK_\d+)\]"
SPAN_PAIR = r"(?s)<(SPAN_\d+)>(.*?)</(SPAN_\d+)>"
SPAN_MARKS, CHUNK_MARKS = ("<SPAN_", "</SPAN_"), ("[PAGE_", "[BLOCK_")
CLOSING, OPENING = "，。；：！？、）】》」』,.;:!?%)]}", "（【《「『([{"
CJK = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2CEAF}\x{F900}-\x{FAFF}]"
GAP_SHARE, PLAIN_SIZE = 0.35, 10.0

_BLOCKS = "array<struct<page:int,block:string,content:string>>"


def _any(text: Column, marks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for mark in marks:
        out = out | F.contains(text, F.lit(mark))
    return out


def block_content(content: Column) -> Column:
    """(names, values) of a block's content: one value without a name, or the pairs of span tags that make up all of
    it, each once and with a text of its own. Null for anything else (O-80)."""

    def plain(text: Column) -> Column:
        return F.when(~_any(text, CHUNK_MARKS), F.struct(F.expr("cast(array() as array<string>)").alias("names"), F.array(text).alias("values")))

    def tagged(text: Column) -> Column:
        group = lambda i: F.regexp_extract_all(text, F.lit(SPAN_PAIR), F.lit(i))

        def checked(names: Column, values: Column, closes: Column) -> Column:
            fine = F.forall(values, lambda v: (strip(v) != "") & ~_any(v, SPAN_MARKS) & ~_any(v, CHUNK_MARKS))
            whole = (strip(F.regexp_replace(text, SPAN_PAIR, "")) == "") & (names == closes) & (F.size(F.array_distinct(names)) == F.size(names))
            return F.when((F.size(names) > 0) & whole & fine, F.struct(names.alias("names"), values.alias("values")))

        return let(group(1), lambda n: let(group(2), lambda v: checked(n, v, group(3))))

    of = lambda text: F.when(text == "", None).when(_any(text, SPAN_MARKS), tagged(text)).otherwise(plain(text))
    return let(strip(content), of)


def parse_chunk(text: Column) -> Column:
    """(pages, blocks) of a chunk, blocks as (page, block, names, values); null unless every line belongs to a page
    and a block, every page has a block and every block a proper content (O-80)."""
    lines = F.transform(F.split(text, LINE_END, -1), strip)
    start = F.struct(
        F.lit(None).cast("int").alias("page"), F.lit(False).alias("has"), F.lit(None).cast("string").alias("block"), F.expr("cast(array() as array<string>)").alias("content"),
        F.expr("cast(array() as array<int>)").alias("pages"), F.expr(f"cast(array() as {_BLOCKS})").alias("blocks"), F.lit(True).alias("ok"),
    )

    def closed(s: Column) -> Column:
        done = F.struct(s["page"].alias("page"), s["block"].alias("block"), F.array_join(s["content"], "\n").alias("content"))
        return F.when(s["block"].isNotNull(), F.array_append(s["blocks"], done)).otherwise(s["blocks"])

    def state(page: Column, has: Column, block: Column, content: Column, pages: Column, blocks: Column, ok: Column) -> Column:
        return F.struct(page.alias("page"), has.alias("has"), block.alias("block"), content.alias("content"), pages.alias("pages"), blocks.alias("blocks"), ok.alias("ok"))

    def step(s: Column, line: Column) -> Column:
        number = F.regexp_extract(line, PAGE_LINE, 1).try_cast("int")
        name = F.regexp_extract(line, BLOCK_LINE, 1)
        rest = F.substring(line, F.length(name) + 3, F.length(line))
        first = F.when(rest == "", F.expr("cast(array() as array<string>)")).otherwise(F.array(rest))
        none = F.expr("cast(array() as array<string>)")
        page = state(number, F.lit(False), F.lit(None).cast("string"), none, F.array_append(s["pages"], number), closed(s), s["ok"] & (s["page"].isNull() | s["has"]))
        block = state(s["page"], F.lit(True), name, first, s["pages"], closed(s), s["ok"] & s["page"].isNotNull())
        loose = state(s["page"], s["has"], s["block"], s["content"], s["pages"], s["blocks"], s["ok"] & (line == ""))
        more = state(s["page"], s["has"], s["block"], F.array_append(s["content"], line), s["pages"], s["blocks"], s["ok"])
        return F.when(number.isNotNull(), page).when(name != "", block).when(s["block"].isNull(), loose).otherwise(more)

    def finish(s: Column) -> Column:
        return F.when(s["ok"] & s["page"].isNotNull() & s["has"], F.struct(s["pages"].alias("pages"), closed(s).alias("blocks")))

    def whole(found: Column) -> Column:
        parsed = F.transform(found["blocks"], lambda b: F.struct(b["page"].alias("page"), b["block"].alias("block"), block_content(b["content"]).alias("c")))

        def checked(blocks: Column) -> Column:
            flat = F.transform(blocks, lambda b: F.struct(b["page"].alias("page"), b["block"].alias("block"), b["c"]["names"].alias("names"), b["c"]["values"].alias("values")))
            return F.when(F.forall(blocks, lambda b: b["c"].isNotNull()), F.struct(found["pages"].alias("pages"), flat.alias("blocks")))

        return F.when(found.isNotNull(), let(parsed, checked))

    return let(F.aggregate(lines, start, step, finish), whole)


def fits(source: Column, candidate: Column) -> Column:
    """Whether a parsed candidate can be put back into its parsed source (O-81): the same pages, blocks and span names;
    a block without spans takes a text, or spans in the order of their numbers."""
    number = lambda name: F.substring(name, 6, 12).cast("long")

    def one(a: Column, b: Column) -> Column:
        ordered = F.transform(b["names"], number) == F.array_sort(F.transform(b["names"], number))
        text = strip(F.array_join(b["values"], "")) != ""
        return (a["page"] == b["page"]) & (a["block"] == b["block"]) & F.when(F.size(a["names"]) > 0, a["names"] == b["names"]).otherwise(ordered & text)

    def both(a: Column, b: Column) -> Column:
        pairs = F.zip_with(a["blocks"], b["blocks"], lambda x, y: F.coalesce(one(x, y), F.lit(False)))
        return (a["pages"] == b["pages"]) & (F.size(a["blocks"]) == F.size(b["blocks"])) & F.forall(pairs, lambda p: p)

    return F.coalesce(let(source, lambda a: let(candidate, lambda b: F.when(a.isNotNull() & b.isNotNull(), both(a, b)))), F.lit(False))


def _joined(rows: DataFrame, keys: list[str], order: list[str], text: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text))), lambda x: x[text]), "")


def cell_text(spans: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, text): the texts of a cell's spans in order, without consecutive repeats; no space between Chinese
    characters, before closing and after opening marks (O-147)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = spans.withColumn("__text", span_text(F.col("text"))).where("__text <> ''")
    rows = rows.withColumn("__before", F.lag("__text").over(w)).where("__before IS NULL OR __before <> __text")
    left, right = F.right("__before", F.lit(1)), F.left("__text", F.lit(1))
    tight = (left.rlike(CJK) & right.rlike(CJK)) | F.contains(F.lit(CLOSING), right) | F.contains(F.lit(OPENING), left)
    rows = rows.withColumn("__text", F.concat(F.when(F.col("__before").isNull() | tight, "").otherwise(" "), F.col("__text")))
    return rows.groupBy(*keys).agg(_joined(rows, keys, order, "__text").alias("text"))


def line_text(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text): the texts of a line's spans (x1, x2, size) from left to right, with a space where the gap is over a
    share of the median size (O-147)."""
    w = Window.partitionBy(*keys).orderBy("x1", "span_id")
    size = F.coalesce(F.median(F.when(F.col("size") > 0, F.col("size"))).over(Window.partitionBy(*keys)), F.lit(PLAIN_SIZE))
    rows = spans.withColumn("__wide", size * GAP_SHARE).withColumn("__text", span_text(F.col("text"))).where("__text <> ''")
    apart = F.coalesce(F.col("x1") - F.lag("x2").over(w) > F.col("__wide"), F.lit(False))
    rows = rows.withColumn("__text", F.concat(F.when(apart, " ").otherwise(""), F.col("__text")))
    return rows.groupBy(*keys).agg(strip(_joined(rows, keys, ["x1", "span_id"], "__text")).alias("text"))


def rendered(blocks: DataFrame, doc: str) -> DataFrame:
    """(doc, text): blocks (page, block, plain or null, spans: array of (name, text)) as lines of tagged text, with the
    page's marker before its first block (O-149). Blocks without text and spans are left out."""
    many = F.array_join(F.transform("spans", lambda s: F.concat(F.lit("<"), s["name"], F.lit(">"), s["text"], F.lit("</"), s["name"], F.lit(">"))), "")
    body = F.coalesce("plain", F.when(F.size("spans") == 1, F.get("spans", F.lit(0))["text"]).otherwise(many))
    rows = blocks.where("plain IS NOT NULL OR size(spans) > 0").withColumn("__line", F.concat(F.format_string("[BLOCK_%d]", "block"), body))
    new = F.coalesce(F.lag("page").over(Window.partitionBy(doc).orderBy("page", "block")) != F.col("page"), F.lit(True))
    line = F.concat(F.when(new, F.format_string("[PAGE_%d]\n", "page")).otherwise(""), F.col("__line"))
    rows = rows.withColumn("__line", line)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "block", "__line"))), lambda x: x["__line"]), "\n")
    return rows.groupBy(doc).agg(text.alias("text"))


def page_chunks(lines: DataFrame, doc: str, most: int) -> DataFrame:
    """(doc, page, chunk, text): the lines of each page (page, block, line) packed under the token limit, each chunk
    with the page's marker (O-54). A marker that leaves no room is an error."""
    marker = F.format_string("[PAGE_%d]", "page")
    rows = lines.groupBy(doc, "page").agg(F.array_sort(F.collect_list(F.struct("block", "line"))).alias("lines"))
    room = F.lit(most) - tokens_words(marker)
    tight = F.when(room <= 0, F.raise_error(F.lit("the limit must be above the tokens of the page's marker")).cast("long")).otherwise(room)
    rows = rows.withColumn("room", tight)
    tokens = F.transform("lines", lambda x: tokens_words(x["line"]))
    rows = rows.select(doc, "page", "lines", pack_greedy(tokens, F.col("room")).alias("chunks"))
    each = rows.select(doc, "page", F.explode(F.arrays_zip("lines", "chunks")).alias("x")).select(doc, "page", F.col("x.chunks").cast("long").alias("chunk"), "x.lines.block", "x.lines.line")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "line"))), lambda x: x["line"]), "\n")
    return each.groupBy(doc, "page", "chunk").agg(text.alias("text")).select(doc, "page", "chunk", F.concat(marker, F.lit("\n"), F.col("text")).alias("text"))
