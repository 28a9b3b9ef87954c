"""Markdown: line kinds, tables, segments, protection and restore."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import markup as mk
from textloom.functions.text import strip

# The forms of lines.
SEPARATOR = r"(?U)^\s*\|?(?:\s*:?-+:?\s*\|)+\s*:?-+:?\s*\|?\s*$"
PLACEHOLDER = r"^%%PROTECTED_[A-Z0-9_]+%%$"
PREFIXES = (
    ("heading", r"^(#{1,6}[ \t]+)"),
    ("blockquote", r"^((?:>[ \t]*)+)"),
    ("list_item", r"(?U)^(\s*(?:[-+*]|\d+\.)\s+(?:\[[ xX]\]\s+)?)"),
)


def lines(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, line, start, content): lines with the offset where each begins."""
    rows = df.select(id_col, F.posexplode(F.split(text, "\n", -1)).alias("line", "content"))
    w = Window.partitionBy(id_col).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum(F.length("content") + 1).over(w), F.lit(0)))


def line_kinds(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``lines`` with kind (O-23, O-24) and prefix length. A table is a separator below a row of as many
    cells, with the rows that follow until one without a pipe."""
    w = Window.partitionBy(id_col).orderBy("line")
    rows = lines(df, id_col).withColumn("core", strip(F.col("content"))).withColumn("sig", mk.table_signature(F.col("content")))
    rows = rows.withColumn("cells", mk.table_cells(F.col("sig"))).withColumn("pipes", F.col("sig.pipes"))
    rows = rows.withColumn("separator", F.col("core").rlike(SEPARATOR))
    valid = F.col("separator") & (F.lag("pipes").over(w) > 0) & (F.lag("cells").over(w) == F.col("cells"))
    rows = rows.withColumn("valid", F.coalesce(valid, F.lit(False)))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    last_separator = F.max(F.when(F.col("valid"), F.col("line"))).over(upto)
    last_plain = F.max(F.when(F.coalesce(F.col("pipes"), F.lit(0)) == 0, F.col("line"))).over(upto)
    body = (F.col("line") > last_separator) & (F.coalesce(last_plain, F.lit(-1)) < last_separator)
    header = F.coalesce(F.lead("valid").over(w), F.lit(False))
    rows = rows.withColumn("in_table", F.coalesce(body, F.lit(False)) | header)
    kind = F.when((F.col("core") == "") | F.col("core").rlike(PLACEHOLDER) | F.col("separator"), "break").when(F.col("in_table"), "table_row")
    prefix = F.lit("")
    for name, pattern in PREFIXES:
        kind = kind.when(F.col("content").rlike(pattern), name)
    for name, pattern in reversed(PREFIXES):
        prefix = F.when(F.col("content").rlike(pattern), F.regexp_extract("content", pattern, 1)).otherwise(prefix)
    rows = rows.withColumn("kind", kind.otherwise("paragraph"))
    prefix = F.when(F.col("kind").isin("heading", "blockquote", "list_item"), prefix).otherwise("")
    return rows.withColumn("prefix", F.length(prefix)).select(id_col, "line", "start", "content", "kind", "prefix")


def segments(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Segments of Markdown texts in order (O-23, O-27): paragraphs are islands of plain lines."""
    w = Window.partitionBy(id_col).orderBy("line")
    rows = line_kinds(df, id_col).where("kind <> 'break'")
    new = (F.col("kind") != "paragraph") | (F.lag("kind").over(w) != "paragraph") | (F.lag("line").over(w) + 1 != F.col("line"))
    rows = rows.withColumn("island", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = rows.groupBy(id_col, "island").agg(
        F.min("kind").alias("kind"),
        F.min("start").alias("start"),
        F.max("prefix").alias("prefix"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "content"))), lambda x: x["content"]), "\n").alias("raw"),
    )
    raw = F.col("raw")
    paragraph = F.col("kind") == "paragraph"
    lead = F.length(raw) - F.length(F.regexp_replace(raw, r"(?U)^\s+", ""))
    text = F.when(paragraph, strip(raw)).otherwise(F.substring(raw, F.col("prefix") + 1, F.length(raw)))
    start = F.col("start") + F.when(paragraph, lead).otherwise(F.col("prefix"))
    out = joined.select(id_col, "kind", start.alias("start_offset"), text.alias("source_text")).where(strip(F.col("source_text")) != "")
    order = F.row_number().over(Window.partitionBy(id_col).orderBy("start_offset")) - 1
    out = out.withColumn("seg_order", order.cast("long"))
    return out.withColumn("segment_id", F.format_string("MD_%04d", "seg_order")).withColumn(
        "end_offset", F.col("start_offset") + F.length("source_text")
    )


# What is protected, in this order, under which name and whether it serves as context. Line ends are
# plain (?d); the block patterns end possessively, so that long blocks take no recursion.
PROTECTED = (
    ("FRONT_MATTER", r"(?dsU)\A---\s*\r?\n.*?\r?\n(?:---|\.\.\.)[ \t]*(?:\r?\n|\z)", True),
    ("CODE_BLOCK", r"(?dms)^(```|~~~).*?^\1[^\n\r]*(?:\r?\n|$)", True),
    ("CODE_BLOCK", r"(?dm)(?:^(?: {4}|\t).*(?:\r?\n|$))++", True),
    ("HTML_BLOCK", r"(?dms)^<[A-Za-z!/][^>]*>.*?(?:\r?\n\r?\n|$)", False),
    ("REFERENCE_LINK", r"(?dmU)^\s*\[[^\]]+\]:\s+\S.*$", False),
    ("INLINE_CODE", r"`[^`\n]+`", False),
)
MARK = r"%%PROTECTED_[A-Z_]+_\d{4}%%"
SNIPPETS, SNIPPET_CHARS = 5, 180
#: What the scan for link destinations steps over at a time.
_TOKEN = r"(?s)\\|\]\(|[()\]]|[^\\()\]]+"
_SPANS = "array<struct<mark:string,content:string,context:boolean>>"


def _marks(kind: str, first: Column, contents: Column, context: bool) -> Column:
    """Contents with their placeholders, numbered from ``first``."""
    return F.transform(
        contents,
        lambda c, i: F.struct(
            F.format_string(f"%%%%PROTECTED_{kind}_%04d%%%%", first + i).alias("mark"), c.alias("content"), F.lit(context).alias("context")
        ),
    )


def _woven(gaps: Column, new: Column) -> Column:
    """Gap, placeholder, gap and so on as one text."""
    return F.array_join(F.flatten(F.zip_with(gaps, new, lambda gap, n: F.array(gap, F.coalesce(n["mark"], F.lit(""))))), "")


def link_destinations(tokens: Column) -> Column:
    """(begin, end) of balanced link destinations in an array of ``_TOKEN`` tokens, as places of the tokens that
    enclose them (O-86). The state is how many parentheses are open, 0 outside; a backslash hides the next
    character of a destination; what never closes keeps the scan inside it to the end."""
    none = F.expr("cast(array() as array<struct<begin:int,end:int>>)")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("open"), F.lit(0).alias("begin"), F.lit(False).alias("hidden"), none.alias("out"))

    def step(s: Column, token: Column) -> Column:
        outside, shown = s["open"] == 0, ~s["hidden"]
        opens = F.when(token == "](", 1).when((token == "(") & shown, 1).otherwise(0)
        closes = F.when((token == ")") & shown, 1).otherwise(0)
        enters = outside & (token == "](")
        now = F.when(outside, F.when(enters, 1).otherwise(0)).otherwise(s["open"] + opens - closes)
        leaves = ~outside & (now == 0)
        found = F.struct(s["begin"].alias("begin"), s["at"].alias("end"))
        return F.struct(
            (s["at"] + 1).alias("at"),
            now.cast("int").alias("open"),
            F.when(enters, s["at"]).otherwise(s["begin"]).alias("begin"),
            (~outside & shown & (token == "\\")).alias("hidden"),
            F.when(leaves, F.array_append(s["out"], found)).otherwise(s["out"]).alias("out"),
        )

    return F.aggregate(tokens, start, step, lambda s: s["out"])


def _computed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once however often they are read: a generator's output is never
    copied into the expressions above it."""
    return df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def protect(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, working, spans, context, restored): texts with placeholders, what they stand for, up to five snippets
    of context, and whether restoring gives the text back (O-85 to O-89). One projection a pattern: matches and
    the gaps between them are cut out of the text so far and woven together again."""
    source = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias(id_col), source.alias("source"), source.alias("working"), F.expr(f"cast(array() as {_SPANS})").alias("spans"))
    for kind, pattern, context in PROTECTED:
        found = F.regexp_extract_all("working", F.lit(pattern), F.lit(0))
        rows = _computed(rows, gaps=F.split("working", pattern, -1), new=_marks(kind, F.size("spans"), found, context))
        rows = _computed(rows, working=F.when(F.size("new") == 0, F.col("working")).otherwise(_woven(F.col("gaps"), F.col("new"))))
        rows = rows.select(id_col, "source", "working", F.concat("spans", "new").alias("spans"))
    links = F.when(F.contains("working", F.lit("](")), F.regexp_extract_all("working", F.lit(_TOKEN), F.lit(0))).otherwise(F.array(F.col("working")))
    rows = _computed(rows, tokens=links)
    rows = _computed(rows, places=link_destinations(F.col("tokens")))
    part = lambda first, end: F.array_join(F.slice("tokens", first + 1, end - first), "")
    edges = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("places", i - 1)["end"])
    gaps = F.transform("places", lambda p, i: part(edges(i), p["begin"] + 1))
    contents = F.transform("places", lambda p: part(p["begin"] + 1, p["end"]))
    rows = _computed(
        rows,
        gaps=F.array_append(gaps, part(edges(F.size("places")), F.size("tokens"))),
        new=_marks("LINK_DEST", F.size("spans"), contents, False),
    )
    rows = _computed(rows, working=F.when(F.size("new") == 0, F.col("working")).otherwise(_woven(F.col("gaps"), F.col("new"))), spans=F.concat("spans", "new"))
    shown = F.slice(F.filter("spans", lambda x: x["context"]), 1, SNIPPETS)
    snippet = lambda x: F.substring(strip(F.regexp_replace(x["content"], r"(?U)\s+", " ")), 1, SNIPPET_CHARS)
    plain = F.transform("spans", lambda x: F.struct(x["mark"].alias("mark"), x["content"].alias("content")))
    rows = rows.select(id_col, "source", "working", plain.alias("spans"), F.transform(shown, snippet).alias("context"))
    restored = F.coalesce(restore(F.col("working"), F.col("spans")) == F.col("source"), F.lit(False))
    return rows.select(id_col, "working", "spans", "context", restored.alias("restored"))


def restore(working: Column, spans: Column) -> Column:
    """The text with the contents of ``spans`` (mark, content) put back in order, or null where its structure was
    broken: a placeholder that is not there exactly once, one that is left, an odd number of fences (O-88)."""
    times = lambda t, what: F.size(F.split(t, what, -1)) - 1
    whole = F.aggregate(
        spans,
        working,
        lambda t, s: F.when(F.size(F.split(t, s["mark"], -1)) == 2, F.replace(t, s["mark"], s["content"])),
    )
    broken = lambda t: t.rlike(MARK) | (times(t, "```") % 2 == 1) | (times(t, "~~~") % 2 == 1)
    return F.get(F.filter(F.array(whole), lambda t: ~broken(t)), F.lit(0))


def accepted(kind: str, candidate: str, source: str) -> Column:
    """Whether a candidate keeps the placeholders, and for rows of tables the pipes (O-70)."""
    marks = lambda c: F.array_sort(F.regexp_extract_all(F.col(c), F.lit(r"%%PROTECTED_[A-Z_]+_\d{4}%%"), F.lit(0)))
    row = F.coalesce(mk.table_signature(F.col(candidate)) == mk.table_signature(F.col(source)), F.lit(False))
    return (strip(F.col(candidate)) != "") & (marks(candidate) == marks(source)) & ((F.col(kind) != "table_row") | row)
