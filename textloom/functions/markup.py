"""Span markup: build, validate, repair, space, strip."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.arrays import let
from textloom.functions.text import strip

SPAN = r"(?s)<span>(.*?)</span>"
TAG = r"</?(?:span|p)>"
SPACE_MARK = "<SPACE>"
_NONE = "cast(array() as array<string>)"


def blank(text: Column) -> Column:
    return strip(text) == ""


def escape(text: Column) -> Column:
    """``&``, ``<`` and ``>`` as entities."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescape(text: Column) -> Column:
    """The reverse of ``escape`` (O-79)."""
    out = F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">"))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def marked_span(text: Column, slides: bool = False) -> Column:
    """A run in a span; on slides a run of white space becomes a mark (O-71)."""
    body = escape(text)
    if slides:
        body = F.when((text != "") & blank(text), SPACE_MARK).otherwise(body)
    return F.concat(F.lit("<span>"), body, F.lit("</span>"))


def candidate_content(candidate: Column, marker: Column, require: bool) -> Column:
    """The answer without its position marker; null where a required one is missing (O-72)."""
    value = F.regexp_replace(candidate, r"^[\r\n]+|[\r\n]+$", "")
    prefix = F.concat(F.lit("["), marker, F.lit("]"))
    other = F.lit(None).cast("string") if require else F.regexp_replace(value, r"^(?:\[[A-Z0-9_]+\])+", "")
    return F.when(F.startswith(value, prefix), F.substring(value, F.length(prefix) + 1, F.length(value))).otherwise(other)


def spans(text: Column) -> Column:
    """Contents of the spans."""
    return F.regexp_extract_all(text, F.lit(SPAN), F.lit(1))


def _tags(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TAG), F.lit(0))


def _outside(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, SPAN, ""), "</?p>", "")


def _same_frame(candidate: Column, source: Column) -> Column:
    return (_tags(candidate) == _tags(source)) & (F.size(spans(candidate)) == F.size(spans(source))) & blank(_outside(candidate))


def valid_document(candidate: Column, source: Column) -> Column:
    """Same tags, nothing outside, blank slots unchanged, others not blanked (O-73)."""
    ok = lambda s, c: F.when(blank(s), c == s).otherwise(~blank(c))
    slots = F.forall(F.zip_with(spans(source), spans(candidate), ok), lambda x: F.coalesce(x, F.lit(False)))
    return _same_frame(candidate, source) & blank(_outside(source)) & slots


def slide_values(text: Column) -> Column:
    """Contents of the spans if the text is nothing but spans, else null."""
    rest = F.regexp_replace(text, SPAN, "")
    loose = lambda t: F.contains(t, F.lit("<span")) | F.contains(t, F.lit("</span"))
    pure = lambda values: F.when((F.size(values) > 0) & let(rest, lambda r: blank(r) & ~loose(r)) & ~F.exists(values, loose), values)
    return let(spans(text), pure)


def valid_slide(candidate: Column, source: Column) -> Column:
    """Pure spans, equally many, space marks at the same places (O-74)."""
    marks = lambda a, b: F.forall(F.zip_with(a, b, lambda x, y: (x == SPACE_MARK) == (y == SPACE_MARK)), lambda x: F.coalesce(x, F.lit(False)))
    same = let(slide_values(source), lambda a: let(slide_values(candidate), lambda b: (F.size(a) == F.size(b)) & marks(a, b)))
    return F.coalesce(same, F.lit(False))


def _align(chunks: Column, slots: Column) -> Column:
    """Chunks on the slots: padded with empty ones, or the surplus joined into the last (null: none)."""
    more = F.concat(F.slice(chunks, F.lit(1), slots - 1), F.array(F.array_join(F.slice(chunks, slots, F.greatest(F.size(chunks), F.lit(1))), "")))
    padded = F.concat(chunks, F.array_repeat(F.lit(""), slots - F.size(chunks)))
    return F.when((slots >= 1) & (F.size(chunks) > 0), F.when(F.size(chunks) > slots, more).otherwise(padded))


def _fill(slots: Column, protected, aligned: Column) -> Column:
    """Protected slots as they are, the others from ``aligned`` in order."""

    def step(state: Column, s: Column) -> Column:
        keep = protected(s)
        return F.struct(
            F.when(keep, state["i"]).otherwise(state["i"] + 1).alias("i"),
            F.array_append(state["out"], F.when(keep, s).otherwise(F.coalesce(F.get(aligned, state["i"]), F.lit("")))).alias("out"),
        )

    start = F.struct(F.lit(0).alias("i"), F.expr(_NONE).alias("out"))
    return F.aggregate(slots, start, step, lambda s: s["out"])


def repair_document(candidate: Column, source: Column) -> Column:
    """The candidate's words on the source's spans, or null (O-75, documents)."""
    boundary = r"(?i)</?(?:span|p)(?:\s[^>]*)?>"
    chunks = F.filter(F.split(candidate, boundary, -1), lambda c: ~blank(c) & (c != SPACE_MARK))

    def filled(slots: Column, aligned: Column) -> Column:
        clean = ~F.exists(aligned, lambda c: F.contains(c, F.lit("<")) | F.contains(c, F.lit(">")))
        marked = lambda c: F.when(c.isNotNull(), F.concat(F.lit("<span>"), c, F.lit("</span>"))).otherwise("")

        def whole(contents: Column) -> Column:
            visible = F.exists(contents, lambda c: ~blank(c))
            pieces = F.zip_with(F.split(source, SPAN, -1), contents, lambda g, c: F.concat(g, marked(c)))
            return F.when(visible, let(F.array_join(pieces, ""), lambda text: F.when(_same_frame(text, source), text)))

        return F.when((F.size(slots) > 0) & aligned.isNotNull() & clean, let(_fill(slots, blank, aligned), whole))

    def on_slots(slots: Column) -> Column:
        wanted = F.size(F.filter(slots, lambda s: ~blank(s)))
        return let(let(chunks, lambda c: let(wanted, lambda n: _align(c, n))), lambda aligned: filled(slots, aligned))

    return let(spans(source), on_slots)


def repair_slide(candidate: Column, source: Column) -> Column:
    """The candidate's words on the source's spans, or null (O-75, slides)."""
    chunks = F.filter(F.split(candidate, r"(?i)<span[^>]*>|</span\s*>", -1), lambda c: (c != SPACE_MARK) & ~blank(c))

    def filled(slots: Column, aligned: Column) -> Column:
        contents = _fill(slots, lambda s: s == SPACE_MARK, aligned)
        text = F.array_join(F.transform(contents, lambda c: F.concat(F.lit("<span>"), c, F.lit("</span>"))), "")
        return F.when(aligned.isNotNull(), let(text, lambda t: F.when(valid_slide(t, source), t)))

    def on_slots(slots: Column) -> Column:
        wanted = F.size(F.filter(slots, lambda s: s != SPACE_MARK))

        def dealt(found: Column, n: Column) -> Column:
            none = F.when((n == 0) & (F.size(found) == 0), F.expr(_NONE))
            aligned = F.when((n > 0) | (F.size(found) == 0), F.coalesce(none, _align(found, F.greatest(n, F.lit(1)))))
            return let(aligned, lambda a: filled(slots, a))

        return F.when(slots.isNotNull(), let(chunks, lambda found: let(wanted, lambda n: dealt(found, n))))

    return let(slide_values(source), on_slots)


def _kind(char: Column, cjk: str) -> Column:
    return F.when(char.rlike("^[A-Za-z]$"), "latin").when(char.rlike("^[0-9]$"), "digit").when(char.rlike(f"^{cjk}$"), "cjk").otherwise("other")


DOCUMENT_CJK = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]"
SLIDE_CJK = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]"


def english_spacing(text: Column, cjk: str = DOCUMENT_CJK) -> Column:
    """A space between words of neighbouring spans (O-76). The rule looks at original neighbours only,
    since a change just appends a space."""
    values = spans(text)
    gaps = F.split(text, SPAN, -1)
    following = F.concat(F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))), F.array(F.lit(None).cast("string")))
    between = F.slice(gaps, F.lit(2), F.size(values))
    zipped = F.arrays_zip(values.alias("l"), following.alias("r"), between.alias("b"), F.slice(gaps, F.lit(1), F.size(values)).alias("g"))

    def one(x: Column) -> Column:
        left = F.regexp_replace(F.replace(x["l"], F.lit(SPACE_MARK), F.lit(" ")), r"(?U)\s+$", "")
        right = F.regexp_replace(F.replace(x["r"], F.lit(SPACE_MARK), F.lit(" ")), r"(?U)^\s+", "")
        a, b = F.right(left, F.lit(1)), F.left(right, F.lit(1))
        ka, kb = _kind(a, cjk), _kind(b, cjk)
        word = ~b.isin(*",.;:!?)]}%/\\-") & (ka != "other") & (kb != "other") & ~((ka == kb) & ka.isin("cjk", "digit"))
        spaced = x["l"].rlike(r"(?U)(?:\s|<SPACE>)$") | x["r"].rlike(r"(?U)^(?:\s|<SPACE>)")
        add = x["r"].isNotNull() & blank(x["b"]) & (left != "") & (right != "") & word & ~spaced
        return F.concat(x["g"], F.lit("<span>"), x["l"], F.when(F.coalesce(add, F.lit(False)), " ").otherwise(""), F.lit("</span>"))

    rebuilt = F.concat(F.array_join(F.transform(zipped, one), ""), F.element_at(gaps, -1))
    return F.when(F.size(values) < 2, text).otherwise(rebuilt)


def accepted_cell(candidate: Column, marker: Column) -> Column:
    """Cell text of an answer with the exact marker and one span, or null (O-79)."""
    body = candidate_content(candidate, marker, True)
    inner = F.regexp_extract(body, r"(?s)^<span>(.*)</span>$", 1)
    single = body.rlike(r"(?s)^<span>.*</span>$") & ~F.contains(inner, F.lit("<span>")) & ~F.contains(inner, F.lit("</span>"))
    return F.when(single & ~blank(inner), unescape(inner))


def plain_of_tagged(text: Column) -> Column:
    """Text of page, block and span marks, without blank lines (O-91)."""
    out = F.regexp_replace(F.regexp_replace(text, r"\[PAGE_\d+\]", ""), r"\[BLOCK_\d+\]", "\n")
    out = F.regexp_replace(F.regexp_replace(out, r"</SPAN_\d+>", " "), r"<SPAN_\d+>", "")
    lines = F.filter(F.transform(F.split(out, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", -1), strip), lambda line: line != "")
    return F.array_join(lines, "\n")


def cell_boundaries(counts: Column) -> Column:
    """Running number of spans at the end of each cell (O-83)."""
    start = F.struct(F.lit(0).alias("n"), F.expr("cast(array() as array<int>)").alias("out"))
    step = lambda s, n: F.struct((s["n"] + n).cast("int").alias("n"), F.array_append(s["out"], (s["n"] + n).cast("int")).alias("out"))
    return F.aggregate(counts, start, step, lambda s: s["out"])


def take_cells(row: Column, counts: Column, kind: str = "span") -> Column:
    """A row's markup cut into cells of the given numbers of spans or paragraphs (O-82)."""
    pieces = F.regexp_extract_all(row, F.lit(rf"(?s)<{kind}>.*?</{kind}>"), F.lit(0))
    ends = cell_boundaries(counts)
    return F.zip_with(ends, counts, lambda e, n: F.array_join(F.slice(pieces, e - n + 1, n), ""))


def table_signature(line: Column) -> Column:
    """Struct (lead, trail, pipes) of unescaped pipes; null for several lines (O-25, O-26)."""
    core = F.regexp_replace(line, r"^[ \t]+|[ \t]+$", "")
    bare = F.regexp_replace(core, r"\\(?s:.)|\\$", "__")
    pipes = F.length(bare) - F.length(F.replace(bare, F.lit("|"), F.lit("")))
    one = F.struct(F.startswith(bare, F.lit("|")).alias("lead"), F.endswith(bare, F.lit("|")).alias("trail"), pipes.alias("pipes"))
    return F.when(~line.rlike(r"[\r\n]"), one)


def table_cells(signature: Column) -> Column:
    """Number of cells of a row (O-26)."""
    return signature["pipes"] + 1 - signature["lead"].cast("int") - signature["trail"].cast("int")


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)
