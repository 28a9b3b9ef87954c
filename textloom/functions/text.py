"""Scalar text functions as column expressions: tokens, names, line ends, predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as ``str.strip`` and ``str.split`` see it.
SPACE = r"[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    """Without white space at both ends (any Unicode white space)."""
    return F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def collapse(text: Column) -> Column:
    """Words joined by one space."""
    return F.regexp_replace(strip(text), rf"(?U){SPACE}+", " ")


def tokens_weighted(text: Column) -> Column:
    """A quarter token for an ASCII character, one for any other; at least one (O-30)."""
    wide = F.length(F.regexp_replace(text, r"[\x00-\x7F]", ""))
    return F.greatest(F.lit(1), F.ceil(wide + (F.length(text) - wide) * 0.25)).cast("long")


def tokens_words(text: Column) -> Column:
    """Words and single symbols (O-31, the offline counter)."""
    return F.regexp_count(text, F.lit(r"(?U)\w+|[^\w\s]")).cast("long")


def tokens_slides(text: Column) -> Column:
    """A quarter of the visible characters, rounded up; at least one (O-32)."""
    visible = F.regexp_replace(text, r"\[[^\]]+\]|</?span>|<SPACE>", "")
    return F.greatest(F.lit(1), F.floor((F.length(visible) + 3) / 4)).cast("long")


def line_ending(text: Column) -> Column:
    """CRLF if there is any, else CR, else LF (O-02)."""
    return F.when(F.contains(text, F.lit("\r\n")), "\r\n").when(F.contains(text, F.lit("\r")), "\r").otherwise("\n")


def with_line_ending(text: Column, ending: Column) -> Column:
    """All line ends as ``ending`` (O-03)."""
    plain = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.replace(plain, F.lit("\n"), ending)


def document_kind(name: Column) -> Column:
    """Pipeline of a file by its suffix, null where there is none (O-04)."""
    suffix = F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))
    kinds = {"txt": "txt", "md": "markdown", "markdown": "markdown", "docx": "docx", "pptx": "pptx", "xlsx": "xlsx", "pdf": "pdf"}
    return F.element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), F.nullif(suffix, F.lit("")))


def source_problem(size: Column, limit: int = 200 * 1024 * 1024) -> Column:
    """``empty_file``, ``file_too_large`` or null (O-05)."""
    return F.when(size <= 0, "empty_file").when(size > limit, "file_too_large")


def base_name(name: Column) -> Column:
    """Last path component; null for names that are no file (O-06)."""
    last = F.trim(F.element_at(F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/"), -1))
    return F.when(~last.isin("", ".", ".."), last)


def display_name(name: Column) -> Column:
    """Base name, ``document`` where there is none (O-07)."""
    return F.coalesce(base_name(name), F.lit("document"))


def output_name(name: Column, language: Column, style: str = "plain") -> Column:
    """``stem.lang.suffix`` and its variants for slides and bilingual files (O-08)."""
    safe = F.regexp_replace(F.regexp_replace(language, r"[^A-Za-z0-9_-]", "-"), r"^-+|-+$", "")
    safe = F.coalesce(F.nullif(safe, F.lit("")), F.lit("translated"))
    stem, suffix = F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(name, r"(\.[^.]*)$", 1)
    middle = {"plain": ".", "slides": ".translated-", "bilingual": ".bilingual-"}[style]
    return F.concat(stem, F.lit(middle), safe, suffix)


def only_marks(text: Column) -> Column:
    """Blank, or nothing but digits, punctuation, symbols and white space (O-34)."""
    return text.rlike(r"(?U)^[\p{N}\p{P}\p{S}\s]*$")


def translatable_cell(text: Column, formula: Column) -> Column:
    """Whether a cell holds natural language (O-33)."""
    core = strip(text)
    # Addresses, paths and identifiers that are never translated.
    code = (
        core.rlike(r"^(?i)(?:https?://|www\.)")
        | core.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$")
        | core.rlike(r"^[A-Za-z]:\\")
        | core.rlike(r"^/[A-Za-z0-9._/\-]+$")
        | core.rlike(r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}$")
    )
    name = core.rlike(r"^[A-Za-z0-9._:/\\-]+$") & core.rlike("[A-Za-z]") & core.rlike("[0-9]") & core.rlike(r"[._:/\\-]")
    return ~formula & (core != "") & ~F.startswith(core, F.lit("=")) & ~code & ~name & ~only_marks(core)


def numeric_fragment(text: Column) -> Column:
    """Digits, fractions and symbols only; not empty (O-35)."""
    compact = F.regexp_replace(text, r"(?U)\s+", "")
    return (compact != "") & compact.rlike(r"^[\p{N}\p{P}\p{S}]+$")


# Marks of unmapped glyphs; the limits in ``recoverable_cid`` are fixed too.
_CID = r"(?i)\(cid:[0-9]+\)"


def recoverable_cid(text: Column) -> Column:
    """Whether a text with unmapped glyph marks is still readable (O-36)."""
    count = F.regexp_count(text, F.lit(_CID))
    clean = F.regexp_replace(text, _CID, " ")
    compact = F.regexp_replace(clean, r"(?U)\s+", "")
    alpha = F.length(F.regexp_replace(compact, r"[^\p{L}]", ""))
    alnum = F.length(F.regexp_replace(compact, r"[^\p{L}\p{N}]", ""))
    words = F.regexp_count(clean, F.lit(r"\p{L}{3,}"))
    parts = F.size(F.filter(F.split(text, _CID, -1), lambda p: F.regexp_replace(p, r"(?U)\s+", "") != ""))
    cjk = compact.rlike(r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]")
    short = (count <= 1) & (parts >= 2) & F.when(cjk, F.length(compact) >= 3).otherwise(alnum >= 4)
    readable = short | (words >= 3) | ((alpha >= 12) & (count <= F.greatest(F.lit(2), F.floor(alpha / 8))))
    return (count > 0) & (compact != "") & ~(count >= F.greatest(F.lit(3), alnum)) & readable


def preserve_span(text: Column) -> Column:
    """Struct (preserve, text): whether a span stays as it is, and its cleaned text (O-37)."""
    has, fine, number = text.rlike(_CID), recoverable_cid(text), numeric_fragment(text)
    clean = F.when(has & fine, F.regexp_replace(text, _CID, " ")).otherwise(text)
    clean = F.when(number, F.replace(clean, F.lit("⁄"), F.lit("/"))).otherwise(clean)
    return F.struct(((has & ~fine) | number | (text == "")).alias("preserve"), clean.alias("text"))


def bold_font(name: Column) -> Column:
    """Whether a font name says bold, without its subset prefix (O-49)."""
    # Name parts of bold faces.
    parts = ("extrabold", "ultrabold", "semibold", "demibold", "black", "heavy", "bold", "demi")
    plain = F.regexp_replace(F.regexp_replace(F.trim(name), "^/+", ""), r"^[A-Za-z0-9]{6}\+", "")
    return F.lower(plain).rlike("|".join(parts))
