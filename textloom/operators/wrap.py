"""Breaking texts into lines of a width, with widths of characters by class in place of a font's.

Texts are taken apart into tokens by expressions; lines are filled in Arrow, in one walk over a text's tokens.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.arrays import let
from textloom.functions.language import PAGE_WIDTHS, visual_length

# Words, marks that stay with what is before them, and the tolerances of a line and of a word.
WORD = r"[A-Za-z0-9\x{C0}-\x{24F}\x{400}-\x{52F}]+(?:[._'’/-][A-Za-z0-9\x{C0}-\x{24F}\x{400}-\x{52F}]+)*"
STAYING = r",.;:!?%)\]}，。；：！？、）】》」』"
LINE_SHARE, WORD_SHARE = 1.01, 1.05


def wrap_tokens(text: Column) -> Column:
    """Words and single characters, each with the white space and closing marks after it (O-29)."""
    return F.regexp_extract_all(text, F.lit(rf"(?sU)(?:{WORD}|\S)[\s{STAYING}]*+"), F.lit(0))


@functools.cache
def _hundredths() -> np.ndarray:
    """Width of every code point by PAGE_WIDTHS, in hundredths; whole numbers add up without rounding."""
    table = np.full(0x110000, 100, np.int64)
    for chars, width in reversed(PAGE_WIDTHS):
        points = [int(hexed, 16) if hexed else ord(one) for hexed, one in re.findall(r"\\x\{([0-9A-F]+)\}|(.)", chars)]
        i = 0
        while i < len(points):
            ranged = i + 2 < len(points) and points[i + 1] == ord("-")
            table[points[i] : points[i + 2 if ranged else i] + 1] = round(width * 100)
            i += 3 if ranged else 1
    return table


def _units(words: list[str]) -> list[float]:
    """``visual_length`` of every word."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    total = np.concatenate([[0], np.cumsum(_hundredths()[points])])[np.concatenate([[0], ends])]
    return (np.diff(total) / 100).tolist()


Paragraphs = list[list[tuple[str, float]] | None]


def _paragraphs(texts: pa.Array) -> Iterator[Paragraphs | None]:
    """The paragraphs of each text as tokens with their widths at a size of one; None for an empty paragraph."""
    rows = texts.to_pylist()
    words = [t for row in rows if row for tokens in row if tokens for t in tokens]
    sized = zip(words, _units(words))
    for row in rows:
        yield None if row is None else [None if tokens is None else [next(sized) for _ in tokens] for tokens in row]


def _filled(paragraphs: Paragraphs, width: float, size: float) -> list[str]:
    """Lines of tokens, white space at their ends included."""
    lines = []
    full, over = width * LINE_SHARE, width * WORD_SHARE
    for tokens in paragraphs:
        if tokens is None:
            lines.append("")
            continue
        held, total = [], 0.0
        for token, unit in tokens:
            wide = unit * size
            parts = zip(token, _units(list(token))) if wide > over and len(token) > 1 else ((token, unit),)
            for part, own in parts:
                w = own * size
                if held and total + w > full:
                    lines.append("".join(held))
                    held, total = [part], w
                else:
                    held.append(part)
                    total += w
        if held:
            lines.append("".join(held))
    return lines


def _wrapped(texts: pa.Array, widths: pa.Array, sizes: pa.Array) -> pa.Array:
    out = []
    for own, width, size in zip(_paragraphs(texts), widths.to_pylist(), sizes.to_pylist()):
        some = width is not None and width > 0
        out.append(None if own is None and some else _filled(own, width, float("nan") if size is None else size) if some else [])
    return pa.array(out, pa.list_(pa.string()))


_wrapped_udf = F.arrow_udf(_wrapped, T.ArrayType(T.StringType()))


def _tokens(text: Column) -> Column:
    """Paragraphs as arrays of tokens, null where empty."""
    paragraphs = F.split(F.regexp_replace(text, r"(?:\r\n|[\r\n])$", ""), r"\r\n|[\r\n]", -1)
    return F.transform(paragraphs, lambda p: F.when(p != "", wrap_tokens(p)))


def _trimmed(lines: Column) -> Column:
    return F.transform(lines, lambda t: F.regexp_replace(t, r"(?U)\s+$", ""))


def wrap(text: Column, width: Column, size: Column) -> Column:
    """The lines of a text in a box of a width at a font size (O-153): tokens fill a line while they fit; what is wider
    than a line is broken between characters. No width, no lines."""
    return _trimmed(_wrapped_udf(_tokens(text), width.cast("double"), size.cast("double")))


# Steps of the search for a size, slack of a height and of a width, the share under which sizes and widths both shrink.
FIT_STEPS, HEIGHT_SLACK, WIDTH_SLACK, SHARED_SHRINK = 10, 0.1, 1.02, 0.85


def _fitted(texts: pa.Array, *numbers: pa.Array) -> pa.Array:
    out = []
    for own, width, height, size, least, line_height in zip(_paragraphs(texts), *(n.to_pylist() for n in numbers)):
        lines = lambda at: (None if own is None else _filled(own, width, at)) if width > 0 else []  # noqa: E731, B023
        if size <= 0:
            out.append((0.0, []))
            continue
        if height <= 0:
            out.append((size, lines(size)))
            continue
        low, high, best = least, size, None
        for _ in range(FIT_STEPS):
            at = (low + high) / 2
            tried = lines(at)
            if tried and len(tried) * at * line_height <= height + HEIGHT_SLACK:
                low, best = at, (at, tried)
            else:
                high = at
        out.append(best or (least, lines(least)))
    return pa.array([{"size": s, "lines": lines} for s, lines in out], pa.struct([("size", pa.float64()), ("lines", pa.list_(pa.string()))]))


_fitted_udf = F.arrow_udf(_fitted, T.StructType([T.StructField("size", T.DoubleType()), T.StructField("lines", T.ArrayType(T.StringType()))]))


def fit_block(text: Column, width: Column, height: Column, size: Column, least: Column, line_height: float = 1.2) -> Column:
    """(size, lines): the largest size found at which a text fits its box (O-153). Sizes from the least to the given one are
    halved FIT_STEPS times; each size wraps the text again, in the row. Where none fits, the least one is taken; a box
    without height takes the given size, and no size gives no lines."""
    given = [F.coalesce(c.cast("double"), F.lit(0.0)) for c in (width, height, size, least)]
    found = _fitted_udf(_tokens(text), *given, F.lit(line_height))
    return F.struct(found["size"].alias("size"), _trimmed(found["lines"]).alias("lines"))


def fit_line(text: Column, width: Column, size: Column, least: Column, scaling: Column, least_scale: Column) -> Column:
    """(size, scale): the size of a text on one line, and the percentage that its characters are narrowed to (O-153). Without
    scaling the size shrinks to the width, but not under the least; with it a much too wide text shrinks by the root of
    what is wanted and is narrowed by the rest, and shrinks again where it would be narrowed too far."""
    unit = visual_length(text, PAGE_WIDTHS)
    floor = F.least(F.greatest(least, F.lit(0.1)), size)
    narrowest = F.least(F.greatest(least_scale, F.lit(1.0)), F.lit(100.0))
    answer = lambda s, h: F.struct(s.cast("double").alias("size"), h.cast("double").alias("scale"))
    wanted = lambda s: width / (unit * s) * 100
    narrowed = lambda s: F.least(F.lit(100.0), F.greatest(wanted(s), narrowest))
    share = width / (unit * size)

    def both(s: Column) -> Column:
        smaller = F.greatest(s * wanted(s) / narrowest, floor)
        return F.when((wanted(s) < narrowest) & (s > floor), let(smaller, lambda t: answer(t, narrowed(t)))).otherwise(answer(s, narrowed(s)))

    def little(s: Column) -> Column:
        over = (s <= floor) & (unit * s > width * WIDTH_SLACK)
        return answer(s, F.when(over, narrowed(s)).otherwise(F.lit(100.0)))

    shrunk = F.greatest(size * share, floor)
    much = let(F.greatest(size * F.greatest(F.sqrt(share), floor / size), floor), both)
    asis = (size <= 0) | (width <= 0) | (unit <= 0) | (unit * size <= width * WIDTH_SLACK)
    return (
        F.when(asis, answer(size, F.lit(100.0)))
        .when(~scaling, answer(shrunk, F.lit(100.0)))
        .when(share < SHARED_SHRINK, much)
        .otherwise(let(shrunk, little))
    )
