"""Spans in the grid that a table's rulings draw: the cell of a span, and spans split at columns.

Rulings are drawn per page and few, so they go to the page's spans as two arrays; all else is in the span's row. The axes of
all spans of a batch are found at once, in one Arrow pass: as nested folds of expressions they are worked out again
wherever they are used, and again in every filter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.text import preserve_span

# Tolerances of axes, tables and rulings, least sizes, shares of the rule on several columns.
AXIS, TABLE, SIDE = 1.5, 2.0, 2.0
LEAST_REACH, REACH_SHARE = 2.0, 0.35
LEAST_COLUMNS, LEAST_WIDTH = 3, 1.0
OVER_SHARE, OVER_SIZE, OVER_LEAST, WIDE_SHARE, CROSSING_SHARE = 0.35, 1.5, 2.0, 2.0, 1.35
QUORUM = 0.8
GAP_WIDTH, GAP_SIZE, GAP_LEAST = 0.8, 0.22, 1.2


Ragged = tuple[np.ndarray, np.ndarray]


def merged(row: np.ndarray, value: np.ndarray, tolerance: float = AXIS) -> Ragged:
    """(row, position): means of runs of a row's sorted positions with gaps up to the tolerance (O-131)."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | ~(value[1:] - value[:-1] <= tolerance)
    starts = np.flatnonzero(new)
    if not len(starts):
        return row, value
    return row[starts], np.add.reduceat(value, starts) / np.diff(np.append(starts, len(row)))


def intervals(row: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, lower, upper): the stretches between neighbouring positions that are wider than the tolerance."""
    wide = np.flatnonzero((row[1:] == row[:-1]) & (position[1:] - position[:-1] > AXIS))
    return row[wide], position[wide], position[wide + 1]


def _first(stretches: tuple[np.ndarray, np.ndarray, np.ndarray], at: np.ndarray) -> Ragged:
    """(lower, upper) of the first stretch of each row that holds its place, else NaN."""
    row, lower, upper = stretches
    hit = np.flatnonzero((at[row] >= lower - AXIS) & (at[row] <= upper + AXIS))
    rows, first = np.unique(row[hit], return_index=True)
    out = np.full((2, len(at)), np.nan)
    out[0, rows], out[1, rows] = lower[hit[first]], upper[hit[first]]
    return out[0], out[1]


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)


def _ragged(lists: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten()


class _Spans:
    """The spans of a batch with the merged columns beside each."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch, self.n = batch, batch.num_rows
        self.of = {k: _numbers(batch.column(k)) for k in ("x1", "y1", "x2", "y2", "size", "t_x1", "t_y1", "t_x2", "t_y2")}
        o = self.of
        self.cx, self.cy = (o["x1"] + o["x2"]) / 2, (o["y1"] + o["y2"]) / 2
        reach = np.maximum(LEAST_REACH, (o["y2"] - o["y1"]) * REACH_SHARE)
        row, v = _ragged(batch.column("__vs"))
        x, low, high = (_numbers(v.field(k)) for k in ("x1", "y1", "y2"))
        beside = (low <= (self.cy + reach)[row]) & (high >= (self.cy - reach)[row]) & (x >= o["t_x1"][row] - TABLE) & (x <= o["t_x2"][row] + TABLE)
        self.columns = merged(row[beside], x[beside])
        self.many = np.bincount(self.columns[0], minlength=self.n)
        self.stretches = intervals(*self.columns)

    def height(self, left: np.ndarray, right: np.ndarray) -> Ragged:
        """(bottom, top) of the row that holds each span's centre, of horizontal rulings that reach from left to right."""
        row, h = _ragged(self.batch.column("__hs"))
        y, first, last = (_numbers(h.field(k)) for k in ("y1", "x1", "x2"))
        inside = (y >= self.of["t_y1"][row] - TABLE) & (y <= self.of["t_y2"][row] + TABLE)
        inside &= (first <= left[row] + SIDE) & (last >= right[row] - SIDE)
        return _first(intervals(*merged(row[inside], y[inside])), self.cy)

    def crossed(self) -> np.ndarray:
        """How many columns lie inside each span."""
        row, at = self.columns
        return np.bincount(row[(at > self.of["x1"][row] + AXIS) & (at < self.of["x2"][row] - AXIS)], minlength=self.n)


def _double(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.float64(), from_pandas=True)


def _padded(left: Column, right: Column, bottom: Column, top: Column) -> Column:
    """A cell's box a little inside its rulings, or on them where nothing would be left."""
    x = F.least(F.lit(2.0), F.greatest((right - left) * 0.03, F.lit(0.5)))
    y = F.least(F.lit(1.0), F.greatest((top - bottom) * 0.05, F.lit(0.2)))
    inside = (right - x > left + x) & (top - y > bottom + y)
    side = lambda a, b: F.when(inside, a).otherwise(b)
    return F.struct(
        side(left + x, left).alias("x1"), side(bottom + y, bottom).alias("y1"), side(right - x, right).alias("x2"), side(top - y, top).alias("y2")
    )


def over_columns(width: Column, left: Column, right: Column, size: Column, x1: Column, x2: Column, crossed: Column) -> Column:
    """Whether a text of several columns is wider than the cell that holds its centre."""
    cell = right - left
    before, after = F.greatest(left - x1, F.lit(0.0)), F.greatest(x2 - right, F.lit(0.0))
    allowed = F.greatest(cell * OVER_SHARE, size * OVER_SIZE, F.lit(OVER_LEAST))
    wide = ((before > allowed) & (after > allowed)) | (width > cell * WIDE_SHARE) | ((crossed >= 2) & (width > cell * CROSSING_SHARE))
    return (width > 0) & (cell > 0) & (before + after > allowed) & wide


_SPAN = ("x1", "y1", "x2", "y2", "size", "t_x1", "t_y1", "t_x2", "t_y2")


def _with_rulings(spans: DataFrame, rulings: DataFrame, page: str, *more: str, how: str = "left") -> DataFrame:
    """Spans with their page's rulings (arrays ``__vs`` and ``__hs``)."""
    box = F.struct(*[F.col(k).cast("double").alias(k) for k in ("x1", "y1", "x2", "y2")])
    drawn = rulings.groupBy(page).agg(*[F.collect_list(F.when(F.col("direction") == d, box)).alias(f"__{d}s") for d in "vh"])
    rows = spans.join(drawn, page, how)
    none = F.expr("cast(array() as array<struct<x1:double,y1:double,x2:double,y2:double>>)")
    own = [F.col(k).cast("double").alias(k) for k in _SPAN]
    return rows.select(page, "span_id", *own, *more, *[F.coalesce(f"__{d}s", none).alias(f"__{d}s") for d in "vh"])


def _kinds(rows: DataFrame, names: tuple[str, ...], **more: T.DataType) -> T.StructType:
    own = {f.name: f.dataType for f in rows.schema.fields}
    return T.StructType([T.StructField(n, k) for n, k in [*((n, own[n]) for n in names), *more.items()]])


def cell_boxes(spans: DataFrame, rulings: DataFrame, page: str) -> DataFrame:
    """(page, span_id, cell): the padded box of the cell that holds each span's centre, else null (O-134). Spans have a box,
    size, and their table's box t_x1 .. t_y2; rulings are those of ``tables.rulings``. A grid needs three vertical
    rulings beside the span; the horizontal ones must reach over the whole column; a text of several columns has
    no cell."""
    rows = _with_rulings(spans, rulings, page)
    keep = (page, "span_id", "x1", "y1", "x2", "y2", "size")
    found = ("__left", "__right", "__bottom", "__top")
    schema = _kinds(rows, keep, __many=T.LongType(), __crossed=T.LongType(), **dict.fromkeys(found, T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _Spans(batch)
            left, right = _first(own.stretches, own.cx)
            sides = [_double(v) for v in (left, right, *own.height(left, right))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(own.many), pa.array(own.crossed()), *sides], schema.names)

    rows = rows.mapInArrow(run, schema)
    left, right, bottom, top = (F.col(k) for k in found)
    high = F.greatest(F.col("y2") - F.col("y1"), F.lit(0.0))
    size = F.coalesce(F.nullif("size", F.lit(0.0)), F.nullif(high, F.lit(0.0)), F.lit(10.0))
    wide = F.greatest(F.col("x2") - F.col("x1"), F.lit(0.0))
    over = over_columns(wide, left, right, size, F.col("x1"), F.col("x2"), F.col("__crossed"))
    fine = (F.col("__many") >= LEAST_COLUMNS) & ~over & (right - left > LEAST_WIDTH) & (top - bottom > 0)
    return rows.select(page, "span_id", F.when(fine, _padded(left, right, bottom, top)).alias("cell"))


def _cell_texts(char: pa.Array, x1: np.ndarray, x2: np.ndarray, starts: np.ndarray, size: np.ndarray) -> list[str]:
    """Texts of the groups of characters that begin at ``starts``, each from left to right, with a space where the gap is wide
    for the group's median width."""
    many = np.diff(np.append(starts, len(x1)))
    group = np.repeat(np.arange(len(starts)), many)
    some = np.flatnonzero(x2 - x1 > 0)
    width, of = (x2 - x1)[some], group[some]
    width = width[np.lexsort((width, of))]
    n = np.bincount(of, minlength=len(starts))
    begin = np.cumsum(n) - n
    middle = np.zeros(len(starts))
    full = np.flatnonzero(n)
    middle[full] = (width[begin[full] + (n[full] - 1) // 2] + width[begin[full] + n[full] // 2]) / 2
    gap = np.maximum(np.maximum(middle * GAP_WIDTH, np.nan_to_num(size) * GAP_SIZE), GAP_LEAST)
    apart = np.zeros(len(x1), bool)
    apart[1:] = (x1[1:] - x2[:-1] > gap[group[1:]]) & (group[1:] == group[:-1])
    apart[1:] &= ~pc.ends_with(char, " ").to_numpy(zero_copy_only=False).astype(bool)[:-1]
    pieces = pc.binary_join_element_wise(pc.if_else(pa.array(apart), " ", ""), char, "")
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(x1)).astype(np.int32)), pieces)
    return [text.strip() for text in pc.binary_join(lists, "").to_pylist()]


def _parts(own: _Spans) -> tuple[np.ndarray, list]:
    """The span (number in the batch), part, text, box and cell of every column that a span is split into."""
    row, c = _ragged(own.batch.column("chars"))
    words = c.field("char").dictionary_encode()
    kinds = words.dictionary.to_pylist()
    order = np.argsort(np.argsort(np.array([k.encode() for k in kinds], object))) if kinds else np.zeros(0, np.int64)
    known = words.indices.fill_null(len(kinds)).to_numpy(zero_copy_only=False)
    shown = np.array([k.strip() != "" for k in kinds] + [False])[known]
    x1, y1, x2, y2 = (_numbers(c.field(k)) for k in ("x1", "y1", "x2", "y2"))
    bottom, top = own.height(own.cx, own.cx)
    middle = (y1 + y2) / 2
    inside = np.array([k != "" for k in kinds] + [False])[known] & (middle >= bottom[row] - AXIS) & (middle <= top[row] + AXIS)
    # the first stretch of its span that holds a character, counted from 0
    s_row, lower, upper = own.stretches
    n = np.bincount(s_row, minlength=own.n)
    begin = np.cumsum(n) - n
    places = np.flatnonzero(inside)
    many = n[row[places]]
    char = np.repeat(places, many)
    stretch = np.arange(len(char)) + np.repeat(begin[row[places]] - (np.cumsum(many) - many), many)
    centre = ((x1 + x2) / 2)[char]
    hit = np.flatnonzero((centre >= lower[stretch] - AXIS) & (centre <= upper[stretch] + AXIS))
    taken, first = np.unique(char[hit], return_index=True)
    at = stretch[hit[first]]  # stretches are in the order of their spans
    every, found = np.bincount(row[shown], minlength=own.n), np.bincount(row[taken[shown[taken]]], minlength=own.n)
    fine = (own.many >= LEAST_COLUMNS) & (every >= 2) & (found >= every * QUORUM)
    kept = fine[row[taken]]
    taken, at = taken[kept], at[kept]
    sort = np.lexsort((y2[taken], x2[taken], y1[taken], np.append(order, 0)[known[taken]], x1[taken], at))
    taken, at = taken[sort], at[sort]
    starts = np.flatnonzero(np.append(True, at[1:] != at[:-1])[: len(at)])
    if not len(starts):
        return starts, [[], *[np.zeros(0)] * 9]
    at, span = at[starts], row[taken[starts]]
    texts = _cell_texts(c.field("char").take(pa.array(taken)), x1[taken], x2[taken], starts, own.of["size"][span])
    part = np.arange(len(span)) - np.searchsorted(span, span)
    full = np.array([t != "" for t in texts])
    use = full & (np.bincount(span, full, own.n)[span] >= 2) & (np.bincount(span, minlength=own.n)[span] >= 2)
    edges = [pick.reduceat(v[taken], starts)[use] for pick, v in ((np.minimum, x1), (np.minimum, y1), (np.maximum, x2), (np.maximum, y2))]
    sides = [lower[at][use], upper[at][use], bottom[span[use]], top[span[use]]]
    return span[use], [[t for t, u in zip(texts, use.tolist()) if u], part[use], *edges, *sides]


def grid_split(spans: DataFrame, rulings: DataFrame, page: str) -> DataFrame:
    """(page, span_id, part, text, kept, x1, y1, x2, y2, cell): spans over several columns as one span a column (O-135). Spans have
    what ``cell_boxes`` needs and ``chars``: array of (char, x1, y1, x2, y2). Characters go to the column and row that hold
    their centres; a span is split only if four fifths of its visible characters have a column and two columns
    have some. ``part`` counts the columns with characters from 0; those with blanks alone leave their number out."""
    kind = "array<struct<char:string,x1:double,y1:double,x2:double,y2:double>>"
    spans = spans.withColumn("chars", F.coalesce(F.col("chars").cast(kind), F.expr(f"cast(array() as {kind})")))
    # A page without rulings splits no span, and with an inner join both sides may come from one shuffle.
    rows = _with_rulings(spans, rulings, page, "chars", how="inner")
    found = ("x1", "y1", "x2", "y2", "__left", "__right", "__bottom", "__top")
    schema = _kinds(rows, (page, "span_id"), text=T.StringType(), part=T.LongType(), **dict.fromkeys(found, T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            span, (texts, part, *numbers) = _parts(_Spans(batch))
            own = [batch.column(k).take(pa.array(span)) for k in (page, "span_id")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(texts, pa.string()), pa.array(part.astype(np.int64)), *map(_double, numbers)], schema.names)

    rows = rows.mapInArrow(run, schema).withColumn("__own", preserve_span(F.col("text")))
    return rows.select(
        page,
        "span_id",
        "part",
        F.col("__own.text").alias("text"),
        F.col("__own.preserve").alias("kept"),
        "x1",
        "y1",
        "x2",
        "y2",
        _padded(F.col("__left"), F.col("__right"), F.col("__bottom"), F.col("__top")).alias("cell"),
    )
