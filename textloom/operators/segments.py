"""Plain-text segmentation, packing, translation, settlement and restore.

All of it is narrow: a document's segments, batches and output are arrays of its own row, so nothing is shuffled. Texts
are split and weighed by expressions; running sums, packing and weaving are folds, in Arrow, linear in a text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.arrays import let
from textloom.functions.text import SPACE, strip, tokens_weighted
from textloom.operators.dealing import small_batches

BLANK_SEPARATOR = r"(?:\r?\n)[ \t]*(?:\r?\n)+"
# A sentence ends after one of these, before white space or the end.
SENTENCE_END = r"(?U)(?<=[。！？; .!?;])(?=\s|$)"
MAX_SEGMENT_TOKENS = 700
MAX_SENTENCE_CHARS = 1200
MAX_BATCH_TOKENS = 800

#: A text of more characters has more tokens than a segment may have, one of fewer has not: each is a quarter to 1.5.
SURELY_LONG, SURELY_SHORT = 4 * MAX_SEGMENT_TOKENS, MAX_SEGMENT_TOKENS * 2 // 3

_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("text", T.StringType())])
_PIECES = "array<struct<text:string,n:int>>"


def _empty(kind: str) -> Column:
    return F.expr(f"cast(array() as {kind})")


def _long(text: Column) -> Column:
    """Whether a text has more tokens than a segment may have; only middling ones are weighed."""
    n = F.length(text)
    return F.when(n > SURELY_LONG, True).when(n <= SURELY_SHORT, False).otherwise(tokens_weighted(text) > MAX_SEGMENT_TOKENS)


def _shown(text: Column) -> Column:
    """A piece of a text; a blank one is passed over."""
    return F.struct(F.when(strip(text) != "", text).alias("text"), F.length(text).alias("n"))


def _passed(n: Column) -> Column:
    return F.struct(F.lit(None).cast("string").alias("text"), n.cast("int").alias("n"))


def _cuts(sentence: str) -> list[str]:
    """A sentence as parts of at most MAX_SENTENCE_CHARS characters, cut after white space, until the rest has no more
    tokens than a segment may have (O-22)."""
    points = np.frombuffer(sentence.encode("utf-32-le"), np.uint32)
    left = np.cumsum(np.where(points < 0x80, 1, 4)[::-1])[::-1]  # quarters of tokens from each place on
    out, at = [], 0
    while at < len(sentence) and len(sentence) - at > MAX_SENTENCE_CHARS and left[at] > 4 * MAX_SEGMENT_TOKENS:
        head = sentence[at : at + MAX_SENTENCE_CHARS]
        upto = next((i for i in range(len(head), 0, -1) if head[i - 1].isspace()), len(head))
        out.append(head[:upto])
        at += upto
    return [*out, sentence[at:]] if at < len(sentence) else out


def _placed(pieces: pa.Array) -> pa.Array:
    """Of the pieces of each text, one after the other, those with a text, with the offset where each begins."""
    at = pieces.offsets.to_numpy()
    at = at - at[0]
    flat = pieces.flatten()
    text, n = flat.field("text"), flat.field("n").to_numpy(False)
    long = np.flatnonzero((n > SURELY_SHORT) & text.is_valid().to_numpy(False))
    parts = {i: _cuts(text[i].as_py()) for i in long.tolist()}
    parts = {i: p for i, p in parts.items() if len(p) > 1}
    if parts:
        many = np.ones(len(n), np.int64)
        many[list(parts)] = [len(p) for p in parts.values()]
        at = np.concatenate([[0], np.cumsum(many)])[at]
        rows = text.to_pylist()
        flat = [part for i, row in enumerate(rows) for part in parts.get(i, (row,))]
        n = np.repeat(n, many)
        n[np.repeat(np.isin(np.arange(len(many)), list(parts)), many)] = [len(part) for i in sorted(parts) for part in parts[i]]
        text = pa.array([part if part and not part.isspace() else None for part in flat], pa.string())
    ends = np.cumsum(n, dtype=np.int64)
    before = np.concatenate([[0], ends])[at[:-1]]
    starts = ends - n - np.repeat(before, np.diff(at))
    kept = text.is_valid().to_numpy(False)
    many = np.concatenate([[0], np.cumsum(kept)])[at]
    spans = pa.StructArray.from_arrays([pa.array(starts[kept].astype(np.int32)), text.filter(pa.array(kept)).cast(pa.string())], ["start", "text"])
    return pa.ListArray.from_arrays(pa.array(many.astype(np.int32)), spans)


def _weights(spans: pa.Array) -> pa.Array:
    """Tokens of each span (``tokens_weighted``)."""
    _, offsets, data = spans.values.field("text").buffers()
    at = np.frombuffer(offsets, np.int32, len(spans.values) + 1) if offsets is not None else np.zeros(1, np.int32)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    total = lambda hits: np.diff(np.concatenate([[0], np.cumsum(hits)])[at])
    plain, points = total(raw < 0x80), total((raw & 0xC0) != 0x80)
    return pa.ListArray.from_arrays(spans.offsets, pa.array(np.maximum(1, -(-(4 * points - 3 * plain) // 4)).astype(np.int64)))


def _woven(texts: pa.Array, spans: pa.Array, translated: pa.Array) -> pa.Array:
    """Each text with its translations in the place of its spans, and whether the spans stand where they say."""
    out, exact = [], []
    for text, own, new in zip(texts.to_pylist(), spans.to_pylist(), translated.to_pylist()):
        parts, end, same = [], 0, True
        for span, other in zip(own, new):
            parts += (text[end : span["start"]], other)
            same = same and span["start"] >= end and text.startswith(span["text"], span["start"])
            end = span["start"] + len(span["text"])
        parts.append(text[end:])
        out.append("".join(parts))
        exact.append(same)
    return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(exact, pa.bool_())], ["text", "exact"])


def _greedy(tokens: pa.Array, limits: pa.Array) -> pa.Array:
    out = []
    for own, limit in zip(tokens.to_pylist(), limits.to_pylist()):
        group, total, groups = 0, 0, []
        for n in own:
            full = total > 0 and total + n > limit
            group, total = group + full, n if full else total + n
            groups.append(group)
        out.append(groups)
    return pa.array(out, pa.list_(pa.int32()))


def _min_max(tokens: pa.Array, least: pa.Array, most: pa.Array) -> pa.Array:
    out = []
    for own, low, high in zip(tokens.to_pylist(), least.to_pylist(), most.to_pylist()):
        group, total, count, groups = 0, 0, 0, []
        for n in own:
            after = group + (count > 0)
            if n > high:
                groups.append(after)
                group, total, count = after + 1, 0, 0
            elif not count or total + n <= high:
                groups.append(group)
                total, count = total + n, count + 1
            elif total < low and count == 1:
                groups.append(group)
                group, total, count = group + 1, 0, 0
            else:
                groups.append(after)
                group, total, count = after, n, 1
        out.append(groups)
    return pa.array(out, pa.list_(pa.int32()))


_woven_udf = F.arrow_udf(_woven, T.StructType([T.StructField("text", T.StringType()), T.StructField("exact", T.BooleanType())]))
_greedy_udf = F.arrow_udf(_greedy, T.ArrayType(T.IntegerType()))
_min_max_udf = F.arrow_udf(_min_max, T.ArrayType(T.IntegerType()))


def sentences(text: Column) -> Column:
    """A trimmed text as pieces that follow each other: itself, or its sentences where it is too long (O-21)."""
    return F.when(_long(text), F.filter(F.split(text, SENTENCE_END, -1), lambda s: s != "")).otherwise(F.array(text))


def txt_pieces(text: Column) -> Column:
    """Array of (text, n): a plain text taken apart into its segments and, without text, what lies between them, one
    after the other (O-20, O-27)."""
    gaps = F.regexp_extract_all(text, F.lit(BLANK_SEPARATOR), F.lit(0))

    def of_part(raw: Column, gap: Column) -> Column:
        after = F.coalesce(F.length(gap), F.lit(0))

        def of_core(core: Column) -> Column:
            lead = F.length(raw) - F.length(F.regexp_replace(raw, rf"(?U)^{SPACE}+", ""))
            trail = F.length(raw) - lead - F.length(core) + after
            body = F.concat(F.array(_passed(lead)), F.transform(sentences(core), _shown), F.array(_passed(trail)))
            return F.when(core == "", F.array(_passed(F.length(raw) + after))).otherwise(body)

        return let(strip(raw), of_core)

    return F.flatten(F.zip_with(F.split(text, BLANK_SEPARATOR, -1), gaps, of_part))


def pack_greedy(tokens: Column, limit: int | Column = MAX_BATCH_TOKENS) -> Column:
    """Batch number of every item: a batch closes before it would exceed the limit (O-50)."""
    return _greedy_udf(tokens, limit if isinstance(limit, Column) else F.lit(limit))


def pack_min_max(tokens: Column, least: int = 500, most: int = 800) -> Column:
    """Batch number of every item with a lower bound: a single small item takes in the one that
    overflows; an item above the upper bound stands alone (O-51)."""
    if least <= 0 or most < least:
        raise ValueError("0 < least <= most is needed")
    return _min_max_udf(tokens, F.lit(least), F.lit(most))


def stub_translation(text: Column) -> Column:
    """The default translator (O-59)."""
    return F.concat(F.lit("[translated] "), text)


def restore(text: Column, spans: Column, translated: Column) -> Column:
    """(text, exact): the text with every span's translation in its place (O-88), and whether each span is the text at its
    offset, in order, so that their own texts would give the text back."""
    return _woven_udf(text, spans, translated)


def segment_documents(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``spans``, ``tokens`` and ``batch`` arrays. Offsets are the running sum of the pieces' lengths. A worker
    holds running sums over the bytes of a batch, so batches are bounded by bytes."""
    small_batches(df.sparkSession)
    new = [T.StructField("spans", T.ArrayType(_SPAN)), T.StructField("tokens", T.ArrayType(T.LongType())), T.StructField("batch", T.ArrayType(T.IntegerType()))]
    schema = T.StructType([*df.schema.fields, *new])
    own, names = df.columns, schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = _placed(batch.column("__pieces"))
            tokens = _weights(spans)
            packed = _greedy(tokens, pa.array([MAX_BATCH_TOKENS] * len(tokens)))
            yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in own), spans, tokens, packed], names)

    return df.withColumn("__pieces", txt_pieces(F.coalesce(F.col(text), F.lit("")))).mapInArrow(run, schema)


def translate_documents(df: DataFrame, translator: Callable[[Column], Column] = stub_translation) -> DataFrame:
    """Segments translated, settled per segment and put back; with the metrics of each document
    (O-59, O-66, O-70, O-88, O-89, O-90)."""
    out = segment_documents(df)
    out = out.withColumn("candidate", F.transform("spans", lambda s: translator(s["text"])))
    settled = F.zip_with(
        "spans", "candidate", lambda s, c: F.when(strip(F.coalesce(c, F.lit(""))) != "", c).otherwise(s["text"])
    )
    good = F.size(F.filter("candidate", lambda c: strip(F.coalesce(c, F.lit(""))) != ""))
    out = out.withColumn("settled", settled)
    out = out.withColumn("woven", restore(F.coalesce(F.col("text"), F.lit("")), F.col("spans"), F.col("settled")))
    return out.select(
        *[c for c in df.columns if c != "text"],
        F.size("spans").cast("long").alias("n_segments"),
        F.when(F.size("batch") > 0, F.array_max("batch") + 1).otherwise(0).cast("long").alias("n_batches"),
        F.aggregate("tokens", F.lit(0).cast("long"), lambda a, b: a + b).alias("est_tokens"),
        good.cast("long").alias("translated"),
        (F.size("spans") - good).cast("long").alias("fallback"),
        F.col("woven.exact").alias("round_trip"),
        F.col("woven.text").alias("output_text"),
    )


def segment_rows(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per segment: id, order, segment_id, offsets, tokens and batch."""
    out = segment_documents(df.select(id_col, "text"))
    zipped = F.arrays_zip(F.col("spans").alias("s"), F.col("tokens").alias("t"), F.col("batch").alias("b"))
    rows = out.select(id_col, F.posexplode(zipped).alias("seg_order", "x"))
    return rows.select(
        id_col,
        F.col("seg_order").cast("long").alias("seg_order"),
        F.format_string("TXT_%04d", "seg_order").alias("segment_id"),
        F.col("x.s.start").cast("long").alias("start_offset"),
        (F.col("x.s.start") + F.length("x.s.text")).cast("long").alias("end_offset"),
        F.col("x.t").alias("tokens"),
        F.col("x.b").cast("long").alias("batch_id"),
        F.col("x.s.text").alias("source_text"),
    )
