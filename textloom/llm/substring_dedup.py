"""Operator 9: removal of repeated passages by fixed-block anchors.

A window is ``window`` consecutive words of one document. Of every document the non-overlapping
blocks of ``block = window // 2`` words are the index; every rolling window of ``block`` words is a
probe. Any window of ``window`` words holds one whole aligned block of the document it lies in, so a
window that two documents share is found by a probe in one that meets an anchor of the other.

The documents are dealt once into chunks of bounded size, by a hash of the id; this exchange is
reused by the three steps that read texts:

1. Each chunk sends its distinct probe hashes, sorted and delta-coded (about two bytes each), with a
   bit for those that are anchors, to buckets of the hash; a bucket answers each chunk with one bit
   per probe: there is such an anchor, and the words stand in more than one document. A hash is sent
   once per chunk however often it stands there, so no passage makes a hot bucket.
2. Around the hits each chunk extends to all whole windows that hold one and sends two independent 64-bit
   hashes of their words with the smallest id; the bucket answers whether a smaller id stands elsewhere.
3. Each chunk merges the windows that a smaller id holds into maximal repeats and removes them.

Defined results: words are ``[^\\x20\\x09-\\x0D]+``, unchanged; null and empty texts have none; windows
are judged on the input; rows with the same id do not remove each other's words; a null id counts
as larger than all others; texts shorter than a window lose nothing; an empty table gives an empty
result; other columns are not read. Window sequences count as equal when both halves of their 128-bit hash
are; anchors, of 32 bits or more, only say where windows are looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.kernels import Words, ranges_hash, split_words, windows
from textloom.llm.scratch import small_batches

#: Code points of text in a chunk, and probes in a bucket: what one task holds at a time.
CHUNK_CHARS = 3_000_000
BUCKET_PROBES = 2_000_000
#: Tasks that chunks are dealt to at most; beyond it a task takes several chunks, one after the other.
PARTITIONS = 20_000
_LAST = (1 << 63) - 1
_WINDOW_SEEDS = (0xC2B2AE3D27D4EB4F, 0x9FB21C651E98DF25)


def _pack(values: np.ndarray, wide: bool) -> tuple[bytes, bytes]:
    """Ascending integers as small differences, with the large ones beside them."""
    kind = np.uint32 if wide else np.uint16
    top = np.iinfo(kind).max
    steps = np.diff(values, prepend=np.uint64(0))
    return np.minimum(steps, np.uint64(top)).astype(kind).tobytes(), steps[steps >= top].tobytes()


def _unpack(small: bytes, large: bytes, wide: bool) -> np.ndarray:
    kind = np.uint32 if wide else np.uint16
    steps = np.frombuffer(small, kind).astype(np.uint64)
    steps[steps == np.iinfo(kind).max] = np.frombuffer(large, np.uint64)
    return np.cumsum(steps)


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)


def _changes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Where a new pair of values begins."""
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    return np.flatnonzero(new)


class _Chunk:
    """One chunk's words and its distinct probes, the same at every step."""

    def __init__(self, table: pa.Table, block: int, bits: int):
        self.ids = table.column("id").to_numpy()
        self.words: Words = split_words(table.column("text"))
        self.hashes = self.words.hashes()
        self.doc = self.words.doc_of
        self.starts, found = windows(self.hashes, self.words.first, block)
        found >>= np.uint64(64 - bits)
        self.order = np.argsort(found, kind="stable")
        sorted_ = found[self.order]
        self.bounds = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(found) else np.zeros(0, np.int64)
        self.probes = sorted_[self.bounds]

    def group(self, flags: np.ndarray) -> np.ndarray:
        """For each distinct probe whether any of its places has the flag."""
        return np.logical_or.reduceat(flags[self.order], self.bounds) if len(self.bounds) else flags

    def spread(self, flags: np.ndarray) -> np.ndarray:
        """Flags of distinct probes at the words where they begin."""
        out = np.zeros(len(self.hashes), bool)
        sizes = np.diff(np.append(self.bounds, len(self.order)))
        out[self.starts[self.order]] = np.repeat(flags, sizes)
        return out


def _split(values: np.ndarray, bits: int, bucket_bits: int) -> list[tuple[int, int, int]]:
    """(bucket, first, end) of ascending values by their top bits."""
    top = (values >> np.uint64(bits - bucket_bits)).astype(np.int64)
    names, first = np.unique(top, return_index=True)
    return list(zip(names.tolist(), first.tolist(), [*first[1:].tolist(), len(values)]))


_SENT = "bucket int, chunk int, n int, a binary, b binary, c binary, d binary"
_BACK = "chunk int, step int, bucket int, bits binary"


def _table(schema: dict[str, pa.DataType], rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.table({k: pa.array(list(c), t) for (k, t), c in zip(schema.items(), columns)})


_SENT_TYPES = {"bucket": pa.int32(), "chunk": pa.int32(), "n": pa.int32()} | {k: pa.binary() for k in "abcd"}
_BACK_TYPES = {"chunk": pa.int32(), "step": pa.int32(), "bucket": pa.int32(), "bits": pa.binary()}


def repeats(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 50,
    chunk_chars: int = CHUNK_CHARS,
    bucket_probes: int = BUCKET_PROBES,
) -> DataFrame:
    """One row per row of ``df``: id, n_words, n_removed, text (kept words joined by one space) and
    repeats (the maximal removed ranges, as first word and end)."""
    block = window // 2
    small_batches(df.sparkSession)
    rows = df.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LAST)).alias("id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n_chunks = max(1, -(-chars // chunk_chars))
    bucket_bits = max(1, int(chars // 6 // bucket_probes)).bit_length()
    # Falsely met anchors cost time only; their share stays below about one in fifty.
    wide = chars // 6 // block > (1 << 32) // 50
    bits = 32 + bucket_bits if wide else 32
    key = F.xxhash64("id", F.when(F.col("id") == _LAST, F.xxhash64("text")))  # rows without an id are spread too
    docs = rows.withColumn("chunk", F.pmod(key, F.lit(n_chunks)).cast("int")).repartition(min(n_chunks, PARTITIONS), "chunk")

    def send_probes(key: tuple, table: pa.Table) -> pa.Table:
        chunk = _Chunk(table, block, bits)
        local = chunk.starts - chunk.words.first[chunk.doc[chunk.starts]]
        anchors = chunk.group(local % block == 0)
        docs_of = chunk.doc[chunk.starts[chunk.order]]
        ends = np.append(chunk.bounds, len(docs_of))
        many = docs_of[ends[:-1]] != docs_of[ends[1:] - 1]
        out = []
        for bucket, a, b in _split(chunk.probes, bits, bucket_bits):
            low = chunk.probes[a:b] & np.uint64((1 << (bits - bucket_bits)) - 1)
            small, large = _pack(low, wide)
            out.append((bucket, key[0].as_py(), b - a, small, large, _bits(anchors[a:b]), _bits(many[a:b])))
        return _table(_SENT_TYPES, out)

    def meet_probes(key: tuple, table: pa.Table) -> pa.Table:
        got = table.to_pylist()
        lists = [_unpack(r["a"], r["b"], wide) for r in got]
        _, inverse = np.unique(np.concatenate(lists), return_inverse=True)
        n = int(inverse.max()) + 1
        anchor, many = np.zeros(n, bool), np.bincount(inverse, minlength=n) > 1
        first = 0
        for r in got:
            own = inverse[first : first + r["n"]]
            anchor[own[_flags(r["c"], r["n"])]] = True
            many[own[_flags(r["d"], r["n"])]] = True
            first += r["n"]
        hit = (anchor & many)[inverse]
        out, first = [], 0
        for r in got:
            own = hit[first : first + r["n"]]
            first += r["n"]
            if own.any():
                out.append((r["chunk"], 1, key[0].as_py(), _bits(own)))
        return _table(_BACK_TYPES, out)

    def flags_of(back: pa.Table, step: int, values: np.ndarray, width: int) -> np.ndarray:
        answer = {r["bucket"]: r["bits"] for r in back.to_pylist() if r["step"] == step}
        out = np.zeros(len(values), bool)
        for bucket, a, b in _split(values, width, bucket_bits):
            if bucket in answer:
                out[a:b] = _flags(answer[bucket], b - a)
        return out

    def candidates(chunk: _Chunk, back: pa.Table) -> tuple[np.ndarray, ...]:
        """Starts of the windows around hits, in the order of their hashes; where each distinct hash
        begins; both halves of the distinct hashes; the smallest id of each."""
        hit = chunk.spread(flags_of(back, 1, chunk.probes, bits))
        sums = np.concatenate([[0], np.cumsum(hit)])
        last = np.repeat(chunk.words.first[1:], np.diff(chunk.words.first)) - window
        begin = np.flatnonzero(np.arange(len(hit)) <= last)
        begin = begin[sums[begin + window - block + 1] > sums[begin]]
        halves = (chunk.hashes, chunk.words.hashes(1))
        first, second = (ranges_hash(h, begin, begin + window, s) for h, s in zip(halves, _WINDOW_SEEDS))
        order = np.lexsort((second, first))
        begin, first, second = begin[order], first[order], second[order]
        bounds = _changes(first, second)
        ids = chunk.ids[chunk.doc[begin]]
        least = np.minimum.reduceat(ids, bounds) if len(begin) else ids
        return begin, bounds, first[bounds], second[bounds], least

    def send_windows(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows or not left.num_rows:
            return _table(_SENT_TYPES, [])
        _, _, hashes, second, least = candidates(_Chunk(left, block, bits), right)
        out = [
            (bucket, key[0].as_py(), b - a, hashes[a:b].tobytes(), least[a:b].tobytes(), second[a:b].tobytes(), b"")
            for bucket, a, b in _split(hashes, 64, bucket_bits)
        ]
        return _table(_SENT_TYPES, out)

    def meet_windows(key: tuple, table: pa.Table) -> pa.Table:
        got = table.to_pylist()
        hashes = np.concatenate([np.frombuffer(r["a"], np.uint64) for r in got])
        ids = np.concatenate([np.frombuffer(r["b"], np.int64) for r in got])
        second = np.concatenate([np.frombuffer(r["c"], np.uint64) for r in got])
        order = np.lexsort((second, hashes))
        bounds = _changes(hashes[order], second[order])
        least = np.minimum.reduceat(ids[order], bounds)
        smaller = np.empty(len(ids), bool)
        smaller[order] = np.repeat(least, np.diff(np.append(bounds, len(ids)))) < ids[order]
        out, first = [], 0
        for r in got:
            own = smaller[first : first + r["n"]]
            first += r["n"]
            if own.any():
                out.append((r["chunk"], 2, key[0].as_py(), _bits(own)))
        return _table(_BACK_TYPES, out)

    def remove(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        words = None
        gone = None
        if right.num_rows and left.num_rows:
            chunk = _Chunk(left, block, bits)
            words = chunk.words
            begin, bounds, hashes, _, least = candidates(chunk, right)
            sizes = np.diff(np.append(bounds, len(begin)))
            elsewhere = np.repeat(flags_of(right, 2, hashes, 64), sizes)
            drop = begin[elsewhere | (chunk.ids[chunk.doc[begin]] > np.repeat(least, sizes))]
            edge = np.bincount(drop, minlength=len(chunk.hashes) + 1) - np.bincount(
                drop + window, minlength=len(chunk.hashes) + 1
            )
            gone = np.cumsum(edge)[:-1] > 0
        words = words or split_words(left.column("text"))
        return _kept(left.column("id"), words, np.zeros(len(words.starts), bool) if gone is None else gone)

    sent = docs.groupBy("chunk").applyInArrow(send_probes, _SENT)
    hits = sent.groupBy("bucket").applyInArrow(meet_probes, _BACK)
    whole = docs.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(send_windows, _SENT)
    smaller = whole.groupBy("bucket").applyInArrow(meet_windows, _BACK)
    back = hits.unionByName(smaller)
    out = docs.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(
        remove, "id long, n_words long, n_removed long, text string, repeats array<struct<first:int,end:int>>"
    )
    return out.withColumn("id", F.when(F.col("id") != _LAST, F.col("id"))).withColumnRenamed("id", id_col)


def _kept(ids: pa.ChunkedArray, words: Words, gone: np.ndarray) -> pa.Table:
    """The kept words of each document joined by one space, and the ranges that are gone."""
    kept = ~gone
    first = words.first
    before = np.concatenate([[0], np.cumsum(kept)])
    n_words, n_kept = np.diff(first), before[first[1:]] - before[first[:-1]]
    # Each kept word with the byte after it, which becomes the space; a document's last has none.
    data = np.append(words.data, np.uint8(0x20))
    starts, ends = words.starts[kept], words.ends[kept]
    last = np.zeros(len(starts), bool)
    last[before[first[1:]][n_kept > 0] - 1] = True
    sizes = ends - starts + ~last
    at = np.concatenate([[0], np.cumsum(sizes)])
    take = np.arange(at[-1]) + np.repeat(starts - at[:-1], sizes)
    out = data[take]
    out[(at[1:] - 1)[~last]] = 0x20
    text_at = at[before[first]]
    text = pa.Array.from_buffers(
        pa.large_string(), len(n_words), [None, pa.py_buffer(text_at.astype(np.int64)), pa.py_buffer(out)]
    ).cast(pa.string())
    # Runs of gone words inside one document.
    inside = np.concatenate([[False], gone, [False]])
    new = inside[1:-1] & ~inside[:-2]
    end = inside[1:-1] & ~inside[2:]
    edges = first[1:-1]
    edges = edges[(edges > 0) & (edges < len(gone))]
    new[edges] |= gone[edges]
    end[edges - 1] |= gone[edges - 1]
    begin, end = np.flatnonzero(new), np.flatnonzero(end) + 1
    run_at = np.searchsorted(begin, first)
    base = first[np.searchsorted(first, begin, "right") - 1]
    runs = pa.ListArray.from_arrays(
        pa.array(run_at.astype(np.int32)),
        pa.StructArray.from_arrays(
            [pa.array((begin - base).astype(np.int32)), pa.array((end - base).astype(np.int32))], ["first", "end"]
        ),
    )
    return pa.table(
        {"id": ids, "n_words": pa.array(n_words), "n_removed": pa.array(n_words - n_kept), "text": text, "repeats": runs}
    )
