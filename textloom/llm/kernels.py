"""Vectorised text kernels over Arrow string buffers (NumPy, no per-row Python).

A *slab* is a slice of a record batch with a bounded number of text bytes, so that the working
arrays (about 30 bytes for each byte of text) stay bounded however long the batches are. One text
longer than the bound forms a slab by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLAB_BYTES = 1 << 18

_P = 0x9E3779B97F4A7C15 | 1
_Q = 0xD6E8FEB86659FD93 | 1
_MASK = (1 << 64) - 1
_powers: dict[int, np.ndarray] = {}
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTES = (_BYTE, np.random.default_rng(20240608).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1))
_BASES = (_P, 0xA0761D6478BD642F | 1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        factors = np.full(size, base, np.uint64)
        factors[0] = 1
        have = _powers[base] = np.multiply.accumulate(factors)
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def ranges_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _P) -> np.ndarray:
    """A 64-bit hash of values[start:end] for every range, by prefix sums of a polynomial."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(base, n), out=total[1:])
    out = (total[ends] - total[starts]) * powers(inverse(base), n + 1)[starts]
    return mix(out ^ ((ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))


def bytes_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, half: int = 0) -> np.ndarray:
    """A 64-bit hash of each range of bytes; halves 0 and 1 share neither values nor base."""
    return ranges_hash(_BYTES[half][data], starts, ends, _BASES[half])


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and the n + 1 offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slabs(batch: pa.RecordBatch, column: str, limit: int = SLAB_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch whose ``column`` holds at most ``limit`` bytes, or one row."""
    if batch.num_rows == 0:
        return
    _, at = text_buffers(batch.column(batch.schema.get_field_index(column)))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(at, at[first] + limit, "right")) - 1
        last = max(first + 1, min(last, batch.num_rows))
        yield batch.slice(first, last - first)
        first = last


@dataclass
class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a run of documents."""

    data: np.ndarray  # uint8, all texts end to end
    doc_at: np.ndarray  # n_docs + 1 byte offsets
    starts: np.ndarray  # byte offsets of words
    ends: np.ndarray
    first: np.ndarray  # n_docs + 1 word ordinals

    def hashes(self, half: int = 0) -> np.ndarray:
        """A 64-bit hash of each word; halves 0 and 1 are independent of each other."""
        return bytes_hash(self.data, self.starts, self.ends, half)

    @property
    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def split_words(texts: pa.Array) -> Words:
    data, at = text_buffers(texts)
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    begins = inside[1:-1] & ~inside[:-2]
    closes = inside[1:-1] & ~inside[2:]
    edges = at[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    begins[edges] |= inside[1:-1][edges]
    closes[edges - 1] |= inside[1:-1][edges - 1]
    starts = np.flatnonzero(begins)
    return Words(data, at, starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, at))


def windows(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ordinals of the words that start a window of ``width`` words inside one document, and the
    hash of each window's word sequence."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    last = np.repeat(first[1:], np.diff(first)) - width
    starts = np.flatnonzero(np.arange(n) <= last)
    return starts, ranges_hash(hashes, starts, starts + width, _Q)


def ngram_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams, document by document, and the n_docs + 1 offsets into them.

    A document of 1 to ``size - 1`` words has one n-gram, the whole of it; an empty one has none.
    """
    hashes = words.hashes()
    counts = np.diff(words.first)
    grams = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    at = np.concatenate([[0], np.cumsum(grams)])
    local = np.arange(at[-1]) - np.repeat(at[:-1], grams)
    starts = np.repeat(words.first[:-1], grams) + local
    ends = starts + np.repeat(np.minimum(counts, size), grams)
    return ranges_hash(hashes, starts, ends, _Q), at
