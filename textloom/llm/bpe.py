"""Operator 3: byte-level BPE encoding and decoding by corpus-level merge replay.

The texts of a slab are cut into pre-tokens by vectorised character-class runs (the same cuts as
``public_tokenizers.PATTERN``), the distinct pre-tokens that the worker has not met are laid end to
end, and one replay encodes all of them: an inverted index leads from each mergeable token pair (by
the rank of its merge) to the positions where the pair stands; ranks are taken in ascending order
and each merge updates the index only for its two neighbours. Words are independent of each other
under BPE, so replaying a part of the corpus at a time gives the same ids as replaying all of it;
this needs no shuffle, and no vocabulary of the corpus's words is ever broadcast. Pre-tokens are told
apart by two independent 64-bit hashes.

Defined results: null and empty texts have no ids and decode to no bytes; ids of a null array
decode to empty; a pre-token of any length is encoded whole; extra columns are kept unless they
have the name of an output column, which then replaces them.
"""

from __future__ import annotations

import array
import base64
import functools
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from textloom.llm.kernels import bytes_hash, slabs, text_buffers
from textloom.llm.scratch import small_batches

#: Words that a worker keeps encoded; beyond it the store starts anew (it only saves time).
CACHE_WORDS = 250_000
#: Bytes of text that one replay covers.
PORTION_BYTES = 3 << 20
_LETTER, _NUMBER, _BLANK, _OTHER = 0, 1, 2, 3
_SHIFT = 20


@functools.cache
def _classes() -> np.ndarray:
    """Class of every code point: letter, number, white space, other."""
    table = np.full(0x110000, _OTHER, np.uint8)
    for point in range(0x110000):
        major = unicodedata.category(chr(point))[0]
        if major == "L":
            table[point] = _LETTER
        elif major == "N":
            table[point] = _NUMBER
    # The code points with the Unicode property White_Space.
    table[[0x20, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _BLANK
    table[0x09:0x0E] = _BLANK
    table[0x2000:0x200B] = _BLANK
    return table


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the byte offset where each begins."""
    begins = np.flatnonzero((data & 0xC0) != 0x80)
    if len(begins) == len(data):
        return data.astype(np.uint32), begins
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), begins


def cut(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Byte offsets where pre-tokens begin, for texts data[at[i]:at[i + 1]]."""
    points, byte_at = code_points(data)
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64)
    kind = _classes()[points]
    edge = np.zeros(n + 1, bool)  # a text begins here
    edge[np.searchsorted(byte_at, at)] = True
    new = np.ones(n + 1, bool)
    new[1:n] = (kind[1:] != kind[:-1]) | edge[1:n]
    begin = new[:n].copy()
    blank = kind == _BLANK
    # The last blank before other text stands alone; a plain space joins what follows it.
    before = np.flatnonzero(blank[:-1] & ~blank[1:] & ~edge[1:n])
    begin[before] = True
    begin[before[points[before] == 0x20] + 1] = False
    # Contractions: an apostrophe that begins a token, directly before letters.
    quote = np.flatnonzero((points == 0x27) & begin)
    quote = quote[(quote + 1 < n)]
    quote = quote[(kind[quote + 1] == _LETTER) & ~edge[quote + 1]]
    if len(quote):
        one = points[quote + 1]
        third = np.minimum(quote + 2, n - 1)
        two = np.where((quote + 2 < n) & ~edge[third], points[third], 0)
        # Fixed values: 's 't 'm 'd and 're 've 'll.
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e")))
        long |= (one == ord("l")) & (two == ord("l"))
        for mask, size in ((short, 2), (long & ~short, 3)):
            hit = quote[mask]
            begin[hit + 1] = False
            after = hit + size
            begin[after[after < n]] = True
    return byte_at[begin]


class Vocabulary:
    """A rank file: ids of byte strings, and of pairs of ids the id they merge into."""

    def __init__(self, path: str):
        self.ranks: dict[bytes, int] = {}
        with open(path, "rb") as lines:
            for line in lines:
                token, _, rank = line.strip().partition(b" ")
                if token:
                    self.ranks[base64.b64decode(token)] = int(rank)
        size = max(self.ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.length = np.array([len(t) for t in self.tokens], np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.length)])
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.words: dict[bytes, int] = {}
        self.forget()

    @functools.cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Every pair of ids that merges, as left << 20 | right, sorted, and the rank of its merge. Decoding needs none."""
        keys, ranks = array.array("q"), array.array("q")
        get = self.ranks.get
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                left, right = get(token[:i]), get(token[i:])
                if left is not None and right is not None:
                    keys.append(left << _SHIFT | right)
                    ranks.append(rank)
        order = np.argsort(np.frombuffer(keys, np.int64))
        return np.frombuffer(keys, np.int64)[order], np.frombuffer(ranks, np.int64)[order]

    @functools.cached_property
    def merged(self) -> dict[int, int]:
        """The same pairs by key, for odd words."""
        keys, ranks = self.pairs
        return dict(zip(keys.tolist(), ranks.tolist()))

    def ranks_of(self, keys: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge, or -1."""
        known, ranks = self.pairs
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, ranks[at], -1)

    def forget(self) -> None:
        self.words.clear()
        self.known_ids = np.zeros(0, np.int32)
        self.known_counts = np.zeros(0, np.int64)

    def one(self, word: bytes) -> list[int]:
        """Ids of one word, lowest rank first and leftmost among equals (quadratic; for odd words)."""
        token = [int(self.of_byte[b]) for b in word]
        get = self.merged.get
        while len(token) > 1:
            ranks = [get(a << _SHIFT | b, 1 << 60) for a, b in zip(token, token[1:])]
            low = min(ranks)
            if low == 1 << 60:
                break
            i = ranks.index(low)
            token[i : i + 2] = [low]
        return token

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and the number of ids of each word."""
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes)
        token = self.of_byte[np.frombuffer(b"".join(words), np.uint8)].astype(np.int32)
        n = len(token)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[ends - 1] = -1
        before[ends - sizes] = -1
        index: dict[int, list[np.ndarray]] = {}  # rank of a merge -> positions where its pair stands
        heap: list[int] = []

        def note(keys: np.ndarray, places: np.ndarray, least: int) -> np.ndarray | None:
            """Enter the pairs that merge; returns the places whose rank is below ``least``."""
            rank = self.ranks_of(keys)
            found = np.flatnonzero(rank >= 0)
            if not len(found):
                return None
            rank, places = rank[found], places[found]
            order = np.argsort(rank, kind="stable")
            rank, places = rank[order], places[order]
            cuts = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]]))
            names, cuts = rank[cuts].tolist(), cuts.tolist()
            for a, b, r in zip(cuts, [*cuts[1:], len(rank)], names):
                if r in index:
                    index[r].append(places[a:b])
                else:
                    index[r] = [places[a:b]]
                    heapq.heappush(heap, r)
            return places[rank < least] if names[0] < least else None

        where = np.flatnonzero(after >= 0)
        if len(where):
            note(token[where].astype(np.int64) << _SHIFT | token[where + 1], where.astype(np.int32), 0)
        odd: list[np.ndarray] = []
        while heap:
            r = heapq.heappop(heap)
            places = index.pop(r)
            p = np.sort(places[0] if len(places) == 1 else np.concatenate(places))
            q = after[p]
            valid = (q >= 0) & (token[p] >= 0)
            valid[1:] &= p[1:] != p[:-1]
            p, q = p[valid], q[valid]
            valid = self.ranks_of(token[p].astype(np.int64) << _SHIFT | token[q]) == r
            p, q = p[valid], q[valid]
            if not len(p):
                continue
            if len(p) > 1 and (touch := p[1:] == q[:-1]).any():  # pairs that share a token: every other one
                i = np.arange(len(p))
                run = np.maximum.accumulate(np.where(np.append(True, ~touch), i, 0))
                free = (i - run) % 2 == 0
                p, q = p[free], q[free]
            s = after[q]
            token[p], token[q], after[p] = r, -1, s
            right = s >= 0
            before[s[right]] = p[right]
            o = before[p]
            o = o[o >= 0]
            places = np.concatenate([p[right], o])
            if len(places):
                low = note(token[places].astype(np.int64) << _SHIFT | token[after[places]], places, r)
                if low is not None:
                    odd.append(low)
        alive = token >= 0
        total = np.concatenate([[0], np.cumsum(alive)])
        ids, counts = token[alive].astype(np.int32), total[ends] - total[ends - sizes]
        if odd:  # a merge made a pair of a lower rank: such words are encoded alone
            at = np.concatenate([[0], np.cumsum(counts)])
            parts = {w: self.one(words[w]) for w in np.unique(np.searchsorted(ends, np.concatenate(odd), "right")).tolist()}
            pieces, last = [], 0
            for w, found in parts.items():
                pieces += [ids[last : at[w]], np.array(found, np.int32)]
                last = at[w + 1]
                counts[w] = len(found)
            ids = np.concatenate([*pieces, ids[last:]])
        return ids, counts

    def encode(self, portion: list[pa.Array]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each array of texts the ids end to end and the n + 1 offsets; one replay for all."""
        if len(self.words) > CACHE_WORDS:
            self.forget()
        cuts, digests, checks, lengths = [], [], [], []
        for texts in portion:
            data, at = text_buffers(texts)
            starts = cut(data, at)
            ends = np.append(starts[1:], len(data))[: len(starts)]
            cuts.append((data, starts, np.searchsorted(starts, at)))
            digests.append(bytes_hash(data, starts, ends))
            checks.append(bytes_hash(data, starts, ends, 1))
            lengths.append(ends - starts)
        digest, check = np.concatenate(digests), np.concatenate(checks)
        del digests, checks
        _, sample, inverse = np.unique(digest, return_index=True, return_inverse=True)
        if not (check[sample][inverse] == check).all():  # two pre-tokens share a digest: both halves tell them apart
            _, sample, inverse = np.unique(np.stack([digest, check], axis=1), axis=0, return_index=True, return_inverse=True)
            inverse = inverse.reshape(-1)
        inverse = inverse.astype(np.int32)
        sizes = np.concatenate(lengths)[sample]
        firsts = np.concatenate([[0], np.cumsum([len(x) for x in lengths])])
        del digest, check, lengths
        words: list[bytes] = [b""] * len(sample)
        place = np.searchsorted(firsts, sample, "right") - 1
        for k, (data, starts, _) in enumerate(cuts):
            raw = data.tobytes()
            own = np.flatnonzero(place == k)
            begin = starts[sample[own] - firsts[k]]
            for i, a, b in zip(own.tolist(), begin.tolist(), (begin + sizes[own]).tolist()):
                words[i] = raw[a:b]
        get = self.words.get
        number = np.array([get(w, -1) for w in words], np.int32)
        fresh = np.flatnonzero(number < 0)
        new = [words[i] for i in fresh.tolist()]
        number[fresh] = np.arange(len(self.words), len(self.words) + len(new))
        self.words.update(zip(new, range(len(self.words), len(self.words) + len(new))))
        if new:
            ids, counts = self.replay(new)
            self.known_ids = np.concatenate([self.known_ids, ids])
            self.known_counts = np.concatenate([self.known_counts, counts])
        word_at = np.concatenate([[0], np.cumsum(self.known_counts)])
        out = []
        for k, (_, _, first) in enumerate(cuts):
            word = number[inverse[firsts[k] : firsts[k + 1]]]
            many = self.known_counts[word]
            at = np.concatenate([[0], np.cumsum(many)])
            take = np.arange(at[-1]) + np.repeat(word_at[word] - at[:-1], many)
            out.append((self.known_ids[take], at[first]))
        return out

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all id sequences end to end, and the n + 1 offsets."""
        sizes = self.length[ids]
        out_at = np.concatenate([[0], np.cumsum(sizes)])
        take = np.arange(out_at[-1]) + np.repeat(self.offset[ids] - out_at[:-1], sizes)
        return self.bytes[take], out_at[at]


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def portions(batches: Iterator[pa.RecordBatch], text: str, limit: int = PORTION_BYTES) -> Iterator[list[pa.RecordBatch]]:
    """Slabs in lists of about ``limit`` bytes of text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for slab in slabs(batch, text):
            held.append(slab)
            size += len(text_buffers(slab.column(text))[0])
            if size >= limit:
                yield held
                held, size = [], 0
    if held:
        yield held


def _with(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name.lower() != name.lower()] + [T.StructField(name, kind)])


def _encoded(words: Vocabulary, batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, pa.ListArray]]:
    """Slabs of the batches with their ids."""
    for portion in portions(batches, text):
        for slab, (found, at) in zip(portion, words.encode([x.column(text) for x in portion])):
            yield slab, pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(found))


def _decoded(words: Vocabulary, ids: pa.Array) -> pa.Array:
    at = np.concatenate([[0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy(False))])
    data, out_at = words.decode(ids.flatten().to_numpy(False).astype(np.int64), at.astype(np.int64))
    return pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(out_at.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids`` (array of int): the text's tokens by the rank file at ``path``."""
    schema = _with(df.schema, ids, T.ArrayType(T.IntegerType(), False))
    keep = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab, column in _encoded(vocabulary(path), batches, text):
            yield pa.RecordBatch.from_arrays([slab.column(k) for k in keep] + [column], [*keep, ids])

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add ``decoded`` (binary): the bytes of the ids. ``ids`` itself is kept."""
    schema = _with(df.schema, decoded, T.BinaryType())
    keep = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                yield pa.RecordBatch.from_arrays([part.column(k) for k in keep] + [_decoded(words, part.column(ids))], [*keep, decoded])

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` without its text, with ``ids`` and the bytes that they decode to. Both steps share a worker and its
    vocabulary; one after the other they hold a worker each for every running task."""
    kinds = _with(_with(df.schema, ids, T.ArrayType(T.IntegerType(), False)), decoded, T.BinaryType())
    schema = T.StructType([f for f in kinds.fields if f.name != text])
    keep = [f.name for f in schema.fields[:-2]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for slab, column in _encoded(words, batches, text):
            yield pa.RecordBatch.from_arrays([*(slab.column(k) for k in keep), column, _decoded(words, column)], [*keep, ids, decoded])

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)
