"""Dense format features of whole texts, and presence of chosen words, for the classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.kernels import Words, slabs, split_words
from textloom.llm.scratch import materialize, small_batches

NAMES = (
    "upper", "digit", "blank", "line", "stop", "shout", "bar", "symbol", "wide",
    "log_words", "word_length", "capital", "caps", "distinct", "short", "closed", "marked", "bigrams", "line_words",
)
#: Words are counted in this many buckets of their hash.
BUCKETS = 1 << 16

_CLASSES = np.zeros((9, 256), np.float64)
for _row, _points in enumerate(
    (
        range(0x41, 0x5B),
        range(0x30, 0x3A),
        (0x20, 0x09, 0x0B, 0x0C, 0x0D),
        (0x0A,),
        (0x2C, 0x2E),
        (0x21, 0x3F),
        (0x7C,),
        [p for p in range(0x21, 0x7F) if not chr(p).isalnum() and chr(p) not in ",.!?|'\"-"],
        range(0x80, 0x100),
    )
):
    _CLASSES[_row, list(_points)] = 1


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[at[1:]] - total[at[:-1]]


def _distinct(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of distinct keys of each document."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((keys, doc))
    k, d = keys[order], doc[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    return np.bincount(d[new], minlength=len(at) - 1).astype(np.float64)


def dense(words: Words, hashes: np.ndarray) -> np.ndarray:
    """n_docs x len(NAMES) features; an empty text has zeros."""
    data, at = words.data, words.doc_at
    size = np.maximum(np.diff(at), 1).astype(np.float64)
    count = np.diff(words.first)
    many = np.maximum(count, 1).astype(np.float64)
    out = np.zeros((len(size), len(NAMES)))
    for row in range(9):
        out[:, row] = _sums(_CLASSES[row][data], at) / size
    head, tail = (data[words.starts], data[words.ends - 1]) if len(words.starts) else (data, data)
    length = (words.ends - words.starts).astype(np.float64)
    upper = np.concatenate([[0], np.cumsum(_CLASSES[0][data])])
    uppers = upper[words.ends] - upper[words.starts]
    symbol = np.concatenate([[0], np.cumsum(_CLASSES[5][data] + _CLASSES[6][data] + _CLASSES[7][data])])
    out[:, 9] = np.log1p(count)
    for column, values in (
        (10, length),
        (11, _CLASSES[0][head]),
        (12, (uppers >= 2) & (uppers >= 0.5 * length)),
        (14, length <= 3),
        (15, _CLASSES[4][tail]),
        (16, symbol[words.ends] > symbol[words.starts]),
    ):
        out[:, column] = _sums(values, words.first) / many
    out[:, 13] = _distinct(hashes, words.first) / many
    pairs = hashes.copy()
    pairs[:-1] ^= hashes[1:] * np.uint64(0x9E3779B97F4A7C15)
    out[:, 17] = _distinct(pairs, words.first) / many
    out[:, 18] = np.log1p(count / (1 + _sums(_CLASSES[3][data], at)))
    return out


def expand(x: np.ndarray) -> np.ndarray:
    """The features with their square roots, so that linear scores can bend."""
    return np.concatenate([x, np.sqrt(np.maximum(x, 0))], axis=1)


def word_buckets(words: Words, hashes: np.ndarray) -> np.ndarray:
    """Bucket of each word."""
    return (hashes >> np.uint64(48)).astype(np.int64) % BUCKETS


def matrix(texts: pa.Array, place: np.ndarray, extra: int) -> tuple[np.ndarray, np.ndarray]:
    """Word counts and features of texts; ``place`` leads from word buckets to the last ``extra`` ones."""
    words = split_words(texts)
    hashes = words.hashes()
    x = dense(words, hashes)
    if extra:
        at = place[word_buckets(words, hashes)]
        has = np.zeros((len(x), extra))
        has[words.doc_of[at >= 0], at[at >= 0]] = 1
        x = np.concatenate([x, has], axis=1)
    return np.diff(words.first), x


def places(chosen: np.ndarray | None) -> tuple[np.ndarray, int]:
    place = np.full(BUCKETS, -1, np.int64)
    if chosen is None:
        return place, 0
    place[chosen] = np.arange(len(chosen))
    return place, len(chosen)


def apply(
    df: DataFrame,
    text_col: str,
    name: str,
    kind: T.DataType,
    function: Callable[[np.ndarray, np.ndarray], pa.Array],
    chosen: np.ndarray | None = None,
) -> DataFrame:
    """``df`` with the column ``name``: function(word counts, features) of each slab of texts. A column of
    that name is replaced; all others are kept."""
    schema = T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, kind)])
    keep = [f.name for f in schema.fields[:-1]]
    place, extra = places(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slab in slabs(batch, text_col):
                column = function(*matrix(slab.column(text_col), place, extra))
                yield pa.RecordBatch.from_arrays([*(slab.column(k) for k in keep), column], [*keep, name])

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lists(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as an array column."""
    at = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.ascontiguousarray(x).ravel()))


def extract(df: DataFrame, text_col: str = "text", name: str = "x") -> DataFrame:
    """``df`` with the dense features as an array of float."""
    return apply(df, text_col, name, T.ArrayType(T.FloatType()), lambda words, x: lists(x.astype(np.float32)))


def labelled(df: DataFrame, known: dict[int, int]) -> DataFrame:
    """The rows of ``df`` whose id is in ``known``; their number is bounded, so they are broadcast."""
    ids = df.sparkSession.createDataFrame([(i,) for i in sorted(known)], "id long")
    return df.join(F.broadcast(ids), "id", "left_semi")


def one_each(df: DataFrame, known: dict[int, int]) -> DataFrame:
    """(id, text): one text of each id of ``known``, the one with the least hash, as a table. Ids may repeat, even in a
    third of all rows; their rows are combined in each task first, so what a fit reads has the bound of ``known``."""
    rows = labelled(df.select("id", "text"), known).groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return materialize(rows, "labelled")


def of_known(df: DataFrame, known: dict[int, int], chosen: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Features and classes of the rows of ``df`` (of ``one_each``)."""
    place, extra = places(chosen)
    ids, kinds = _sorted(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, own, kind in _labelled(batches, ids, kinds):
            _, x = matrix(batch.column("text"), place, extra)
            rows = pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(kind), rows], ["id", "kind", "x"])

    small_batches(df.sparkSession)
    rows = df.select("id", "text").mapInArrow(run, "id long, kind long, x binary").collect()
    rows.sort(key=lambda r: (r["id"], bytes(r["x"])))
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows], np.float64)
    return x, np.array([r["kind"] for r in rows], np.int64)


def _sorted(known: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    ids = np.array(sorted(known), np.int64)
    return ids, np.array([known[i] for i in ids.tolist()], np.int64)


def _labelled(
    batches: Iterator[pa.RecordBatch], ids: np.ndarray, kinds: np.ndarray
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slabs of the rows whose id is known, with their ids and classes."""
    for batch in batches:
        own = batch.column("id").fill_null(np.iinfo(np.int64).min).to_numpy(False)
        if not len(ids):
            continue
        at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
        some = ids[at] == own
        if some.any():
            done, kind, own = 0, kinds[at[some]], own[some]
            for slab in slabs(batch.filter(pa.array(some)), "text"):
                n = slab.num_rows
                yield slab, own[done : done + n], kind[done : done + n]
                done += n


def presence(df: DataFrame, known: dict[int, int], n_classes: int) -> np.ndarray:
    """Over the rows of ``df`` (of ``one_each``): how many texts of each class (id -> class) have a word of each bucket.
    BUCKETS x n_classes counts."""
    ids, kinds = _sorted(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS * n_classes, np.int64)
        for slab, _, kind in _labelled(batches, ids, kinds):
            words = split_words(slab.column("text"))
            once = np.unique(words.doc_of * BUCKETS + word_buckets(words, words.hashes()))
            total += np.bincount(once % BUCKETS * n_classes + kind[once // BUCKETS], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "n"])

    small_batches(df.sparkSession)
    found = df.select("id", "text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS * n_classes)
    for cell, n in found.collect():
        out[cell] = n
    return out.reshape(BUCKETS, n_classes)
