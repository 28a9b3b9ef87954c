"""Operator 6: n-gram Jaccard self-join by MinHash banding.

1. Every text gets ``bands * rows`` MinHash values of its word n-grams and one hash per band. Rows
   per band and bands are chosen so that a pair at the threshold is missed with a chance of at most
   ``1 - recall``. Texts with the same words are one *class*; only its smallest id goes on.
2. Band hashes are shuffled; those that one class has alone are dropped by a count.
3. Every class goes to the home of its most populous band bucket, then to the most crowded home that
   it shares a bucket with; a home is dealt out to blocks of about ``block`` classes. Two blocks are compared when any bucket has classes of both. A bucket with a
   third of all rows is so many blocks, and no pair of texts is ever a row of a table.
4. Each pair of blocks gets its texts and verifies all pairs between them on the full n-gram sets,
   as products of incidence matrices. It returns, for each class, the number of links and the
   smallest id linked, never the pairs.

Defined results: words are ``[^\\x20\\x09-\\x0D]+``, unchanged; a text of 1 to ``size - 1`` words has one
n-gram, the whole of it; null and empty texts have none and link with nothing, not even each other;
copies count as links; rows that share an id are documents of their own, whatever their texts; null ids are left out of the join and returned with a null class; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.components import connected_components
from textloom.llm.kernels import inverse, mix, ngram_hashes, powers, ranges_hash, slabs, split_words
from textloom.llm.scratch import materialize, small_batches
from textloom.llm.skew import join_spread

BLOCK = 1024
#: N-grams in a block: with BLOCK, what a task holds of it.
BLOCK_GRAMS = 1_000_000
#: Bytes of texts that a worker holds at a time while it gathers small pairs of blocks.
GATHER_BYTES = 2 << 20


def choose_bands(threshold: float, recall: float, rows: int = 4) -> int:
    """Bands of ``rows`` MinHash values that find a pair at the threshold with chance ``recall``."""
    bands = 1
    while (1 - threshold**rows) ** bands > 1 - recall:
        bands += 1
    return bands


_SIGNED = "id long, key long, f1 long, f2 long, n int, bands array<long>"


def signatures(df: DataFrame, size: int, bands: int, rows: int, seed: int = 1) -> DataFrame:
    """Per row of ``df`` (id, key, text): two hashes of the word sequence, the number of n-grams (with
    repeats) and the band hashes."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) | np.uint64(1)
    masks = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slab in slabs(batch, "text"):
                words = split_words(slab.column("text"))
                hashes = words.hashes()
                begin, end = words.first[:-1], words.first[1:]
                f1 = ranges_hash(hashes, begin, end, 0x9FB21C651E98DF25)
                f2 = ranges_hash(words.hashes(1), begin, end, 0xD1B54A32D192ED03)
                grams, at = ngram_hashes(words, size)
                has = np.flatnonzero(np.diff(at))
                least = np.empty((bands * rows, len(has)), np.uint64)
                cuts = at[:-1][has]
                for k in range(bands * rows):
                    if len(has):
                        np.minimum.reduceat((grams ^ masks[k]) * factors[k], cuts, out=least[k])
                band = np.zeros((len(has), bands), np.uint64)
                for b in range(bands):
                    x = np.full(len(has), b + 1, np.uint64)
                    for r in range(rows):
                        x = mix(x * np.uint64(0x9E3779B97F4A7C15) + least[b * rows + r])
                    band[:, b] = x
                counts = np.zeros(slab.num_rows, np.int32)
                counts[has] = bands
                bands_at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(bands_at), pa.array(band.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [
                        slab.column("id"),
                        slab.column("key"),
                        pa.array(f1.view(np.int64)),
                        pa.array(f2.view(np.int64)),
                        pa.array(np.diff(at).astype(np.int32)),
                        column,
                    ],
                    ["id", "key", "f1", "f2", "n", "bands"],
                )

    small_batches(df.sparkSession)
    return df.select("id", "key", "text").mapInArrow(run, _SIGNED)


def _pairs_of(reps: DataFrame, block: int) -> DataFrame:
    """(pair, side, id, weight): which classes each pair of blocks compares."""
    member = reps.select("id", "n", F.explode("bands").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    member = materialize(member.join(shared, "bucket"), "members")
    first = member.groupBy("id").agg(F.max(F.struct("many", "bucket")).alias("home"))
    first = first.select("id", F.col("home.bucket").alias("home"))
    crowd = first.groupBy("home").agg(F.count(F.lit(1)).alias("crowd"))
    first = materialize(first.join(crowd, "home"), "homes")
    # Each class moves to the most crowded home that it shares a bucket with.
    around = member.select("id", "bucket", "n").join(first, "id")
    best = around.groupBy("bucket").agg(F.max(F.struct("crowd", "home")).alias("best"))
    home = around.select("id", "bucket", "n").join(best, "bucket").groupBy("id").agg(
        F.max("best").alias("best"), F.max("n").alias("n")
    )
    home = materialize(home.select("id", "n", F.col("best.home").alias("home")), "moved")
    parts = home.groupBy("home").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / BLOCK_GRAMS)).alias("parts")
    )
    home = home.join(parts, "home").select(
        "id", F.xxhash64("home", F.pmod(F.xxhash64("id"), F.col("parts"))).alias("block")
    )
    home = materialize(home, "blocks")
    inside = member.select("id", "bucket").join(home, "id").select("bucket", "block").distinct()
    other = inside.select("bucket", F.col("block").alias("block2"))
    meet = inside.join(other, "bucket").where("block <= block2").select("block", "block2").distinct()
    meet = meet.withColumn("pair", F.xxhash64("block", "block2"))
    sides = meet.select("pair", "block", F.lit(0).alias("side")).unionByName(
        meet.where("block <> block2").select("pair", F.col("block2").alias("block"), F.lit(1).alias("side"))
    )
    return home.join(sides, "block").select("pair", "side", "id")


def links_between(grams: np.ndarray, at: np.ndarray, left: list[int], right: list[int], threshold: float) -> np.ndarray:
    """Which sets of ``left`` and ``right`` (sorted distinct n-grams at grams[at[k]:at[k+1]]) have a
    Jaccard similarity of at least ``threshold``."""
    sizes = np.diff(at)
    common = np.zeros((len(left), len(right)), np.float64)
    if len(left) * len(right) <= 16:
        for i, a in enumerate(left):
            for j, b in enumerate(right):
                x, y = grams[at[a] : at[a + 1]], grams[at[b] : at[b + 1]]
                if min(len(x), len(y)) >= threshold * max(len(x), len(y)) and len(y):
                    found = np.minimum(np.searchsorted(y, x), len(y) - 1)
                    common[i, j] = np.count_nonzero(y[found] == x)
    else:
        some = left if right is left else left + right
        take = np.concatenate([np.arange(at[k], at[k + 1]) for k in some])
        names, gram, seen = np.unique(grams[take], return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(some)), sizes[some])
        order = np.argsort(gram, kind="stable")
        order = order[seen[gram[order]] > 1]  # an n-gram of one set alone is common to no two
        row, gram = row[order], np.cumsum(np.diff(gram[order], prepend=-1) > 0) - 1
        step = max(256, (16 << 20) // (4 * len(some)))
        for first in range(0, int(gram[-1]) + 1 if len(gram) else 0, step):
            a, b = np.searchsorted(gram, [first, first + step])
            x = np.zeros((len(some), min(step, int(gram[-1]) + 1 - first)), np.float32)
            x[row[a:b], gram[a:b] - first] = 1
            common += x @ x.T if right is left else x[: len(left)] @ x[len(left) :].T
    union = sizes[left][:, None] + sizes[right][None, :] - common
    return (common >= threshold * union - 1e-9) & (common > 0)


def _least_reached(link: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id that each row and each column reaches by links of this matrix."""
    top = np.iinfo(np.int64).max
    rows, columns = left.copy(), right.copy()
    while True:
        new_rows = np.minimum(rows, np.where(link, columns[None, :], top).min(axis=1))
        new_columns = new_rows if same else np.minimum(columns, np.where(link, new_rows[:, None], top).min(axis=0))
        if (new_rows == rows).all() and (new_columns == columns).all():
            return rows, columns
        rows, columns = new_rows, new_columns


def _distinct_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    grams, at = ngram_hashes(split_words(texts), size)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    return grams[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(at) - 1))])


def _verified(batches: Iterator[pa.RecordBatch], size: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows (pair, side, id, weight, text) sorted by pair -> (id, links, least)."""

    def settle(table: pa.Table) -> pa.RecordBatch:
        keys = [table.column(k).to_numpy() for k in ("pair", "side", "id")]
        new = np.ones(table.num_rows, bool)  # copies of a row come in again
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        if not new.all():
            table = table.filter(pa.array(new))
        pair, side, ids, weight = (table.column(k).to_numpy() for k in ("pair", "side", "id", "weight"))
        grams, at = _distinct_sets(table.column("text").combine_chunks(), size)
        edges = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1], [True]]))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            rows = np.arange(a, b)
            left = rows[side[a:b] == 0].tolist()
            right = rows[side[a:b] == 1].tolist() if side[a:b].any() else left
            if not left or (right is left and len(left) < 2):
                continue
            link = links_between(grams, at, left, right, threshold)
            if right is left:
                np.fill_diagonal(link, False)
            if not link.any():
                continue
            x, y = np.array(left), np.array(right)
            near, far = _least_reached(link, ids[x], ids[y], right is left)
            for z, w, m, least in ((x, y, link, near), (y, x, link.T, far))[: 1 if right is left else 2]:
                some = np.flatnonzero(m.any(axis=1))
                out.append((ids[z][some], m[some] @ weight[w], least[some]))
        parts = [np.concatenate(c) if out else np.zeros(0, np.int64) for c in zip(*out)] or [np.zeros(0, np.int64)] * 3
        return pa.RecordBatch.from_arrays([pa.array(p.astype(np.int64)) for p in parts], ["id", "links", "least"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        for slab in slabs(batch, "text", GATHER_BYTES):
            held.append(slab)
            if sum(x.column("text").nbytes for x in held) < GATHER_BYTES:
                continue
            table = pa.Table.from_batches(held)
            pair = table.column("pair").to_numpy()
            end = int(np.flatnonzero(pair != pair[-1])[-1]) + 1 if (pair != pair[-1]).any() else 0
            if end:  # the last pair of blocks may go on
                yield settle(table.slice(0, end))
                held = table.slice(end).to_batches()
    if held:
        yield settle(pa.Table.from_batches(held))


def join(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    threshold: float = 0.8,
    recall: float = 0.99999,
    rows: int = 4,
    block: int = BLOCK,
) -> DataFrame:
    """One row per row of ``df``: id, class_id (smallest id of the texts with the same words),
    component_id (smallest id reachable by links), n_links (other documents linked directly) and key (a hash of the
    text, which tells rows of one id apart)."""
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    docs = docs.withColumn("key", F.xxhash64("text"))
    known = docs.where("id IS NOT NULL")
    signed = materialize(signatures(known, size, choose_bands(threshold, recall, rows), rows), "signatures")
    classes = signed.where("n > 0").groupBy("f1", "f2").agg(F.min(F.struct("id", "key")).alias("one"), F.count(F.lit(1)).alias("copies"))
    classes = classes.select("f1", "f2", F.col("one.id").alias("class_id"), F.col("one.key").alias("key"), "copies")
    # A class goes by its smallest id; where that id has several texts, its classes go by a hash of their words.
    classes = materialize(classes, "word-classes")
    shared = materialize(classes.groupBy("class_id").agg(F.count(F.lit(1)).alias("many")).where("many > 1"), "shared-ids")
    node = F.when(F.col("many").isNull(), F.col("class_id")).otherwise(F.xxhash64("f1", "f2", F.lit("class")))
    classes = materialize(classes.join(shared, "class_id", "left").withColumn("node", node).drop("many"), "classes")
    weights = classes.select(F.col("node").alias("id"), F.col("copies").alias("weight"), F.col("class_id").alias("doc"), "key")
    reps = signed.withColumnRenamed("id", "class_id").join(classes.select("class_id", "key", F.col("node").alias("id")), ["class_id", "key"])
    reps = reps.dropDuplicates(["id"])
    pairs = materialize(_pairs_of(reps, block).join(weights, "id"), "block-pairs")
    # The same plan at every size: without the hint small inputs would be broadcast.
    texts = known.withColumnRenamed("id", "doc").join(pairs.hint("merge"), ["doc", "key"]).select("pair", "side", "id", "weight", "text")
    dealt = texts.repartition("pair").sortWithinPartitions("pair", "side", "id")
    found = materialize(
        dealt.mapInArrow(lambda batches: _verified(batches, size, threshold), "id long, links long, least long"),
        "links",
    )
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    component = connected_components(found.select(F.col("id").alias("u"), F.col("least").alias("v")))
    if not shared.isEmpty():  # the least node of a component may then be a hash: the least id of its classes it is
        members = classes.select("node", "class_id").join(component, "node")
        least = members.groupBy("component").agg(F.min("class_id").alias("least"))
        component = materialize(members.join(least, "component").select("node", F.col("least").alias("component")), "components")
    of_class = (
        classes.join(links.withColumnRenamed("id", "node"), "node", "left")
        .join(component, "node", "left")
        .select(
            "f1",
            "f2",
            "class_id",
            "copies",
            F.coalesce("component", "class_id").alias("component_id"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    of_class = materialize(of_class, "class-links")
    return (
        join_spread(
            signed.select("id", "key", F.when(F.col("n") > 0, F.col("f1")).alias("f1"), "f2"), of_class, ["f1", "f2"], "copies", ["id", "key"], "left"
        )
        .select(
            F.col("id").alias(id_col),
            F.coalesce("class_id", "id").alias("class_id"),
            F.coalesce("component_id", "id").alias("component_id"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            "key",
        )
        .unionByName(
            docs.where("id IS NULL").select(
                F.col("id").alias(id_col),
                F.col("id").alias("class_id"),
                F.col("id").alias("component_id"),
                F.lit(0).cast("long").alias("n_links"),
                "key",
            )
        )
    )
