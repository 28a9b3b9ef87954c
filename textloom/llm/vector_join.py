"""Operator 10: near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors x, y have cosine >= t exactly when |x - y|^2 <= 2 (1 - t). The vectors are rotated by a
fixed random rotation and split into blocks; each block's share of that squared distance is in
proportion to its dimensions, so a linked pair is within its share in one block at least.

1. Equal vectors are one *class*; only its smallest id goes on.
2. Each block is joined by range: its first ``GRID`` rotated coordinates fall into cells twice the
   block's radius wide; a vector goes to its own cell and to the neighbouring cells (one of each
   opposite two) that the radius reaches. Cells with many vectors are dealt out to tiles.
3. Each tile finds the pairs within the block's share, verifies the cosine in double precision on the
   whole vectors and counts a pair in the first block whose share it meets, hence once. It returns per
   class the number of links and the smallest id reached, never the pairs.

Vectors of each length are joined apart, with a rotation and blocks of their own.

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing,
not even with copies; vectors of unequal length do not link; equal vectors count as links; rows that repeat
an id are rows of their own in n_links and share their component; rows with a null id link with nothing and
are not kept; an empty table gives an empty result; other columns are not read. Vectors are scaled by a power
of two first, which no cosine notices, so that no norm overflows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.components import connected_components
from textloom.llm.scratch import materialize, small_batches
from textloom.llm.skew import join_spread

BLOCK_DIMS = 8
GRID = 2
TILE = 8192
_SLACK = 1e-6


class Blocks:
    """A rotation and the blocks of the rotated coordinates."""

    def __init__(self, dims: int, threshold: float, block_dims: int, seed: int = 3):
        self.dims, self.threshold = dims, threshold
        q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
        self.rotation = q * np.sign(np.diag(r))
        edges = list(range(0, dims, block_dims)) + [dims]
        self.slices = [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]
        total = 2 * (1 - threshold)
        self.budget = np.array([total * (s.stop - s.start) / dims for s in self.slices])

    def rotated(self, x: np.ndarray) -> np.ndarray:
        return (x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]) @ self.rotation

    def cells(self, z: np.ndarray, block: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(rows, cell x and y, role): role 0 the own cell, 1 a neighbouring one within reach."""
        own = z[:, self.slices[block]][:, :GRID]
        if own.shape[1] < 2:
            own = np.concatenate([own, np.zeros((len(own), 2 - own.shape[1]))], axis=1)
        reach = np.sqrt(self.budget[block] * (1 + 4 * _SLACK)) + 1e-9
        width = 2 * reach
        cell = np.floor(own / width).astype(np.int64)
        inside = own - cell * width
        rows = np.arange(len(own))
        yield rows, cell, 0
        for dx, dy in ((0, 1), (1, -1), (1, 0), (1, 1)):
            near = np.ones(len(own), bool)
            for axis, step in enumerate((dx, dy)):
                if step == 1:
                    near &= width - inside[:, axis] <= reach
                elif step == -1:
                    near &= inside[:, axis] <= reach
            yield rows[near], cell[near] + (dx, dy), 1


def _array(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors as rows, each with its largest component between a half and one."""
    x = column.flatten().to_numpy(False).astype(np.float64).reshape(-1, dims)
    if not len(x):
        return x
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def _tiles(reps: DataFrame, blocks: Blocks, tile: int) -> DataFrame:
    """(tile, block, side, id, node): the vectors that each tile compares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, nodes = batch.column("id"), batch.column("node")
            z = blocks.rotated(_array(batch.column("vector"), blocks.dims))
            for b in range(len(blocks.slices)):
                for rows, cell, role in blocks.cells(z, b):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(rows), b, np.int32)),
                            pa.array(cell[:, 0].astype(np.int32)),
                            pa.array(cell[:, 1].astype(np.int32)),
                            pa.array(np.full(len(rows), role, np.int32)),
                            ids.take(pa.array(rows)),
                            nodes.take(pa.array(rows)),
                        ],
                        ["block", "cx", "cy", "role", "id", "node"],
                    )

    cell = ["block", "cx", "cy"]
    small_batches(reps.sparkSession)
    placed = materialize(
        reps.select("id", "node", "vector").mapInArrow(run, "block int, cx int, cy int, role int, id long, node long"), "cells"
    )
    sizes = placed.groupBy(*cell).agg(
        F.ceil(F.sum(F.when(F.col("role") == 0, 1).otherwise(0)) / tile).cast("int").alias("homes"),
        F.ceil(F.sum("role") / tile).cast("int").alias("guests"),
    )
    dealt = placed.join(sizes.where("homes > 0"), cell)
    parts = F.when(F.col("role") == 0, F.col("homes")).otherwise(F.col("guests"))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("id", "node"), parts).cast("int"))
    none = F.expr("cast(array() as array<int>)")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(none)
    # Tiles (i, j): home part i with home part j >= i, and (i, -1 - j): home part i with guest part j.
    pair = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    part = F.col("part")
    as_home = F.concat(
        F.transform(upto(F.col("homes") - part), lambda k: pair(part, part + k, 0)),
        F.transform(upto(part), lambda k: pair(k, part, 1)),
        F.transform(upto(F.col("guests")), lambda k: pair(part, -1 - k, 0)),
    )
    as_guest = F.transform(upto(F.col("homes")), lambda k: pair(k, -1 - part, 1))
    dealt = dealt.withColumn("pair", F.explode(F.when(F.col("role") == 0, as_home).otherwise(as_guest)))
    return dealt.select(F.xxhash64(*cell, "pair.i", "pair.j").alias("tile"), "block", "pair.side", "id", "node")


def _linked(
    blocks: Blocks, block: int, x: np.ndarray, y: np.ndarray | None
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i of x, j of y) that link and belong to this block; with y None pairs i < j of x."""
    zx = blocks.rotated(x)
    zy, other = (zx, x) if y is None else (blocks.rotated(y), y)
    own = blocks.slices[block]
    # |a - b|^2 <= limit as one product of widened vectors; single precision with slack, verified below.
    limit = blocks.budget[block] * (1 + 1e-4) + 1e-5
    a, b = zx[:, own], zy[:, own]
    half_a, half_b = np.einsum("ij,ij->i", a, a) / 2, np.einsum("ij,ij->i", b, b) / 2
    wide_a = np.column_stack([a, -half_a, np.ones(len(a))]).astype(np.float32)
    wide_b = np.ascontiguousarray(np.column_stack([b, np.ones(len(b)), -half_b]).astype(np.float32).T)
    norm_x = np.sqrt(np.einsum("ij,ij->i", x, x))
    norm_y = np.sqrt(np.einsum("ij,ij->i", other, other))
    step = max(1, (2 << 20) // max(len(b), 1))
    left, right = [], []
    for first in range(0, len(a), step):
        skip = first if y is None else 0  # the triangle only
        hit = np.flatnonzero((wide_a[first : first + step] @ wide_b[:, skip:]) >= np.float32(-limit / 2))
        i, j = np.divmod(hit, len(b) - skip)
        i, j = i + first, j + skip
        if y is None:
            i, j = i[j > i], j[j > i]
        for at in range(0, len(i), 65536):
            p, q = i[at : at + 65536], j[at : at + 65536]
            cosine = np.einsum("ij,ij->i", x[p], other[q]) / (norm_x[p] * norm_y[q])
            ok = cosine >= blocks.threshold
            p, q = p[ok], q[ok]
            square = (zx[p] - zy[q]) ** 2
            within = np.stack([square[:, s].sum(axis=1) for s in blocks.slices], axis=1) <= blocks.budget * (1 + _SLACK)
            mine = within.argmax(axis=1) == block
            left.append(p[mine])
            right.append(q[mine])
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def _least(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest id that each vector of a tile reaches by the tile's links."""
    label = ids.copy()
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        if (label == before).all():
            return label


def join(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.9,
    block_dims: int = BLOCK_DIMS,
    tile: int = TILE,
) -> DataFrame:
    """One row per row of ``df``: id, n_links (other vectors linked directly), component_id (smallest id
    reachable by links) and kept (whether the row is that one)."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("vector"))
    huge = F.lit(float("inf"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < huge))
    usable = F.coalesce(finite & F.exists("vector", lambda v: v != 0) & F.col("id").isNotNull(), F.lit(False))
    rows = rows.withColumn("usable", usable)
    # A vector alone in its length has nothing to link with.
    sizes = rows.where("usable").groupBy(F.size("vector").alias("n")).count().where("count > 1")
    lengths = sorted(r["n"] for r in sizes.collect())
    rows = rows.withColumn("usable", F.col("usable") & F.size("vector").isin(lengths))
    out = rows.where("NOT usable").select("id", F.col("id").alias("component"), F.lit(0).cast("long").alias("links"))
    for n in lengths:
        own = rows if len(lengths) == 1 else rows.where(F.size("vector") == n)
        out = _joined(own.where("usable"), Blocks(n, threshold, block_dims), tile).unionByName(out)
    return _result(out, id_col)


def _joined(rows: DataFrame, blocks: Blocks, tile: int) -> DataFrame:
    """(id, component, links) of usable vectors of one length."""
    # An id may stand for several vectors: a class is its smallest id and a hash of the vector.
    classes = rows.groupBy("vector").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    reps = materialize(classes.select("id", F.xxhash64("vector").alias("node"), "copies", "vector"), "vectors")
    dealt = _tiles(reps, blocks, tile).join(reps, ["id", "node"]).select("tile", "block", "side", "id", "node", "copies", "vector")
    dealt = dealt.repartition("tile").sortWithinPartitions("tile", "side", "id", "node")

    def settle(table: pa.Table) -> pa.RecordBatch:
        side, ids, nodes, copies = (table.column(k).to_numpy() for k in ("side", "id", "node", "copies"))
        x = _array(table.column("vector").combine_chunks(), blocks.dims)
        cut = int(np.searchsorted(side, 1))
        block = int(table.column("block")[0].as_py())
        i, j = _linked(blocks, block, x[:cut], x[cut:] if cut < len(x) else None)
        j = j + cut if cut < len(x) else j
        links = np.bincount(i, copies[j], len(x)) + np.bincount(j, copies[i], len(x))
        some = np.flatnonzero(links)
        least = _least(ids, i, j)
        return pa.RecordBatch.from_arrays(
            [pa.array(v[some]) for v in (ids, nodes, links.astype(np.int64), least)], ["id", "node", "links", "least"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            keys = batch.column("tile").to_numpy()
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                if a < b:
                    if held and held[0].column("tile")[0].as_py() != keys[a]:
                        yield settle(pa.Table.from_batches(held))
                        held = []
                    held.append(batch.slice(a, b - a))
        if held:
            yield settle(pa.Table.from_batches(held))

    found = materialize(dealt.mapInArrow(run, "id long, node long, links long, least long"), "vector-links")
    links = found.groupBy("id", "node").agg(F.sum("links").alias("links"))
    component = connected_components(found.select(F.col("id").alias("u"), F.col("least").alias("v")))
    component = component.withColumnRenamed("node", "id")
    of_class = (
        reps.join(links, ["id", "node"], "left")
        .join(component, "id", "left")
        .select(
            "vector",
            "copies",
            F.coalesce("component", "id").alias("component"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
        )
    )
    of_class = materialize(of_class, "vector-classes")
    return join_spread(rows.select("id", "vector"), of_class, ["vector"], "copies", ["id"]).select("id", "component", "links")


def _result(found: DataFrame, id_col: str) -> DataFrame:
    return found.select(
        F.col("id").alias(id_col),
        F.col("links").cast("long").alias("n_links"),
        F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"),
    )
