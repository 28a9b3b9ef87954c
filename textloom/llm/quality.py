"""Operator 8: quality scores by Bradley-Terry pairwise ranking.

Dense features of the whole text are extracted in one pass and kept in a table. Every labelled row that is
not held out is learned from, and every preference pair (a good text before a bad one): the logistic loss on
feature differences gives the weights of a document score. Its sums over pairs are taken over rows: what a row
is worth depends on its score and on how many scores of the other class lie where, so counts of scores on a
fine grid (``GRID`` to a unit, linear in between) stand for the other class, and a Newton step is two passes
over the labelled rows. The score quantile at the share of bad labels is the threshold (exact, by counts over
parts that narrow), and the scale maps it to ``CUT``, so that ``score >= CUT`` is the accepted side. The driver
gets sums of fixed size only.

Defined results: null and empty texts have zero features and a score like any other; ids and labels
are never features; labels other than 0 and 1, and null ids, are not learned from; where one of the
two labels is missing every score is 0.5; every row gives one row, repeated rows included; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import features
from textloom.llm.scratch import materialize

#: Labelled rows to learn from; None: all.
LABELLED = None
PAIRS = 60_000
CUT = 0.3
#: Scores are counted at this many places to a unit, up to REACH on both sides; a probability is then off by under 1e-4.
GRID, REACH = 16, 64
#: Sums for the curvature use fewer places. Parts into which a quantile's interval is cut. Sums in a row.
COARSE, PARTS, WIDE = 4, 1024, 64


def held_out(id_col: Column) -> Column:
    """Whether a row is kept from learning: the CRC-32 of its id as text is a multiple of five."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _newton(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], n: int, ridge: float, steps: int) -> np.ndarray:
    """Weights from the mean gradient and curvature of the log odds at given weights."""
    w = np.zeros(n)
    for _ in range(steps):
        gradient, curvature = sums(w)
        step = np.linalg.solve(curvature + ridge * np.eye(n), gradient - ridge * w)
        w += step * min(1.0, 3.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 5, ridge: float = 1e-3, steps: int = 25) -> np.ndarray:
    """Weights of rows in memory by drawn preference pairs; ``fit_all`` is the same over a table and all pairs."""
    rng = np.random.default_rng(seed)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    n = min(pairs, len(good) * len(bad) * 4)
    d = x[rng.choice(good, n)] - x[rng.choice(bad, n)]

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        return d.T @ (1 - p) / n, (d * (p * (1 - p))[:, None]).T @ d / n

    return _newton(sums, x.shape[1], ridge, steps)


def totals(table: DataFrame, function: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum over all rows of ``table`` (label, x) of function(expanded features, labels), a vector of ``size`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(False).astype(np.float64).reshape(batch.num_rows, -1)
                total += function(features.expand(x), batch.column("label").to_numpy(False))
        rows = np.zeros((-(-size // WIDE), WIDE))
        rows.ravel()[:size] = total
        some = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(column) for column in rows[some].T)], ["row", *names])

    names = [f"n{i}" for i in range(WIDE)]
    schema = "row long, " + ", ".join(f"{n} double" for n in names)
    found = table.select("label", "x").mapInArrow(run, schema).groupBy("row").agg(*[F.sum(n).alias(n) for n in names])
    out = np.zeros((-(-size // WIDE), WIDE))
    for row in found.collect():
        out[row["row"]] = row[1:]
    return out.ravel()[:size]


def _places(s: np.ndarray, grid: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of the grid under each score, and the share of the one above."""
    at = (np.clip(s, -REACH, REACH) + REACH) * grid
    low = np.minimum(at.astype(np.int64), 2 * REACH * grid - 1)
    return low, at - low


def fit_all(table: DataFrame, mean: np.ndarray, scale: np.ndarray, many: np.ndarray, ridge: float = 1e-3, steps: int = 25) -> np.ndarray:
    """Weights over all preference pairs of ``table``. ``many``: rows of label 0 and of label 1."""
    n, pairs = len(mean), float(many[0] * many[1])
    fine, coarse = 2 * REACH * GRID + 1, 2 * REACH * COARSE + 1
    odds = lambda grid: 1 / (1 + np.exp(-np.arange(-2 * REACH * grid, 2 * REACH * grid + 1) / grid))
    lost, steep = odds(GRID), odds(COARSE)
    curve, steep = lost * (1 - lost), steep * (1 - steep)
    # at each place, the sum over counted scores of a function of (place - score)
    over = lambda counts, kernel: np.convolve(kernel, counts, "full")[len(counts) - 1 : 2 * len(counts) - 1]

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def count(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            low, above = _places((x - mean) / scale @ w, GRID)
            cell = low + y * fine
            return np.bincount(cell, 1 - above, 2 * fine) + np.bincount(cell + 1, above, 2 * fine)

        bad, good = totals(table, count, 2 * fine).reshape(2, fine)
        # of a row of each label: the pairs that go against it, and their curvature
        against = np.stack([over(good, lost), over(bad, lost[::-1])]) / pairs
        bent = np.stack([over(good, curve), over(bad, curve)]) / pairs

        def move(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            z = (x - mean) / scale
            s = z @ w
            low, above = _places(s, GRID)
            value = lambda of: of[y, low] * (1 - above) + of[y, low + 1] * above
            gradient = (value(against) * (2 * y - 1)) @ z
            own = (z * value(bent)[:, None]).T @ z
            low, above = _places(s, COARSE)
            where = np.zeros((2 * coarse, n))
            np.add.at(where, low + y * coarse, z * (1 - above)[:, None])
            np.add.at(where, low + y * coarse + 1, z * above[:, None])
            return np.concatenate([gradient, own.ravel(), where.ravel()])

        found = totals(table, move, n + n * n + 2 * coarse * n)
        low, high = found[n + n * n :].reshape(2, coarse, n)
        met = np.stack([over(column, steep) for column in low.T], axis=1)
        cross = high.T @ met / pairs
        curvature = found[n : n + n * n].reshape(n, n) - cross - cross.T
        # the grids differ a little, so a direction without curvature may come out just below none
        size, axes = np.linalg.eigh((curvature + curvature.T) / 2)
        return found[:n], (axes * np.maximum(size, 0)) @ axes.T

    return np.round(_newton(sums, n, ridge, steps), 6)


def _ranked(values: DataFrame, rank: int) -> float:
    """The value ``s`` of a rank from 0: its interval is cut in parts and narrowed to the part that holds it."""
    low, high = values.agg(F.min("s"), F.max("s")).first()
    while low < high and (high - low) / PARTS > 0:
        part = F.floor(F.least((F.col("s") - low) * (PARTS / (high - low)), F.lit(PARTS - 1.0)))
        parts = values.where(F.col("s").between(low, high)).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("low"), F.max("s").alias("high"))
        for row in sorted(parts.collect(), key=lambda r: r["part"]):
            if rank < row["n"]:
                low, high = row["low"], row["high"]
                break
            rank -= row["n"]
    return low


def quantile(values: DataFrame, n: int, share: float) -> float:
    """The exact quantile of the ``n`` values ``s``, linear between two neighbours."""
    at = share * (n - 1)
    first = _ranked(values, int(at))
    return first if at == int(at) else first + (at - int(at)) * (_ranked(values, int(at) + 1) - first)


class Model:
    """Standardisation, weights, and the map from a document score to 0..1. Made of rows in memory; ``of`` makes it
    over a table."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        x = features.expand(x)
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        self.weights = fit((x - self.mean) / self.scale, y)
        s = self.rank(x)
        self.threshold = float(np.quantile(s, (y == 0).mean()))
        self._set_slope(np.quantile(np.abs(s - self.threshold), 0.5))

    @classmethod
    def of(cls, table: DataFrame) -> Model | None:
        """Over all rows of ``table`` (label, x); None where a label is missing. Sums are rounded where they enter, so
        that the order in which tasks end does not show."""
        model = cls.__new__(cls)
        n = 2 * len(features.NAMES)
        found = totals(table, lambda x, y: np.concatenate([[(y == 0).sum(), (y == 1).sum()], x.sum(axis=0)]), 2 + n)
        many = found[:2]
        if not many.all():
            return None
        model.mean = np.round(found[2:] / many.sum(), 9)
        mean = model.mean
        spread = totals(table, lambda x, y: ((x - mean) ** 2).sum(axis=0), n)
        model.scale = np.maximum(np.round(np.sqrt(spread / many.sum()), 9), 1e-6)
        model.weights = fit_all(table, model.mean, model.scale, many)
        scores = table.select(model.ranked(F.col("x")).alias("s"))
        rows = int(many.sum())
        model.threshold = quantile(scores, rows, many[0] / rows)
        model._set_slope(quantile(scores.select(F.abs(F.col("s") - model.threshold).alias("s")), rows, 0.5))
        return model

    def _set_slope(self, spread: float) -> None:
        self.slope = float(3.0 / max(spread, 1e-6))

    def rank(self, expanded: np.ndarray) -> np.ndarray:
        return (expanded - self.mean) / self.scale @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.rank(features.expand(x)) - self.threshold) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def ranked(self, x: Column) -> Column:
        """The document score as an expression on the feature array."""
        n = len(self.weights) // 2
        total = F.lit(0.0)
        for i, (w, m, s) in enumerate(zip(self.weights.tolist(), self.mean.tolist(), self.scale.tolist())):
            value = x[i % n].cast("double")
            total = total + (F.sqrt(F.greatest(value, F.lit(0.0))) if i >= n else value) * (w / s) - w * m / s
        return total

    def column(self, x: Column) -> Column:
        """The score of 0..1 as an expression on the feature array."""
        z = self.slope * (self.ranked(x) - self.threshold) + float(np.log(CUT / (1 - CUT)))
        return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(40.0)), F.lit(-40.0))))


def chosen(labels: DataFrame, id_col: str, label_col: str, limit: int | None = LABELLED) -> DataFrame:
    """(id, label) of the rows that are not held out, at most ``limit`` if that is given."""
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    known = known.where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id")))
    return known if limit is None else known.orderBy(F.xxhash64("id"), "id", "label").limit(limit)


def train(extracted: DataFrame, some: DataFrame) -> Model | None:
    """``extracted``: id, x; ``some``: id, label. None where a label is missing. Rows that share an id count as one (the
    least features) and are combined in each task before the join, so a repeated id is no large group."""
    each = extracted.where("id IS NOT NULL").groupBy("id").agg(F.min("x").alias("x"))
    return Model.of(materialize(each.join(some.distinct(), "id").select("label", "x"), "labelled"))


def _docs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))


def rank(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    limit: int | None = LABELLED,
) -> DataFrame:
    """One row per row of ``df``: id, held_out, score, predicted. Held-out labels are not learned."""
    extracted = materialize(features.extract(_docs(df, id_col, text_col)).drop("text"), "features")
    model = train(extracted, chosen(labels, id_col, label_col, limit))
    score = F.lit(0.5) if model is None else model.column(F.col("x"))
    return extracted.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= CUT).cast("int")
    )


def accepted(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    limit: int | None = LABELLED,
) -> DataFrame:
    """The rows of ``df`` whose score reaches the cut, scored where they lie: texts are not shuffled, so features are
    taken twice, for the fit and for the scores."""
    extracted = features.extract(_docs(df, id_col, text_col)).drop("text")
    model = train(extracted, chosen(labels, id_col, label_col, limit))
    if model is None:
        return df
    name = features.free_name(df, "__features")
    scored = features.extract(df, text_col, name)
    return scored.where(model.column(F.col(name)) >= CUT).drop(name)
