"""Operator 2: mixing to target weights by soft domain membership.

1. A classifier is fitted on at most ``LABELLED`` rows of the labelled table (a documented bound; the
   smallest hashes of the id). Domains are what the labels mark: toxic texts, texts of low quality, and
   the others. Its features are the dense ones and the presence of the ``CHOSEN`` most telling words.
2. Every document gets posteriors of the domains and its number of words as tokens.
3. Rates r >= 0 are fitted by projected gradient on |B'r - t|^2 / 2 + ``RIDGE`` |r - 1|^2 / 2, where B
   holds the expected domain tokens of the documents, t the targets, a domain's misfit is squared over its
   expected tokens (so that traces of a domain without documents of its own move no others), and the
   distance from 1 counts by tokens (so that rates do not depend on length). At its minimum a rate is 1
   plus the document's posteriors times one multiplier a domain, projected to its bounds; the steps go
   along the gradient in the multipliers, scaled by the Gram matrix of the documents that no bound holds.
   Each step is one distributed sum of a few numbers, so no rate ever leaves its row.

Every domain with expected tokens is in the fit: a target of 0 is a goal of 0, and a rare domain is raised
by rates above 1. Only domains without any tokens are left out, and the other targets scaled up; if no
domain with a target above 0 has tokens, rates stay 1.

Defined results: null and empty texts have 0 tokens, and posteriors and a rate like any text; labels with nulls or of unknown ids are not learned; with fewer than two domains among the labels all
posteriors are the shares of the labels; an empty table gives an empty result; repeated rows get the
same rate.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm import features
from textloom.llm.scratch import materialize

DOMAINS = ("clean", "low", "toxic")
TARGETS = {"clean": 0.90, "low": 0.04, "toxic": 0.06}
LABELLED = 8000
CHOSEN = 256
RIDGE = 1e-4
MAX_STEPS = 40
TOLERANCE = 1e-5


def domain_of(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, label): the place in DOMAINS of each labelled row."""
    kind = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 0)
    return labels.select(F.col(id_col).cast("long").alias("id"), kind.alias("label")).where("id IS NOT NULL AND label IS NOT NULL")


@dataclass
class Classifier:
    """Softmax regression on standardised features."""

    chosen: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # (features + 1) x domains
    prior: np.ndarray

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.repeat(self.prior[None, :], len(x), axis=0)
        z = (_widen(x) - self.mean) / self.scale
        s = np.concatenate([z, np.ones((len(z), 1))], axis=1) @ self.weights
        s = np.exp(s - s.max(axis=1, keepdims=True))
        return s / s.sum(axis=1, keepdims=True)


def _widen(x: np.ndarray) -> np.ndarray:
    n = len(features.NAMES)
    return np.concatenate([features.expand(x[:, :n]), x[:, n:]], axis=1)


def choose_words(counts: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """The word buckets whose presence tells most about the class (mutual information)."""
    total = sizes.sum()
    info = np.zeros(len(counts))
    for seen in (counts, sizes - counts):
        both = seen / total
        apart = both.sum(axis=1, keepdims=True) * (sizes / total)
        with np.errstate(divide="ignore", invalid="ignore"):
            info += np.nansum(np.where(both > 0, both * np.log(both / apart), 0), axis=1)
    info[counts.sum(axis=1) < 3] = 0
    best = np.argsort(-info, kind="stable")[:n]
    return np.sort(best[info[best] > 0])


def fit_classifier(docs: DataFrame, labels: DataFrame, limit: int = LABELLED, words: int = CHOSEN) -> Classifier:
    """``docs``: id, text; ``labels``: id, label."""
    some = labels.orderBy(F.xxhash64("id"), "id", "label").limit(limit).collect()
    known = {r["id"]: int(r["label"]) for r in some}
    k = len(DOMAINS)
    sizes = np.bincount(np.array(list(known.values()), np.int64), minlength=k).astype(float)
    prior = sizes / sizes.sum() if sizes.sum() else np.full(k, 1 / k)
    empty = np.zeros(0, np.int64)
    if (sizes > 0).sum() < 2:
        return Classifier(empty, np.zeros(0), np.zeros(0), np.zeros((0, k)), prior)
    own = features.one_each(docs, known)
    chosen = choose_words(features.presence(own, known, k), sizes, words)
    x, y = features.of_known(own, known, chosen)
    if not len(y) or y.min() == y.max():
        return Classifier(empty, np.zeros(0), np.zeros(0), np.zeros((0, k)), prior)
    x = _widen(x)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], axis=1)
    truth = np.eye(k)[y]
    w = np.zeros((z.shape[1], k))
    ahead, rate = w, 4.0 / np.linalg.eigvalsh(z.T @ z / len(z))[-1]
    for step in range(300):
        s = z @ ahead
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        new = ahead - rate * (z.T @ (p - truth) / len(z) + 1e-4 * ahead)
        ahead, w = new + step / (step + 3) * (new - w), new
    return Classifier(chosen, mean, scale, w, prior)


_MEMBER = T.StructType([T.StructField("tokens", T.LongType()), T.StructField("p", T.ArrayType(T.DoubleType()))])


def with_posteriors(df: DataFrame, model: Classifier, text_col: str = "text", name: str = "member") -> DataFrame:
    """``df`` with ``name``: (tokens, p), the number of words and the posteriors in the order of DOMAINS."""

    def member(words: np.ndarray, x: np.ndarray) -> pa.Array:
        p = features.lists(model.posteriors(x))
        return pa.StructArray.from_arrays([pa.array(words.astype(np.int64)), p], ["tokens", "p"])

    return features.apply(df, text_col, name, _MEMBER, member, model.chosen)


@dataclass
class Rates:
    """A fit: a document's rate is 1 plus its posteriors times the multipliers, projected to its bounds.
    ``converged`` tells whether the slope came under the tolerance, ``reached`` the expected tokens of each
    domain at these rates."""

    multipliers: list[float]
    anchor: int | None = None
    converged: bool = True
    reached: list[float] = field(default_factory=list)

    def free(self, p: Column) -> Column:
        rate = F.lit(1.0)
        for i, v in enumerate(self.multipliers):
            if v:
                rate = rate + p[i] * v
        return rate

    def bounds(self, p: Column) -> tuple[Column, Column]:
        return (F.lit(0.0), F.lit(float("inf"))) if self.anchor is None else (p[self.anchor], F.lit(1.0))

    def column(self, member: Column) -> Column:
        low, high = self.bounds(member["p"])
        return F.least(high, F.greatest(low, self.free(member["p"])))


def _sums(members: DataFrame, rates: Rates) -> tuple[np.ndarray, np.ndarray, float]:
    """Expected tokens of the domains at these rates, the Gram matrix of the documents whose rate is not at
    a bound, and the sum of the tokens times the integral of the projection: one pass over the members."""
    k = len(DOMAINS)
    p, z = F.col("p"), rates.free(F.col("p"))
    low, high = rates.bounds(p)
    rate = rates.column(F.struct("p"))
    inside = F.when((z > low) & (z < high), F.col("tokens")).otherwise(0)
    sums = [F.sum(rate * F.col("tokens") * p[i]) for i in range(k)]
    grams = [F.sum(inside * p[i] * p[j]) for i in range(k) for j in range(k)]
    area = F.sum(F.col("tokens") * (rate * z - rate * rate / 2))
    row = members.agg(*[c.alias(f"c{n}") for n, c in enumerate([*sums, *grams, area])]).first()
    values = np.array([v or 0.0 for v in row], float)
    return values[:k], values[k:-1].reshape(k, k), float(values[-1])


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """Pseudo-inverse that does not take a small domain for a dependent one."""
    scale = 1 / np.sqrt(np.maximum(np.diag(matrix), 1e-300))
    return np.linalg.pinv(matrix * np.outer(scale, scale), rcond=1e-10, hermitian=True) * np.outer(scale, scale)


def fit_rates(members: DataFrame, targets: dict[str, float], budget: float | None = None, whole: bool = False) -> Rates:
    """``members``: tokens, p. Expected tokens of domain k become targets[k] of the budget (default: all
    tokens). With ``whole`` the domain with the largest target sets the budget at its own tokens and stays;
    domains with more than their target shrink to it, scarcer ones stay as they are, short of it. Rates then
    lie between the posterior of that domain and 1, so no other domain takes its documents away."""
    k = len(DOMAINS)
    one = Rates([0.0] * k)
    p = F.col("p")
    products = [F.sum(F.col("tokens") * p[i] * p[j]) for i in range(k) for j in range(k)]
    first = members.agg(*[c.alias(f"c{n}") for n, c in enumerate([F.sum(F.col("tokens") * p[i]) for i in range(k)] + products)]).first()
    values = np.array([v or 0.0 for v in first], float)
    have, gram = values[:k], values[k:].reshape(k, k)
    weight = np.where(have > 0, np.array([targets[d] for d in DOMAINS]), 0)
    if weight.sum() <= 0:
        return one
    live = np.flatnonzero(have > 0)
    weight = weight / weight.sum()
    total = have.sum() if budget is None else budget
    anchor = None
    if whole:
        scale = np.sqrt(np.diag(gram)[live])
        if np.linalg.matrix_rank(gram[np.ix_(live, live)] / np.outer(scale, scale), tol=1e-9) < 2:
            return one  # the posteriors are all alike: no rates change the shares
        anchor = int(np.argmax(weight))
        total = float(have[anchor] / weight[anchor])
    goal = np.minimum(weight * total, have) if whole else weight * total

    def state(multipliers: np.ndarray) -> tuple[Rates, np.ndarray, np.ndarray, float]:
        rates = Rates(multipliers.tolist(), anchor)
        reached, inside, area = _sums(members, rates)
        rates.reached = reached.tolist()
        ridge = RIDGE * have * multipliers
        return rates, reached - goal + ridge, inside, area - goal @ multipliers + multipliers @ ridge / 2

    at, length, fresh = np.zeros(k), 1.0, True
    rates, slope, inside, value = state(at)
    for _ in range(MAX_STEPS):
        if np.abs(slope).max() <= TOLERANCE * goal.max():
            break
        if fresh:
            move = np.zeros(k)
            move[live] = -_inverse((inside + RIDGE * np.diag(have))[np.ix_(live, live)]) @ slope[live]
            length = 1.0
            if -(slope @ move) <= 1e-9 * have.sum():
                break
        tried = state(at + length * move)
        fresh = tried[3] <= value + 1e-4 * length * (slope @ move) + 1e-12 * abs(value)
        if fresh:
            at = at + length * move
            rates, slope, inside, value = tried
        else:
            length /= 4
    else:
        rates.converged = False
        warnings.warn(f"rates did not converge in {MAX_STEPS} steps: slope {np.abs(slope).max():.3g}", stacklevel=2)
    return rates


def fit(
    df: DataFrame,
    labels: DataFrame,
    targets: dict[str, float] = TARGETS,
    id_col: str = "doc_id",
    text_col: str = "text",
    budget: float | None = None,
    whole: bool = False,
    name: str = "member",
    keep: tuple[str, ...] | None = None,
) -> tuple[DataFrame, Rates]:
    """A table of the columns ``keep`` of ``df`` (default: all) and ``name``: (tokens, p), and the rates. Texts
    are read once for it; the fit reads its column ``name`` alone."""
    model = fit_classifier(_docs(df, id_col, text_col), domain_of(labels, id_col))
    scored = with_posteriors(df, model, text_col, name)
    if keep is not None:
        scored = scored.select(*[F.col(f"`{c}`") for c in keep], name)
    scored = materialize(scored, "members")
    return scored, fit_rates(scored.select(f"{name}.*"), targets, budget, whole)


def _docs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))


def rated(df: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, tokens, p, rate; texts are read once for the posteriors."""
    name = features.free_name(df, "member")
    scored, rates = fit(df, labels, targets, id_col, text_col, name=name, keep=(id_col,))
    own = F.col(f"`{id_col}`").cast("long").alias(id_col)
    return scored.select(own, f"{name}.tokens", f"{name}.p", rates.column(F.col(name)).alias("rate"))


def mix(
    df: DataFrame,
    labels: DataFrame,
    targets: dict[str, float] = TARGETS,
    id_col: str = "doc_id",
    text_col: str = "text",
    budget: float | None = None,
    whole: bool = False,
) -> tuple[DataFrame, Rates]:
    """``df`` with the columns member (tokens, p) and rate, and the fit. Columns of ``df`` stay as they are: where
    it has one of these names, the new one ends in an underscore."""
    member = features.free_name(df, "member")
    scored, rates = fit(df, labels, targets, id_col, text_col, budget, whole, member)
    return scored.withColumn(features.free_name(df, "rate"), rates.column(F.col(f"`{member}`"))), rates


def copies(rate: Column, key: Column) -> Column:
    """A whole number of copies with the rate as its mean, by a hash of the key; a rate within one
    hundredth of 1 or a greater whole number counts as it, small ones are drawn as they are."""
    near = F.when((F.round(rate) >= 1) & (F.abs(rate - F.round(rate)) <= 0.01), F.round(rate)).otherwise(rate)
    draw = F.pmod(F.xxhash64(F.lit("copies"), key), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(near + draw).cast("int")


def resample(
    df: DataFrame,
    labels: DataFrame,
    targets: dict[str, float] = TARGETS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows of ``df``, each as often as its rate says, with a budget that repeats no row and keeps
    the domain with the largest target (``fit_rates`` with ``whole``)."""
    member = features.free_name(df, "member")
    scored, rates = fit(df, labels, targets, id_col, text_col, whole=True, name=member)
    many = copies(rates.column(F.col(member)), F.col(f"`{id_col}`"))
    copy = features.free_name(df, "copy")
    repeated = scored.select(*[F.col(f"`{c}`") for c in df.columns], F.explode(F.array_repeat(F.lit(0), many)).alias(copy))
    return repeated.select(*[F.col(f"`{c}`") for c in df.columns])
