"""Operator 13: quality rules combined by weak supervision (DataFrame functions only).

1. Counts of each whole text in one narrow pass, kept as a table of a few numbers a row.
2. Rules vote 0 (low) or 1 (good) on these counts, or abstain (null) where they cannot tell.
3. Expectation-maximisation over the votes: a text is good with a prior chance, and each rule calls a low text
   low with one chance and a good text low with another, whatever the other rules say; abstaining tells nothing.
   Votes enter only as numbers of texts with the same votes, so the distributed part is one grouping, exact over
   all rows, with at most 3 ** len(RULES) groups (59,049), which go to the driver; their number depends on the
   rules alone. Texts that fail the base rule need no verdict and are not learned from. No rule may call more than
   ``FALSE_LOW`` of the good texts low.
4. The posterior chance of being good is a sum of log odds over the votes; texts under ``CUT`` go. This stands in
   place of a filter that asks for every rule to pass; ``base_failed`` is the only hard rule.

Repeated windows: the five words of a window are compared as a 64-bit hash inside one text (a text of a million
words has a false repeat with a chance of about 3e-8).

Defined results: words are ``[^\\x20\\x09-\\x0D]+``; null and empty texts have 0 in every count and fail the base
rule; a text on which every rule abstains has the prior; rows that repeat count as often as they stand there; null
ids stay; an empty table gives an empty result; other columns of the table (of any name) are left out.
"""

from __future__ import annotations

import functools
import itertools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.scratch import materialize

WINDOW = 5
CUT = 0.5
#: At most this part of the good texts gets a low vote of one rule: what makes it a rule. Without it a trait that a
#: twentieth of all texts has, apart from other traits, would count as a habit of good ones.
FALSE_LOW = 0.02
#: No rate comes nearer to 0 or 1 than this.
LEAST = 1e-4
TOLERANCE = 1e-8
_BLANKS = ("\t", "\n", "\x0b", "\x0c", "\r")
_SYMBOLS = "#*$%&|<>"


def _without(text: Column, chars: str | tuple[str, ...], instead: str = "") -> Column:
    for char in chars:
        text = F.replace(text, F.lit(char), F.lit(instead))
    return text


def _joined(a: Column, b: Column, shift: int) -> Column:
    """Hashes of a's elements with those of b that stand ``shift`` places further."""
    return F.zip_with(a, F.slice(b, shift + 1, F.greatest(F.size(b) - shift, F.lit(0))), lambda x, y: F.xxhash64(x, y))


def _ended(line: Column) -> Column:
    bare = F.rtrim(line, F.lit(" \t\r\"')»”"))
    return functools.reduce(lambda a, b: a | b, [F.endswith(bare, F.lit(mark)) for mark in ".!?:;。！？…"])


def counts(df: DataFrame, keep: Column, text_col: str = "text") -> DataFrame:
    """Per row of ``df``: ``keep``, and the counts that the rules use, all long."""
    rows = df.select(keep.alias("keep"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("spaced", _without(F.col("text"), _BLANKS, " "))
    rows = rows.withColumns(
        {
            "words": F.array_remove(F.split("spaced", " "), ""),
            "lines": F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(" \t\x0b\x0c\r")) != ""),
        }
    )
    # the hash of five words from those of fewer; reading an array's elements by place, or slice(), costs far more
    rows = rows.withColumn("one", F.transform("words", lambda word: F.xxhash64(word)))
    rows = rows.withColumn("two", _joined(F.col("one"), F.col("one"), 1))
    rows = rows.withColumn("four", _joined(F.col("two"), F.col("two"), 2))
    many = F.size("words") >= WINDOW
    five = F.slice(_joined(F.col("four"), F.col("one"), 4), 1, F.greatest(F.size("words") - (WINDOW - 1), F.lit(0)))
    rows = rows.withColumn("windows", F.when(many, five).otherwise(F.expr("cast(array() as array<bigint>)")))
    # texts without any repeat, nearly all, need no sorting
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    some = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.withColumn("placed", F.when(some, placed))
    near = lambda e, i: F.coalesce(F.get("placed", i)["h"] == e["h"], F.lit(False))
    twice = F.transform("placed", lambda e, k: F.when(near(e, k - 1) | near(e, k + 1), e["i"]))
    rows = rows.withColumn("places", F.sort_array(F.array_compact(twice)))
    steps = F.transform("places", lambda p, k: F.least(F.coalesce(F.get("places", k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
    covered = F.coalesce(F.aggregate(steps, F.lit(0), lambda a, b: a + b), F.lit(0))
    length = F.length("text")
    of = {
        "n_words": F.size("words"),
        "word_chars": F.length(_without(F.col("spaced"), " ")),
        "n_symbols": length - F.length(_without(F.col("text"), _SYMBOLS)),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": covered,
        "n_lines": F.size("lines"),
        "n_ended": F.size(F.filter("lines", _ended)),
        "n_calls": length - F.length(_without(F.col("text"), "!")),
        "n_numbers": F.regexp_count("text", F.lit("[0-9]+")),
        "n_shouts": F.regexp_count("text", F.lit(r"\p{Lu}{2,}")),
        "n_distinct": F.size(F.array_distinct("words")),
    }
    return rows.select("keep", *[v.cast("long").alias(k) for k, v in of.items()])


RULES = ("length", "word_length", "symbols", "copied_lines", "repeated_words", "shouting", "calls", "digits", "vocabulary", "endings")


def _rule(low: Column, good: Column) -> Column:
    """A vote: low, else good, else none."""
    return F.when(low, 0).when(good, 1)


def rules() -> dict[str, Column]:
    """The votes of each rule on a row of ``counts``; a ratio over 0 abstains."""
    c = F.col
    share = lambda a, b: c(a).cast("double") / F.nullif(c(b), F.lit(0))
    wide, symbols, copied = share("word_chars", "n_words"), share("n_symbols", "n_words"), share("n_dup_lines", "n_lines")
    again, shouts, calls = share("n_repeat_words", "n_words"), share("n_shouts", "n_words"), share("n_calls", "n_words")
    digits, own, ended = share("n_numbers", "n_words"), share("n_distinct", "n_words"), share("n_ended", "n_lines")
    votes = {
        "length": _rule(c("n_words") < 10, c("n_words") >= 50),
        "word_length": _rule((wide < 2.5) | (wide > 12), (wide >= 3.5) & (wide <= 9)),
        "symbols": _rule(symbols > 0.1, symbols < 0.02),
        "copied_lines": _rule((copied > 0.3) & (c("n_lines") > 3), copied < 0.1),
        "repeated_words": _rule(again > 0.15, again < 0.05),
        "shouting": _rule((shouts > 0.3) & (c("n_words") >= 10), shouts < 0.1),
        "calls": _rule(calls > 0.2, calls < 0.05),
        "digits": _rule(digits > 0.5, digits < 0.15),
        "vocabulary": _rule((own < 0.25) & (c("n_words") >= 20) & (c("n_words") < 1000), own > 0.45),
        "endings": _rule((ended < 0.1) & (c("n_lines") > 3), ended > 0.6),
    }
    return {name: votes[name] for name in RULES}



@dataclass
class Votes:
    """A fitted model: the prior chance of a good text, and per rule the chances of a low vote on a low and on a
    good text."""

    good: float
    low_on_low: np.ndarray
    low_on_good: np.ndarray
    steps: int = 0

    def odds(self) -> tuple[float, np.ndarray]:
        """Log odds of a good text: the prior's, and what each rule's votes 0 and 1 add."""
        a, b = self.low_on_low, self.low_on_good
        return float(np.log(self.good / (1 - self.good))), np.stack([np.log(b / a), np.log((1 - b) / (1 - a))], axis=1)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Chance of a good text for rows of votes (0, 1, and -1 for none)."""
        prior, gain = self.odds()
        z = prior + sum((np.where(votes[:, j] < 0, 0, gain[j, np.maximum(votes[:, j], 0)]) for j in range(votes.shape[1])), np.zeros(len(votes)))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def column(self, votes: dict[str, Column]) -> Column:
        """The same chance as an expression."""
        prior, gain = self.odds()
        total = F.lit(prior)
        for vote, (low, good) in zip(votes.values(), gain.tolist()):
            total = total + F.when(vote == 0, low).when(vote == 1, good).otherwise(0.0)
        return 1 / (1 + F.exp(-F.greatest(F.least(total, F.lit(40.0)), F.lit(-40.0))))


def fit(votes: np.ndarray, n: np.ndarray) -> Votes:
    """Expectation-maximisation over patterns of votes, each of ``n`` texts. It starts from texts with a low vote
    as low ones, and ends when no rate moves by more than TOLERANCE."""
    said, low = votes >= 0, votes == 0
    q = np.where(low.any(axis=1), 0.1, 0.98)
    model = Votes(0.5, np.full(votes.shape[1], 0.5), np.full(votes.shape[1], FALSE_LOW))
    for step in itertools.count(1):
        g, b = n * q, n * (1 - q)
        new = Votes(
            float((g.sum() + 1) / (n.sum() + 2)),
            np.clip((b @ low + 1) / (b @ said + 2), FALSE_LOW, 1 - FALSE_LOW),
            np.clip((g @ low + LEAST) / (g @ said + 1), LEAST, FALSE_LOW),
            step,
        )
        moved = max(abs(new.good - model.good), np.abs(new.low_on_low - model.low_on_low).max(), np.abs(new.low_on_good - model.low_on_good).max())
        model, q = new, new.posterior(votes)
        if moved <= TOLERANCE:
            break
    return model


def _failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _fenced(counted: DataFrame) -> DataFrame:
    """The same rows behind a generator: a filter on the counts would else move below the steps that make them, and
    make them again for every element of an array."""
    names = [c for c in counted.columns if c != "keep"]
    return counted.select("keep", F.inline(F.array(F.struct(*names))))


def patterns(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Distinct votes (-1: none) of the texts that pass the base rule, and the number of texts with each."""
    code = F.lit(0)
    for vote in rules().values():
        code = code * 3 + F.coalesce(vote + 1, F.lit(0))
    found = _fenced(counted).where(~_failed()).groupBy(code.cast("long").alias("code")).agg(F.count(F.lit(1)).alias("n")).orderBy("code").collect()
    codes = np.array([r["code"] for r in found], np.int64)
    votes = codes[:, None] // 3 ** np.arange(len(RULES) - 1, -1, -1) % 3 - 1
    return votes, np.array([r["n"] for r in found], np.float64)


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """One row per row of ``df``: id, the counts, base_failed, posterior (chance of being good), kept, and the
    votes as a map of those that are given."""
    counted = materialize(counts(df, F.col(f"`{id_col}`"), text_col), "rule-counts")
    votes, model = rules(), fit(*patterns(counted))
    given = F.map_filter(F.create_map(*[x for k, v in votes.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    chance = model.column(votes)
    return counted.select(
        F.col("keep").alias(id_col),
        *[c for c in counted.columns if c != "keep"],
        _failed().alias("base_failed"),
        chance.alias("posterior"),
        (~_failed() & (chance >= cut)).alias("kept"),
        given.alias("votes"),
    )


def accepted(df: DataFrame, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of ``df`` that are kept, judged where they lie: texts are read twice and never shuffled."""
    model = fit(*patterns(counts(df, F.lit(0), text_col)))
    judged = _fenced(counts(df, F.struct("*"), text_col))
    return judged.where(~_failed() & (model.column(rules()) >= cut)).select("keep.*")
