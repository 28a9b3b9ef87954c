"""Operator 13: counts against a plain version, the fit against one over single texts, verdicts against labels."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import quality_rules as rules

LONG = " ".join(f"w{i % 50_000}" for i in range(100_004))
ODD = [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, ""), (4, " \t\n \x0b"), (None, "no id " * 9), (5, LONG), (6, "#*$%&|<> x\n x\n x\n\n x"), (7, "a a a a a a a a a a a a")]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    seen, copies = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            copies += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), copies, len(covered), failed


def counted(row):
    return row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, row.base_failed


def test_counts_of_odd_texts(spark):
    clash = ("keep", "words", "lines", "windows", "placed", "text_", "n_words", "votes")
    df = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({c: F.lit("clash") for c in clash})
    got = sorted(((r.doc_id, *counted(r)) for r in rules.judge(df).collect()), key=repr)
    assert got == sorted(((i, *plain(t)) for i, t in ODD), key=repr)
    kept = rules.accepted(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} <= {5, None}


def test_counts_of_random_texts(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(["a", "b", "é", "日", "#", "|", " ", " ", "\n", "\r\n", "\t", "\x0c", " "]) for _ in range(rng.randrange(120)))) for i in range(400)]
    for r in rules.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert counted(r) == plain(rows[r.doc_id][1]), rows[r.doc_id]


def test_counts_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = rules.judge(docs).join(docs, "doc_id").collect()
    assert len(rows) == docs.count() and all(counted(r) == plain(r.text) for r in rows)


def test_fit_over_patterns_is_the_fit_over_texts():
    rng = np.random.default_rng(5)
    votes = rng.choice([-1, 0, 1], (500, 4), p=[0.2, 0.1, 0.7])
    some, n = np.unique(votes, axis=0, return_counts=True)
    a, b = rules.fit(some, n.astype(float)), rules.fit(votes, np.ones(len(votes)))
    assert a.good == pytest.approx(b.good) and np.allclose(a.low_on_low, b.low_on_low) and np.allclose(a.low_on_good, b.low_on_good)


def test_fit_finds_the_rules_that_are_right():
    rng = np.random.default_rng(6)
    low = rng.random(20_000) < 0.1
    chance = np.where(low[:, None], [0.9, 0.8, 0.7], [0.01, 0.005, 0.015])
    votes = np.where(rng.random((20_000, 3)) < 0.3, -1, 1 - (rng.random((20_000, 3)) < chance))
    model = rules.fit(votes, np.ones(len(votes)))
    assert model.good == pytest.approx(0.9, abs=0.02) and np.allclose(model.low_on_low, [0.9, 0.8, 0.7], atol=0.08)
    said = (votes >= 0).any(axis=1)
    assert ((model.posterior(votes) < 0.5) == low)[said].mean() > 0.97


def test_the_expression_is_the_posterior(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = rules.judge(df).collect()
    some = rules.counts(df, F.col("doc_id"))
    model = rules.fit(*rules.patterns(some))
    for r in rows:
        votes = np.array([[r.votes.get(name, -1) for name in rules.RULES]])
        assert r.posterior == pytest.approx(model.posterior(votes)[0])


def test_verdicts_against_labels(spark):
    """No label is ever read: rules alone drop most of the low documents and next to no clean one."""
    path = "/root/testdata/sf0.01/{}.parquet"
    rows = rules.judge(spark.read.parquet(path.format("documents"))).join(spark.read.parquet(path.format("labels")), "doc_id").collect()
    low = [r.kept for r in rows if r.quality == 0]
    good = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    assert np.mean(low) < 0.1 and np.mean(good) > 0.99


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert rules.judge(df).count() == 0 and rules.accepted(df).count() == 0
