"""Segmentation, packing and restore on literal cases."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import segments as sg


def _est(text):
    return max(1, -(-sum(4 if ord(c) > 127 else 1 for c in text) // 4))


def _spans(text):
    out, at = [], 0
    for i, part in enumerate(re.split(r"((?:\r?\n)[ \t]*(?:\r?\n)+)", text)):
        begin, at = at, at + len(part)
        if i % 2 or not part.strip():
            continue
        core = part.strip()
        base = begin + len(part) - len(part.lstrip())
        if _est(core) <= 700:
            out.append((base, core))
            continue
        cuts = [0, *[m.start() for m in re.finditer(r"(?<=[。！？; .!?;])(?=\s|$)", core)], len(core)]
        for a, b in zip(cuts, cuts[1:]):
            while _est(core[a:b]) > 700:
                n = min(b, a + 1200)
                while a < n < b and not core[n - 1].isspace():
                    n -= 1
                n = n if n > a else min(b, a + 1200)
                out.append((base + a, core[a:n]))
                a = n
            if a < b:
                out.append((base + a, core[a:b]))
    return [s for s in out if s[1].strip()]


def _texts():
    rng = random.Random(4)
    words = ["alpha", "beta.", "γ", "漢字", "delta!", "e" * 30, "f;"]
    out = ["", "   ", "one", "a\n\nb", "a\r\n \r\n\r\nb  \n\n", "x" * 5000, "字" * 900, "no end " * 700]
    for _ in range(25):
        n = rng.randint(1, 900)
        out.append("".join(rng.choice(words) + rng.choice([" ", " ", "\n", "\n\n", "  "]) for _ in range(n)))
    return out


def test_spans_meet_a_python_twin(spark):
    texts = _texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.text) for s in r.spans] for r in sg.segment_documents(df).collect()}
    for i, text in enumerate(texts):
        assert got[i] == _spans(text), text[:60]


def test_restore_is_exact(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(_texts())] + [(99, None)], "doc_id long, text string")
    rows = sg.translate_documents(df).collect()
    assert all(r.round_trip for r in rows)
    failing = sg.translate_documents(df, lambda t: F.lit(" ")).collect()
    assert all(r.translated == 0 and r.fallback == r.n_segments for r in failing)
    texts = dict(df.collect())
    assert all(r.output_text == (texts[r.doc_id] or "") for r in failing)


@pytest.mark.parametrize("text", ["x" * 2_000_000, "Some words here. " * 120_000, "a b c\n\n" * 200_000], ids=["no space", "sentences", "lines"])
def test_a_long_text_takes_linear_time(spark, text):
    start = time.time()
    row = sg.translate_documents(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.round_trip and row.n_segments > 1000 and time.time() - start < 60


@pytest.mark.parametrize(
    ("tokens", "greedy", "bounded"),
    [
        ([400, 500, 100], [0, 1, 1], [0, 0, 1]),
        ([100, 900, 100], [0, 1, 2], [0, 1, 2]),
        ([300, 300, 300, 900, 100], [0, 0, 1, 2, 3], [0, 0, 1, 2, 3]),
        ([], [], []),
    ],
)
def test_packers(spark, tokens, greedy, bounded):
    df = spark.createDataFrame([(tokens,)], "t array<bigint>")
    row = df.select(sg.pack_greedy(F.col("t")).alias("g"), sg.pack_min_max(F.col("t")).alias("b")).first()
    assert (row.g, row.b) == (greedy, bounded)


def test_bounds_are_checked():
    with pytest.raises(ValueError):
        sg.pack_min_max(F.lit(None), 0, 10)


@pytest.mark.parametrize(("text", "n"), [("Hello, world!", 4), ("", 0), ("naïve café", 2)])
def test_word_counter(spark, text, n):
    assert spark.range(1).select(tx.tokens_words(F.lit(text)).alias("n")).first().n == n
