"""Operator 11: Elias-Fano lists, cuts against a plain version, hot texts, odd rows."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.llm import elias_fano, fill_in_middle, queries

LONG = "\n".join(f"ligne {i} é" for i in range(60_000))
ROWS = [
    (1, "one\ntwo\nthree"), (1, "one\ntwo\nthree"), (2, None), (3, ""), (4, "\n"), (5, "\n\n\n"), (6, "no line feed"),
    (7, "has <P> in it\nand more"), (8, "ends\n"), (9, "日本\n語\r\nテキスト"), (None, "no id\nat all"), (None, "no id\nat all"),
    (10, LONG), (11, LONG), (12, "a <S\n<\n>"), (13, "one\ntwo\nthree"), (-14, "minus\nfourteen\n𝒳𝒴"),
]


def plain(key, text, rate=100, spm=50, seed=7):
    text = text or ""
    hashed = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(hashed[8 * i : 8 * i + 8], 16) for i in range(4)]
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return key, len(lines), "plain", None, None, text
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    form = "spm" if h[3] % 100 < spm else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return key, len(lines), form, len(p), len(m), out


@given(st.lists(st.integers(0, 1 << 40), max_size=200))
def test_lists_give_back_their_elements(values):
    values = sorted(values)
    data = elias_fano.encode(np.array(values, np.int64))
    assert elias_fano.size(data) == len(values)
    assert elias_fano.select(data, np.arange(len(values))).tolist() == values
    with pytest.raises(IndexError):
        elias_fano.select(data, np.array([len(values)]))


def test_a_list_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 120, 10_000))
    assert len(elias_fano.encode(ends)) < 10_000 * 9 / 8 + 16


@pytest.mark.parametrize("least", [256, 1])
def test_cuts_meet_the_plain_version(spark, monkeypatch, least):
    monkeypatch.setattr(fill_in_middle, "LEAST", least)  # 1: every repeated text is hot
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("digest", "id", "n", "form", "rows", "salt", "place")})
    out = fill_in_middle.transform(df)
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = out.withColumn("back", fill_in_middle.restore(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted((plain(*r) for r in ROWS), key=repr)
    texts = {(k, t or "") for k, t in ROWS}
    assert all((r.doc_id, r.back) in texts for r in got)


def test_rates_and_seed(spark):
    df = spark.createDataFrame([(i, f"a\nb\nc {i}") for i in range(300)], "doc_id long, text string")
    got = fill_in_middle.transform(df, plan=fill_in_middle.Plan(rate=60, spm=20, seed=11)).collect()
    assert sorted(map(tuple, got)) == sorted(plain(i, f"a\nb\nc {i}", 60, 20, 11) for i in range(300))


def test_a_hot_text_is_spread(spark, monkeypatch):
    monkeypatch.setattr(fill_in_middle, "LEAST", 50)
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1000, "hot\ntext\n").otherwise(F.concat(F.lit("t\n"), "id")).alias("text"))
    rows = fill_in_middle.transform(df).collect()
    assert len(rows) == 3000 and all(tuple(r) == plain(r.doc_id, "hot\ntext\n" if r.doc_id < 1000 else f"t\n{r.doc_id}") for r in rows)


def test_no_rows(spark):
    assert fill_in_middle.transform(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_two_texts_of_one_digest_stop_the_job(spark):
    rows = spark.createDataFrame([(b"d", "one"), (b"d", "two")], "digest binary, text string")
    with pytest.raises(Exception, match="two texts share a digest"):
        fill_in_middle._index(rows.repartition(1)).collect()


def test_the_query_rebuilds_every_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = queries.op11_fill_in_middle(spark, "/root/testdata/sf0.001").join(docs, "doc_id").collect()
    assert len(rows) == docs.count() and all(r.restored_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest() for r in rows)
