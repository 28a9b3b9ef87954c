"""Odd tables for every operator: nulls, repeated rows, clashing names, very long texts, no rows."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textloom.llm import bpe, exact_dedup, features, jaccard_join, mixing, quality, queries, substring_dedup, token_counts

SMALL = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 5000}x{i // 5000}" for i in range(200_000))
ROWS = [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, ""), (4, " \t\n "), (None, "no id"), (None, "no id"), (5, LONG), (6, LONG + " end")]
#: Names that operators use for themselves.
CLASH = ["id", "norm", "digest", "salt", "n", "x", "chunk", "member", "rate", "keys", "line", "f1", "__hot", "__features", "keep_id", "class_id", "tokens"]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.withColumns({c: F.lit("clash") for c in CLASH})


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 0), (None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int")


def test_exact_dedup_on_odd_rows(spark, odd):
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup(odd).collect()), key=str)
    expected = [(1, 1, 2, True), (1, 1, 2, True), (2, 2, 2, True), (3, 2, 2, False), (4, 4, 1, True), (None, None, 2, False), (None, None, 2, False), (5, 5, 1, True), (6, 6, 1, True)]
    assert got == sorted(expected, key=str)
    kept = exact_dedup.keep(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 1, 2, 4, 5, 6]


def test_a_hot_group_is_spread(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 4000, "hot text").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    rows = exact_dedup.dedup(df).collect()
    assert len(rows) == 5000 and sum(r.kept for r in rows) == 1001 and {r.group_size for r in rows} == {4000, 1}


def test_jaccard_on_odd_rows(spark, odd):
    got = sorted(((r.doc_id, r.component_id, r.n_links) for r in jaccard_join.join(odd).collect()), key=str)
    expected = [(1, 1, 1), (1, 1, 1), (2, 2, 0), (3, 3, 0), (4, 4, 0), (None, None, 0), (None, None, 0), (5, 5, 1), (6, 5, 1)]
    assert got == sorted(expected, key=str)


def test_substring_dedup_on_odd_rows(spark, odd):
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.repeats(odd).collect()), key=str)
    expected = [(1, 6, 0), (1, 6, 0), (2, 0, 0), (3, 0, 0), (4, 0, 0), (None, 2, 0), (None, 2, 0), (5, 200_000, 0), (6, 200_001, 200_000)]
    assert got == sorted(expected, key=str)


def test_bpe_on_odd_rows(spark, odd):
    ids = bpe.encode(odd, queries.TOKENIZER)
    assert ids.columns == [*odd.columns, "ids"]
    rows = bpe.decode(ids, queries.TOKENIZER).select("doc_id", "text", "decoded").collect()
    assert len(rows) == len(ROWS) and all(bytes(r.decoded) == (r.text or "").encode() for r in rows)


def test_models_on_odd_rows(spark, odd):
    scored = quality.rank(odd, labels(spark)).collect()
    assert len(scored) == len(ROWS) and all(0 <= r.score <= 1 for r in scored)
    assert quality.accepted(odd, labels(spark)).columns == odd.columns
    rated = mixing.rated(odd, labels(spark)).collect()
    assert len(rated) == len(ROWS) and {r.doc_id: r.tokens for r in rated}[6] == 200_001
    assert mixing.resample(odd, labels(spark)).columns == odd.columns
    assert features.free_name(odd, "member") == "member_"


def test_token_counts_on_odd_rows(spark, odd):
    rows = token_counts.count_documents(odd.where("doc_id > 1"), queries.TOKENIZER, queries.SEPARATOR).collect()
    assert len(rows) == 5
    assert token_counts.count_documents(odd.limit(0), queries.TOKENIZER, queries.SEPARATOR).count() == 0


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_without_rows(spark, stage):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, SMALL)
    assert out.count() == 0 and (stage == "byte_bpe" or out.columns == docs.columns)


def test_stages_on_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in ROWS if i not in (5, 6)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[1:3]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
    kept = corpus_pipeline.near_duplicates(spark, docs, SMALL).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "3", "4", "None", "None"]
    digests = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.byte_bpe(spark, docs, SMALL).collect()}
    assert digests[2] == hashlib.sha256(b"").hexdigest() and re.fullmatch("[0-9a-f]{64}", digests[1])


def test_one_id_with_two_texts(spark):
    """Rows that share an id are documents of their own for links, components and the pipeline's stage."""
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (1, a), (4, "quite another text of more than five words")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = jaccard_join.join(docs).join(docs.select(F.xxhash64("text").alias("key"), "text").distinct(), "key")
    got = {(r.doc_id, r.text): (r.component_id, r.n_links) for r in found.collect()}
    assert got == {(1, a): (1, 2), (1, b): (1, 1), (2, a + " more"): (1, 2), (3, b + " more"): (1, 1), (4, rows[5][1]): (4, 0)}
    kept = corpus_pipeline.near_duplicates(spark, docs, SMALL).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(1, a), (1, b), rows[5]])


def test_a_smaller_id_reached_over_a_shared_one(spark):
    """A component takes its smallest id although the classes of a shared id go by hashes."""
    c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "cd")
    rows = [(7, c), (7, d), (9, c + " more"), (5, d + " more")]
    found = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"))
    texts = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.xxhash64("text").alias("key"), "text")
    got = {(r.doc_id, r.text): r.component_id for r in found.join(texts, ["doc_id", "key"]).collect()}
    assert got == {(7, c): 7, (9, c + " more"): 7, (7, d): 5, (5, d + " more"): 5}


def test_a_repeated_id_does_not_weigh_on_the_fits(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    known = spark.read.parquet(f"{SMALL}/labels.parquet")
    one = quality.chosen(known, "doc_id", "quality", quality.LABELLED)
    first = one.orderBy("id").first()["id"]
    text = docs.where(F.col("doc_id") == first).first()["text"]
    many = docs.unionByName(spark.range(30_000).select(F.lit(first).cast("long").alias("doc_id"), F.lit(text[:400]).alias("text")))
    ids = {r["id"]: 0 for r in one.collect()}
    assert features.one_each(many.withColumnRenamed("doc_id", "id"), ids).count() == len(ids)
    fits = []
    for table in (docs, docs.unionByName(docs.where(F.col("doc_id") == first))):
        extracted = features.extract(quality._docs(table, "doc_id", "text")).drop("text")
        fits.append(quality.train(extracted, one))
    assert (fits[0].weights == fits[1].weights).all() and fits[0].threshold == fits[1].threshold
    models = [mixing.fit_classifier(mixing._docs(t, "doc_id", "text"), mixing.domain_of(known)) for t in (docs, docs.union(docs))]
    assert (models[0].weights == models[1].weights).all() and (models[0].chosen == models[1].chosen).all()
