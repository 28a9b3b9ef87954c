"""Long lines, hot lines, clashing names and odd ids of line deduplication."""

import random

from textloom.llm import line_dedup


def _rows(spark, docs, schema="doc_id long, text string"):
    return {r[0]: r for r in line_dedup.dedup(spark.createDataFrame(docs, schema)).collect()}


def test_lines_around_the_bound_of_long_ones(spark):
    rng = random.Random(4)
    docs, expected, number = [], {}, 0
    for n in (2 * line_dedup.LONG - 2, 2 * line_dedup.LONG - 1, 2 * line_dedup.LONG, 2 * line_dedup.LONG + 1, 2 * line_dedup.LONG + 2, 2 * line_dedup.LONG + 3):
        words = [f"w{rng.randrange(10**9)}" for _ in range(n)]
        replaced, shorter, far = list(words), list(words), list(words)
        replaced[rng.randrange(n)] = "other"
        del shorter[rng.randrange(n)]
        far[3], far[-3] = "one", "two"
        for kind, gone in ((words, 0), (replaced, 1), (shorter, 1), (far, 0)):
            docs.append((number, " ".join(kind)))
            expected[number] = gone
            number += 1
    got = _rows(spark, docs)
    assert {k: r.n_dropped for k, r in got.items()} == expected


def test_a_line_of_a_hundred_thousand_words(spark):
    words = [f"w{i}" for i in range(100_000)]
    docs = [(1, " ".join(words)), (2, " ".join(words[:70_000] + ["x"] + words[70_000:])), (3, " ".join(["y"] + words[1:-1] + ["z"]))]
    got = _rows(spark, docs)
    assert {k: r.n_dropped for k, r in got.items()} == {1: 0, 2: 1, 3: 0}


def test_a_text_of_many_lines_loses_them_all(spark):
    lines = [f"line {i} of a long text" for i in range(20_000)]
    docs = [(1, "\n".join(lines)), (2, "\n".join([*lines, "and its own last words"]))]
    got = _rows(spark, docs)
    # All lines of the first text but the earliest are one word from it.
    assert (got[1].n_lines, got[1].n_dropped) == (20_000, 19_999)
    assert (got[2].n_dropped, got[2].text) == (20_000, "and its own last words")


def test_odd_ids_and_clashing_names(spark):
    line = "one two three four five six"
    docs = [(1, line, 7, "a"), (1, line + "\nand more words in here too", 8, "b"), (None, line, 9, "c"), (2, None, 1, "d"), (3, "", 2, "e"), (4, line, 3, "f")]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_dropped long, gone string")
    rows = line_dedup.dedup(df).collect()
    assert df.columns == ["doc_id", "text", "n_dropped", "gone"]
    assert [c for c in line_dedup.dedup(df).columns] == ["doc_id", "text", "gone", "n_lines", "n_dropped"]
    found = {(r.doc_id, r.gone): (r.text, r.n_dropped) for r in rows}
    assert found[(None, "c")] == (line, 0)
    assert found[(2, "d")] == (None, 0)
    assert found[(3, "e")] == ("", 0)
    assert found[(4, "f")] == ("", 1)
    assert found[(1, "a")] == (line, 0)


def test_bound_of_words_is_a_parameter(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a b d"), (3, "x"), (4, "y")], "doc_id long, text string")
    assert {r.doc_id: r.n_dropped for r in line_dedup.dedup(df).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    assert {r.doc_id: r.n_dropped for r in line_dedup.dedup(df, min_words=3).collect()} == {1: 0, 2: 1, 3: 0, 4: 0}
    assert {r.doc_id: r.n_dropped for r in line_dedup.dedup(df, min_words=1).collect()} == {1: 0, 2: 1, 3: 0, 4: 1}
