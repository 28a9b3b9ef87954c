"""The thin query of each operator over its whole table, and SQL twins where SQL can express them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe, exact_dedup, fill_in_middle, jaccard_join, line_dedup, mixing, pii, quality, quality_rules, retention, substring_dedup, token_counts, vector_join

#: End-of-document identifier, free in the rank file.
SEPARATOR = 50256
TOKENIZER = public_tokenizers.path("byte_bpe_50k.tiktoken")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in flat token files between separators."""
    return token_counts.count_documents(documents(spark, sf_dir), TOKENIZER, SEPARATOR)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain posteriors and fitted rates of all documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = mixing.rated(documents(spark, sf_dir), labels)
    posteriors = [F.col("p")[i].alias(f"p_{name}") for i, name in enumerate(mixing.DOMAINS)]
    return found.select("doc_id", F.col("tokens").alias("n_tokens"), *posteriors, "rate")


def encoded(docs: DataFrame) -> DataFrame:
    """Digests of the ids and of the bytes that they decode to."""
    return bpe.round_trip(docs.select("doc_id", "text"), TOKENIZER).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every text, as digests."""
    return encoded(documents(spark, sf_dir))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines left of every document when copies and lines one word apart from an earlier one go."""
    found = line_dedup.dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which row of equal texts stays."""
    found = exact_dedup.dedup(documents(spark, sf_dir))
    return found.withColumnRenamed("digest", "text_sha256")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of equal word sequences and their links of Jaccard similarity 0.8 on five words."""
    return jaccard_join.join(documents(spark, sf_dir), size=5, threshold=0.8).drop("key")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data: counts and digest of the base spans, and all spans. The four counts are of base spans, n_added
    of the others, n_spans of both."""
    found = pii.find(documents(spark, sf_dir))
    written = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [
        (F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.BASE_KINDS
    ]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_added"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from the labels that are not held out."""
    return quality.rank(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of passages of 50 words that a smaller doc_id holds, removed."""
    found = substring_dedup.repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op10_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.9 between all embeddings, and their components."""
    return vector_join.join(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text cut at two of its lines and put in another order, and put back."""
    made = fill_in_middle.transform(documents(spark, sf_dir))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        digest(F.col("output")).alias("output_sha256"),
        digest(fill_in_middle.restore(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


def op12_cohort_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retention cells as known before March 2024 and at the end; every third click, by a hash, is late."""
    clicks, clients = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("clicks", "clients"))
    hashed = retention.crc(F.col("click_id"))
    return retention.retention(clicks, clients, dt.datetime(2024, 3, 1), F.when(hashed % 3 == 0, hashed % 100))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every text, the base rule, and the verdict of all rules weighed by their fitted accuracies."""
    return quality_rules.judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_mixing": op2_mixing,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_line_dedup": op4_line_dedup,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_pii": op7_pii,
    "op8_quality": op8_quality,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_vector_join": op10_vector_join,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_cohort_retention": op12_cohort_retention,
    "op13_quality_rules": op13_quality_rules,
}

_WORDS = r"list_filter(string_split_regex(coalesce({0}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_BIT = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
#: CRC-32 of a whole number in decimal: the table of its 256 steps by rule, then a fold over the digits.
_CRC_STEPS = f"(SELECT list(list_reduce(range(8), lambda c, i: {_BIT}, x) ORDER BY x) AS steps FROM range(256) t(x))"
_CRC = """xor(list_reduce(list_transform(string_split({0}::VARCHAR, ''), lambda d: ascii(d)::BIGINT),
             lambda c, d: xor(c >> 8, steps[(xor(c, d) & 255) + 1]), 4294967295::BIGINT), 4294967295)"""

ORACLE: dict[str, str] = {
    "op11_fill_in_middle": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id::VARCHAR) AS h FROM documents),
        u AS (
            SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines,
                   list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS hs FROM t
        ),
        c AS (SELECT *, len(lines) AS n, hs[1] % (len(lines) + 1) AS a, hs[2] % (len(lines) + 1) AS b FROM u),
        p AS (
            SELECT doc_id, text, n, array_to_string(lines[1:least(a, b)], '') AS prefix,
                   array_to_string(lines[least(a, b) + 1:greatest(a, b)], '') AS middle, array_to_string(lines[greatest(a, b) + 1:], '') AS suffix,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
                        WHEN hs[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
            FROM c
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM p
    """,
    "op12_cohort_retention": rf"""
        WITH rows AS (SELECT DISTINCT * FROM clicks WHERE ts IS NOT NULL AND client_id IS NOT NULL),
        hashed AS (SELECT *, {_CRC.format('click_id')} AS h FROM rows, {_CRC_STEPS}),
        known AS (
            SELECT s.state, client_id, ts, kind, CAST(coalesce(floor(100 * value + 0.5), 0) AS BIGINT) AS cents
            FROM hashed, (VALUES (0), (1)) s(state)
            WHERE state = 1 OR arrived_at + to_days(CASE WHEN h % 3 = 0 THEN h % 100 ELSE 0 END::INTEGER) < TIMESTAMP '2024-03-01'
        ),
        starts AS (SELECT state, client_id, min(ts) AS start FROM known WHERE kind = 'purchase' GROUP BY ALL),
        placed AS (
            SELECT a.state, a.client_id, a.start, coalesce(c.city, '') AS segment,
                   CAST(floor(date_diff('day', DATE '1970-01-01', a.start::DATE) / 3) AS BIGINT) AS cohort
            FROM starts a LEFT JOIN clients c USING (client_id)
        ),
        moves AS (SELECT client_id, count(DISTINCT cohort) > 1 AS moved FROM placed GROUP BY client_id),
        sums AS (
            SELECT state, segment, cohort, (epoch_us(ts) - epoch_us(start)) // 259200000000 AS period, client_id, moved, sum(cents) AS cents
            FROM known JOIN placed USING (state, client_id) JOIN moves USING (client_id) WHERE ts >= start GROUP BY ALL
        )
        SELECT state, segment, cohort, period, count(*) AS users, CAST(sum({_CRC.format('client_id')}) AS BIGINT) AS users_crc32,
               count(*) FILTER (moved) AS moved, CAST(sum(cents) AS BIGINT) AS cents
        FROM sums, {_CRC_STEPS} GROUP BY state, segment, cohort, period
    """,
    "op5_exact_dedup": r"""
        WITH rows AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \t\n\v\f\r]+', ' ', 'g') AS norm FROM documents
        )
        SELECT doc_id,
               min(doc_id) OVER (PARTITION BY norm) AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept,
               sha256(norm) AS text_sha256
        FROM rows
    """,
    "op4_line_dedup": rf"""
        WITH l AS (
            SELECT doc_id, u.i AS line, {_WORDS.format('u.t')} AS w
            FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda t, i: {{'t': t, 'i': i - 1}})) AS u FROM documents)
        ), d AS (
            SELECT array_to_string(w, ' ') AS body, any_value(w) AS w, min((doc_id, line)) AS first FROM l WHERE len(w) > 0 GROUP BY body
        ), v AS (
            SELECT body, first, p, array_to_string(w[1:p - 1] || w[p + 1:], ' ') AS less, len(w) AS n
            FROM (SELECT *, unnest(range(1, len(w) + 1)) AS p FROM d WHERE len(w) >= {line_dedup.MIN_WORDS})
        ), least AS (SELECT less, p, n, min(first) AS other FROM v GROUP BY less, p, n),
        near AS (
            SELECT v.body FROM v JOIN least USING (less, p, n) WHERE other < v.first
            UNION SELECT d.body FROM d JOIN v ON v.less = d.body AND v.n = len(d.w) + 1 WHERE len(d.w) >= {line_dedup.MIN_WORDS} AND v.first < d.first
            UNION SELECT v.body FROM v JOIN d ON v.less = d.body AND v.n = len(d.w) + 1 WHERE len(d.w) >= {line_dedup.MIN_WORDS} AND d.first < v.first
        ), gone AS (
            SELECT doc_id, list(line) AS gone FROM l JOIN d ON d.body = array_to_string(l.w, ' ')
            WHERE len(l.w) > 0 AND ((doc_id, line) <> first OR d.body IN (SELECT body FROM near)) GROUP BY doc_id
        )
        SELECT doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_dropped,
               sha256(CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda t, i: NOT list_contains(gone, i - 1)), chr(10)) END) AS kept_sha256
        FROM documents LEFT JOIN gone USING (doc_id)
    """,
    "op6_ngram_jaccard": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
        g AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS gram FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
        SELECT w.doc_id, CASE WHEN len(w) = 0 THEN w.doc_id ELSE min(w.doc_id) OVER (PARTITION BY array_to_string(w, ' ')) END AS class_id,
               (SELECT min(b) FROM reach WHERE a = w.doc_id) AS component_id, (SELECT count(*) FROM link WHERE a = w.doc_id) AS n_links
        FROM w
    """,
    "op9_substring_dedup": rf"""
        WITH w AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
        k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w)),
        least AS (SELECT key, min(doc_id) AS least FROM k GROUP BY key),
        gone AS (SELECT doc_id, list(p) AS gone FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM k JOIN least USING (key) WHERE least < doc_id) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
               sha256(array_to_string(list_filter(w, lambda x, i: NOT coalesce(list_contains(gone, i), false)), ' ')) AS kept_sha256
        FROM w LEFT JOIN gone USING (doc_id)
    """,
    "op10_vector_join": """
        WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
        c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
        SELECT vec_id, (SELECT count(*) FROM link WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c
    """,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
