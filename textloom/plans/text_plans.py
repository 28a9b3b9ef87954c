"""Queries over documents: segments, tokens, batches, names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import segments as sg


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")


# Segments by recursion: parts, sentences, then cuts of sentences that are too long.



def _est(x: str) -> str:
    wide = f"length(regexp_replace({x}, '[\\x00-\\x7F]', '', 'g'))"
    return f"CAST(greatest(1, ceil({wide} + (length({x}) - {wide}) * 0.25)) AS BIGINT)"


SEGMENTS = rf"""
    WITH RECURSIVE parts AS (
        SELECT doc_id, p.o AS part, regexp_replace(p.t, '^\s+|\s+$', '', 'g') AS core
        FROM (SELECT doc_id, unnest(list_transform(string_split_regex(coalesce(text, ''), '(?:\r?\n)[ \t]*(?:\r?\n)+'),
                                    lambda t, i: {{'t': t, 'o': i}})) AS p FROM documents)
    ), sentences AS (
        SELECT doc_id, part, s.o AS sent, s.t AS body
        FROM (SELECT doc_id, part, unnest(list_transform(
                CASE WHEN {_est('core')} <= 700 THEN [core]
                     ELSE string_split(regexp_replace(regexp_replace(core, '([。！？; .!?;])(\s)', '\1' || chr(1) || '\2', 'g'),
                                                      '([。！？; .!?;])(\s)', '\1' || chr(1) || '\2', 'g'), chr(1)) END,
                lambda t, i: {{'t': t, 'o': i}})) AS s FROM parts WHERE core <> '')
    ), cuts AS (
        SELECT doc_id, part, sent, 0 AS k, CAST(NULL AS VARCHAR) AS piece, body AS rest FROM sentences
        UNION ALL
        SELECT doc_id, part, sent, k + 1, substr(rest, 1, n), substr(rest, n + 1)
        FROM (SELECT *, CASE WHEN {_est('rest')} <= 700 OR length(rest) <= 1200 THEN length(rest)
                             WHEN regexp_matches(substr(rest, 1, 1200), '\s')
                             THEN length(regexp_extract(substr(rest, 1, 1200), '(?s)^.*\s'))
                             ELSE 1200 END AS n FROM cuts WHERE rest <> '')
    ), segments AS (
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part, sent, k) - 1 AS seg_order, piece,
               {_est('piece')} AS tokens
        FROM cuts WHERE piece IS NOT NULL AND regexp_matches(piece, '\S')
    ), packed AS (
        SELECT doc_id, seg_order, tokens, 0 AS batch_id, tokens AS total FROM segments WHERE seg_order = 0
        UNION ALL
        SELECT s.doc_id, s.seg_order, s.tokens,
               CASE WHEN p.total + s.tokens > 800 THEN p.batch_id + 1 ELSE p.batch_id END,
               CASE WHEN p.total + s.tokens > 800 THEN s.tokens ELSE p.total + s.tokens END
        FROM packed p JOIN segments s ON s.doc_id = p.doc_id AND s.seg_order = p.seg_order + 1
    )
"""


def pipeline_job_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """O-20 to O-22, O-50, O-59, O-70, O-88 to O-90 over all documents."""
    return sg.translate_documents(_docs(spark, sf)).withColumn("output_chars", F.length("output_text").cast("long")).drop("output_text")


def seg_txt(spark: SparkSession, sf: str) -> DataFrame:
    rows = sg.segment_rows(_docs(spark, sf))
    return rows.select("doc_id", "seg_order", "segment_id", "tokens", F.md5(F.col("source_text").cast("binary")).alias("text_md5"))


def batch_greedy(spark: SparkSession, sf: str) -> DataFrame:
    rows = sg.segment_rows(_docs(spark, sf))
    return rows.groupBy("doc_id", "batch_id").agg(F.count(F.lit(1)).alias("segments"), F.sum("tokens").alias("batch_tokens"))


def seg_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Each segment's offsets cut its text out of the document."""
    rows = sg.segment_rows(_docs(spark, sf)).join(_docs(spark, sf), "doc_id")
    cut = F.substring("text", F.col("start_offset").cast("int") + 1, (F.col("end_offset") - F.col("start_offset")).cast("int"))
    return rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("segments"), F.count_if(cut == F.col("source_text")).alias("exact")
    )


def token_estimates(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return _docs(spark, sf).select(
        "doc_id",
        tx.tokens_weighted(t).alias("weighted"),
        tx.tokens_words(t).alias("words"),
        tx.tokens_slides(t).alias("slides"),
    )


def line_endings(spark: SparkSession, sf: str) -> DataFrame:
    """O-02 and O-03 on texts whose line ends depend on the id."""
    ends = F.when(F.col("doc_id") % 3 == 0, "\r\n").when(F.col("doc_id") % 3 == 1, "\r").otherwise("\n")
    made = _docs(spark, sf).withColumn("made", F.replace("text", F.lit("\n"), ends))
    return made.select(
        "doc_id",
        F.hex(tx.line_ending(F.col("made"))).alias("ending"),
        F.md5(tx.with_line_ending(F.col("made"), F.lit("\r\n")).cast("binary")).alias("crlf_md5"),
    )


_NAMES = "concat(CASE page_id % 5 WHEN 0 THEN 'C:\\\\in\\\\' WHEN 1 THEN '/srv/' WHEN 2 THEN 'a/b/' ELSE '' END, 'Doc ', page_id, element_at(array('.TXT','.md','.docx','.PPTX','.xlsx','.pdf','.rtf',''), cast(page_id % 8 as int) + 1))"
_NAMES_DUCK = r"concat(CASE page_id % 5 WHEN 0 THEN 'C:\in\' WHEN 1 THEN '/srv/' WHEN 2 THEN 'a/b/' ELSE '' END, 'Doc ', page_id, ['.TXT','.md','.docx','.PPTX','.xlsx','.pdf','.rtf',''][page_id % 8 + 1])"
_LANGS = "element_at(array('fr','zh-CN','de AT','--','', 'pt_BR'), cast(page_id % 6 as int) + 1)"
_LANGS_DUCK = "['fr','zh-CN','de AT','--','', 'pt_BR'][page_id % 6 + 1]"


def file_names(spark: SparkSession, sf: str) -> DataFrame:
    """O-04 to O-08 on made-up paths."""
    made = spark.read.parquet(f"{sf}/pages.parquet").select(
        "page_id", F.expr(_NAMES).alias("path"), F.expr(_LANGS).alias("lang"), (F.length("html") * (F.col("page_id") % 4) * 40000).alias("size")
    )
    base = tx.base_name(F.col("path"))
    return made.select(
        "page_id",
        tx.document_kind(F.col("path")).alias("kind"),
        tx.source_problem(F.col("size").cast("long")).alias("problem"),
        base.alias("base_name"),
        tx.display_name(F.col("path")).alias("display_name"),
        tx.output_name(base, F.col("lang")).alias("output_name"),
        tx.output_name(base, F.col("lang"), "bilingual").alias("bilingual_name"),
    )


def content_digests(spark: SparkSession, sf: str) -> DataFrame:
    """O-18: digest and size, and whether they meet a manifest (here: of the texts as stored)."""
    rows = _docs(spark, sf).withColumn("bytes", F.col("text").cast("binary"))
    return rows.select("doc_id", F.sha2("bytes", 256).alias("sha256"), F.length("bytes").cast("long").alias("size_bytes"))


QUERIES = {
    "pipeline_job_metrics": pipeline_job_metrics,
    "seg_txt": seg_txt,
    "seg_offsets": seg_offsets,
    "batch_greedy": batch_greedy,
    "token_estimates": token_estimates,
    "line_endings": line_endings,
    "file_names": file_names,
    "content_digests": content_digests,
}

_MARK = "[translated] "
ORACLE = {
    "pipeline_job_metrics": SEGMENTS
    + rf"""
    SELECT d.doc_id, coalesce(n_segments, 0) AS n_segments, coalesce(n_batches, 0) AS n_batches,
           CAST(coalesce(est_tokens, 0) AS BIGINT) AS est_tokens, coalesce(n_segments, 0) AS translated,
           CAST(0 AS BIGINT) AS fallback, true AS round_trip,
           length(coalesce(text, '')) + {len(_MARK)} * coalesce(n_segments, 0) AS output_chars
    FROM documents d LEFT JOIN (
        SELECT doc_id, count(*) AS n_segments, CAST(max(batch_id) + 1 AS BIGINT) AS n_batches, sum(tokens) AS est_tokens
        FROM packed GROUP BY doc_id) USING (doc_id)
    """,
    "seg_txt": SEGMENTS
    + "SELECT doc_id, seg_order, printf('TXT_%04d', seg_order) AS segment_id, tokens, md5(piece) AS text_md5 FROM segments",
    "seg_offsets": SEGMENTS
    + "SELECT doc_id, count(*) AS segments, count(*) AS exact FROM segments GROUP BY doc_id",
    "batch_greedy": SEGMENTS
    + """SELECT doc_id, CAST(batch_id AS BIGINT) AS batch_id, count(*) AS segments, CAST(sum(tokens) AS BIGINT) AS batch_tokens
         FROM packed GROUP BY doc_id, batch_id""",
    "token_estimates": rf"""
        SELECT doc_id, {_est('text')} AS weighted,
               CAST(len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]')) AS BIGINT) AS words,
               CAST(greatest(1, (length(regexp_replace(text, '\[[^\]]+\]|</?span>|<SPACE>', '', 'g')) + 3) // 4) AS BIGINT) AS slides
        FROM documents
    """,
    "line_endings": """
        SELECT doc_id, CASE WHEN NOT contains(text, chr(10)) THEN '0A' WHEN doc_id % 3 = 0 THEN '0D0A'
                            WHEN doc_id % 3 = 1 THEN '0D' ELSE '0A' END AS ending,
               md5(replace(text, chr(10), chr(13) || chr(10))) AS crlf_md5
        FROM documents
    """,
    "file_names": rf"""
        WITH made AS (SELECT page_id, {_NAMES_DUCK} AS path, {_LANGS_DUCK} AS lang, length(html) * (page_id % 4) * 40000 AS size FROM pages),
        named AS (SELECT *, list_extract(string_split(replace(path, '\', '/'), '/'), -1) AS base,
                         coalesce(nullif(regexp_replace(regexp_replace(lang, '[^A-Za-z0-9_-]', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'translated') AS safe FROM made)
        SELECT page_id,
               CASE lower(regexp_extract(path, '\.([^./\\]+)$', 1)) WHEN 'txt' THEN 'txt' WHEN 'md' THEN 'markdown' WHEN 'docx' THEN 'docx'
                    WHEN 'pptx' THEN 'pptx' WHEN 'xlsx' THEN 'xlsx' WHEN 'pdf' THEN 'pdf' END AS kind,
               CASE WHEN size <= 0 THEN 'empty_file' WHEN size > 209715200 THEN 'file_too_large' END AS problem,
               base AS base_name, base AS display_name,
               regexp_replace(base, '\.[^.]*$', '') || '.' || safe || regexp_extract(base, '(\.[^.]*)$', 1) AS output_name,
               regexp_replace(base, '\.[^.]*$', '') || '.bilingual-' || safe || regexp_extract(base, '(\.[^.]*)$', 1) AS bilingual_name
        FROM named
    """,
    "content_digests": "SELECT doc_id, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS size_bytes FROM documents",
}
