"""A corpus pipeline of five of the training-data operators.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``. All but the last return the columns of
``documents``. A stage deletes the tables that the latest call of its predecessor over the same folder left
in the shared folder, whose result has then been written (not if ``docs`` still reads them); other results
held in the session keep theirs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import jaccard_join, line_dedup, mixing, quality, queries, scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Shares of tokens after the quality stage, which leaves next to nothing of the low domain. Clean documents
#: stay on any input: the others shrink to these shares beside them, or stay short of them.
TARGETS = {"clean": 0.94, "low": 0.0, "toxic": 0.06}
#: (application, folder) -> the stage called last over it, and its tables.
_left: dict[tuple[str, str], tuple[int, list[str]]] = {}


def _tidy(number: int, stage: Stage) -> Stage:
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir)
        last, tables = _left.pop(key, (-1, []))
        if last == number - 1 and not scratch.reads(docs, tables):
            scratch.delete(spark, tables)
        with scratch.owned() as tables:
            out = stage(spark, docs, sf_dir)
        _left[key] = (number, tables)
        return out

    return run


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the cut."""
    return quality.accepted(docs, _labels(spark, sf_dir))


def near_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier line equals or nearly equals; documents that had words and lose
    all of them go. ``n_chars`` follows the text."""
    kept = line_dedup.dedup(docs)
    blank = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", "")) == 0
    kept = kept.where(~(blank & (F.col("n_dropped") > 0))).drop("n_lines", "n_dropped")
    return kept.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id, once if its row is repeated
    (rows without an id stay)."""
    groups = jaccard_join.join(docs.select("doc_id", "text"))
    extra = groups.where("doc_id <> component_id").select("doc_id", F.col("key").alias("__key"))
    kept = docs.withColumn("__key", F.xxhash64("text")).join(extra.hint("merge"), ["doc_id", "__key"], "left_anti")
    keys = {
        "__h1": F.xxhash64("text"),
        "__h2": F.xxhash64(F.lit(7), "text"),
        "__alone": F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()),
    }
    return kept.withColumns(keys).dropDuplicates(["doc_id", *keys]).select(docs.columns)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents resampled to at most the target shares of tokens beside the clean ones, which stay."""
    return mixing.resample(docs, _labels(spark, sf_dir), TARGETS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes, as digests."""
    return queries.encoded(docs)


_STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", near_line_dedup),
    ("ngram_jaccard", near_duplicates),
    ("mixing", mixing_weights),
    ("byte_bpe", byte_bpe),
]
STAGES: list[tuple[str, Stage]] = [(name, _tidy(i, stage)) for i, (name, stage) in enumerate(_STAGES)]

#: SQL can express neither the fitted models nor the tokeniser.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again. Tables of the run that nothing
    reads any more are deleted as it goes; only the last stage's stay, which the result reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[str] = []
    for _, stage in _STAGES[:-1]:
        with scratch.owned() as tables:
            out = stage(spark, docs, sf_dir)
            path = scratch.new_path(spark, "stage")
            out.write.parquet(path)
        scratch.delete(spark, [*before, *tables[:-1]])
        before = [path]
        docs = spark.read.parquet(path)
    return _STAGES[-1][1](spark, docs, sf_dir)
