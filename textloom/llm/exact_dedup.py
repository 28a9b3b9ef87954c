"""Operator 5: exact deduplication by skew-safe combining (DataFrame functions only).

1. Locally: rows of one input partition with the same digest and the same full text are combined
   before anything is shuffled (map-side aggregation keyed by digest, salt and text).
2. Salted merge: the partial groups of a (digest, salt) meet in one task, compared by full text. A
   text's copies spread over ``salts`` tasks, so a group with a third of all rows has no hot task.
3. Global merge: one row per salt and distinct text is left; these salt winners combine to one row
   per distinct text, again compared by full text.
4. Membership: every row takes its class by digest; a hot digest is spread over salts again. Where two different texts share a digest (step 3
   has then two rows for it) the rows of that digest take their class by full text instead.

Defined results: null counts as empty; texts are equal when they are identical after every run of
``[\\x20\\x09-\\x0D]`` is replaced by one space (no trimming, so a leading space counts); the smallest
id stays, and of rows that share it all stay (ids are expected to be unique); null ids are never the
smallest, and a group of only null ids has a null ``keep_id`` and keeps none; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.scratch import materialize
from textloom.llm.skew import join_spread

SALTS = 16
_BLANKS = ("\t", "\n", "\x0b", "\x0c", "\r")


def normalised(text: Column) -> Column:
    """Every run of blanks becomes one space; null becomes empty."""
    out = F.coalesce(text, F.lit(""))
    for blank in _BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(" "))
    return F.when(F.contains(out, F.lit("  ")), F.regexp_replace(out, " {2,}", " ")).otherwise(out)


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def classes(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per distinct content of ``rows`` (id, norm, digest): digest, norm, keep_id, group_size."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    merged = salted.groupBy("digest", "salt", "norm").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    return merged.groupBy("digest", "norm").agg(F.min("id").alias("keep_id"), F.sum("n").alias("group_size"))


def dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = SALTS,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per row of ``df``: id, keep_id, group_size, kept, digest, and whether a digest is shared."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), normalised(F.col(f"`{text_col}`")).alias("norm"))
    rows = rows.withColumn("digest", digest(F.col("norm")))
    groups = classes(rows, salts)
    shared = groups.groupBy("digest").agg(
        F.count(F.lit(1)).alias("contents"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    )
    shared = materialize(shared, "exact-classes")
    alone = shared.where("contents = 1")
    out = join_spread(rows.drop("norm"), alone, ["digest"], "group_size", ["id"])
    if not shared.where("contents > 1").isEmpty():
        clash = shared.where("contents > 1").select("digest")
        part = rows.join(clash, "digest", "left_semi")
        out = out.unionByName(
            part.join(classes(part, salts), ["digest", "norm"]).drop("norm").withColumn("contents", F.lit(2))
        )
    return out.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.coalesce(F.col("id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        "digest",
    )


def keep(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay."""
    kept = dedup(df, id_col, text_col).where("kept").select(F.col(id_col).alias("__keep")).distinct()
    return df.join(kept, F.col(f"`{id_col}`") == F.col("__keep"), "left_semi")
