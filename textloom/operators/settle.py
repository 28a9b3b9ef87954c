"""What becomes of an answer's segments: as they are, repaired by the model, repaired by rule, or the source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import markup as mk
from textloom.functions.arrays import let

Repairer = Callable[[Column, Column], Column]


def settled(candidate: Column, source: Column, valid: Repairer, by_rule: Repairer, by_model: Column) -> Column:
    """(text, outcome) of a segment: the candidate if it is valid, else the model's repair if that is, else the repair by
    rule, else the source. Blank and missing candidates fall back at once."""
    outcome = lambda text, name: F.struct(text.alias("text"), F.lit(name).alias("outcome"))
    ruled = let(by_rule(candidate, source), lambda r: F.when(r.isNotNull(), outcome(r, "repaired")).otherwise(outcome(source, "fallback")))
    mended = let(by_model, lambda m: F.when(F.coalesce(valid(m, source), F.lit(False)), outcome(m, "model")).otherwise(ruled))
    blank = F.coalesce(mk.blank(candidate), F.lit(True))
    return F.when(blank, outcome(source, "fallback")).when(F.coalesce(valid(candidate, source), F.lit(False)), outcome(candidate, "strict")).otherwise(mended)


def settle_documents(rows: DataFrame, candidate: str, source: str, model: Repairer) -> DataFrame:
    """``rows`` with text and outcome; the model is asked for each malformed segment by itself (O-77)."""
    c, s = F.col(candidate), F.col(source)
    made = settled(c, s, mk.valid_document, mk.repair_document, model(c, s))
    return rows.select("*", F.explode(F.array(made)).alias("__made")).select(*rows.columns, "__made.*")


def settle_slides(rows: DataFrame, batch: str, order: str, candidate: str, source: str, model: Repairer) -> DataFrame:
    """``rows`` with text, outcome and ``asked``: the place of a malformed segment in the one repair call that all
    malformed segments of its batch share (O-78); null for others."""
    c, s = F.col(candidate), F.col(source)
    malformed = ~F.coalesce(mk.blank(c), F.lit(True)) & ~F.coalesce(mk.valid_slide(c, s), F.lit(False))
    marked = rows.select("*", F.explode(F.array(malformed)).alias("__bad"))
    place = F.row_number().over(Window.partitionBy(batch, "__bad").orderBy(order)) - 1
    asked = marked.withColumn("asked", F.when(F.col("__bad"), place).cast("long")).drop("__bad")
    made = settled(c, s, mk.valid_slide, mk.repair_slide, model(c, s))
    return asked.select("*", F.explode(F.array(made)).alias("__made")).select(*rows.columns, "asked", "__made.*")
