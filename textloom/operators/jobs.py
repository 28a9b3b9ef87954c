"""Job metadata as tables: folds over ordered events, latest rows, top-N, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stages in order, as the progress column names them.
STAGES = ("extracting", "translating", "formatting")


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order (O-171)."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rank = 1").drop("__rank")


def staged_candidates(df: DataFrame, key: str, value: str, order: list[Column], usable: Column) -> DataFrame:
    """Values of keys that occur more than once, with their best rank (O-172)."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).withColumn(
        "many", F.count(F.lit(1)).over(Window.partitionBy(key))
    )
    return ranked.where((F.col("many") > 1) & usable).groupBy(key, value).agg(F.min("rank").cast("long").alias("priority"))


def upsert_least(stored: DataFrame, fresh: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Both tables by key, with the smaller value where both have one (O-172)."""
    new = fresh.withColumnRenamed(value, "__new")
    return stored.join(new, keys, "full").select(*keys, F.least(value, "__new").alias(value))


def progress_percent(stage: Column, processed: Column, total: Column) -> Column:
    """Percent done as older clients show it (O-165); stage as its place in STAGES."""
    share = F.floor(processed * 100 / F.nullif(total, F.lit(0)))
    return F.when(stage == 0, 0).when(stage == 2, 100).otherwise(F.coalesce(share, F.lit(0))).cast("long")


def fold_progress(df: DataFrame, job: str, order: list[str]) -> DataFrame:
    """Snapshots (stage, processed, total) of each job in order; stale ones are dropped (O-164). One row per
    job: accepted, stage, processed, total, progress."""
    rows = df.groupBy(job).agg(F.array_sort(F.collect_list(F.struct(*order, "stage", "processed", "total"))).alias("events"))

    def step(s: Column, e: Column) -> Column:
        valid = (e["processed"] >= 0) & (e["processed"] <= e["total"])
        onward = (e["stage"] > s["stage"]) | (
            (e["stage"] == s["stage"]) & (e["processed"] >= s["processed"]) & (e["total"] == s["total"])
        )
        taken = F.struct((s["accepted"] + 1).alias("accepted"), *[e[c].cast("long").alias(c) for c in ("stage", "processed", "total")])
        return F.when(valid & onward, taken).otherwise(s)

    zero = F.lit(0).cast("long")
    start = F.struct(*[zero.alias(c) for c in ("accepted", "stage", "processed", "total")])
    out = rows.withColumn("s", F.aggregate("events", start, step)).select(job, "s.*")
    return out.withColumn("progress", progress_percent(F.col("stage"), F.col("processed"), F.col("total")))


def fold_status(df: DataFrame, job: str, order: list[str]) -> DataFrame:
    """Status of each job after its requested actions in order (O-163): run and cancel need a queued job,
    fail any that is not cancelled. One row per job: status, applied."""
    rows = df.groupBy(job).agg(F.array_sort(F.collect_list(F.struct(*order, "action"))).alias("events"))

    def step(s: Column, e: Column) -> Column:
        target = (
            F.when((e["action"] == "run") & (s["status"] == "queued"), "running")
            .when((e["action"] == "cancel") & (s["status"] == "queued"), "cancelled")
            .when((e["action"] == "fail") & (s["status"] != "cancelled"), "failed")
            .when(e["action"] == "succeed", "succeeded")
        )
        moved = F.struct(target.alias("status"), (s["applied"] + 1).alias("applied"))
        return F.when(target.isNotNull(), moved).otherwise(s)

    start = F.struct(F.lit("queued").alias("status"), F.lit(0).cast("long").alias("applied"))
    return rows.select(job, F.aggregate("events", start, step).alias("s")).select(job, "s.*")


def recent(df: DataFrame, created: str, key: str, n: int) -> DataFrame:
    """The n newest rows, ties by key (O-162); a top-k of the plan, not a sort of all rows."""
    return df.orderBy(F.desc(created), F.desc(key)).limit(n)


def sweep(df: DataFrame) -> DataFrame:
    """Jobs that a restart found unfinished fail (O-167)."""
    open_ = F.col("status").isin("queued", "running")
    return df.withColumn("error_code", F.when(open_, "process_interrupted").otherwise(F.col("error_code"))).withColumn(
        "status", F.when(open_, "failed").otherwise(F.col("status"))
    )


def replace_children(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Child rows with those of every key in ``fresh`` replaced (O-166)."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def history_filter(df: DataFrame, status: str | None, needle: str) -> DataFrame:
    """Rows of a status (running includes queued) whose name or model contains the words (O-196)."""
    kept = df if status is None else df.where(F.col("status").isin("queued", "running") if status == "running" else F.col("status") == status)
    text = F.lit(needle.strip().lower())
    return kept.where(F.contains(F.lower("source_name"), text) | F.contains(F.lower("model_id"), text))


def create(jobs: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """Jobs with the requested ones as queued (O-160). A request with the id of a job is not taken."""
    fresh = requests.join(jobs, "id", "left_anti")
    fresh = fresh.withColumns({"status": F.lit("queued"), "progress": F.lit(0).cast("long"), "created_at": now, "updated_at": now})
    return jobs.unionByName(fresh, allowMissingColumns=True)


def upsert_front(jobs: DataFrame, key: str, place: str, fresh: DataFrame) -> DataFrame:
    """The list with the fresh rows (place: the order of arrival) in front, the last first, and without older rows of
    their ids (O-197)."""
    rows = jobs.withColumn("__at", -F.col(place) - 1).unionByName(fresh.withColumn("__at", F.col(place)))
    last = latest(rows, [key], [F.desc("__at")])
    return last.withColumn(place, (F.row_number().over(Window.orderBy(F.desc("__at"))) - 1).cast("long")).drop("__at")


# The options of each kind of document with their defaults.
OPTIONS = {"docx": {"translate_tables": True, "bilingual": False}, "pptx": {"translate_tables": True, "translate_notes": True}, "pdf": {"bilingual": False}}


def document_options(kind: Column, given: Column, options: dict[str, Column]) -> tuple[dict[str, Column], Column]:
    """Options with the defaults of their kind of document, and an error code (O-169). ``given`` is the kind that the
    options were made for, null without options; other kinds than the document's, and options of kinds that
    have none, are errors."""
    known = kind.isin(*OPTIONS)
    wrong = given.isNotNull() & (~known | (given != kind))
    out = {}
    for name, value in options.items():
        column = F.lit(None).cast("boolean")
        for k, defaults in OPTIONS.items():
            if name in defaults:
                column = F.when((kind == k) & ~wrong, F.coalesce(F.when(given.isNotNull(), value), F.lit(defaults[name]))).otherwise(column)
        out[name] = column
    return out, F.when(wrong, "invalid_document_options")


def options_text(kind: Column, options: dict[str, Column]) -> Column:
    """Options as stable JSON text with sorted keys and without missing ones (O-168); null without a kind."""
    values = {**{k: v.cast("string") for k, v in options.items()}, "kind": F.concat(F.lit('"'), kind, F.lit('"'))}
    parts = [F.when(v.isNotNull(), F.concat(F.lit(f'"{k}": '), v)) for k, v in sorted(values.items())]
    return F.when(kind.isNotNull(), F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")))
