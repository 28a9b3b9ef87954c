"""Batches of texts sent to a translator: index checks, calls with a targeted retry, backoff, commit order.

The translator itself is a column function (the deterministic stub by default); a real one is a scalar Arrow
function over a batch's rows. Slots are the tasks that Spark runs at a time, so bounds are numbers of
partitions, not locks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.language import unchanged_needs_retry
from textloom.functions.text import strip

# Requests in flight per job, per model and at most; retries at most.
PER_JOB, PER_MODEL, MOST = 6, 15, 32
MOST_RETRIES = 3


def indexed_once(answers: DataFrame, batch: str, index: str, size: str) -> DataFrame:
    """Answers whose index is in range and occurs once in its batch (O-65)."""
    w = Window.partitionBy(batch, index)
    once = answers.withColumn("__times", F.count(F.lit(1)).over(w)).where("__times = 1").drop("__times")
    return once.where((F.col(index) >= 0) & (F.col(index) < F.col(size)))


def indexed_strictly(answers: DataFrame, batch: str, index: str, size: str, arrival: str, text: str) -> DataFrame:
    """(batch, index, text) of the batches whose indices are exactly 0 .. size - 1; of answers with the same index the
    last to arrive counts (O-66)."""
    last = answers.groupBy(batch, index).agg(F.max_by(text, arrival).alias(text), F.max(size).alias("__size"))
    w = Window.partitionBy(batch)
    whole = (F.count(F.lit(1)).over(w) == F.col("__size")) & (F.min(index).over(w) == 0) & (F.max(index).over(w) == F.col("__size") - 1)
    return last.withColumn("__whole", whole).where("__whole").select(batch, index, text)


def usage_sum(a: Column, b: Column) -> Column:
    """Null only where both are null."""
    return F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


def call_batches(
    texts: DataFrame, batch: str, first: Callable[[Column], Column], again: Callable[[Column], Column], usage: Callable[[Column], Column]
) -> DataFrame:
    """Answers of each text (batch, index, text, position, retried) with the usage of its batch (O-60). ``texts``: batch,
    index, text, source, target, hint. Blank texts pass through; the others are numbered anew (position); texts
    that came back unchanged are asked once more, but for word documents, and keep the first answer if that is
    unchanged too."""
    blank = strip(F.col("text")) == ""
    rows = texts.withColumn("__blank", blank)
    place = F.row_number().over(Window.partitionBy(batch, "__blank").orderBy("index")) - 1
    rows = rows.withColumn("position", F.when(~F.col("__blank"), place).cast("long"))
    rows = rows.withColumn("__first", F.when(~F.col("__blank"), first(F.col("text"))))
    unchanged = lambda answer: unchanged_needs_retry(F.col("text"), answer, F.col("source"), F.col("target"))
    retried = ~F.col("__blank") & ~F.startswith("hint", F.lit("docx")) & unchanged(F.col("__first"))
    # In a row of its own, since the columns below would each judge the answer again.
    rows = rows.select("*", F.explode(F.array(F.coalesce(retried, F.lit(False)))).alias("retried"))
    rows = rows.withColumn("__again", F.when(F.col("retried"), again(F.col("text"))))
    better = F.col("retried") & ~unchanged(F.col("__again"))
    answer = F.when(F.col("__blank"), F.col("text")).when(better, F.col("__again")).otherwise(F.col("__first"))
    rows = rows.withColumn("answer", answer)
    spent = lambda asked: F.sum(F.when(asked, usage(F.col("text")))).over(Window.partitionBy(batch))
    total = usage_sum(spent(~F.col("__blank")), spent(F.col("retried")))
    return rows.select(batch, "index", F.col("answer").alias("text"), "position", "retried", total.alias("usage"))


def attempts(outcomes: DataFrame, call: str, retries: int, delay: float) -> DataFrame:
    """(call, attempts, waited, done) of calls whose possible outcomes (attempt from 0, ok, retryable) are known (O-61):
    one goes on while it fails retryably and retries are left, and waits ``delay * 2 ** attempt`` before each."""
    most = max(0, min(retries, MOST_RETRIES))
    tries = outcomes.where(F.col("attempt") <= most)
    ends = F.min(F.when(F.col("ok") | ~F.col("retryable"), F.col("attempt"))).alias("end")
    found = tries.groupBy(call).agg(ends, F.max("attempt").alias("last"), F.min(F.when(F.col("ok"), F.col("attempt"))).alias("__ok"))
    used = F.coalesce("end", "last")
    waited = (F.pow(F.lit(2.0), used) - 1) * delay
    return found.select(call, (used + 1).cast("long").alias("attempts"), waited.alias("waited"), F.coalesce(F.col("__ok") == used, F.lit(False)).alias("done"))


def committed(settled: DataFrame, job: str, group: str, order: str) -> DataFrame:
    """(job, group, at): when each settled group is committed (O-56): results are committed as a prefix in the order of the
    groups, so a group waits for all before it. ``order`` is the moment when it settled, null if it has not yet."""
    w = Window.partitionBy(job).orderBy(group).rowsBetween(Window.unboundedPreceding, 0)
    rows = settled.withColumn("__open", F.max(F.col(order).isNull()).over(w)).withColumn("at", F.max(order).over(w))
    return rows.select(job, group, F.when(~F.col("__open"), F.col("at")).alias("at"))


def job_concurrency(value: Column) -> Column:
    """A configured number of requests in flight, as JSON text; anything but an integer is 1 (O-57)."""
    number = F.when(value.rlike(r"^-?\d+$"), value.try_cast("int"))
    return F.greatest(F.coalesce(number, F.lit(1)), F.lit(1))


def model_slots(requests: DataFrame, limits: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, order, slot, wave): requests of each provider and model dealt over its slots in their order (O-58).
    ``limits``: keys and slots; 15 where none is set, 32 at most."""
    rows = requests.join(limits, keys, "left")
    bound = F.least(F.greatest(F.coalesce("slots", F.lit(PER_MODEL)), F.lit(1)), F.lit(MOST))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    rows = rows.withColumn("__bound", bound).withColumn("__place", place)
    return rows.select(*keys, order, (F.col("__place") % F.col("__bound")).cast("long").alias("slot"), F.floor(F.col("__place") / F.col("__bound")).cast("long").alias("wave"))
