"""How rows are dealt over tasks and batches, so that what a task holds does not grow with its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rows of a task that sorts and groups whole keys: 64 MB of a shuffle may hold ten times as many short rows, and each
#: sort and each table of groups in a task keeps them all.
TASK_ROWS = 250_000
#: Bytes of an Arrow batch between the JVM and Python: both sides hold a few for each running task.
BATCH_BYTES = 2 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def dealt(df: DataFrame, *keys: str, rows: int) -> DataFrame:
    """``df`` (of about ``rows`` rows) dealt by its keys over as many tasks as it has TASK_ROWS, at least one for each core.
    What is then grouped, ordered or joined by them needs no further shuffle; two tables dealt for equal ``rows`` meet."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *keys)


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes; the default lets 10,000 long texts through at once."""
    if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
