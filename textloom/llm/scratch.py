"""Intermediate tables in the folder that all executors share (``spark.checkpoint.dir``).

A result may read the tables that its operator wrote for as long as it is held, so nothing is deleted behind a
caller's back: who wants the tables of a call gone lists them with ``owned`` and deletes them once the result
has been written.
"""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from textloom.operators.dealing import small_batches  # noqa: F401

_owner: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("textloom-owner", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset, as in tests, a folder of our own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if found:
        return found.rstrip("/")
    own = "file://" + tempfile.mkdtemp(prefix="textloom-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


@contextlib.contextmanager
def owned() -> Iterator[list[str]]:
    """The list of the tables written inside the block, by this thread or task."""
    tables: list[str] = []
    token = _owner.set(tables)
    try:
        yield tables
    finally:
        _owner.reset(token)


def keep_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no ``owned`` list names."""
    return f"{shared_dir(spark)}/textloom/{uuid.uuid4().hex}/{name}"


def new_path(spark: SparkSession, name: str) -> str:
    path = keep_path(spark, name)
    tables = _owner.get()
    if tables is not None:
        tables.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def reads(df: DataFrame, tables: list[str]) -> bool:
    """Whether the plan of ``df`` reads one of these tables."""
    names = {path.split("/")[-2] for path in tables}
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation":
            roots = leaf.relation().location().rootPaths()
            if any(roots.apply(k).getParent().getName() in names for k in range(roots.size())):
                return True
    return False


def delete(spark: SparkSession, tables: list[str]) -> None:
    """Delete tables; call it only when the results that read them have been written."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in tables:
        path = jvm.org.apache.hadoop.fs.Path(name).getParent()
        path.getFileSystem(conf).delete(path, True)
