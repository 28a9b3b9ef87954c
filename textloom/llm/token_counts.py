"""Operator 1: token counts by separator scan of flat, unindexed token files.

A token file is a run of little-endian identifiers of fixed width, document after document, each
ended by the separator; it has no index, so where documents begin is known only after a scan.

1. Ranges: files are cut into blocks of ``block_bytes`` from their sizes alone.
2. Scan: every block is read by itself and searched for the separator in one vector comparison; it
   reports the positions found.
3. Stitch: a prefix scan over blocks gives each the number of separators before it and the position
   of the last one, so the document that a block begins in the middle of gets its first half. The
   scan has two levels (blocks within groups of ``GROUP``, then groups), so a file of any size is
   never one task's list of blocks.

Files are read and written through ``pyarrow.fs`` by ranges, so a file of any size takes one block of
memory; its location must be reachable from all executors (the shared folder is).

Defined results: an empty file has no documents; two separators in a row give a document of 0
tokens; tokens after the last separator are a document that is not ``terminated``; a file whose size
is no multiple of the width is an error; a null or empty text is a document of 0 tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm import bpe
from textloom.llm.scratch import materialize, new_path

BLOCK_BYTES = 4 << 20
GROUP = 1024


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri.removeprefix("file:"))


def list_files(uri: str, suffix: str = ".bin") -> list[tuple[str, int]]:
    """(location, size) of the token files in a folder."""
    fs, path = _open(uri)
    scheme = uri[: len(uri) - len(path)] if uri.endswith(path) else "file://"
    found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    return sorted((scheme + f.path, f.size) for f in found if f.path.endswith(suffix))


def write_token_files(df: DataFrame, path: str, tokenizer: str, separator: int) -> DataFrame:
    """Encode (id, text) and write one flat file of 16-bit identifiers per task into the folder ``path``,
    each document followed by the separator. Returns (file, ordinal, id): what stands where.

    A task writes under a name of its own and renames it at the end, so a task that runs again
    after a lost executor replaces the file with the same bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bpe.vocabulary(tokenizer)
        task = TaskContext.get()
        fs, folder = _open(path)
        fs.create_dir(folder, recursive=True)
        name = f"{folder}/tokens-{task.partitionId():06d}.bin"
        own = f"{name}.{task.taskAttemptId()}"
        ordinal = 0
        with fs.open_output_stream(own) as sink:
            for portion in bpe.portions(batches, "text"):
                for slab, (ids, at) in zip(portion, words.encode([x.column("text") for x in portion])):
                    sink.write(np.insert(ids, at[1:], separator).astype("<u2").tobytes())
                    n = slab.num_rows
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([task.partitionId()] * n, pa.int32()),
                            pa.array(np.arange(ordinal, ordinal + n)),
                            slab.column("id"),
                        ],
                        ["file", "ordinal", "id"],
                    )
                    ordinal += n
        fs.move(own, name)

    return df.select("id", "text").mapInArrow(run, "file int, ordinal long, id long")


def block_ranges(spark: SparkSession, files: list[tuple[str, int]], width: int, block_bytes: int) -> DataFrame:
    """(file, path, block, first token, tokens): the blocks of the files, from their sizes."""
    bad = [path for path, size in files if size % width]
    if bad:
        raise ValueError(f"sizes are no multiple of {width}: {bad[:3]}")
    rows = [(i, path, size // width) for i, (path, size) in enumerate(files)]
    listed = spark.createDataFrame(rows, "file int, path string, tokens long")
    per = max(1, block_bytes // width)
    blocks = listed.where("tokens > 0").withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(tokens - 1) div {per}")))
    )
    return blocks.select(
        "file",
        "path",
        "block",
        (F.col("block") * per).alias("first"),
        F.least(F.lit(per).cast("long"), F.col("tokens") - F.col("block") * per).alias("size"),
        F.col("tokens").alias("total"),
    )


def scan(
    spark: SparkSession,
    files: list[tuple[str, int]],
    separator: int,
    width: int = 2,
    block_bytes: int = BLOCK_BYTES,
    group: int = GROUP,
) -> DataFrame:
    """(file, ordinal, start, n_tokens, terminated) of every document in the token files; ``file`` is the
    place in ``files`` and start the token offset in the file."""
    kind = {1: "<u1", 2: "<u2", 4: "<u4", 8: "<u8"}[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                fs, path = _open(r["path"])
                with fs.open_input_file(path) as source:
                    source.seek(r["first"] * width)
                    ids = np.frombuffer(source.read(r["size"] * width), kind)
                if len(ids) != r["size"]:
                    raise OSError(f"{r['path']} is shorter than its listed size")
                found = np.flatnonzero(ids == separator) + r["first"]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["file"]], pa.int32()),
                        pa.array([r["block"]], pa.int64()),
                        pa.array([r["first"] + r["size"]], pa.int64()),
                        pa.array([r["total"]], pa.int64()),
                        pa.array([found], pa.list_(pa.int64())),
                    ],
                    ["file", "block", "end", "total", "found"],
                )

    ranges = block_ranges(spark, files, width, block_bytes)
    tasks = max(1, min(-(-sum(size for _, size in files) // block_bytes), 20_000))
    seen = ranges.repartition(tasks, "file", "block").mapInArrow(
        run, "file int, block long, end long, total long, found array<long>"
    )
    seen = materialize(seen, "separators").withColumn("part", F.expr(f"block div {group}"))
    # Level one: within groups of blocks. Level two: over the groups.
    inner = Window.partitionBy("file", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    last = F.get("found", F.size("found") - 1)
    brief = seen.select("file", "part", "block", F.size("found").alias("n"), last.alias("last"))
    groups = brief.groupBy("file", "part").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    groups = groups.select(
        "file",
        "part",
        F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("n_before"),
        F.coalesce(F.max("last").over(outer), F.lit(-1)).alias("last_before"),
    )
    carried = brief.join(groups, ["file", "part"]).select(
        "file",
        "block",
        (F.col("n_before") + F.coalesce(F.sum("n").over(inner), F.lit(0))).alias("base"),
        F.greatest("last_before", F.coalesce(F.max("last").over(inner), F.lit(-1))).alias("carry"),
    )
    whole = seen.join(carried, ["file", "block"])
    # A file's last block closes the document that no separator ends.
    tail = (F.col("end") == F.col("total")) & (
        F.coalesce(F.get("found", F.size("found") - 1), F.col("carry")) < F.col("total") - 1
    )
    stops = F.when(tail, F.array_append("found", F.col("total"))).otherwise(F.col("found"))
    out = whole.select("file", "base", "carry", "total", stops.alias("stops")).select(
        "file", "base", "carry", "total", "stops", F.posexplode("stops").alias("i", "stop")
    )
    start = F.coalesce(F.get("stops", F.col("i") - 1), F.col("carry")) + 1
    return out.select(
        "file",
        (F.col("base") + F.col("i")).alias("ordinal"),
        start.alias("start"),
        (F.col("stop") - start).alias("n_tokens"),
        (F.col("stop") < F.col("total")).alias("terminated"),
    )


def count_documents(
    df: DataFrame,
    tokenizer: str,
    separator: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Tokenise ``df`` into flat files in the shared folder and count each document's tokens by the scan
    of those files: one row per row of ``df``: id, n_tokens."""
    spark = df.sparkSession
    folder = new_path(spark, "token-files")
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    stands = materialize(write_token_files(docs, folder, tokenizer, separator), "token-files-order")
    files = list_files(folder)
    number = {int(path.rsplit("-", 1)[1][:-4]): i for i, (path, _) in enumerate(files)}
    counts = scan(spark, files, separator, 2, block_bytes)
    names = spark.createDataFrame([(i, n) for n, i in number.items()], "file int, task int")
    counts = counts.join(names, "file").select(F.col("task").alias("file"), "ordinal", "n_tokens")
    return stands.join(counts, ["file", "ordinal"], "left").select(
        F.col("id").alias(id_col), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens")
    )
