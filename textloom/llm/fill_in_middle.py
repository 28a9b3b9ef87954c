"""Operator 11: fill-in-middle transformation over an index of distinct texts.

1. Digests of all texts are kept in a small table (id, digest, place), and counted. Digests with more than 1 / ``PARTS``
   of all rows (and ``LEAST`` rows) are *hot*; at most ``PARTS`` digests can be, so their list is broadcast at any size.
2. The index: texts of a digest meet and are grouped by their whole content. Texts that are not hot are shuffled once,
   by digest. Hot ones are combined in each task and again, so of a third of all rows one text a task is moved; a hot
   text then stands once for each of as many groups as its rows fill parts.
3. Documents (id and digest, no text) join the index back, sorted by digest. The first document of a group brings its
   text along; its line ends are encoded once, as an Elias-Fano list over code points, which serves the whole group.
   (Encoding before the join would cost a second shuffle of all texts: Python steps lose the partitioning.)
4. Each document picks its two cuts from the list by the hashes of its id, and the text is cut there.

Nothing takes two texts of one digest for one: a job that meets them fails with an error.

Defined results: null counts as empty, an empty text has no lines and stays plain; texts that hold a marker stay plain;
rows of one id are cut alike if their texts are; a null id is cut as the id ''; an empty table gives an empty result;
other columns of the table (of any name) are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm import elias_fano
from textloom.llm.kernels import text_buffers
from textloom.llm.scratch import materialize, small_batches

#: A group of the join back holds at most this part of all rows, or LEAST rows.
PARTS = 4096
LEAST = 256
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


@dataclass(frozen=True)
class Plan:
    """Percentages of documents that are transformed, and of those with the suffix first."""

    rate: int = 100
    spm: int = 50
    seed: int = 7


def line_ends(texts: pa.Array) -> list[bytes]:
    """Elias-Fano list of the ends of the lines of each text, in code points. The last line may have no line feed."""
    data, at = text_buffers(texts)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    ends = np.flatnonzero(data == 0x0A) + 1
    first = np.searchsorted(ends, at, "right")
    out = []
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        own = ends[first[i] : first[i + 1]]
        if b > a and not (len(own) and own[-1] == b):
            own = np.append(own, b)
        out.append(elias_fano.encode(points[own] - points[a]))
    return out


def _ends(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Ends of prefix and middle after so many lines, of rows sorted by group; the first of a group has its text, and
    its list stays for the others."""
    own, held = None, b""
    for groups, texts, *cuts in batches:
        out = np.zeros((len(groups), 2), np.int64)
        first = texts.is_valid().to_numpy(False)
        lists = iter(line_ends(texts.filter(pa.array(first))))
        for i, (group, begins, *many) in enumerate(zip(groups.to_pylist(), first.tolist(), *(c.to_pylist() for c in cuts))):
            if begins:
                own, held = group, next(lists)
            elif group != own:
                raise ValueError("rows of a group do not follow each other")
            some = [k for k in many if k]
            if some:
                out[i, 2 - len(some) :] = elias_fano.select(held, np.array(some) - 1)
        yield pa.StructArray.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["prefix", "middle"])


def _index(texts: DataFrame) -> DataFrame:
    """Per distinct text of ``texts`` (digest, text; all of a digest in one task): digest, text, n, marked. It fails where
    a digest has two texts."""
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    n = (lines + F.when((F.col("text") != "") & ~F.endswith("text", F.lit("\n")), 1).otherwise(0)).cast("long")
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    many = F.count(F.lit(1)).over(Window.partitionBy("digest"))
    wrong = F.raise_error(F.lit("two texts share a digest")).cast("long")
    own = texts.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("rows")).withColumn("many", many)
    return own.select("digest", "text", F.when(F.col("many") == 1, n).otherwise(wrong).alias("n"), marked.alias("marked"))


def units(seed: int, key: Column) -> list[Column]:
    """Four whole numbers of 32 bits from the seed and a key."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(hashed, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", plan: Plan = Plan()) -> DataFrame:
    """One row per row of ``df``: id, n (lines), form (plain, psm, spm), prefix_chars, middle_chars (null if plain), output."""
    small_batches(df.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    digest = F.unhex(F.sha2(text.cast("binary"), 256))
    known = df.select(F.col(f"`{id_col}`").alias("id"), digest.alias("digest"), F.monotonically_increasing_id().alias("place"))
    known = materialize(known, "digests")
    sizes = known.groupBy("digest").agg(F.count(F.lit(1)).alias("rows"))
    most = max(LEAST, -(-known.count() // PARTS))
    hot = sizes.where(F.col("rows") > most).select("digest", F.ceil(F.col("rows") / most).cast("int").alias("groups"))
    hot = materialize(hot, "hot-digests")
    texts = df.select(digest.alias("digest"), text.alias("text"))
    cold = _index(texts.join(F.broadcast(hot), "digest", "left_anti").repartition("digest"))
    made = [_cut(known.join(F.broadcast(hot), "digest", "left_anti"), cold, ["digest"], plan)]
    if not hot.isEmpty():
        few = texts.join(F.broadcast(hot.select("digest")), "digest", "left_semi")
        few = few.withColumn("salt", F.spark_partition_id() % 64).groupBy("digest", "salt", "text").count()
        index = _index(few.select("digest", "text")).join(F.broadcast(hot), "digest")
        index = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
        rows = known.join(F.broadcast(hot), "digest").withColumn("salt", F.pmod(F.xxhash64("place"), F.col("groups")).cast("int"))
        made.append(_cut(rows.drop("groups"), index, ["digest", "salt"], plan))
    return (made[0] if len(made) == 1 else made[0].unionByName(made[1])).withColumnRenamed("id", id_col)


def _cut(known: DataFrame, index: DataFrame, keys: list[str], plan: Plan) -> DataFrame:
    """id, n, form, prefix_chars, middle_chars and output of the documents ``known`` (id, place and keys)."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("place"))
    joined = known.withColumn("nth", nth).join(index.hint("merge"), keys)
    h = units(plan.seed, F.col("id"))
    plain = (F.col("text") == "") | F.col("marked") | (h[2] % 100 >= plan.rate)
    form = F.when(plain, "plain").when(h[3] % 100 < plan.spm, "spm").otherwise("psm")
    rows = joined.select("id", "text", "n", "nth", form.alias("form"), (h[0] % (F.col("n") + 1)).alias("a"), (h[1] % (F.col("n") + 1)).alias("b"), *keys)
    ends = F.arrow_udf(_ends, T.StructType([T.StructField("prefix", T.LongType()), T.StructField("middle", T.LongType())]))
    group = F.xxhash64(*keys)
    rows = rows.withColumn("at", ends(group, F.when(F.col("nth") == 1, F.col("text")), F.least("a", "b"), F.greatest("a", "b")))
    size = lambda value: F.when(F.col("form") != "plain", value)
    rows = rows.select("id", "n", "form", "text", size(F.col("at.prefix")).alias("prefix_chars"), size(F.col("at.middle") - F.col("at.prefix")).alias("middle_chars"))
    start, length = F.col("prefix_chars").cast("int"), F.col("middle_chars").cast("int")
    prefix, middle = F.substring("text", F.lit(1), start), F.substring("text", start + 1, length)
    suffix = F.substring("text", start + length + 1, F.lit(2**31 - 1))
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(F.col("text"))
    )
    return rows.select("id", "n", "form", "prefix_chars", "middle_chars", output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from. Its parts hold no marker, so markers stand once."""
    after = lambda mark: F.instr(output, F.lit(mark)) + len(mark)
    between = lambda a, b: F.substring(output, after(a), F.instr(output, F.lit(b)) - after(a))
    middle = F.substring(output, after(MIDDLE), F.lit(2**31 - 1))
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
