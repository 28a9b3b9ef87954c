"""Operator 12: a cohort retention matrix as known at two moments (DataFrame functions only).

1. Equal rows count once: a grouping by all columns, dealt by all of them, so no key is hot. What later steps
   need of a row (a few numbers) is written as a table.
2. Conditional minima: one aggregation gives each client its earliest start among the rows known at the cut
   (state 0) and among all (state 1), and its number of rows. Partial minima are combined before the shuffle.
3. Shuffle join back: the rows meet the starts of their client. A client with more than 1 / ``parts`` of all
   rows is dealt out over as many groups as it holds such parts; at most ``parts`` clients can, so the list of
   them that is broadcast has at most ``parts`` rows at any size.
4. Rows are summed per (state, client, period) inside the join's tasks first, then per client, and these sums
   roll up to (state, segment, cohort, period); both groupings combine before they shuffle.

Days and periods are those of the wall clock: of the stored value for timestamps without a zone, else of the
session's zone. They are counted in whole microseconds, so a period ends exactly.

Defined results: rows without a time or client are left out; without an arrival they are known in state 1
alone; a null identifier is not late; a null kind is no start; values that are null, not finite or beyond a long
count as 0 cents; a client that stands in ``clients`` several times takes its smallest segment, one without a
segment or not there ''; clients without a start have no cells; ties of the first start are one start; an empty
table gives an empty result; other columns of the tables (of any name) only tell rows apart. A cell whose cents
pass a long gives null for them.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.scratch import materialize

#: No group of the join back holds more than this part of all rows.
PARTS = 4096
DAY = 86_400_000_000


def micros(time: Column) -> Column:
    """Microseconds of the wall clock since 1970, exact, for timestamps with and without a zone."""
    seconds = F.unix_date(time.cast("date")).cast("long") * 86_400 + F.hour(time) * 3600 + F.minute(time) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), time) * 1_000_000).cast("long")


def floor_div(value: Column, by: int) -> Column:
    """Whole-number division that rounds down, also below zero."""
    return F.call_function("div", value - F.pmod(value, F.lit(by)), F.lit(by))


def cents(value: Column) -> Column:
    """Value in hundredths, halves up; 0 where it is null, not finite or beyond a long."""
    hundred = value * F.lit(100.0) + F.lit(0.5)
    return F.when(F.abs(hundred) < F.lit(2.0**62), F.floor(hundred)).otherwise(F.lit(0)).cast("long")


def crc(value: Column) -> Column:
    """CRC-32 of a whole number in decimal."""
    return F.crc32(value.cast("string").cast("binary"))


def facts(
    clicks: DataFrame,
    cut: dt.datetime,
    late_days: Column | None = None,
    client_col: str = "client_id",
    time_col: str = "ts",
    arrival_col: str = "arrived_at",
    kind_col: str = "kind",
    value_col: str = "value",
    start_kind: str = "purchase",
) -> DataFrame:
    """Each different row of ``clicks`` once: client, at, early (known before the cut), starts, cents, salt."""
    c = lambda name: F.col(f"`{name}`")
    before = (cut.replace(tzinfo=None) - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
    arrival = micros(c(arrival_col)) + F.coalesce(late_days if late_days is not None else F.lit(0), F.lit(0)).cast("long") * DAY
    rows = clicks.where(c(time_col).isNotNull() & c(client_col).isNotNull()).distinct()
    return rows.select(
        c(client_col).cast("long").alias("client"),
        micros(c(time_col)).alias("at"),
        F.coalesce(arrival < before, F.lit(False)).alias("early"),
        F.coalesce(c(kind_col) == start_kind, F.lit(False)).alias("starts"),
        cents(c(value_col)).alias("cents"),
        F.xxhash64(*[c(name) for name in (time_col, arrival_col, value_col, *[n for n in clicks.columns if n.endswith("_id")])]).alias("salt"),
    )


def starts(rows: DataFrame, clients: DataFrame, client_col: str = "client_id", segment_col: str = "city") -> DataFrame:
    """Per client with a start: client, n (its rows), start0, start1, segment."""
    first = lambda when: F.min(F.when(when, F.col("at")))
    found = rows.groupBy("client").agg(
        F.count(F.lit(1)).alias("n"), first(F.col("starts") & F.col("early")).alias("start0"), first(F.col("starts")).alias("start1")
    )
    found = found.where(F.col("start1").isNotNull())
    segments = clients.where(F.col(f"`{client_col}`").isNotNull()).groupBy(F.col(f"`{client_col}`").cast("long").alias("client"))
    segments = segments.agg(F.min(F.col(f"`{segment_col}`").cast("string")).alias("segment"))
    return found.join(segments.hint("merge"), "client", "left").withColumn("segment", F.coalesce("segment", F.lit("")))


def joined(rows: DataFrame, begun: DataFrame, parts: int = PARTS) -> DataFrame:
    """``rows`` with the starts of their client; clients of many rows are dealt over several groups."""
    total = begun.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    many = begun.where(F.col("n") * parts > total).select("client", F.ceil(F.col("n") * parts / max(total, 1)).cast("int").alias("groups"))
    groups = F.coalesce("groups", F.lit(1))
    left = rows.join(F.broadcast(many), "client", "left").withColumn("salt", F.pmod("salt", groups).cast("int")).drop("groups")
    right = begun.join(F.broadcast(many), "client", "left")
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), groups - 1))).drop("groups", "n")
    return left.join(right.hint("merge"), ["client", "salt"])


def cells(rows: DataFrame, begun: DataFrame, width_days: int = 3, parts: int = PARTS) -> DataFrame:
    """The nonempty cells: state, segment, cohort, period, users, users_crc32, moved, cents."""
    width = width_days * DAY
    both = joined(rows, begun, parts)
    state = lambda n, known: F.when(known & (F.col("at") >= F.col(f"start{n}")), F.struct(F.lit(n).alias("state"), F.col(f"start{n}").alias("start")))
    states = F.array_compact(F.array(state(0, F.col("early")), state(1, F.lit(True))))
    moved = floor_div(F.col("start0"), width) != floor_div(F.col("start1"), width)
    seen = both.select("client", "segment", "at", "cents", F.coalesce(moved, F.lit(False)).alias("moved"), F.explode(states).alias("s"))
    keys = {
        "state": F.col("s.state"),
        "cohort": floor_div(F.col("s.start"), width),
        "period": floor_div(F.col("at") - F.col("s.start"), width),
    }
    # segment, cohort and moved follow from state and client; as keys they keep the sums in hash tables
    per_client = seen.select("client", "segment", "moved", *[v.alias(k) for k, v in keys.items()], F.col("cents").cast("decimal(20,0)").alias("cents"))
    per_client = per_client.groupBy("state", "client", "period", "segment", "cohort", "moved").agg(F.sum("cents").alias("cents"))
    return per_client.groupBy("state", "segment", "cohort", "period").agg(
        F.count(F.lit(1)).alias("users"),
        F.sum(crc(F.col("client"))).alias("users_crc32"),
        F.count_if("moved").alias("moved"),
        F.sum("cents").try_cast("long").alias("cents"),
    )


def retention(clicks: DataFrame, clients: DataFrame, cut: dt.datetime, late_days: Column | None = None, width_days: int = 3, parts: int = PARTS) -> DataFrame:
    """Cells of the retention matrix as known at ``cut`` and at the end. ``late_days`` is added to the arrivals."""
    rows = materialize(facts(clicks, cut, late_days), "facts")
    begun = materialize(starts(rows, clients), "starts")
    return cells(rows, begun, width_days, parts)
