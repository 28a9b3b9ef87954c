"""Operator 12 against a plain version, on odd rows and with a hot client."""

import datetime as dt
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from textloom.llm import retention

CUT = dt.datetime(2024, 3, 1)
KINDS = ("purchase", "view", "click", None)
CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"
CLIENTS = "client_id long, city string"


def crc(n):
    return zlib.crc32(str(n).encode())


def plain(clicks, clients, width=3):
    city = defaultdict(str)
    for client, name in sorted(clients, key=lambda c: (c[1] is None, c[1] or "")):
        if client is not None and client not in city:
            city[client] = name or ""
    starts, known = ({}, {}), ([], [])
    for row in set(clicks):
        click, ts, arrived, client, kind, value, _ = row
        if ts is None or client is None:
            continue
        late = crc(click) % 100 if click is not None and crc(click) % 3 == 0 else 0
        for state in (0, 1):
            if state or arrived is not None and arrived + dt.timedelta(days=late) < CUT:
                known[state].append((client, ts, value))
                if kind == "purchase":
                    starts[state][client] = min(starts[state].get(client, ts), ts)
    epoch, span = dt.datetime(1970, 1, 1), dt.timedelta(days=width)
    cohort = lambda s: (s - epoch) // span
    cells = defaultdict(lambda: (set(), []))
    for state in (0, 1):
        for client, ts, value in known[state]:
            if client in starts[state] and ts >= (start := starts[state][client]):
                cell = cells[state, city[client], cohort(start), (ts - start) // span]
                cell[0].add(client)
                cell[1].append(value)
    out = []
    for key, (users, values) in cells.items():
        moved = sum(u in starts[0] and u in starts[1] and cohort(starts[0][u]) != cohort(starts[1][u]) for u in users)
        cents = sum(int((100 * v + 0.5) // 1) for v in values if v is not None and abs(v) < 1e15)
        out.append((*key, len(users), sum(map(crc, users)), moved, cents))
    return sorted(out)


def run(spark, clicks, clients, extra=(), parts=retention.PARTS):
    df = spark.createDataFrame(clicks, CLICKS).withColumns({c: F.lit("clash") for c in extra})
    late = F.when(retention.crc(F.col("click_id")) % 3 == 0, retention.crc(F.col("click_id")) % 100)
    out = retention.retention(df, spark.createDataFrame(clients, CLIENTS), CUT, late, parts=parts)
    assert out.columns == ["state", "segment", "cohort", "period", "users", "users_crc32", "moved", "cents"]
    return sorted(map(tuple, out.collect()))


def made(n, seed, hot=0.0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        ts = dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=rng.randrange(150 * retention.DAY))
        client = 3 if rng.random() < hot else rng.choice([None, *range(12)])
        value = rng.choice([None, float("nan"), float("inf"), 1e300, -3.005, round(rng.uniform(-50, 500), 2)])
        rows.append((rng.choice([None, *[i] * 9]), rng.choice([None, *[ts] * 9]), rng.choice([None, *[ts + dt.timedelta(seconds=1)] * 6]), client, rng.choice(KINDS), value, rng.choice([None, "{}"])))
    return rows + [r for r in rows if rng.random() < 0.2 and r[5] == r[5]]


@pytest.mark.parametrize("parts", [2, 4096])
def test_cells_meet_the_plain_version(spark, parts):
    clicks = [r for r in made(700, 4, 0.35) if r[5] is None or r[5] == r[5]]
    clients = [(i, f"city {i % 3}") for i in range(8)] + [(8, None), (8, "twice"), (9, "b"), (9, "a"), (None, "nobody")]
    assert run(spark, clicks, clients, ["client", "at", "salt", "segment", "n", "state"], parts) == plain(clicks, clients)


def test_periods_end_to_the_microsecond(spark):
    start = dt.datetime(2024, 1, 2, 3, 4, 5, 678901)
    span = dt.timedelta(days=3)
    times = [start, start + span - dt.timedelta(microseconds=1), start + span, start - dt.timedelta(microseconds=1), dt.datetime(1969, 12, 30)]
    clicks = [(1, t, t, 5, "purchase" if t == start else "view", 0.005, None) for t in times]
    got = run(spark, clicks, [])
    assert got == plain(clicks, []) and [r[3] for r in got if r[0] == 1] == [0, 1]
    early = [(1, dt.datetime(1969, 12, 30), None, 5, "purchase", 1.0, None)]
    assert run(spark, early, []) == plain(early, []) and run(spark, early, [])[0][2] == -1


def test_not_a_number_is_no_money(spark):
    at = dt.datetime(2024, 1, 5)
    assert run(spark, [(1, at, at, 2, "purchase", float("nan"), None), (2, at, at, 2, "view", 1.25, None)], [])[0][-1] == 125


def test_a_hot_client_is_dealt_out(spark):
    clicks = spark.range(20_000).select(
        F.col("id").alias("click_id"),
        F.timestamp_add("SECOND", F.col("id").cast("int"), F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz")).alias("ts"),
        F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz").alias("arrived_at"),
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("client_id"),
        F.lit("purchase").alias("kind"),
        F.lit(1.0).alias("value"),
    )
    rows = retention.facts(clicks, CUT)
    begun = retention.starts(rows, spark.createDataFrame([], CLIENTS))
    groups = retention.joined(rows, begun, 64).groupBy("client", "salt").count().where("client = 7").collect()
    assert len(groups) > 15 and max(r["count"] for r in groups) < 2 * 20_000 / 64
    assert sum(r["count"] for r in groups) == 6668


def test_no_rows(spark):
    assert run(spark, [], [(1, "x")]) == []
