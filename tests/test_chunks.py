"""The grammar of chunks against a parser by hand, on made-up and broken chunks."""

import random
import re

import pytest
from pyspark.sql import functions as F

from textloom.operators import chunks as ck


def by_hand(text):
    """[(page, block, [(name or None, value)])] or None."""
    blocks, page, empty = [], None, True
    for line in (x.strip() for x in text.split("\n")):
        if m := re.fullmatch(r"\[PAGE_(\d+)\]", line):
            if page is not None and empty:
                return None
            page, empty = int(m.group(1)), True
            blocks.append(page)
        elif m := re.match(r"\[(BLOCK_\d+)\]", line):
            if page is None:
                return None
            empty = False
            blocks.append([page, m.group(1), [line[m.end() :]] if line[m.end() :] else []])
        elif blocks and isinstance(blocks[-1], list):
            blocks[-1][2].append(line)
        elif line:
            return None
    if page is None or empty:
        return None
    out = []
    for b in blocks:
        if isinstance(b, int):
            continue
        body, pairs = "\n".join(b[2]).strip(), []
        if not body:
            return None
        if "<SPAN_" not in body and "</SPAN_" not in body:
            if "[PAGE_" in body or "[BLOCK_" in body:
                return None
            pairs = [(None, body)]
        while body and pairs[:1] != [(None, body)]:
            m = re.match(r"<(SPAN_\d+)>((?:(?!</?SPAN_|\[PAGE_|\[BLOCK_).)*)</\1>\s*", body, re.S)
            if not m or not m.group(2).strip() or m.group(1) in [n for n, _ in pairs]:
                return None
            pairs.append((m.group(1), m.group(2)))
            body = body[m.end() :]
        out.append((b[0], b[1], pairs))
    return [b for b in blocks if isinstance(b, int)], out


def fits_by_hand(a, b):
    if a is None or b is None or a[0] != b[0] or [x[:2] for x in a[1]] != [x[:2] for x in b[1]]:
        return False
    for (_, _, x), (_, _, y) in zip(a[1], b[1]):
        names = [n for n, _ in y if n]
        if x[0][0]:
            if names != [n for n, _ in x]:
                return False
        elif names != sorted(names, key=lambda n: int(n[5:])) or not "".join(v for _, v in y).strip():
            return False
    return True


def made(rng):
    parts = ["[PAGE_1]", "[PAGE_2]", "[BLOCK_0]", "[BLOCK_1]", "[BLOCK_0]text", "[BLOCK_1]<SPAN_0>a</SPAN_0>", "[BLOCK_2]<SPAN_1>a</SPAN_1> <SPAN_0>b\nc</SPAN_0>",
             "[BLOCK_2]<SPAN_0>a</SPAN_1>", "[BLOCK_3]<SPAN_0> </SPAN_0>", "loose", "", "  ", "[BLOCK_4]x [PAGE_3]", "<SPAN_3>z</SPAN_3>", "[BLOCK_5]<SPAN_0>a<SPAN_1>b</SPAN_1></SPAN_0>"]
    good = ["[PAGE_1]", "[BLOCK_0]text", "[BLOCK_1]<SPAN_0>a</SPAN_0><SPAN_1>b</SPAN_1>", "[PAGE_2]", "[BLOCK_0]more", "lines"]
    if rng.random() < 0.6:
        out = list(good)
        for _ in range(rng.randint(0, 2)):
            out[rng.randrange(len(out))] = rng.choice(parts)
        return "\n".join(out)
    return "\n".join(rng.choice(parts) for _ in range(rng.randint(0, 6)))


def test_chunks_against_a_parser_by_hand(spark):
    rng = random.Random(3)
    texts = [made(rng) for _ in range(1200)]
    pairs = list(enumerate(zip(texts, texts[1:] + texts[:1])))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in pairs], "id long, a string, b string")
    df = df.select("id", F.explode(F.array(F.struct(ck.parse_chunk(F.col("a")).alias("x"), ck.parse_chunk(F.col("b")).alias("y")))).alias("p"))
    rows = {r.id: r for r in df.select("id", "p.x", ck.fits(F.col("p.x"), F.col("p.y")).alias("fits")).collect()}
    some = 0
    for i, (a, b) in pairs:
        hand, got = by_hand(a), rows[i].x
        if hand is None:
            assert got is None, a
        else:
            some += 1
            assert (got.pages, [(x.page, x.block, list(x["values"]), list(x.names)) for x in got.blocks]) == (
                hand[0], [(p, n, [v for _, v in c], [m for m, _ in c if m]) for p, n, c in hand[1]]), a
        assert rows[i].fits == fits_by_hand(hand, by_hand(b)), (a, b)
    assert some > 100 and sum(r.fits for r in rows.values()) > 20


@pytest.mark.parametrize("text", ["", "x", "[PAGE_1]", "[BLOCK_0]x", "[PAGE_1]\n[BLOCK_0]", "[PAGE_1]\n[PAGE_2]\n[BLOCK_0]x"])
def test_what_is_no_chunk(spark, text):
    assert spark.range(1).select(ck.parse_chunk(F.lit(text)).alias("p")).first().p is None
