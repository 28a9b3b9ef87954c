"""Operators on texts against brute force, with nulls, empty texts, ties and empty tables."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from textloom.llm import bpe, exact_dedup, jaccard_join, line_dedup, pii, queries, substring_dedup, token_counts

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [(9000, None), (9001, ""), (9002, "  "), (9003, "a b"), (9004, "a  b")]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def corpus(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def reference_encoder():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_meets_the_library_on_random_text(reference_encoder):
    rng = random.Random(1)
    parts = ["'s", "'t", "'re", "'ll", "'", "''", " ", "  ", "\n", "\t", "\xa0", "a", "th", "é", "字", "1", "½", "!", "...", "\x1c",
             "\x85", "😀", "re", "s", "\r\n", "x" * 30, "n't", "Ⅷ", "́", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["", None, "a" * 3000, "".join(chr(rng.randrange(0x20, 0x2FFF)) for _ in range(2000))]
    coder = bpe.Vocabulary(PATH)
    half = len(texts) // 2
    for portion in (texts[:half], texts[half:]):
        (ids, at), = coder.encode([pa.array(portion)])
        data, bytes_at = coder.decode(ids.astype(np.int64), at)
        for i, text in enumerate(portion):
            assert ids[at[i] : at[i + 1]].tolist() == reference_encoder.encode_ordinary(text or "")
            assert data[bytes_at[i] : bytes_at[i + 1]].tobytes() == (text or "").encode()


def test_words_that_fall_back_are_encoded_alike():
    coder = bpe.Vocabulary(PATH)
    ids, counts = coder.replay([b" hello", b"aaaaaaa", b"x"])
    at = np.concatenate([[0], np.cumsum(counts)])
    for i, word in enumerate([b" hello", b"aaaaaaa", b"x"]):
        assert ids[at[i] : at[i + 1]].tolist() == coder.one(word)


def test_op3_over_documents(spark, reference_encoder):
    got = {r.doc_id: r for r in queries.op3_byte_bpe(spark, SF).collect()}
    for doc, text in corpus(spark):
        ids = reference_encoder.encode_ordinary(text or "")
        assert got[doc].n_tokens == len(ids)
        assert got[doc].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[doc].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_keeps_other_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "hi", [9], "x")], "doc_id long, text string, ids array<int>, lang string")
    row = bpe.decode(bpe.encode(df, PATH), PATH).first()
    assert bytes(row.decoded) == b"hi" and row.lang == "x" and row.ids != [9]
    assert bpe.encode(df.limit(0), PATH).count() == 0


def test_scan_stitches_blocks(spark, tmp_path):
    rng, expected = random.Random(1), []
    for k, n in enumerate([0, 1, 7, 64, 200, 33]):
        ids = np.array([rng.choice([0, 0, 1, 2, 3]) for _ in range(n)], "<u2")
        if k == 5:
            ids[:] = 1
        ids.tofile(tmp_path / f"f{k}.bin")
        start = ordinal = 0
        for i, v in enumerate(ids.tolist()):
            if v == 0:
                expected.append((k, ordinal, start, i - start, True))
                ordinal, start = ordinal + 1, i + 1
        if start < n:
            expected.append((k, ordinal, start, n - start, False))
    found = token_counts.scan(spark, token_counts.list_files(str(tmp_path)), 0, 2, block_bytes=16, group=3).collect()
    assert sorted(map(tuple, found)) == sorted(expected)
    with pytest.raises(ValueError):
        token_counts.scan(spark, [("x.bin", 3)], 0)


def test_op1_counts_what_op3_encodes(spark):
    encoded = {r.doc_id: r.n_tokens for r in queries.op3_byte_bpe(spark, SF).collect()}
    assert {r.doc_id: r.n_tokens for r in queries.op1_token_counts(spark, SF).collect()} == encoded


def _near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_lines(docs):
    first = {}
    for d, t in sorted((d, t) for d, t in docs if t):
        for i, line in enumerate(t.split("\n")):
            if words(line):
                first.setdefault(tuple(words(line)), (d, i))
    around = defaultdict(list)
    for w in first:
        if len(w) >= line_dedup.MIN_WORDS:
            around[w].append(w)
            for i in range(len(w)):
                around[w[:i] + w[i + 1 :]].append(w)
    gone = {b for group in around.values() for a in group for b in group if first[a] < first[b] and _near(a, b)}
    out = {}
    for d, t in docs:
        if t is None:
            out[d] = (0, 0, None)
            continue
        lines = t.split("\n")
        kept = [x for i, x in enumerate(lines) if not words(x) or (tuple(words(x)) not in gone and first[tuple(words(x))] == (d, i))]
        out[d] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_line_dedup(spark):
    rng = random.Random(4)
    base = [[rng.choice("abcd") for _ in range(rng.randint(1, 9))] for _ in range(60)]
    docs = []
    for d in range(120):
        lines = []
        for _ in range(rng.randint(0, 6)):
            b, r = list(rng.choice(base)), rng.random()
            if r < 0.3:
                b[rng.randrange(len(b))] = rng.choice("wxyz")
            elif r < 0.5:
                b.insert(rng.randrange(len(b) + 1), rng.choice("wxyz"))
            elif r < 0.6:
                b.pop(rng.randrange(len(b)))
            lines.append((" " if r < 0.8 else "  ").join(b))
        docs.append((d * 13 % 997, "\n".join(lines)))
    docs += [(5000, None), (5001, ""), (5002, "\n\n")]
    df = table(spark, docs).withColumn("n_lines", F.lit("clash")).withColumn("lang", F.lit("x"))
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup(df).collect()}
    assert got == brute_lines(docs)
    assert line_dedup.dedup(table(spark, docs).limit(0)).count() == 0


def test_op4_over_documents(spark):
    expected = {d: (n, k, hashlib.sha256(t.encode()).hexdigest()) for d, (n, k, t) in brute_lines(corpus(spark)).items()}
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in queries.op4_line_dedup(spark, SF).collect()} == expected


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup_compares_contents(spark, weak):
    rng = random.Random(2)
    docs = [(i, rng.choice(["a b", "a  b", "a\tb", " a b", "c", None, "", "d" * 9])) for i in range(60)]
    digest = (lambda t: (F.crc32(t.cast("binary")) % 2).cast("string")) if weak else exact_dedup.sha256
    got = exact_dedup.dedup(table(spark, docs), salts=3, digest=digest).collect()
    norm = {d: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for d, t in docs}
    size, least = Counter(norm.values()), {}
    for d, t in norm.items():
        least[t] = min(least.get(t, d), d)
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got} == {
        (d, least[t], size[t], least[t] == d) for d, t in norm.items()
    }
    assert {r.doc_id for r in exact_dedup.keep(table(spark, docs)).collect()} == set(least.values())
    assert exact_dedup.dedup(table(spark, docs).limit(0)).count() == 0


def brute_jaccard(docs, size=5, least=0.8):
    sets = {}
    for d, t in docs:
        w = words(t)
        sets[d] = (frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset(), tuple(w))
    index, links, parent = defaultdict(list), Counter(), {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, (s, _) in sets.items():
        for g in s:
            index[g].append(d)
    for d, (s, _) in sets.items():
        for e, n in Counter(e for g in s for e in index[g] if e > d).items():
            if n >= least * (len(s) + len(sets[e][0]) - n) - 1e-9:
                links[d] += 1
                links[e] += 1
                a, b = root(d), root(e)
                parent[max(a, b)] = min(a, b)
    classes = {}
    for d in sorted(sets):
        classes.setdefault(sets[d][1], d)
    return {d: (classes[w] if w else d, root(d), links[d]) for d, (_, w) in sets.items()}


def test_jaccard_join(spark):
    rng, docs = random.Random(5), []
    for _ in range(8):
        base = [rng.choice("abcdefghijkl") for _ in range(120)]
        for _ in range(rng.choice([1, 3, 40, 60])):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice("xyz")
            docs.append((len(docs) * 7 % 2003, " ".join(copy)))
    docs += ODD
    got = {r[0]: tuple(r[1:4]) for r in jaccard_join.join(table(spark, docs), block=16).collect()}
    assert got == brute_jaccard(docs)
    assert jaccard_join.join(table(spark, docs).limit(0)).count() == 0


def test_op6_over_documents(spark):
    got = {r[0]: tuple(r[1:]) for r in queries.op6_ngram_jaccard(spark, SF).collect()}
    assert got == brute_jaccard(corpus(spark))


def test_bands_reach_the_recall():
    bands = jaccard_join.choose_bands(0.8, 0.99999)
    assert 1 - (1 - 0.8**4) ** bands >= 0.99999 > 1 - (1 - 0.8**4) ** (bands - 1)


def brute_windows(docs, window):
    tokens, least, out = {d: words(t) for d, t in docs}, {}, {}
    for d, w in tokens.items():
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            least[key] = min(least.get(key, d), d)
    for d, w in tokens.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out[d] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def test_substring_dedup(spark):
    rng = random.Random(3)
    base, docs = [rng.choice("abcdefgh") for _ in range(400)], []
    for i in range(60):
        a = rng.randint(0, 350)
        b = a + rng.randint(0, 50)
        docs.append((i * 7 % 61, " ".join(base[a:b] + [rng.choice("xyz") for _ in range(rng.randint(0, 12))] + base[b - 10 : b + 15])))
    docs += ODD + [(9100, "é " * 30), (9101, "q " * 400)]
    found = substring_dedup.repeats(table(spark, docs), window=10, chunk_chars=500, bucket_probes=200).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in found} == brute_windows(docs, 10)
    for r in found:
        assert sum(x["end"] - x["first"] for x in r.repeats) == r.n_removed
    assert substring_dedup.repeats(table(spark, docs).limit(0)).count() == 0


def test_op9_over_documents(spark):
    expected = {d: (n, k, hashlib.sha256(t.encode()).hexdigest()) for d, (n, k, t) in brute_windows(corpus(spark), 50).items()}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op9_substring_dedup(spark, SF).collect()} == expected


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute_pii(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if (
                kind == "email"
                or (kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")))
                or (kind == "card" and 16 <= len(digits) <= 19 and _luhn(digits))
                or (kind == "phone" and 8 <= len(digits) <= 15)
            ):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_base_spans_meet_the_plain_patterns(spark):
    rng = random.Random(2)
    parts = ["a", "b.c", "@", "x@y.zz", "_", "-", " ", "é", "😀", "1", "22", "255", ".", "+1", "(", "4111 1111 1111 1111",
             "4111111111111111", "10.0.0.1", "256.1.1.1", "+49 30 1234567", "00000", "--", "\n"]
    docs = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for i in range(1500)]
    docs += [(5000, None), (5001, "a" * 50000 + " " + "1" * 30000 + " 1" * 20000 + "@" * 100)]
    for r in pii.find(table(spark, docs)).collect():
        assert [f"{s.kind}:{s.start}:{s.end}" for s in r.base] == brute_pii(r.text)
        assert {(s.kind, s.start, s.end) for s in r.base} <= {(s.kind, s.start, s.end) for s in r.spans}
    assert pii.find(table(spark, docs).limit(0)).count() == 0


def test_pii_adds_and_redacts(spark):
    text = "call (212) 555-0199 or mail bob [at] example [dot] com today, host 2001:db8:85a3:1:2:8a2e:370:7334"
    clean = "version 10.20.30 of item 123-45-678 was built on 2021-10-12, look at home. Then order 1234 5678"
    rows = {r.doc_id: r for r in pii.redact(table(spark, [(1, text), (2, clean)])).collect()}
    assert rows[1].text == "call [PHONE] or mail [EMAIL] today, host [IP]"
    assert rows[2].text == clean


def test_pii_model_is_right_on_held_out_sentences(spark):
    trees, least = pii.model(spark)
    held = [e for e in pii.examples(seed=99) if e[0] < 600]
    df = spark.createDataFrame([(n, t) for n, t, _ in held], "doc_id long, text string")
    truth = {n: y for n, _, y in held}
    added = {r.doc_id: any(s.score is not None for s in r.spans) for r in pii.find(df).collect()}
    wrong = sum(added[n] and not y for n, y in truth.items())
    found = sum(added[n] and y for n, y in truth.items())
    assert wrong <= 0.02 * max(found, 1) and found >= 0.5 * sum(truth.values())


def test_pii_chain_of_overlaps_keeps_both_ends(spark):
    rows = [([("phone", 0, 10, 3.0), ("card", 8, 20, 2.0), ("phone", 18, 30, 1.0)],), ([("ip", 4, 9, 1.0)],), ([],)]
    df = spark.createDataFrame(rows, "spans array<struct<kind:string,start:long,end:long,score:double>>")
    got = [sorted((s.start, s.end) for s in r[0]) for r in df.select(pii.apart(F.col("spans"))).collect()]
    assert got == [[(0, 10), (18, 30)], [(4, 9)], []]


def test_encoding_and_decoding_share_a_worker(spark):
    rows = [(1, "one two  three"), (2, None), (3, ""), (4, "naïve 漢字 it's")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    two = bpe.decode(bpe.encode(df, queries.TOKENIZER), queries.TOKENIZER).drop("text").collect()
    assert sorted(bpe.round_trip(df, queries.TOKENIZER).collect()) == sorted(two)
    assert queries.encoded(df)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    words = bpe.Vocabulary(queries.TOKENIZER)
    ids = words.encode([pa.array(["a b"])])[0]
    assert words.decode(ids[0], ids[1])[0].tobytes() == b"a b"
    fresh = bpe.Vocabulary(queries.TOKENIZER)
    fresh.decode(ids[0], ids[1])
    assert "pairs" not in vars(fresh)  # decoding holds no pairs
