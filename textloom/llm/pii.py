"""Operator 7: personal data by candidate gradient boosting (DataFrame functions only, no shuffle).

*Base spans* of four kinds follow fixed patterns with checks (parts of an address, Luhn sum, digit counts) and
always stay. High-recall generators propose overlapping candidates around and beside them: spelled-out mail
addresses, telephone numbers without a plus sign, cards of 13 to 15 digits, version-6 addresses, and a fifth
kind, secrets: what is assigned to a password or token, and opaque runs of letters and digits, which often are
two candidates for one place. Boosted trees score a candidate's format and the words around it; a threshold
per kind, calibrated on held-out examples for ``PRECISION``, selects those that are added. Of overlapping
candidates the best stays, and base spans come before all others.

The trees are fitted on ``EXAMPLES`` made-up sentences of known truth (a fixed, documented bound; no
row of the input is used), with the features computed by the same expressions as in scoring.

Defined results: null and empty texts have no spans; positions are code points, ends exclusive; base spans
of different kinds may overlap; every row of the input gives one row, repeated rows included; extra
columns are not read. The patterns are written with possessive repeats and look-behinds so that very
long runs take neither deep recursion nor quadratic time; they match what the plain forms match. Positions,
overlaps and the choice among candidates are found by running sums and maxima in blocks of the square root of
their number, so a text with very many spans takes no quadratic time either.
"""

from __future__ import annotations

import random
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.arrays import let, running
from textloom.llm import boosting

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
EXAMPLES = 3000
PRECISION = 0.99
#: No candidate below these log odds is added, whatever the calibration says.
LEAST_LOG_ODDS = 2.0

_BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# Names of what must not be published.
_NAMES = r"(?:password|passwd|passphrase|pwd|secret|token|credential|(?:api|access|private|auth)[_ -]?key)"
_CANDIDATES = {
    "email": (
        r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]|\{at\}| at ) ?"
        r"[A-Za-z0-9-]++(?:(?: ?(?:\(dot\)|\[dot\]|\{dot\}) ?| dot |\.)[A-Za-z0-9-]{2,}+)++",
    ),
    "ip": (r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){2,7}+:?(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",),
    "card": (r"(?<![0-9])[0-9]{4}[ -]?[0-9]{4,6}[ -]?[0-9]{4,5}(?![0-9])",),
    "phone": (r"(?<![0-9])(?:\([0-9]{2,5}\) ?|[0-9]{2,5}[ ./-])(?:[0-9]{2,4}[ .-]){1,3}[0-9]{2,4}(?![0-9])",),
    "secret": (
        r"(?i)(" + _NAMES + r"[\"']?\s{0,2}[:=]\s{0,2}[\"']?)[^\s\"',;:=<>]{6,}+",
        r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{16,}+",
    ),
}
# Words that announce each kind, and words that announce other numbers.
_CUES = {
    "email": r"mail|contact|write|reach|reply|send",
    "ip": r"\bip|host|server|address|login|client|peer",
    "card": r"card|visa|master|amex|credit|debit|payment|charge",
    "phone": r"tel|phone|call|fax|mobile|cell|contact|whatsapp|dial|ring",
    "secret": _NAMES,
}
_OTHER_CUES = (
    r"(?:order|invoice|isbn|issn|version|ver|sku|serial|item|ref|part|ticket|page|date|time|mac|hash|build|no"
    r"|commit|sha|sha1|sha256|md5|etag|checksum|digest|file|image|slug|path|url|uuid|id)\b[^a-z0-9]*$"
)
_NEED = {"ip": r"[0-9]\.[0-9]", "card": r"[0-9]{2}|[0-9][ -][0-9]", "phone": r"\+[0-9]"}
# What a text must hold for a generator to look at it. All but spelled-out addresses and assigned values have digits.
_OFFER = {
    "email": r"(?i)[(\[{]at[)\]}]| at  ?[a-z0-9-]++(?: ?[(\[{]dot| dot |\.[a-z0-9-])",
    "ip": r":[0-9A-Fa-f]{0,4}:",
    "card": r"[0-9]{4}",
    "phone": r"[0-9][) ./-]",
    "secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16}",
}
_ASSIGNED = r"(?i)" + _NAMES + r"[\"']?\s{0,2}[:=]"
_FEATURES = (
    "digits", "length", "marks", "luhn", "distinct", "zero", "cue", "other", "glued", "bracket", "suffix", "letters", "capitals", "chars",
    "hex", "assigned", "parts", "kind",
)
_SPAN = "struct<kind:string,start:bigint,end:bigint,text:string>"


def _none() -> Column:
    return F.expr(f"cast(array() as array<{_SPAN}>)")


def _located(text: Column, pattern: str, kind: str, lead: bool = False) -> Column:
    """Matches of the pattern with their positions: the lengths of the gaps and matches, summed up. With ``lead``
    the pattern's first group stands before the span."""

    def spans(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        steps = F.zip_with(found, gaps, lambda f, g: (F.length(f) + F.length(g)).cast("long"))

        def placed(f: Column, end: Column) -> Column:
            skip = F.length(F.regexp_extract(f, "^" + pattern, 1)) if lead else F.lit(0)
            start = end - F.length(f) + skip
            body = F.substring(f, skip + 1, F.length(f)) if lead else f
            return F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), body.alias("text"))

        return F.when(F.size(found) > 0, F.zip_with(found, running(steps, lambda a, b: a + b), placed)).otherwise(_none())

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)


BLOCK = 4096


def blocks(text: Column) -> Column:
    """The text in blocks, since every cut out of a text counts its characters from the beginning."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / BLOCK).cast("int")), lambda k: F.substring(text, k * BLOCK + 1, F.lit(BLOCK)))


def piece(cut: Column, begin: Column, end: Column) -> Column:
    """The characters begin .. end of a text in blocks."""
    a, b = F.floor(begin / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
    first, last = (begin % BLOCK).cast("int"), (end % BLOCK).cast("int")
    one = F.substring(F.get(cut, a), first + 1, (end - begin).cast("int"))
    many = F.concat(F.substring(F.get(cut, a), first + 1, F.lit(BLOCK)), F.array_join(F.slice(cut, a + 2, F.greatest(b - a - 1, F.lit(0))), ""), F.substring(F.get(cut, b), F.lit(1), last))
    return F.when(end <= begin, "").when(a == b, one).otherwise(many)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _valid(kind: str, text: Column) -> Column:
    if kind == "ip":

        def small(part: Column) -> Column:
            value = F.regexp_replace(part, "^0+", "")
            return (F.length(value) <= 3) & (F.coalesce(value.try_cast("int"), F.lit(0)) <= 255)

        return F.forall(F.split(text, r"\."), small)
    digits = _digits(text)
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    return F.length(digits).between(8, 15)


def _checked(kind: str) -> Callable[[Column], Column]:
    return lambda x: _valid(kind, x["text"])


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end, text), by kind as listed and then start."""
    parts = {}
    for kind in BASE_KINDS:
        spans = _located(text, _BASE[kind], kind)
        if kind != "email":
            spans = F.filter(spans, _checked(kind))
        need = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(_NEED[kind])
        parts[kind] = F.when(need, spans).otherwise(_none())
    numbers = F.concat(*[parts[k] for k in BASE_KINDS if k != "email"])
    return F.concat(parts["email"], F.when(text.rlike("[0-9]"), numbers).otherwise(_none()))


def _features(cut: Column, size: Column, x: Column) -> Column:
    digits = _digits(x["text"])
    first = F.greatest(x["start"] - 30, F.lit(0))
    left = F.lower(piece(cut, first, x["start"]))
    right = F.lower(piece(cut, x["end"], F.least(x["end"] + 2, size)))
    cue = F.lit(False)
    for kind in KINDS:
        cue = cue | ((x["kind"] == kind) & left.rlike(_CUES[kind]))
    code = F.lit(0)
    for i, kind in enumerate(KINDS):
        code = F.when(x["kind"] == kind, F.lit(i)).otherwise(code)
    values = [
        F.length(digits),
        F.length(x["text"]),
        F.length(F.regexp_replace(x["text"], "[^ .()/:-]", "")),
        F.call_function("luhn_check", digits),
        F.size(F.array_distinct(F.split(digits, ""))),
        F.startswith(digits, F.lit("0")),
        cue,
        left.rlike(_OTHER_CUES),
        left.rlike(r"[a-z0-9_#/=.$-]$") | right.rlike(r"^(?:[a-z0-9_/=%$-]|\.[0-9])"),
        x["text"].rlike(r"[\[({]"),
        F.lower(x["text"]).rlike(r"(?:com|org|net|edu|gov|io|de|fr|es|uk|eu)$"),
        F.length(F.regexp_replace(x["text"], "[^A-Za-z]", "")),
        F.length(F.regexp_replace(x["text"], "[^A-Z]", "")),
        F.size(F.array_distinct(F.split(F.lower(x["text"]), ""))),
        x["text"].rlike("^[0-9a-fA-F]+$"),
        left.rlike(_NAMES + r"[\"']?\s{0,2}[:=]\s{0,2}[\"']?$"),
        F.length(F.regexp_replace(x["text"], "[^+/_-]", "")),
        code,
    ]
    return F.struct(*[v.cast("double").alias(n) for n, v in zip(_FEATURES, values)])


def clear_of(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others. In the order of the spans' ends and the others' starts, the
    greatest end of the others so far tells."""
    event = lambda x, at, own: F.struct(
        at.alias("at"), F.lit(own).alias("other"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["text"].alias("text")
    )
    # At the same place a span comes first: what starts where it ends does not overlap it.
    events = F.array_sort(F.concat(F.transform(spans, lambda x: event(x, x["end"], 0)), F.transform(others, lambda x: event(x, x["start"], 1))))

    def kept(e: Column) -> Column:
        reach = running(F.transform(e, lambda x: F.when(x["other"] == 1, x["end"]).otherwise(0).cast("long")), lambda a, b: F.greatest(a, b))
        pairs = F.zip_with(e, reach, lambda x, r: F.struct(x.alias("x"), r.alias("r")))
        free = F.filter(pairs, lambda p: (p["x"]["other"] == 0) & (p["r"] <= p["x"]["start"]))
        return F.transform(free, lambda p: F.struct(*[p["x"][c].alias(c) for c in ("kind", "start", "end", "text")]))

    return F.when((F.size(spans) == 0) | (F.size(others) == 0), spans).otherwise(let(events, kept))


def candidates(text: Column, base: Column) -> Column:
    """Array of (kind, start, end, text, features) of all generators; those that a base span overlaps lose to it."""
    some = lambda need, *spans: F.when(need, F.concat(*spans)).otherwise(_none())
    offered = lambda k, p: some(text.rlike(_OFFER[k]), _located(text, p, k))
    assigned, opaque = _CANDIDATES["secret"]
    signs = F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))
    found = F.concat(
        offered("email", *_CANDIDATES["email"]),
        some(text.rlike("[0-9]"), *[offered(k, *_CANDIDATES[k]) for k in ("ip", "card", "phone")], offered("secret", opaque)),
        some(signs, some(text.rlike(_ASSIGNED), _located(text, assigned, "secret", lead=True))),
    )
    free = let(F.array_distinct(found), lambda spans: clear_of(spans, base))

    def described(spans: Column) -> Column:
        with_features = lambda cut: F.transform(spans, lambda x: x.withField("features", _features(cut, F.length(text), x)))
        return let(F.when(F.size(spans) > 0, blocks(text)), with_features)

    return let(free, described)


def examples(n: int = EXAMPLES, seed: int = 11) -> list[tuple[int, str, int]]:
    """(number, sentence, truth): made-up sentences with one candidate that is personal data or not."""
    rng = random.Random(seed)
    digit = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(3, 8)))
    hexa = lambda: "%x" % rng.randrange(1, 65536)

    def luhn(stem: str) -> str:
        for last in "0123456789":
            total = 0
            for i, c in enumerate(reversed(stem + last)):
                d = int(c) * (1 + i % 2)
                total += d - 9 * (d > 9)
            if total % 10 == 0:
                return stem + last
        raise AssertionError

    def phone() -> str:
        return rng.choice(
            [
                f"({rng.randint(201, 989)}) {rng.randint(200, 999)}-{digit(4)}",
                f"{rng.randint(201, 989)}-{rng.randint(200, 999)}-{digit(4)}",
                f"0{digit(rng.randint(2, 3))} {digit(3)} {digit(4)}",
                f"0{digit(1)} {digit(2)} {digit(2)} {digit(2)} {digit(2)}",
            ]
        )

    def chars(alphabet: str, n: int) -> str:
        return "".join(rng.choice(alphabet) for _ in range(n))

    lower, upper, numbers = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    def secret() -> str:
        name = rng.choice(["password", "passwd", "pwd", "token", "secret", "api_key", "access_key", "api-key"])
        sign, quote = rng.choice(["=", ": ", " = ", ":"]), rng.choice(["", "", '"', "'"])
        value = rng.choice(
            [
                chars("0123456789abcdef", rng.choice([16, 18, 32, 40])),
                chars(lower + upper + numbers, rng.randint(8, 40)),
                chars(lower + numbers + "!$#", rng.randint(8, 14)),
            ]
        )
        free = rng.choice(
            [
                rng.choice(["AK", "AS", "GK", "SK"]) + chars(upper + numbers, 18),
                rng.choice(["ghp", "sk_live", "xoxb", "pat"]) + "_" + chars(lower + upper + numbers, rng.randint(20, 40)),
                chars(lower + upper + numbers, rng.randint(28, 44)),
            ]
        )
        return free if rng.random() < 0.4 else f"{name}{sign}{quote}{value}{quote}"

    def plain_run() -> str:
        name = rng.choice(["password", "token", "secret", "api key"])
        return rng.choice(
            [
                "-".join(word() for _ in range(rng.randint(3, 5))) + f"-{digit(rng.choice([1, 4]))}",
                f"IMG_{rng.randint(1999, 2030)}{digit(4)}_{digit(6)}",
                "/".join([word(), word(), digit(4), word()]),
                f"{word()}_{word()}_{word()}_v{digit(1)}",
                f"{rng.choice(['commit', 'sha1', 'md5', 'checksum', 'etag'])} {chars('0123456789abcdef', rng.choice([32, 40]))}",
                f"{name}: {rng.choice(['required', 'expired', 'optional', 'missing', 'invalid', 'forgotten', 'unknown'])}",
            ]
        )

    amex = lambda: f"{(c := luhn('3' + rng.choice('47') + digit(12)))[:4]} {c[4:10]} {c[10:]}"
    true = {
        "email": lambda: f"{word()}{rng.choice([' at ', ' (at) ', '[at]', ' [at] '])}{word()}"
        f"{rng.choice([' dot ', ' (dot) ', '[dot]', '.'])}{rng.choice(['com', 'org', 'net', 'de', 'fr'])}",
        "ip": lambda: ":".join(hexa() for _ in range(8)),
        "card": lambda: rng.choice([amex(), luhn("3" + rng.choice("47") + digit(12))]),
        "phone": phone,
        "secret": secret,
    }
    false = {
        "email": lambda: rng.choice(
            [f"{word()} at {word()}.{word()}", f"{word()} at {word()} dot {word()}", f"look at {word()}.{rng.choice(['com', 'org'])}"]
        ),
        "ip": lambda: rng.choice(
            [f"{rng.randint(10, 23)}:{rng.randint(10, 59)}:{rng.randint(10, 59)}", ":".join(f"{rng.randrange(256):02x}" for _ in range(6))]
        ),
        "card": lambda: rng.choice([digit(4) + digit(4) + digit(rng.choice([4, 5])), f"{digit(4)}-{digit(4)}-{digit(4)}"]),
        "phone": lambda: rng.choice(
            [
                f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}",
                f"{digit(3)}-{digit(2)}-{digit(3)}",
                f"{rng.randint(10, 99)}.{digit(3)}.{digit(3)}",
                f"{rng.randint(10, 99)} {digit(2)} {digit(2)}",
                f"{rng.randint(10, 28)}/{rng.randint(10, 12)}/{rng.randint(1900, 2030)} {digit(2)}.{digit(2)}",
            ]
        ),
        "secret": plain_run,
    }
    cues = {
        "secret": ["key", "use", "credential", "secret"],
        "email": ["mail me", "contact", "write to", "reach us:"],
        "ip": ["ip", "host", "server address", "client"],
        "card": ["card", "credit card", "amex", "charge"],
        "phone": ["call", "phone:", "tel", "mobile", "fax"],
    }
    others = ["order", "invoice no", "isbn", "version", "item", "ref", "ticket", "page", "date", "build"]
    out = []
    for i in range(n):
        kind, truth = rng.choice(KINDS), rng.random() < 0.5
        body = (true if truth else false)[kind]()
        if truth:
            lead = rng.choice(cues[kind]) if rng.random() < 0.85 else word()
        else:
            lead = rng.choice([rng.choice(others), word(), word(), rng.choice(others + cues[kind])])
        glue = "" if not truth and rng.random() < 0.15 else " "
        out.append((i, f"{word()} {word()} {lead}{glue}{body}{rng.choice([' ', '. ', ', '])}{word()}", int(truth)))
    return out


_models: dict[int, tuple[list, dict[str, float]]] = {}


def model(spark: SparkSession, n: int = EXAMPLES) -> tuple[list, dict[str, float]]:
    """The fitted trees and the threshold of each kind; fitted once per process."""
    if n not in _models:
        made = spark.createDataFrame(examples(n), "number int, text string, truth int")
        made = made.withColumn("base", base_spans(F.col("text"))).withColumn(
            "one", F.explode(candidates(F.col("text"), F.col("base")))
        )
        rows = made.select("number", "truth", "one.kind", "one.features.*").orderBy("number", "one.start").collect()
        x = np.array([[r[f] if f != "kind" else float(KINDS.index(r[2])) for f in _FEATURES] for r in rows])
        y = np.array([r["truth"] for r in rows], float)
        held = np.array([r["number"] % 5 == 0 for r in rows])
        trees = boosting.fit(x[~held], y[~held])
        score = boosting.predict(trees, x)
        least = {}
        for i, kind in enumerate(KINDS):
            own = held & (x[:, -1] == i)
            order = np.argsort(-score[own], kind="stable")
            s, right = score[own][order], np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1)
            good = np.flatnonzero(right >= PRECISION)
            least[kind] = max(float(s[good[-1]]) if len(good) else float("inf"), LEAST_LOG_ODDS)
        _models[n] = (trees, least)
    return _models[n]


def _best(spans: Column) -> Column:
    """The same of a few spans that hang together."""
    ordered = F.transform(
        F.array_sort(F.transform(spans, lambda x: F.struct((-x["score"]).alias("s"), x["start"], x["end"], x["kind"], x.alias("x")))),
        lambda o: o["x"],
    )

    def step(kept: Column, x: Column) -> Column:
        clash = F.exists(kept, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
        return F.when(clash, kept).otherwise(F.array_append(kept, x))

    return F.when(F.size(spans) > 1, F.aggregate(ordered, F.slice(spans, 1, 0), step)).otherwise(spans)


def apart(spans: Column) -> Column:
    """The spans (start, end, kind, score) that no better one kept overlaps: by falling score, then start. Spans
    are chosen within runs that hang together by overlaps."""

    def chosen(ordered: Column) -> Column:
        reach = running(F.transform(ordered, lambda o: o["end"].cast("long")), lambda a, b: F.greatest(a, b))

        def of(r: Column) -> Column:
            new = lambda i: (i == 0) | (F.get(r, i - 1) <= F.get(ordered, i)["start"])
            heads = F.filter(F.sequence(F.lit(0), F.size(r) - 1), new)
            cut = lambda h: F.transform(h, lambda a, j: F.slice(ordered, a + 1, F.coalesce(F.get(h, j + 1), F.size(r)) - a))
            runs = let(heads, cut)
            return F.flatten(F.transform(runs, lambda run: _best(F.transform(run, lambda o: o["x"]))))

        return let(reach, of)

    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"], x["end"], x["kind"], x["score"].alias("score"), x.alias("x"))))
    return F.when(F.size(spans) > 1, let(ordered, chosen)).otherwise(spans)


def _computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once: a generator's output is not copied into the expressions above."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, text, base (array of kind, start, end, text) and spans (all, with
    score; null for base spans), both by kind as listed and then start."""
    trees, least = model(df.sparkSession)
    rows = df.select(F.col(f"`{id_col}`").alias(id_col), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"))
    rows = _computed(rows, "__base", base_spans(F.col("__text")))
    rows = _computed(rows, "__proposed", candidates(F.col("__text"), F.col("__base")))

    def scored(x: Column) -> Column:
        return x.withField("score", boosting.expression(trees, lambda i: x["features"][_FEATURES[i]]))

    def selected(x: Column) -> Column:
        out = F.lit(False)
        for kind, threshold in least.items():
            if threshold != float("inf"):
                out = out | ((x["kind"] == kind) & (x["score"] >= threshold))
        return out

    rows = _computed(rows, "__selected", F.filter(F.transform("__proposed", scored), selected))
    rows = _computed(rows, "__added", apart(F.col("__selected")))

    def plain(x: Column, score: Column) -> Column:
        return F.struct(
            F.array_position(F.array(*[F.lit(k) for k in KINDS]), x["kind"]).alias("order"),
            x["start"].alias("start"),
            x["end"].alias("end"),
            x["kind"].alias("kind"),
            score.alias("score"),
        )

    spans = F.array_sort(
        F.concat(
            F.transform("__base", lambda x: plain(x, F.lit(None).cast("double"))),
            F.transform("__added", lambda x: plain(x, x["score"])),
        )
    )
    return rows.select(id_col, F.col("__text").alias("text"), F.col("__base").alias("base"), spans.alias("spans"))


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, spans): texts with their spans replaced by ``[KIND]``; overlapping spans become one mark."""
    found = find(df, id_col, text_col)
    by_start = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"], s["end"], s["kind"])))
    rows = _computed(found.select(id_col, F.col("text").alias("__text"), "spans"), "__ordered", by_start)
    ends = F.transform("__ordered", lambda s: s["end"].cast("long"))
    rows = _computed(_computed(rows, "__reach", running(ends, lambda a, b: F.greatest(a, b))), "__cut", blocks(F.col("__text")))
    before = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get("__reach", i - 1))
    gap = lambda a, b: piece(F.col("__cut"), a, b)
    mark = lambda s, i: F.when(s["start"] >= before(i), F.concat(gap(before(i), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")
    last = F.coalesce(F.get("__reach", F.size("__reach") - 1), F.lit(0).cast("long"))
    text = F.concat(F.array_join(F.transform("__ordered", mark), ""), gap(last, F.length("__text").cast("long")))
    return rows.select(id_col, text.alias(text_col), "spans")
