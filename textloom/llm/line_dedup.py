"""Operator 4: line deduplication by a deletion-neighbourhood join (DataFrame functions only).

The edit distance counts whole words inserted, deleted or replaced; the bound is one. A line goes when
an earlier line of the corpus (by document id, then line number) has the same words, or, for lines of
at least ``min_words`` words, is within the bound; lines are judged on the input, so a line that goes
itself still counts as earlier. Blank lines always stay.

1. Equal lines meet by a 128-bit hash of their words, combined before the shuffle.
2. Lines within the bound have the first or the last half of their words in common (an edit lies in
   one half only); distinct lines that share no half with another are out of the join without loss.
3. Of the others every variant with one word deleted is emitted as a hashed key with the place of
   the deletion. Two lines differ by a replaced word exactly when variants with the same place are
   equal, and by an inserted word when one line equals a variant of the other; so a key needs only
   its earliest line, and a key with a third of all lines is one group-by minimum, not pairs.
4. Each match is verified on the words themselves: common prefix and suffix must leave at most one
   word.
5. Documents lose the lines found, by line number.

Only the half that is not shared is varied: the other one is part of the key. Rows that go back to the earliest line of their key meet it in ``SALTS`` places, so a key with a third
of all rows is no single task. A variant of a line up to ``LONG`` words is hashed as a string; longer lines
get theirs from running sums over their words, so no line takes quadratic work. Rests of ``LONG`` and
``LONG + 1`` words have both kinds of keys: no pair falls between.

Defined results: lines end at ``\\n``; words are ``[^\\x20\\x09-\\x0D]+``; a null text stays null and has no
lines; rows with the same id count as one document (all lose the same line numbers); rows with a
null id are returned as they are; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.arrays import let, running
from textloom.llm.scratch import materialize

#: Shorter lines go only if equal: in four words an edit leaves under 0.8 of them.
MIN_WORDS = 5
LONG = 256
SALTS = 8


def normalised(text: Column) -> Column:
    """Single spaces for all runs of blanks but line ends; lines may still begin or end with one."""
    plain = ~text.rlike(r"[\x09\x0B\x0C\x0D]") & ~F.contains(text, F.lit("  "))
    return F.when(plain, text).otherwise(F.regexp_replace(text, r"[\x20\x09\x0B\x0C\x0D]+", " "))


def _split(text: Column) -> Column:
    """The lines of a text, to be trimmed."""
    return F.split(normalised(text), "\n", -1)


def _hashes(value: Column) -> tuple[Column, Column]:
    return F.xxhash64(value), F.xxhash64(F.lit(7), value)


def _count(line: Column) -> Column:
    """Words of a normalised line that is not empty."""
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _words(line: Column, many: Column) -> Column:
    """The first ``many`` words of a normalised line, or the last ones where it is negative."""
    return F.call_function("substring_index", line, F.lit(" "), many)


def _half(place: Column, n: Column) -> Column:
    """How many words the half key at this place of a line's keys covers; of the last ones if negative."""
    size = F.when(place < 2, F.floor((n - 1) / 2)).otherwise(F.floor(n / 2)).cast("int")
    return F.when(place % 2 == 0, size).otherwise(-size)


def _half_keys(line: Column, n: Column) -> Column:
    """Hashes of the first and the last p words, p = half of n - 1 and, for even n, of n."""
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    key = lambda p, end: F.xxhash64(F.lit(end), p, _words(line, p if end == "first" else -p))
    two = [key(low, "first"), key(low, "last")]
    return F.when(low == high, F.array(*two)).otherwise(F.array(*two, key(high, "first"), key(high, "last")))


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """(id, line, h1, h2, keys) of every line that is not blank."""
    # The outer form keeps the optimiser from splitting twice, once to filter.
    lines = docs.where("id IS NOT NULL").select("id", F.posexplode_outer(_split(F.col("text"))).alias("line", "raw"))
    lines = lines.select("id", "line", F.trim("raw").alias("words")).where("words <> ''")
    lines = lines.withColumn("n", _count(F.col("words")))  # used often: stays a projection of its own
    h1, h2 = _hashes(F.col("words"))
    keys = F.when(F.col("n") >= min_words, _half_keys(F.col("words"), F.col("n")))
    return lines.select("id", "line", h1.alias("h1"), h2.alias("h2"), keys.alias("keys"))


def _meet(many: DataFrame, few: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Inner join of ``many`` with ``few``, which has a key once: its rows stand in SALTS places, where the rows
    of ``many`` go by a hash of ``by``."""
    dealt = many.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))
    everywhere = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(everywhere, [*keys, "salt"]).drop("salt")


def _parts(held: DataFrame) -> DataFrame:
    """(id, line, half, kept, rest, n) of (id, line, words, place): ``rest`` are the n words beside the half at
    that place, which another line shares."""
    words, p, many = F.col("words"), F.col("half"), F.col("many")
    held = held.withColumn("many", _count(words)).withColumn("half", _half(F.col("place"), many))
    rest = F.when(p == 0, words).otherwise(_words(words, F.when(p > 0, p - many).otherwise(p + many)))
    return held.select("id", "line", "half", _words(words, p).alias("kept"), rest.alias("rest"), (many - F.abs(p)).alias("n"))


def _short_keys() -> Column:
    """(place, v1, v2) for a rest and its variants as strings: place 0 is the whole, place p has lost word p."""
    rest, n = F.col("rest"), F.col("n")
    key = lambda less: [F.xxhash64(F.lit(seed), "half", "kept", less).alias(f"v{seed}") for seed in (1, 2)]

    def less(place: Column) -> Column:
        inside = (place > 1) & (place < n)
        return F.concat(_words(rest, place - 1), F.when(inside, F.lit(" ")).otherwise(F.lit("")), _words(rest, place - n))

    one = lambda place: let(F.when(place == 0, rest).otherwise(less(place)), lambda text: F.struct(place.alias("place"), *key(text)))
    return F.transform(F.sequence(F.lit(0), n), one)


def _long_keys() -> Column:
    """The same from running sums. A sequence's hash is the XOR of the hashes of its words with their places, so the
    one without word p is that of the words before it and of the words after it moved up by one: with the XOR of
    both hashes of each word summed up to p, that of word p in its place, and that of all words moved up."""
    xor = Column.bitwiseXOR
    base = F.xxhash64("half", "kept")

    def sums(words: Column, seed: int) -> Column:
        stay = F.transform(words, lambda w, i: F.xxhash64(F.lit(seed), w, i))
        move = F.transform(words, lambda w, i: F.xxhash64(F.lit(seed), w, i - 1))
        total = lambda v: F.aggregate(v, F.lit(0).cast("long"), xor)
        both = lambda s: let(move, lambda m: F.struct(s.alias("stay"), running(F.zip_with(s, m, xor), xor).alias("upto"), total(s).alias("whole"), total(m).alias("moved")))
        return let(stay, both)

    def keys(words: Column) -> Column:
        key = lambda seed, value: F.xxhash64(F.lit(seed), base, value).alias(f"v{seed}")
        less = lambda s, p: xor(xor(F.get(s["upto"], p), F.get(s["stay"], p)), s["moved"])
        some = lambda a, b: F.concat(
            F.array(F.struct(F.lit(0).alias("place"), key(1, a["whole"]), key(2, b["whole"]))),
            F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda p: F.struct((p + 1).alias("place"), key(1, less(a, p)), key(2, less(b, p)))),
        )
        return let(sums(words, 11), lambda a: let(sums(words, 13), lambda b: some(a, b)))

    return let(F.split("rest", " ", -1), keys)


def _variants(parts: DataFrame) -> DataFrame:
    """(id, line, place, v1, v2): the keys of every rest and of its variants."""
    none = F.expr("cast(array() as array<struct<place:int,v1:bigint,v2:bigint>>)")
    short, long = F.when(F.col("n") <= LONG + 1, _short_keys()).otherwise(none), F.when(F.col("n") >= LONG, _long_keys()).otherwise(none)
    keys = F.when(F.col("n") < LONG, short).otherwise(F.concat(short, long))
    # The outer form keeps the optimiser from computing the keys twice, once to filter.
    return parts.select("id", "line", F.explode_outer(keys).alias("key")).select("id", "line", "key.*")


def _common_prefix(a: Column, b: Column) -> Column:
    differs = F.transform(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda same: ~same)
    at = F.array_position(differs, F.lit(True))
    return F.when(at > 0, at - 1).otherwise(F.greatest(F.size(a), F.size(b)))


def within_one(a: Column, b: Column) -> Column:
    """Whether two word arrays are at most one inserted, deleted or replaced word apart."""
    longer = F.greatest(F.size(a), F.size(b))
    rest = longer - _common_prefix(a, b) - _common_prefix(F.reverse(a), F.reverse(b))
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (rest <= 1)


def _near(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(h1, h2) of the distinct lines that have an earlier line within the bound of one edit."""
    member = distinct.where("keys IS NOT NULL").select("h1", "h2", F.posexplode("keys").alias("place", "key"))
    shared = member.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where("many > 1").select("key")
    some = _meet(member, shared, ["key"], ["h1"]).groupBy("h1", "h2").agg(F.collect_set("place").alias("places"))
    some = materialize(some, "line-halves")
    # The words of these lines, from the first document that has them.
    wanted = distinct.join(some, ["h1", "h2"]).groupBy(F.col("first.id").alias("id")).agg(
        F.collect_set(F.struct("first.line", "places")).alias("wanted")
    )
    held = docs.join(wanted, "id").select("id", "wanted", _split(F.col("text")).alias("content"))
    held = held.select("id", "content", F.explode("wanted").alias("one"))
    held = held.select("id", "one.line", "one.places", F.trim(F.get("content", F.col("one.line"))).alias("words"))
    h1, h2 = _hashes(F.col("words"))
    held = materialize(held.select("*", h1.alias("h1"), h2.alias("h2")).dropDuplicates(["h1", "h2"]), "near-lines")
    held = held.where("words <> ''")
    halves = held.select("id", "line", "words", F.explode("places").alias("place"))
    parts = _parts(halves)
    every = materialize(_variants(parts), "variants")
    every = every.select(F.struct("id", "line").alias("first"), "place", "v1", "v2")
    variants, whole = every.where("place > 0"), every.where("place = 0").drop("place")
    key = ["v1", "v2"]
    # A replaced word: the earliest line with this variant at this place.
    least = variants.groupBy(*key, "place").agg(F.min("first").alias("other"), F.count(F.lit(1)).alias("many"))
    least = least.where("many > 1").drop("many")
    replaced = _meet(variants, least, [*key, "place"], ["first"]).where("other < first").select("first", "other")
    # An inserted word: a line against the lines of which it is a variant, both ways.
    longer = _meet(variants, whole.select(*key, F.col("first").alias("shorter")), key, ["first"])
    inserted = longer.groupBy("shorter").agg(F.min("first").alias("other")).where("other < shorter")
    deleted = longer.groupBy("first").agg(F.min("shorter").alias("other")).where("other < first")
    matches = replaced.unionByName(inserted.withColumnRenamed("shorter", "first")).unionByName(deleted).distinct()
    split = F.split("words", " ", -1)
    mine = held.select(F.struct("id", "line").alias("first"), "h1", "h2", split.alias("mine"))
    theirs = held.select(F.struct("id", "line").alias("other"), split.alias("theirs"))
    checked = matches.join(mine, "first").join(theirs, "other").where(within_one(F.col("mine"), F.col("theirs")))
    return checked.select("h1", "h2").distinct()


def drops(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, gone): the line numbers (from 0) that each document loses; only documents that lose some."""
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    lines = materialize(_lines(docs, min_words), "lines")
    distinct = materialize(
        lines.groupBy("h1", "h2").agg(
            F.min(F.struct("id", "line")).alias("first"), F.count(F.lit(1)).alias("many"), F.first("keys").alias("keys")
        ),
        "distinct-lines",
    )
    near = materialize(_near(docs, distinct).withColumn("near", F.lit(True)), "near")
    touched = distinct.select("h1", "h2", "first", "many").join(near, ["h1", "h2"], "left")
    touched = touched.where("many > 1 OR near").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    gone = _meet(lines.select("id", "line", "h1", "h2"), touched, ["h1", "h2"], ["id", "line"])
    gone = gone.where(F.col("near") | (F.struct("id", "line") != F.col("first")))
    return gone.groupBy("id").agg(F.collect_set("line").alias("gone"))


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``df`` with the kept lines as text, and n_lines and n_dropped after its own columns (names of
    ``df`` come first: columns of these names are replaced)."""
    found = drops(df, id_col, text_col, min_words).select(F.col("id").alias("__id"), F.col("gone").alias("__gone"))
    names = [c for c in df.columns if c not in ("n_lines", "n_dropped")]
    whole, gone, lines = F.col(f"`{text_col}`"), F.col("__gone"), F.col("__lines")
    joined = df.join(found, F.col(f"`{id_col}`") == F.col("__id"), "left")
    # A generator's output is computed once, a projection in every use.
    split = F.array(F.struct(F.when(gone.isNotNull(), F.split(whole, "\n", -1)).alias("__lines")))
    joined = joined.select("*", F.inline(split))
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    ends = F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit("")))
    text = F.when(gone.isNull(), whole).otherwise(F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n"))
    return joined.select(
        *[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in names],
        F.when(whole.isNull(), 0).otherwise(ends + 1).cast("long").alias("n_lines"),
        F.when(gone.isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_dropped"),
    )
