"""Queries of packing, prompts, answers and markup over conversations, pages and line items."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import markup as mk
from textloom.functions import text as tx
from textloom.operators import prompts as pr
from textloom.operators import segments as sg
from textloom.operators import settle as st


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/conversations.parquet")


_A, _B = "substr(text, 1, 12)", "substr(text, 13)"
_SOURCE = f"concat('<span>', {_A}, '</span><span> </span><span>', {_B}, '</span>')"
_CANDIDATE = f"""CASE (conv_id + turn) % 9
    WHEN 0 THEN concat('<span>', {_A}, '</span><span> </span><span>', {_B}, '</span>')
    WHEN 1 THEN concat('<span>', {_A}, '</span><span> </span>')
    WHEN 2 THEN concat('<span>', {_A}, '</span><span> </span><span>', {_B}, '</span>tail')
    WHEN 3 THEN concat('<span> </span><span> </span><span>', {_B}, '</span>')
    WHEN 4 THEN concat('<span>', {_A}, '<span>', {_B}, '</span></span>')
    WHEN 5 THEN concat({_A}, {_B})
    WHEN 6 THEN concat('<span>', {_A}, '</span><span>x</span><span>', {_B}, '</span>')
    WHEN 7 THEN concat('<span>', {_A}, '</span><span> </span><span>', {_B}, '</span><span>c</span>')
    ELSE '' END"""
_SLIDE_SOURCE = f"concat('<span>', {_A}, '</span><span><SPACE></span><span>', {_B}, '</span>')"
_SLIDE_CANDIDATE = _CANDIDATE.replace("<span> </span>", "<span><SPACE></span>")


def _marked(spark: SparkSession, sf: str) -> DataFrame:
    return _turns(spark, sf).select(
        "conv_id", "turn", F.expr(_SOURCE).alias("source"), F.expr(_CANDIDATE).alias("candidate"),
        F.expr(_SLIDE_SOURCE).alias("slide_source"), F.expr(_SLIDE_CANDIDATE).alias("slide_candidate"),
    )


def markup_validate(spark: SparkSession, sf: str) -> DataFrame:
    """O-73 and O-74."""
    return _marked(spark, sf).select(
        "conv_id", "turn", mk.valid_document(F.col("candidate"), F.col("source")).alias("document_ok"),
        mk.valid_slide(F.col("slide_candidate"), F.col("slide_source")).alias("slide_ok"),
    )


def markup_repair(spark: SparkSession, sf: str) -> DataFrame:
    """O-75."""
    return _marked(spark, sf).select(
        "conv_id", "turn", mk.repair_document(F.col("candidate"), F.col("source")).alias("document"),
        mk.repair_slide(F.col("slide_candidate"), F.col("slide_source")).alias("slide"),
    )


def markup_settle(spark: SparkSession, sf: str) -> DataFrame:
    """O-77 and O-78: strict answer, deterministic repair, source; with counts by outcome."""
    rows = _marked(spark, sf)
    repaired = mk.repair_document(F.col("candidate"), F.col("source"))
    outcome = F.when(mk.valid_document(F.col("candidate"), F.col("source")), "strict").when(repaired.isNotNull(), "repaired").otherwise("fallback")
    return rows.select("conv_id", outcome.alias("outcome")).groupBy("conv_id", "outcome").agg(F.count(F.lit(1)).alias("n"))


def settle_turns(spark: SparkSession, sf: str) -> DataFrame:
    """O-77 and O-78: a model that gives the source's spans back for each fourth turn, and the broken answer for others."""
    model = lambda candidate, source: F.when(F.col("turn") % 4 == 0, source).otherwise(candidate)
    rows = _marked(spark, sf)
    documents = st.settle_documents(rows.select("conv_id", "turn", "candidate", "source"), "candidate", "source", model)
    slides = st.settle_slides(rows.select("conv_id", "turn", "slide_candidate", "slide_source"), "conv_id", "turn", "slide_candidate", "slide_source", model)
    first = documents.select("conv_id", "turn", F.col("outcome").alias("document"), F.md5("text").alias("document_md5"))
    return first.join(slides.select("conv_id", "turn", F.col("outcome").alias("slide"), "asked"), ["conv_id", "turn"])


def markup_escape(spark: SparkSession, sf: str) -> DataFrame:
    """O-71 and O-79 on page sources."""
    piece = F.col("html")
    cell = F.concat(F.lit("[CELL_A1]"), mk.marked_span(piece))
    return spark.read.parquet(f"{sf}/pages.parquet").select(
        "page_id", F.md5(mk.marked_span(piece).cast("binary")).alias("escaped_md5"),
        (mk.accepted_cell(cell, F.lit("CELL_A1")) == piece).alias("round_trip"),
        mk.accepted_cell(cell, F.lit("CELL_B1")).isNull().alias("wrong_marker"),
    )


def english_spacing(spark: SparkSession, sf: str) -> DataFrame:
    """O-76 on runs that end where words do or do not."""
    made = F.concat(*[F.concat(F.lit("<span>"), F.substring("text", 1 + 7 * i, 7 if i < 3 else 1 << 30), F.lit("</span>")) for i in range(4)])
    return _turns(spark, sf).select("conv_id", "turn", mk.english_spacing(made).alias("spaced"))


def html_plain_text(spark: SparkSession, sf: str) -> DataFrame:
    """O-91 on tagged text made of page sources."""
    made = F.concat(F.lit("[PAGE_1]\n[BLOCK_1]<SPAN_1>"), F.replace("html", F.lit("</p>"), F.lit("</SPAN_1>[BLOCK_2]<SPAN_1>")), F.lit("</SPAN_1>"))
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.md5(mk.plain_of_tagged(made).cast("binary")).alias("plain_md5"))


def _packed(rows: DataFrame, keys: list[str], order: str, tokens: str, packer) -> DataFrame:
    grouped = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, tokens))).alias("items"))
    grouped = grouped.withColumn("batch", packer(F.transform("items", lambda x: x[tokens])))
    out = grouped.select(*keys, F.explode(F.arrays_zip("items", "batch")).alias("x"))
    return out.select(*keys, F.col(f"x.items.{order}").alias(order), F.col(f"x.items.{tokens}").alias(tokens), F.col("x.batch").cast("long").alias("batch"))


def batch_minmax(spark: SparkSession, sf: str) -> DataFrame:
    """O-51: turns of a conversation, with ten times their estimated tokens."""
    rows = _turns(spark, sf).select("conv_id", "turn", (tx.tokens_weighted(F.col("text")) * 10).alias("tokens"))
    return _packed(rows, ["conv_id"], "turn", "tokens", sg.pack_min_max)


def batch_per_scope(spark: SparkSession, sf: str) -> DataFrame:
    """O-52: packing per scope (role), scopes numbered by first appearance."""
    from pyspark.sql import Window

    rows = _turns(spark, sf).select("conv_id", "role", "turn", (tx.tokens_weighted(F.col("text")) * 10).alias("tokens"))
    local = _packed(rows, ["conv_id", "role"], "turn", "tokens", sg.pack_min_max)
    first = F.min("turn").over(Window.partitionBy("conv_id", "role"))
    number = F.dense_rank().over(Window.partitionBy("conv_id").orderBy("scope", "batch")) - 1
    return local.withColumn("scope", first).withColumn("batch_id", number.cast("long")).select("conv_id", "turn", "batch_id")


def batch_slides(spark: SparkSession, sf: str) -> DataFrame:
    """O-53: line items as shapes, orders as decks, suppliers' remainder as slides."""
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        "l_orderkey", (F.col("l_suppkey") % 2).alias("slide"),
        (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("item"), (F.col("l_quantity") * 13).cast("long").alias("tokens"),
    )
    rows = rows.groupBy("l_orderkey", "slide", "item").agg(F.sum("tokens").alias("tokens"))
    return _packed(rows, ["l_orderkey", "slide"], "item", "tokens", sg.pack_min_max)


def batch_pages(spark: SparkSession, sf: str) -> DataFrame:
    """O-54: chunks of a page under a budget without the page marker; chunk text lengths."""
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        "l_orderkey", (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("block"), (F.col("l_quantity") * 17).cast("long").alias("tokens")
    )
    rows = rows.groupBy("l_orderkey", "block").agg(F.sum("tokens").alias("tokens"))
    packed = _packed(rows, ["l_orderkey"], "block", "tokens", lambda t: sg.pack_greedy(t, 1200 - 4))
    return packed.groupBy("l_orderkey", "batch").agg(F.count(F.lit(1)).alias("blocks"), F.sum("tokens").alias("tokens"))


def prompt_payload(spark: SparkSession, sf: str) -> DataFrame:
    """O-55: one indexed payload per conversation, and its task context."""
    rows = _turns(spark, sf).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    indexed = F.transform("t", lambda x, i: F.struct(i.alias("index"), x["text"].alias("text")))
    context = F.struct(
        F.lit("txt").alias("format"), F.lit("auto").alias("source_language"),
        F.lit("automatically identified language").alias("source_language_label"), F.lit("fr").alias("target_language"),
        F.lit("French").alias("target_language_label"),
        F.slice(F.filter(F.transform("t", lambda x: x["role"]), lambda r: tx.strip(r) != ""), 1, 5).alias("read_only_context"),
    )
    return rows.select("conv_id", F.to_json(F.struct(indexed.alias("segments"))).alias("payload"), F.to_json(context).alias("context"))


_FORMATS = ("txt", "md_quality_retry", "docx", "docx_repair", "html")
_TARGETS = ("zh-CN", "fr", " JA", "ko_KR")


def prompt_envelopes(spark: SparkSession, sf: str) -> DataFrame:
    """O-55: the whole envelope of each conversation, of five formats to four languages; the roles are context."""
    rows = _turns(spark, sf).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    pick = lambda names: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("conv_id") % len(names) + 1).cast("int"))
    texts = F.transform("t", lambda x: x["text"])
    answers = F.slice(F.transform("t", lambda x: x["role"]), 1, F.greatest(F.size("t") - (F.col("conv_id") % 3 == 0).cast("int"), F.lit(1)))
    calls = rows.select(
        "conv_id", pick(_FORMATS).alias("format"), F.when(F.col("conv_id") % 2 == 0, "en").alias("source"), pick(_TARGETS).alias("target"), texts.alias("texts"),
        F.when(F.col("conv_id") % 3 == 1, F.transform("t", lambda x: F.when(x["role"] == "user", x["role"]).otherwise(" "))).alias("context"),
        F.when(F.col("conv_id") % 5 == 3, answers).alias("candidates"),
    )
    return pr.envelopes(calls).select("conv_id", "task_context", "payload", "problem")


_ANSWER = """CASE conv_id % 5 WHEN 0 THEN p WHEN 1 THEN replace(p, '"index":1', '"index":0') WHEN 2 THEN replace(p, '"index":0', '"index":99')
    WHEN 3 THEN substr(p, 1, length(p) - 1) ELSE replace(p, '"text":"', '"text":" ') END"""


def parse_response(spark: SparkSession, sf: str) -> DataFrame:
    """O-62: whether an answer is complete, and its texts."""
    texts = F.transform("t", lambda x, i: F.struct(i.alias("index"), F.concat(F.lit("T"), x["turn"].cast("string")).alias("text")))
    rows = _turns(spark, sf).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn"))).alias("t"))
    rows = rows.select("conv_id", F.size("t").alias("n"), F.to_json(F.struct(texts.alias("segments"))).alias("p"))
    rows = rows.withColumn("parsed", F.from_json(F.expr(_ANSWER), "segments array<struct<index:int,text:string>>")["segments"])
    index = F.transform("parsed", lambda s: s["index"])
    fine = F.forall("parsed", lambda s: (s["index"] >= 0) & (s["index"] < F.col("n")) & (tx.strip(s["text"]) != ""))
    ok = F.coalesce(fine & (F.size(F.array_distinct(index)) == F.col("n")) & (F.size("parsed") == F.col("n")), F.lit(False))
    return rows.select("conv_id", ok.alias("ok"), F.when(ok, F.array_join(F.transform("parsed", lambda s: F.trim(s["text"])), "|")).alias("texts"))


def index_filters(spark: SparkSession, sf: str) -> DataFrame:
    """O-65 and O-66: answers by index per order; lenient keeps indices that occur once and are in range,
    strict wants the whole set."""
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", (F.col("l_partkey") % 4).alias("i"))
    n = F.lit(3)
    one = rows.groupBy("l_orderkey", "i").agg(F.count(F.lit(1)).alias("c"))
    return one.groupBy("l_orderkey").agg(
        F.count_if((F.col("c") == 1) & (F.col("i") < n)).alias("lenient"),
        ((F.count(F.lit(1)) == n) & (F.min("i") == 0) & (F.max("i") == n - 1)).alias("strict"),
    )


_STATUS = "CASE WHEN s IN (401, 403) THEN 'authentication_failed' WHEN s = 402 THEN 'insufficient_balance' WHEN s = 404 THEN 'model_not_found' WHEN s = 408 THEN 'timeout' WHEN s = 429 THEN 'rate_limited' WHEN s IN (400, 422) THEN 'invalid_request' WHEN s >= 500 THEN 'upstream_unavailable' ELSE 'upstream_error' END"


def http_status(spark: SparkSession, sf: str) -> DataFrame:
    """O-63 and O-64: status codes and token counts of made-up calls, summed with nulls (O-41)."""
    rows = spark.read.parquet(f"{sf}/events.parquet").select(
        F.element_at(F.array(*[F.lit(x) for x in (200, 400, 401, 402, 403, 404, 408, 418, 422, 429, 500, 503)]), (F.col("event_id") % 12 + 1).cast("int")).alias("s"),
        F.when(F.col("event_id") % 5 < 3, F.col("event_id") % 7 - 1).alias("tokens"),
    )
    counted = F.when(F.col("tokens") >= 0, F.col("tokens"))
    return rows.select(F.col("s").cast("long").alias("status"), F.expr(_STATUS).alias("code"), F.expr("s in (408, 429) or s >= 500").alias("retryable"), counted.alias("t")).groupBy(
        "status", "code", "retryable").agg(F.sum("t").alias("tokens"), F.count(F.lit(1)).alias("n"))


def cell_split(spark: SparkSession, sf: str) -> DataFrame:
    """O-82 and O-83: a row of six spans as cells of one, two and three."""
    made = F.concat(*[F.concat(F.lit("<span>"), F.substring("text", 1 + 5 * i, 5 if i < 5 else 1 << 30), F.lit("</span>")) for i in range(6)])
    counts = F.array(F.lit(1), F.lit(2), F.lit(3))
    return _turns(spark, sf).select(
        "conv_id", "turn", F.array_join(mk.take_cells(made, counts), "#").alias("cells"),
        F.array_join(mk.cell_boundaries(counts).cast("array<string>"), ",").alias("bounds"),
    )


QUERIES = {f.__name__: f for f in (
    markup_validate, markup_repair, markup_settle, settle_turns, markup_escape, english_spacing, html_plain_text, batch_minmax, batch_per_scope,
    batch_slides, batch_pages, prompt_payload, prompt_envelopes, parse_response, index_filters, http_status, cell_split,
)}


_W = pr.Wording()


def _json(value: object) -> str:
    """A value as JSON inside a SQL literal."""
    return json.dumps(value, ensure_ascii=False, separators=(",", ":")).replace("'", "''")


def _est(x: str) -> str:
    wide = f"length(regexp_replace({x}, '[\\x00-\\x7F]', '', 'g'))"
    return f"CAST(greatest(1, ceil({wide} + (length({x}) - {wide}) * 0.25)) AS BIGINT)"


def _pack_sql(items: str, keys: str, order: str, tail: str) -> str:
    """Packer with a lower bound, by recursion over the items in order."""
    on = " AND ".join(f"n.{k} = p.{k}" for k in keys.split(", "))
    shut = "(n.tokens > 800 OR (p.total > 0 AND p.total + n.tokens > 800 AND p.total < 500 AND p.count = 1))"
    big = "(n.tokens > 800)"
    fits = "(p.count = 0 OR p.total + n.tokens <= 800)"
    takes = "(p.count > 0 AND p.total < 500 AND p.count = 1)"
    here = f"CASE WHEN {big} THEN p.next + CASE WHEN p.count > 0 THEN 1 ELSE 0 END WHEN {fits} OR {takes} THEN p.next ELSE p.next + 1 END"
    return f"""
        WITH RECURSIVE items AS ({items}),
        n AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM items),
        p AS (
            SELECT {keys}, {order}, tokens, rn, 0 AS batch, CASE WHEN tokens > 800 THEN 1 ELSE 0 END AS next,
                   CASE WHEN tokens > 800 THEN 0 ELSE tokens END AS total, CASE WHEN tokens > 800 THEN 0 ELSE 1 END AS count
            FROM n WHERE rn = 1
            UNION ALL
            SELECT {', '.join('n.' + k for k in keys.split(', '))}, n.{order}, n.tokens, n.rn, {here},
                   {here} + CASE WHEN {big} THEN 1 WHEN {fits} THEN 0 WHEN {takes} THEN 1 ELSE 0 END,
                   CASE WHEN {big} THEN 0 WHEN {fits} THEN p.total + n.tokens WHEN {takes} THEN 0 ELSE n.tokens END,
                   CASE WHEN {big} THEN 0 WHEN {fits} THEN p.count + 1 WHEN {takes} THEN 0 ELSE 1 END
            FROM p JOIN n ON {on} AND n.rn = p.rn + 1
        ) {tail}"""


_TOK = f"SELECT conv_id, role, turn, {_est('text')} * 10 AS tokens FROM conversations"
_SP = lambda x: f"regexp_extract_all({x}, '(?s)<span>(.*?)</span>', 1)"
_BL = lambda x: f"NOT regexp_matches({x}, '\\S')"
_FRAME = lambda c, s: f"""(regexp_extract_all({c}, '</?(?:span|p)>') = regexp_extract_all({s}, '</?(?:span|p)>') AND len({_SP(c)}) = len({_SP(s)})
    AND {_BL(f"regexp_replace(regexp_replace({c}, '(?s)<span>(.*?)</span>', '', 'g'), '</?p>', '', 'g')")})"""  # noqa: E731
_DOC_OK = f"""({_FRAME('candidate', 'source')} AND len(list_filter(list_zip({_SP('source')}, {_SP('candidate')}),
    lambda x: NOT CASE WHEN {_BL('x[1]')} THEN x[1] = x[2] ELSE NOT ({_BL('x[2]')}) END)) = 0)"""
_VALUES = lambda c: f"""CASE WHEN len({_SP(c)}) > 0 AND {_BL(f"regexp_replace({c}, '(?s)<span>(.*?)</span>', '', 'g')")}
    AND len(list_filter({_SP(c)}, lambda v: contains(v, '<span') OR contains(v, '</span'))) = 0 THEN {_SP(c)} END"""  # noqa: E731
_MARKED = f"""marked AS (SELECT conv_id, turn, {_SOURCE} AS source, {_CANDIDATE} AS candidate, {_SLIDE_SOURCE} AS slide_source, {_SLIDE_CANDIDATE} AS slide_candidate FROM conversations)"""
_FIT = lambda chunks, n: f"CASE WHEN len({chunks}) = 0 THEN NULL WHEN len({chunks}) > {n} THEN list_concat({chunks}[1:{n} - 1], [array_to_string({chunks}[{n}:], '')]) ELSE list_resize({chunks}, {n}, '') END"
# The three slots of the made-up sources: text, protected, text.
_REPAIR = f"""
    WITH {_MARKED}, chunks AS (
        SELECT *, list_filter(string_split_regex(candidate, '(?i)</?(?:span|p)(?:\\s[^>]*)?>'), lambda c: NOT ({_BL('c')})) AS dc,
               list_filter(string_split_regex(slide_candidate, '(?i)<span[^>]*>|</span\\s*>'), lambda c: NOT ({_BL('c')}) AND c <> '<SPACE>') AS sc,
               {_SP('source')} AS slots, {_SP('slide_source')} AS sslots FROM marked
    ), sized AS (
        SELECT *, CAST(len(list_filter(slots, lambda s: NOT ({_BL('s')}))) AS BIGINT) AS dn FROM chunks
    ), fitted AS (
        SELECT *, CASE WHEN dn >= 1 THEN {_FIT('dc', 'dn')} END AS df, {_FIT('sc', '2')} AS sf2 FROM sized
    ), filled AS (
        SELECT *, CASE WHEN {_BL('slots[1]')} THEN slots[1] ELSE df[1] END AS d1,
               CASE WHEN {_BL('slots[3]')} THEN slots[3] WHEN {_BL('slots[1]')} THEN df[1] ELSE df[2] END AS d3 FROM fitted
    )"""
ORACLE = {
    "markup_validate": f"""WITH {_MARKED} SELECT conv_id, turn, {_DOC_OK} AS document_ok,
        coalesce(({_VALUES('slide_candidate')}) IS NOT NULL AND len({_VALUES('slide_candidate')}) = len({_VALUES('slide_source')})
          AND list_transform({_VALUES('slide_candidate')}, lambda v: v = '<SPACE>') = list_transform({_VALUES('slide_source')}, lambda v: v = '<SPACE>'), false) AS slide_ok FROM marked""",
    "markup_repair": _REPAIR
    + f"""SELECT conv_id, turn, CASE WHEN df IS NOT NULL AND NOT ({_BL("d1 || d3")}) AND len(list_filter(df, lambda c: contains(c, '<') OR contains(c, '>'))) = 0
            THEN '<span>' || d1 || '</span><span> </span><span>' || d3 || '</span>' END AS document,
        CASE WHEN sf2 IS NOT NULL THEN '<span>' || sf2[1] || '</span><span><SPACE></span><span>' || sf2[2] || '</span>' END AS slide FROM filled""",
    "markup_settle": _REPAIR
    + f"""SELECT conv_id, CASE WHEN {_DOC_OK} THEN 'strict' WHEN df IS NOT NULL AND NOT ({_BL("d1 || d3")})
          AND len(list_filter(df, lambda c: contains(c, '<') OR contains(c, '>'))) = 0 THEN 'repaired' ELSE 'fallback' END AS outcome, count(*) AS n FROM filled GROUP BY ALL""",
    "settle_turns": _REPAIR
    + f""", z AS (SELECT *, {_DOC_OK} AS dok, df IS NOT NULL AND NOT ({_BL("d1 || d3")}) AND len(list_filter(df, lambda c: contains(c, '<') OR contains(c, '>'))) = 0 AS drep,
          coalesce(({_VALUES('slide_candidate')}) IS NOT NULL AND len({_VALUES('slide_candidate')}) = len({_VALUES('slide_source')})
          AND list_transform({_VALUES('slide_candidate')}, lambda v: v = '<SPACE>') = list_transform({_VALUES('slide_source')}, lambda v: v = '<SPACE>'), false) AS sok,
          {_DOC_OK.replace('candidate', 'source')} AS own, ({_VALUES('slide_source')}) IS NOT NULL AS sown FROM filled),
        y AS (SELECT *, CASE WHEN {_BL('candidate')} THEN 'fallback' WHEN dok THEN 'strict' WHEN turn % 4 = 0 AND own THEN 'model' WHEN drep THEN 'repaired' ELSE 'fallback' END AS document,
              CASE WHEN {_BL('slide_candidate')} THEN 'fallback' WHEN sok THEN 'strict' WHEN turn % 4 = 0 AND sown THEN 'model' WHEN sf2 IS NOT NULL THEN 'repaired' ELSE 'fallback' END AS slide,
              NOT ({_BL('slide_candidate')}) AND NOT sok AS bad FROM z)
        SELECT conv_id, turn, document, md5(CASE document WHEN 'strict' THEN candidate WHEN 'repaired' THEN '<span>' || d1 || '</span><span> </span><span>' || d3 || '</span>' ELSE source END) AS document_md5, slide,
               CASE WHEN bad THEN row_number() OVER (PARTITION BY conv_id, bad ORDER BY turn) - 1 END AS asked FROM y""",
    "markup_escape": r"""
        WITH e AS (SELECT page_id, html, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS e FROM pages),
        c AS (SELECT *, '[CELL_A1]<span>' || e || '</span>' AS cell FROM e),
        r AS (SELECT *, replace(replace(replace(regexp_extract(cell, '(?s)^\[CELL_A1\]<span>([^<]*)</span>$', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS back FROM c)
        SELECT page_id, md5('<span>' || e || '</span>') AS escaped_md5, back = html AS round_trip, NOT starts_with(cell, '[CELL_B1]') AS wrong_marker FROM r""",
    "english_spacing": r"""
        WITH s AS (SELECT conv_id, turn, list_transform([0, 1, 2, 3], lambda i: CASE WHEN i < 3 THEN substr(text, 1 + 7 * i, 7) ELSE substr(text, 22) END) AS v FROM conversations),
        e AS (SELECT *, list_transform([1, 2, 3], lambda i: {'l': v[i], 'r': v[i + 1], 'a': right(rtrim(v[i], ' ' || chr(10) || chr(9) || chr(13)), 1), 'b': left(ltrim(v[i + 1], ' ' || chr(10) || chr(9) || chr(13)), 1)}) AS p FROM s),
        f AS (SELECT *, list_transform(p, lambda x: regexp_matches(x.a, '^[A-Za-z0-9]$') AND regexp_matches(x.b, '^[A-Za-z0-9]$')
                  AND NOT (regexp_matches(x.a, '^[0-9]$') AND regexp_matches(x.b, '^[0-9]$'))
                  AND NOT regexp_matches(x.l, '\s$') AND NOT regexp_matches(x.r, '^\s')) AS add FROM e)
        SELECT conv_id, turn, array_to_string(list_transform([1, 2, 3, 4], lambda i: '<span>' || v[i] || CASE WHEN i < 4 AND add[i] THEN ' ' ELSE '' END || '</span>'), '') AS spaced FROM f
    """,
    "html_plain_text": r"""
        WITH m AS (SELECT page_id, '[PAGE_1]' || chr(10) || '[BLOCK_1]<SPAN_1>' || replace(html, '</p>', '</SPAN_1>[BLOCK_2]<SPAN_1>') || '</SPAN_1>' AS t FROM pages),
        r AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\[PAGE_\d+\]', '', 'g'), '\[BLOCK_\d+\]', chr(10), 'g'), '</SPAN_\d+>', ' ', 'g'), '<SPAN_\d+>', '', 'g') AS t FROM m)
        SELECT page_id, md5(array_to_string(list_filter(list_transform(string_split_regex(t, '\r\n|[\n\r\x0b\x0c]'), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), lambda l: l <> ''), chr(10))) AS plain_md5 FROM r
    """,
    "batch_minmax": _pack_sql(_TOK, "conv_id", "turn", "SELECT conv_id, turn, tokens, CAST(batch AS BIGINT) AS batch FROM p"),
    "batch_per_scope": _pack_sql(_TOK, "conv_id, role", "turn", """, s AS (SELECT *, min(turn) OVER (PARTITION BY conv_id, role) AS scope FROM p)
        SELECT conv_id, turn, dense_rank() OVER (PARTITION BY conv_id ORDER BY scope, batch) - 1 AS batch_id FROM s"""),
    "batch_slides": _pack_sql("SELECT l_orderkey, l_suppkey % 2 AS slide, l_partkey * 10 + l_linenumber AS item, CAST(sum(CAST(trunc(l_quantity * 13) AS BIGINT)) AS BIGINT) AS tokens FROM lineitem GROUP BY ALL",
        "l_orderkey, slide", "item", "SELECT l_orderkey, slide, item, tokens, CAST(batch AS BIGINT) AS batch FROM p"),
    "batch_pages": """
        WITH RECURSIVE items AS (SELECT l_orderkey, l_partkey * 10 + l_linenumber AS block, CAST(sum(CAST(trunc(l_quantity * 17) AS BIGINT)) AS BIGINT) AS tokens FROM lineitem GROUP BY ALL),
        n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY block) AS rn FROM items),
        p AS (SELECT l_orderkey, tokens, rn, 0 AS batch, tokens AS total FROM n WHERE rn = 1
              UNION ALL SELECT n.l_orderkey, n.tokens, n.rn, CASE WHEN p.total + n.tokens > 1196 THEN p.batch + 1 ELSE p.batch END,
                     CASE WHEN p.total + n.tokens > 1196 THEN n.tokens ELSE p.total + n.tokens END FROM p JOIN n ON n.l_orderkey = p.l_orderkey AND n.rn = p.rn + 1)
        SELECT l_orderkey, CAST(batch AS BIGINT) AS batch, count(*) AS blocks, CAST(sum(tokens) AS BIGINT) AS tokens FROM p GROUP BY l_orderkey, batch
    """,
    "prompt_payload": """
        WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i FROM conversations)
        SELECT conv_id, '{"segments":[' || string_agg('{"index":' || i || ',"text":' || CAST(to_json(text) AS VARCHAR) || '}', ',' ORDER BY i) || ']}' AS payload,
               '{"format":"txt","source_language":"auto","source_language_label":"automatically identified language","target_language":"fr","target_language_label":"French","read_only_context":['
               || string_agg('"' || role || '"', ',' ORDER BY i) FILTER (i < 5) || ']}' AS context
        FROM t GROUP BY conv_id
    """,
    "prompt_envelopes": f"""
        WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
        u AS (SELECT *, conv_id % 5 = 3 AS repair, greatest(n - CASE WHEN conv_id % 3 = 0 THEN 1 ELSE 0 END, 1) AS many FROM t),
        g AS (SELECT conv_id, any_value(repair AND many <> n) AS odd,
                     '{{"segments":[' || string_agg('{{"index":' || i || ',"text":' || CAST(to_json(text) AS VARCHAR) || CASE WHEN repair AND i < many THEN ',"candidate":"' || role || '"' ELSE '' END || '}}', ',' ORDER BY i) || ']}}' AS payload,
                     list('"' || role || '"' ORDER BY i) FILTER (role = 'user') AS ctx FROM u GROUP BY conv_id),
        c AS (SELECT *, {list(_FORMATS)!r}[conv_id % 5 + 1] AS format, {list(_TARGETS)!r}[conv_id % 4 + 1] AS target, ['Simplified Chinese', 'French', 'Japanese', 'ko_KR'][conv_id % 4 + 1] AS label FROM g)
        SELECT conv_id, CASE WHEN NOT odd THEN payload END AS payload, CASE WHEN odd THEN 'candidate_count' END AS problem,
               '{{"format":"' || format || '","prompt_version":"{_W.version}","source_language":"' || CASE WHEN conv_id % 2 = 0 THEN 'en","source_language_label":"English' ELSE 'auto","source_language_label":"automatically identified language' END
               || '","target_language":"' || target || '","target_language_label":"' || label || '"'
               || CASE conv_id % 5 {" ".join(f"WHEN {i} THEN ',\"format_constraints\":{_json(_W.constraints[f])}'" for i, f in enumerate(("txt", "md", "docx", "docx_repair")))} ELSE '' END
               || CASE WHEN conv_id % 5 = 2 THEN CASE WHEN conv_id % 4 = 0 THEN ',"format_example":{_json(_W.examples["docx", "zh"])}' ELSE ',"format_example":{_json(_W.examples["docx", "en"])}' END ELSE '' END
               || CASE WHEN conv_id % 3 = 1 AND len(ctx) > 0 THEN ',"read_only_context":[' || array_to_string(ctx[1:5], ',') || ']' ELSE '' END
               || CASE WHEN conv_id % 5 = 1 THEN ',"retry_reason":{_json(_W.retry)}' ELSE '' END || '}}' AS task_context FROM c
    """,
    "parse_response": """
        WITH t AS (SELECT conv_id, list(turn ORDER BY turn) AS t, count(*) AS n FROM conversations GROUP BY conv_id),
        p AS (SELECT conv_id, n, '{"segments":[' || array_to_string(list_transform(t, lambda x, i: '{"index":' || (i - 1) || ',"text":"T' || x || '"}'), ',') || ']}' AS p FROM t),
        a AS (SELECT conv_id, n, CASE conv_id % 5 WHEN 0 THEN p WHEN 1 THEN replace(p, '"index":1', '"index":0') WHEN 2 THEN replace(p, '"index":0', '"index":99')
                     WHEN 3 THEN substr(p, 1, length(p) - 1) ELSE replace(p, '"text":"', '"text":" ') END AS a FROM p),
        j AS (SELECT conv_id, n, CASE WHEN json_valid(a) THEN CAST(json_extract(a, '$.segments[*].index') AS INTEGER[]) END AS idx, CASE WHEN json_valid(a) THEN json_extract_string(a, '$.segments[*].text') END AS txt FROM a),
        o AS (SELECT *, coalesce(list_sort(idx) = range(n), false) AS ok FROM j)
        SELECT conv_id, ok, CASE WHEN ok THEN array_to_string(list_transform(txt, lambda x: trim(x)), '|') END AS texts FROM o""",
    "index_filters": """
        WITH one AS (SELECT l_orderkey, l_partkey % 4 AS i, count(*) AS c FROM lineitem GROUP BY ALL)
        SELECT l_orderkey, count(*) FILTER (c = 1 AND i < 3) AS lenient, count(*) = 3 AND min(i) = 0 AND max(i) = 2 AS strict FROM one GROUP BY l_orderkey
    """,
    "http_status": f"""
        WITH r AS (SELECT [200, 400, 401, 402, 403, 404, 408, 418, 422, 429, 500, 503][event_id % 12 + 1] AS s, CASE WHEN event_id % 5 < 3 THEN event_id % 7 - 1 END AS tokens FROM events)
        SELECT CAST(s AS BIGINT) AS status, {_STATUS} AS code, s IN (408, 429) OR s >= 500 AS retryable, CAST(sum(tokens) FILTER (tokens >= 0) AS BIGINT) AS tokens, count(*) AS n FROM r GROUP BY ALL
    """,
    "cell_split": """
        WITH s AS (SELECT conv_id, turn, list_transform([0, 1, 2, 3, 4, 5], lambda i: '<span>' || CASE WHEN i < 5 THEN substr(text, 1 + 5 * i, 5) ELSE substr(text, 26) END || '</span>') AS v, [1, 2, 3] AS counts FROM conversations),
        b AS (SELECT *, list_transform(counts, lambda c, i: CAST(list_sum(counts[1:i]) AS BIGINT)) AS ends FROM s)
        SELECT conv_id, turn, array_to_string(list_transform(ends, lambda e, i: array_to_string(v[e - counts[i] + 1:e], '')), '#') AS cells, array_to_string(ends, ',') AS bounds FROM b""",
}
