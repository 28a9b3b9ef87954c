"""Queries of job metadata and inventories over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import inventory as inv
from textloom.operators import jobs as jb
from textloom.service import Providers, Resources


def _view(spark: SparkSession, sf: str, name: str, sql: str) -> DataFrame:
    table = spark.read.parquet(f"{sf}/{name}.parquet")
    return table.selectExpr(*[c.strip() for c in sql.split(";")])


_SNAPSHOT = (
    "user_id * 20 + event_id % 20 AS job; event_id; CASE WHEN event_id % 17 = 0 THEN 2 WHEN event_id % 5 = 0 THEN 0 ELSE 1 END AS stage; "
    "CASE WHEN event_id % 17 = 0 THEN 10 WHEN event_id % 5 = 0 THEN 0 ELSE event_id % 11 END AS processed; "
    "CASE WHEN event_id % 17 <> 0 AND event_id % 5 = 0 THEN 0 WHEN event_id % 19 = 0 THEN 9 ELSE 10 END AS total"
)


def progress_fold(spark: SparkSession, sf: str) -> DataFrame:
    """O-164 and O-165."""
    return jb.fold_progress(_view(spark, sf, "events", _SNAPSHOT), "job", ["event_id"])


_ACTIONS = "user_id * 20 + event_id % 20 AS job; event_id; CASE event_id % 7 WHEN 0 THEN 'cancel' WHEN 1 THEN 'fail' WHEN 2 THEN 'succeed' ELSE 'run' END AS action"


def job_transitions(spark: SparkSession, sf: str) -> DataFrame:
    """O-163 and O-166."""
    return jb.fold_status(_view(spark, sf, "events", _ACTIONS), "job", ["event_id"])


def dedup_latest(spark: SparkSession, sf: str) -> DataFrame:
    """O-171: the newest event of each user and type."""
    rows = _view(spark, sf, "events", "user_id; event_type; event_id; ts")
    return jb.latest(rows, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


def staged_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """O-172: best rank of each user's event types, against a stored table of the same."""
    rows = _view(spark, sf, "events", "user_id; concat('keychain:provider/', event_type) AS ref; event_id; ts")
    fresh = jb.staged_candidates(rows, "user_id", "ref", [F.desc("ts"), F.desc("event_id")], F.col("ref").like("keychain:provider/%"))
    stored = _view(spark, sf, "customer", "c_custkey AS user_id; 'keychain:provider/click' AS ref; cast(c_custkey % 9 + 1 as bigint) AS priority")
    return jb.upsert_least(stored, fresh, ["user_id", "ref"], "priority")


def recent_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """O-161 and O-162: the 30 newest orders with their line numbers as artifacts."""
    top = jb.recent(_view(spark, sf, "orders", "o_orderkey; o_orderdate; o_orderstatus"), "o_orderdate", "o_orderkey", 30)
    items = _view(spark, sf, "lineitem", "l_orderkey AS o_orderkey; l_linenumber")
    with_items = F.broadcast(top).join(items, "o_orderkey", "left").groupBy("o_orderkey", "o_orderstatus")
    return with_items.agg(F.concat_ws(",", F.array_sort(F.collect_list(F.col("l_linenumber").cast("string")))).alias("artifacts"))


_JOB = "o_orderkey AS id; CASE o_orderkey % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'succeeded' WHEN 3 THEN 'failed' ELSE 'cancelled' END AS status; cast(null as string) AS error_code; concat('Report ', o_orderkey % 100, '.docx') AS source_name; lower(o_orderpriority) AS model_id"


def startup_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """O-167, by outcome."""
    return jb.sweep(_view(spark, sf, "orders", _JOB)).groupBy("status", "error_code").agg(F.count(F.lit(1)).alias("n"))


def history_filter(spark: SparkSession, sf: str) -> DataFrame:
    """O-196 and the fixed columns of O-195."""
    return jb.history_filter(_view(spark, sf, "orders", _JOB), "running", " URGENT ").select("id", "status", "source_name")


def artifact_replace(spark: SparkSession, sf: str) -> DataFrame:
    """O-166 and O-175: stored artifacts from a parent column, replaced where a new set exists."""
    stored = _view(spark, sf, "orders", "o_orderkey AS job; 'translated' AS kind; concat('/out/', o_orderkey) AS path").where("path IS NOT NULL")
    fresh = _view(spark, sf, "lineitem", "l_orderkey AS job; concat('part-', l_linenumber) AS kind; concat('/new/', l_orderkey, '/', l_linenumber) AS path")
    return jb.replace_children(stored, fresh.where("kind = 'part-7'").distinct(), "job")


def enum_remap(spark: SparkSession, sf: str) -> DataFrame:
    """O-174: statuses renamed, null where there is no new name."""
    name = F.when(F.col("o_orderstatus") == "F", "formatting").when(F.col("o_orderstatus") == "O", "extracting")
    return _view(spark, sf, "orders", "o_orderstatus").groupBy(name.alias("stage")).agg(F.count(F.lit(1)).alias("n"))


def options_json(spark: SparkSession, sf: str) -> DataFrame:
    """O-168 and O-170: tolerant read of JSON columns, checked languages."""
    rows = _view(spark, sf, "events", "event_id; CASE WHEN event_id % 9 = 0 THEN substr(props, 2) ELSE props END AS raw; CASE event_id % 4 WHEN 0 THEN 'auto' WHEN 1 THEN '' WHEN 2 THEN ' en ' ELSE 'fr' END AS lang")
    parsed = F.from_json("raw", "page string, ref string")
    language = F.when(~F.trim("lang").isin("", "auto"), F.trim("lang"))
    return rows.select("event_id", F.col("raw").isNotNull().alias("stored"), parsed.isNull().alias("null_options"), language.alias("language"))


def path_tail_recursive(spark: SparkSession, sf: str) -> DataFrame:
    """O-173: the last component of a path by recursion."""
    _view(spark, sf, "pages", "page_id AS id; replace(url, '\\\\', '/') AS value").createOrReplaceTempView("textloom_paths")
    return spark.sql(
        """
        WITH RECURSIVE tail(id, value) AS (
            SELECT id, value FROM textloom_paths
            UNION ALL
            SELECT id, substr(value, instr(value, '/') + 1) FROM tail WHERE instr(value, '/') > 0
        )
        SELECT id, coalesce(nullif(value, ''), 'document') AS name FROM tail WHERE instr(value, '/') = 0
        """
    )


_CURRENT = "cast(s_suppkey % 5 as int) AS provider; concat('m', s_suppkey) AS model_id; concat('u', s_suppkey) AS upstream; s_name AS name; CASE s_suppkey % 3 WHEN 0 THEN 'catalog' WHEN 1 THEN 'remote' ELSE 'manual' END AS source; s_suppkey % 2 = 0 AS enabled; s_suppkey % 4 <> 0 AS available"
_ITEMS = "cast(c_custkey % 5 as int) AS provider; concat('m', c_custkey + CASE WHEN c_custkey % 7 = 0 THEN 100000 ELSE 0 END) AS model_id; concat('u', c_custkey + CASE WHEN c_custkey % 11 = 0 THEN 200000 ELSE 0 END) AS upstream; c_name AS name; CASE WHEN c_custkey % 6 < 3 THEN 'remote' ELSE 'catalog' END AS source"


def _current(spark, sf):
    return _view(spark, sf, "supplier", _CURRENT)


def _items(spark, sf):
    return _view(spark, sf, "customer", _ITEMS)


def inventory_merge(spark: SparkSession, sf: str) -> DataFrame:
    """O-180, by change."""
    return inv.merge(_current(spark, sf), _items(spark, sf).where("model_id <> 'm33'"))


def discovery_merge(spark: SparkSession, sf: str) -> DataFrame:
    """O-182."""
    catalog = _current(spark, sf).select("provider", "model_id", "upstream", "name", "source")
    return inv.discover(catalog, _items(spark, sf))


def manual_merge(spark: SparkSession, sf: str) -> DataFrame:
    """O-183."""
    both = _current(spark, sf).select("provider", "model_id", "upstream", "name", "source").unionByName(_items(spark, sf))
    return inv.prefer(both, ["provider", "model_id"])


def catalog_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """O-184."""
    return inv.overlay(_current(spark, sf), _items(spark, sf))


def probe_save(spark: SparkSession, sf: str) -> DataFrame:
    """O-181 and O-188."""
    probed = _view(spark, sf, "customer", "cast(c_custkey % 3 as int) AS provider; concat('m', c_custkey) AS model_id; c_custkey % 90 AS latency_ms")
    return inv.save_probe(_current(spark, sf), probed)


def default_model(spark: SparkSession, sf: str) -> DataFrame:
    """O-185."""
    rows = _current(spark, sf).withColumn("n", F.substring("model_id", 2, 20).cast("long"))
    requested = F.when(F.col("provider") == 1, "m11")
    existing = F.when(F.col("provider") == 2, "m32").when(F.col("provider") == 3, "gone")
    return inv.default_model(rows, requested, existing, (F.col("source") == "catalog") & (F.col("provider") != 4), F.col("n"))


def catalog_integrity(spark: SparkSession, sf: str) -> DataFrame:
    """O-189 and O-16."""
    providers = _view(spark, sf, "nation", "concat('p', n_nationkey % 20) AS id")
    models = _view(spark, sf, "part", "concat('m', p_partkey) AS id")
    pairs = _view(spark, sf, "lineitem", "concat('p', l_suppkey % 23) AS provider; concat('m', l_partkey + CASE WHEN l_partkey % 500 = 0 THEN 1000000 ELSE 0 END) AS model_id")
    return inv.integrity(providers, models, pairs)


def pack_progress(spark: SparkSession, sf: str) -> DataFrame:
    """O-190."""
    assets = _view(spark, sf, "part", "p_brand AS pack; p_size * 1000 AS size; p_partkey % 3 <> 0 OR p_brand = 'Brand#1' AS ready; CASE WHEN p_partkey % 6 = 0 THEN 2500 END AS partial")
    return inv.pack_progress(assets)


def provider_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    """O-198: providers are configured, one is activated, its models are enabled by id, another is deleted."""
    configs = _current(spark, sf).select("provider").distinct().select("provider", (F.col("provider") == 0).alias("active"), F.lit("old").alias("settings"))
    fresh = configs.where("provider IN (1, 3)").select("provider", "active", F.lit("new").alias("settings"))
    now = Providers(configs, _current(spark, sf)).configured(fresh).activated(F.lit(3)).activated(F.lit(77))
    now = now.enabled(F.lit(3), F.array(F.lit(" m3 "), F.lit("m8"), F.lit("m8"), F.lit(""))).deleted(F.lit(2))
    return now.listed().select("provider", "model_id", "enabled", "place").join(now.configs, "provider")


def resource_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    """O-199: one pack and one asset are installed, the transfers of another pack are cancelled."""
    assets = _view(spark, sf, "part", "concat('a', p_partkey) AS id; p_brand AS pack; p_size * 1000 AS size; p_partkey % 3 <> 0 AS ready; CASE WHEN p_partkey % 6 = 0 THEN 2500 END AS partial")
    return Resources(assets).installed(["a6"], ["Brand#2"]).cancelled([], ["Brand#3"]).status()


def asset_selection(spark: SparkSession, sf: str) -> DataFrame:
    """O-191, O-17 and O-187."""
    assets = _view(spark, sf, "part", "concat('a', p_partkey) AS id; p_brand AS pack; p_size AS size")
    ids = inv.normalise_ids(F.array(F.concat(F.lit(" "), F.col("id")), F.col("id"), F.lit(" "), F.col("pack")))
    return inv.select_assets(assets, ["a1", "a7"], ["Brand#2"]).select("id", "pack", F.concat_ws("|", ids).alias("ids"))


QUERIES = {f.__name__: f for f in (
    progress_fold, job_transitions, dedup_latest, staged_candidates, recent_jobs, startup_sweep, history_filter, artifact_replace,
    enum_remap, options_json, path_tail_recursive, inventory_merge, discovery_merge, manual_merge, catalog_overlay, probe_save,
    default_model, catalog_integrity, pack_progress, provider_endpoints, resource_endpoints, asset_selection,
)}


def _select(view: str, table: str) -> str:
    return f"SELECT {view.replace(';', ',').replace('cast(null as string)', 'CAST(NULL AS VARCHAR)')} FROM {table}"


_C, _I = _select(_CURRENT, "supplier"), _select(_ITEMS, "customer")
ORACLE = {
    "progress_fold": f"""
        WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY event_id) AS rn FROM ({_select(_SNAPSHOT, 'events')})),
        f AS (SELECT DISTINCT job, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS accepted, CAST(0 AS BIGINT) AS stage, CAST(0 AS BIGINT) AS processed, CAST(0 AS BIGINT) AS total FROM e
              UNION ALL
              SELECT f.job, e.rn, CASE WHEN ok THEN f.accepted + 1 ELSE f.accepted END, CASE WHEN ok THEN e.stage ELSE f.stage END,
                     CASE WHEN ok THEN e.processed ELSE f.processed END, CASE WHEN ok THEN e.total ELSE f.total END
              FROM f JOIN e ON e.job = f.job AND e.rn = f.rn + 1,
              LATERAL (SELECT e.processed <= e.total AND (e.stage > f.stage OR (e.stage = f.stage AND e.processed >= f.processed AND e.total = f.total)) AS ok))
        SELECT job, accepted, stage, processed, total, CAST(CASE WHEN stage = 0 THEN 0 WHEN stage = 2 THEN 100 WHEN total = 0 THEN 0 ELSE processed * 100 // total END AS BIGINT) AS progress
        FROM f QUALIFY row_number() OVER (PARTITION BY job ORDER BY rn DESC) = 1
    """,
    "job_transitions": f"""
        WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY event_id) AS rn FROM ({_select(_ACTIONS, 'events')})),
        f AS (SELECT DISTINCT job, CAST(0 AS BIGINT) AS rn, 'queued' AS status, CAST(0 AS BIGINT) AS applied FROM e
              UNION ALL
              SELECT f.job, e.rn, coalesce(t, f.status), f.applied + CASE WHEN t IS NULL THEN 0 ELSE 1 END
              FROM f JOIN e ON e.job = f.job AND e.rn = f.rn + 1,
              LATERAL (SELECT CASE WHEN action = 'run' AND status = 'queued' THEN 'running' WHEN action = 'cancel' AND status = 'queued' THEN 'cancelled'
                                   WHEN action = 'fail' AND status <> 'cancelled' THEN 'failed' WHEN action = 'succeed' THEN 'succeeded' END AS t))
        SELECT job, status, applied FROM f QUALIFY row_number() OVER (PARTITION BY job ORDER BY rn DESC) = 1
    """,
    "dedup_latest": "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "staged_candidates": """
        WITH r AS (SELECT user_id, 'keychain:provider/' || event_type AS ref, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank, count(*) OVER (PARTITION BY user_id) AS many FROM events),
        f AS (SELECT user_id, ref, min(rank) AS priority FROM r WHERE many > 1 GROUP BY user_id, ref),
        s AS (SELECT c_custkey AS user_id, 'keychain:provider/click' AS ref, c_custkey % 9 + 1 AS priority FROM customer)
        SELECT coalesce(f.user_id, s.user_id) AS user_id, coalesce(f.ref, s.ref) AS ref, CAST(least(f.priority, s.priority) AS BIGINT) AS priority
        FROM f FULL JOIN s ON f.user_id = s.user_id AND f.ref = s.ref
    """,
    "recent_jobs": """
        WITH t AS (SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 30)
        SELECT o_orderkey, o_orderstatus, coalesce(string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)), '') AS artifacts
        FROM t LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus
    """,
    "startup_sweep": f"SELECT CASE WHEN status IN ('queued', 'running') THEN 'failed' ELSE status END AS status, CASE WHEN status IN ('queued', 'running') THEN 'process_interrupted' END AS error_code, count(*) AS n FROM ({_select(_JOB, 'orders')}) GROUP BY ALL",
    "history_filter": f"SELECT id, status, source_name FROM ({_select(_JOB, 'orders')}) WHERE status IN ('queued', 'running') AND (contains(lower(source_name), 'urgent') OR contains(lower(model_id), 'urgent'))",
    "artifact_replace": """
        WITH f AS (SELECT DISTINCT l_orderkey AS job, 'part-7' AS kind, '/new/' || l_orderkey || '/7' AS path FROM lineitem WHERE l_linenumber = 7)
        SELECT o_orderkey AS job, 'translated' AS kind, '/out/' || o_orderkey AS path FROM orders WHERE o_orderkey NOT IN (SELECT job FROM f) UNION ALL SELECT * FROM f
    """,
    "enum_remap": "SELECT CASE o_orderstatus WHEN 'F' THEN 'formatting' WHEN 'O' THEN 'extracting' END AS stage, count(*) AS n FROM orders GROUP BY ALL",
    "options_json": """
        SELECT event_id, props IS NOT NULL AS stored, props IS NULL AS null_options,
               CASE event_id % 4 WHEN 2 THEN 'en' WHEN 3 THEN 'fr' END AS language FROM events
    """,
    "path_tail_recursive": r"SELECT page_id AS id, coalesce(nullif(list_extract(string_split(replace(url, '\', '/'), '/'), -1), ''), 'document') AS name FROM pages",
    "inventory_merge": f"""
        WITH c AS ({_C}), i AS (SELECT * FROM ({_I}) WHERE model_id <> 'm33'),
        m AS (SELECT i.*, coalesce(u.model_id, k.model_id) AS known FROM i LEFT JOIN c u ON u.provider = i.provider AND u.upstream = i.upstream
              LEFT JOIN c k ON k.provider = i.provider AND k.model_id = i.model_id)
        SELECT c.provider, c.model_id, coalesce(m.upstream, c.upstream) AS upstream,
               CASE WHEN m.known IS NOT NULL AND NOT (c.source = 'manual' AND m.source <> 'catalog') THEN m.name ELSE c.name END AS name,
               CASE WHEN m.known IS NOT NULL AND NOT (c.source = 'manual' AND m.source <> 'catalog') THEN m.source ELSE c.source END AS source,
               c.enabled, CASE WHEN m.known IS NOT NULL THEN true WHEN c.source = 'remote' THEN false ELSE c.available END AS available,
               CASE WHEN m.known IS NOT NULL AND c.available THEN 'unchanged' WHEN m.known IS NOT NULL THEN 'restored'
                    WHEN c.source = 'remote' AND c.available THEN 'unavailable' ELSE 'kept' END AS change
        FROM c LEFT JOIN m ON m.provider = c.provider AND m.known = c.model_id
        UNION ALL SELECT provider, model_id, upstream, name, source, false, true, 'added' FROM m WHERE known IS NULL
    """,
    "discovery_merge": f"""
        WITH c AS ({_C}), i AS ({_I})
        SELECT provider, model_id, upstream, name, source FROM c UNION ALL
        SELECT provider, model_id, upstream, name, source FROM i
        WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.provider = i.provider AND (c.upstream = i.upstream OR c.model_id = i.model_id))
        QUALIFY row_number() OVER (PARTITION BY provider, upstream ORDER BY model_id) = 1
    """,
    "manual_merge": f"""
        SELECT provider, model_id, upstream, name, source FROM (SELECT provider, model_id, upstream, name, source FROM ({_C}) UNION ALL SELECT * FROM ({_I}))
        QUALIFY row_number() OVER (PARTITION BY provider, model_id ORDER BY CASE source WHEN 'catalog' THEN 0 WHEN 'manual' THEN 1 ELSE 2 END, model_id, name) = 1
    """,
    "catalog_overlay": f"""
        SELECT coalesce(c.provider, i.provider) AS provider, coalesce(c.model_id, i.model_id) AS model_id, coalesce(i.upstream, c.upstream) AS upstream,
               coalesce(i.name, c.name) AS name, CASE WHEN i.upstream IS NOT NULL THEN 'catalog' ELSE c.source END AS source, coalesce(c.enabled, false) AS enabled
        FROM ({_C}) c FULL JOIN ({_I}) i ON c.provider = i.provider AND c.model_id = i.model_id
    """,
    "probe_save": f"""
        WITH c AS ({_C}), p AS (SELECT CAST(c_custkey % 3 AS INT) AS provider, concat('m', c_custkey) AS model_id, c_custkey % 90 AS latency_ms FROM customer)
        SELECT coalesce(c.provider, p.provider) AS provider, coalesce(c.model_id, p.model_id) AS model_id, coalesce(c.name, p.model_id) AS name, coalesce(c.source, 'remote') AS source,
               CASE WHEN p.model_id IS NOT NULL THEN true WHEN c.provider IN (SELECT provider FROM p) THEN false ELSE c.enabled END AS enabled,
               CASE WHEN p.model_id IS NOT NULL THEN 'succeeded' ELSE 'not_tested' END AS probe_status, p.latency_ms
        FROM c FULL JOIN p ON c.provider = p.provider AND c.model_id = p.model_id
    """,
    "default_model": f"""
        WITH r AS (SELECT *, CAST(substr(model_id, 2) AS BIGINT) AS n FROM ({_C}))
        SELECT provider, model_id FROM r QUALIFY row_number() OVER (PARTITION BY provider ORDER BY
            CASE WHEN provider = 1 AND model_id = 'm11' THEN 0 WHEN provider = 2 AND model_id = 'm32' THEN 1 WHEN source = 'catalog' AND provider <> 4 THEN 2 ELSE 3 END, n) = 1
    """,
    "catalog_integrity": """
        WITH p AS (SELECT 'p' || (n_nationkey % 20) AS id FROM nation), m AS (SELECT 'm' || p_partkey AS id FROM part),
        x AS (SELECT 'p' || (l_suppkey % 23) AS provider, 'm' || (l_partkey + CASE WHEN l_partkey % 500 = 0 THEN 1000000 ELSE 0 END) AS model_id FROM lineitem)
        SELECT 'duplicate provider' AS problem, id AS item FROM p GROUP BY id HAVING count(*) > 1
        UNION ALL SELECT 'duplicate model', id FROM m GROUP BY id HAVING count(*) > 1
        UNION ALL SELECT 'duplicate pair', provider || '/' || model_id FROM x GROUP BY ALL HAVING count(*) > 1
        UNION ALL SELECT DISTINCT 'unknown provider', provider FROM x WHERE provider NOT IN (SELECT id FROM p)
        UNION ALL SELECT DISTINCT 'unknown model', model_id FROM x WHERE model_id NOT IN (SELECT id FROM m)
    """,
    "pack_progress": """
        WITH a AS (SELECT p_brand AS pack, p_size * 1000 AS size, p_partkey % 3 <> 0 OR p_brand = 'Brand#1' AS ready, CASE WHEN p_partkey % 6 = 0 THEN 2500 END AS part FROM part)
        SELECT coalesce(pack, '(all)') AS pack, CAST(sum(size) AS BIGINT) AS size_bytes, CAST(sum(CASE WHEN ready THEN size ELSE least(coalesce(part, 0), size) END) AS BIGINT) AS completed_bytes, bool_and(ready) AS ready
        FROM a GROUP BY GROUPING SETS ((pack), ())
    """,
    "provider_endpoints": f"""
        WITH m AS (SELECT provider, model_id, CASE WHEN provider = 3 THEN model_id IN ('m3', 'm8') ELSE enabled END AS enabled FROM ({_C}) WHERE provider <> 2)
        SELECT provider, model_id, enabled, row_number() OVER (PARTITION BY provider ORDER BY enabled DESC, model_id) AS place, provider = 3 AS active, CASE WHEN provider IN (1, 3) THEN 'new' ELSE 'old' END AS settings FROM m""",
    "resource_endpoints": """
        WITH a AS (SELECT p_brand AS pack, p_size * 1000 AS size, p_partkey % 3 <> 0 OR p_brand = 'Brand#2' OR p_partkey = 6 AS ready, CASE WHEN p_partkey % 6 = 0 AND p_brand <> 'Brand#3' THEN 2500 END AS part FROM part)
        SELECT coalesce(pack, '(all)') AS pack, CAST(sum(size) AS BIGINT) AS size_bytes, CAST(sum(CASE WHEN ready THEN size ELSE least(coalesce(part, 0), size) END) AS BIGINT) AS completed_bytes, bool_and(ready) AS ready
        FROM a GROUP BY GROUPING SETS ((pack), ())""",
    "asset_selection": "SELECT 'a' || p_partkey AS id, p_brand AS pack, 'a' || p_partkey || '|' || p_brand AS ids FROM part WHERE p_partkey IN (1, 7) OR p_brand = 'Brand#2'",
}
