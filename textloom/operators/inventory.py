"""Model inventories as tables: merge, discovery, overlay, selection, integrity, packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ("provider", "model_id", "upstream", "name", "source", "enabled", "available")


def _matched(current: DataFrame, items: DataFrame) -> DataFrame:
    """Items with the model id of the stored row that they are: by upstream id, then by model id."""
    up = current.select("provider", "upstream", F.col("model_id").alias("by_up"))
    own = current.select("provider", "model_id", F.col("model_id").alias("by_id"))
    joined = items.join(up, ["provider", "upstream"], "left").join(own, ["provider", "model_id"], "left")
    return joined.withColumn("known", F.coalesce("by_up", "by_id"))


def merge(current: DataFrame, items: DataFrame) -> DataFrame:
    """Stored models after a sync with the discovered ``items`` (O-180): new ones come in disabled, known
    ones are seen again, remote ones not seen become unavailable. ``change`` says what happened."""
    found = _matched(current, items)
    new = found.where("known IS NULL").select(
        "provider", "model_id", "upstream", "name", "source", F.lit(False).alias("enabled"), F.lit(True).alias("available"),
        F.lit("added").alias("change"),
    )
    seen = found.where("known IS NOT NULL").select(
        "provider", F.col("known").alias("model_id"), F.col("upstream").alias("new_upstream"),
        F.col("name").alias("new_name"), F.col("source").alias("new_source"),
    )
    rows = current.join(seen, ["provider", "model_id"], "left")
    here = F.col("new_source").isNotNull()
    manual = (F.col("source") == "manual") & (F.col("new_source") != "catalog")
    gone = ~here & (F.col("source") == "remote") & F.col("available")
    kept = rows.select(
        "provider", "model_id",
        F.coalesce("new_upstream", "upstream").alias("upstream"),
        F.when(here & ~manual, F.col("new_name")).otherwise(F.col("name")).alias("name"),
        F.when(here & ~manual, F.col("new_source")).otherwise(F.col("source")).alias("source"),
        "enabled",
        F.when(here, True).when(gone, False).otherwise(F.col("available")).alias("available"),
        F.when(here & F.col("available"), "unchanged").when(here, "restored").when(gone, "unavailable").otherwise("kept").alias("change"),
    )
    return kept.unionByName(new)


def discover(catalog: DataFrame, remote: DataFrame) -> DataFrame:
    """The catalog and the remote models that it has under neither id; of equal ones the first (O-182)."""
    fresh = remote.join(catalog.select("provider", "upstream"), ["provider", "upstream"], "left_anti").join(
        catalog.select("provider", "model_id"), ["provider", "model_id"], "left_anti"
    )
    first = Window.partitionBy("provider", "upstream").orderBy("model_id")
    fresh = fresh.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return catalog.unionByName(fresh.select(catalog.columns))


def prefer(rows: DataFrame, key: list[str], source: str = "source") -> DataFrame:
    """One row per key by precedence catalog, manual, remote (O-183)."""
    order = F.when(F.col(source) == "catalog", 0).when(F.col(source) == "manual", 1).otherwise(2)
    w = Window.partitionBy(*key).orderBy(order, "model_id", "name")
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def overlay(stored: DataFrame, catalog: DataFrame) -> DataFrame:
    """Stored models with the catalog's names over them, and those only the catalog has (O-184)."""
    c = catalog.select("provider", "model_id", F.col("upstream").alias("c_up"), F.col("name").alias("c_name"))
    rows = stored.join(c, ["provider", "model_id"], "full")
    return rows.select(
        "provider", "model_id", F.coalesce("c_up", "upstream").alias("upstream"), F.coalesce("c_name", "name").alias("name"),
        F.when(F.col("c_up").isNotNull(), "catalog").otherwise(F.col("source")).alias("source"),
        F.coalesce("enabled", F.lit(False)).alias("enabled"),
    )


def save_probe(stored: DataFrame, probed: DataFrame) -> DataFrame:
    """Stored models after a probe (O-181): probed ones are enabled with their latency, others of the same
    provider are disabled, columns the probe does not set stay."""
    touched = probed.select("provider").distinct().withColumn("__hit", F.lit(True))
    p = probed.select("provider", "model_id", F.col("latency_ms").alias("new_latency"), F.lit(True).alias("__probed"))
    rows = stored.join(p, ["provider", "model_id"], "full").join(touched, "provider", "left")
    hit = F.coalesce("__probed", F.lit(False))
    return rows.select(
        "provider", "model_id", F.coalesce("name", "model_id").alias("name"), F.coalesce("source", F.lit("remote")).alias("source"),
        F.when(hit, True).when(F.col("__hit"), False).otherwise(F.col("enabled")).alias("enabled"),
        F.when(hit, "succeeded").otherwise("not_tested").alias("probe_status"),
        F.col("new_latency").alias("latency_ms"),
    )


def default_model(rows: DataFrame, requested: Column, existing: Column, is_default: Column, order: Column) -> DataFrame:
    """One model per provider: the requested one, the existing one, the first default, the first (O-185)."""
    rank = F.when(F.col("model_id") == requested, 0).when(F.col("model_id") == existing, 1).when(is_default, 2).otherwise(3)
    return rows.groupBy("provider").agg(F.min_by("model_id", F.struct(rank, order)).alias("model_id"))


def normalise_ids(ids: Column) -> Column:
    """Trimmed, without blanks and repeats, in order (O-187)."""
    return F.array_distinct(F.filter(F.transform(ids, lambda x: F.trim(x)), lambda x: x != ""))


def integrity(providers: DataFrame, models: DataFrame, pairs: DataFrame) -> DataFrame:
    """Problems of a catalog: duplicate ids and pairs, references to nothing (O-189)."""
    twice = lambda df, c, what: df.groupBy(c.alias("item")).count().where("count > 1").select(F.lit(what).alias("problem"), "item")
    pair = F.concat_ws("/", F.col("provider"), F.col("model_id"))
    lost = lambda key, known, what: (
        pairs.join(known.select(F.col("id").alias(key)), key, "left_anti").select(F.lit(what).alias("problem"), F.col(key).alias("item")).distinct()
    )
    return (
        twice(providers, F.col("id"), "duplicate provider")
        .unionByName(twice(models, F.col("id"), "duplicate model"))
        .unionByName(twice(pairs, pair, "duplicate pair"))
        .unionByName(lost("provider", providers, "unknown provider"))
        .unionByName(lost("model_id", models, "unknown model"))
    )


def pack_progress(assets: DataFrame) -> DataFrame:
    """Size, completed bytes and readiness per pack and in total (O-190); ``assets`` has pack, size, ready
    and partial (bytes of the one in transfer, else null)."""
    done = F.when(F.col("ready"), F.col("size")).otherwise(F.least(F.coalesce("partial", F.lit(0)), F.col("size")))
    rows = assets.withColumn("done", done)
    return rows.rollup("pack").agg(
        F.sum("size").alias("size_bytes"), F.sum("done").alias("completed_bytes"), F.bool_and("ready").alias("ready")
    ).withColumn("pack", F.coalesce("pack", F.lit("(all)")))


def select_assets(assets: DataFrame, ids: list[str], packs: list[str]) -> DataFrame:
    """Assets with a requested id or pack; all if nothing is requested (O-191)."""
    return assets.where(F.col("id").isin(ids) | F.col("pack").isin(packs)) if ids or packs else assets


def listed(models: DataFrame) -> DataFrame:
    """Models with their place in the list of their provider: enabled ones first, then by id (O-186)."""
    order = Window.partitionBy("provider").orderBy(F.desc("enabled"), "model_id")
    return models.withColumn("place", F.row_number().over(order).cast("long"))
