"""What the endpoints offer, as functions from tables to tables: providers with their models, and resource packs.

Every method returns a new object; tables are never changed in place, so a caller decides what to write."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators import inventory as inv


@dataclass(frozen=True)
class Providers:
    """``configs``: provider, active and settings; ``models``: the columns of ``inventory.COLUMNS`` (O-198)."""

    configs: DataFrame
    models: DataFrame

    def listed(self) -> DataFrame:
        """Models of all configured providers with their place in the list."""
        return inv.listed(self.models.join(self.configs.select("provider"), "provider", "left_semi"))

    def discovered(self, remote: DataFrame) -> DataFrame:
        return inv.discover(self.models.select("provider", "model_id", "upstream", "name", "source"), remote)

    def synced(self, items: DataFrame) -> "Providers":
        return replace(self, models=inv.merge(self.models, items).drop("change"))

    def enabled(self, provider: Column, ids: Column) -> "Providers":
        """The models of a provider with the given ids are enabled, its others disabled."""
        wanted = F.array_contains(inv.normalise_ids(ids), F.col("model_id"))
        own = F.col("provider") == provider
        return replace(self, models=self.models.withColumn("enabled", F.when(own, wanted).otherwise(F.col("enabled"))))

    def activated(self, provider: Column) -> "Providers":
        """One provider is active, if there is one of that name; else nothing changes."""
        rows = self.configs.withColumn("__new", F.col("provider") == provider)
        any_new = rows.agg(F.max("__new").alias("__any"))  # one row
        rows = rows.join(F.broadcast(any_new), F.lit(True))
        return replace(self, configs=rows.withColumn("active", F.when(F.col("__any"), F.col("__new")).otherwise(F.col("active"))).drop("__new", "__any"))

    def configured(self, fresh: DataFrame) -> "Providers":
        """Configurations written over those of the same providers."""
        kept = self.configs.join(fresh.select("provider"), "provider", "left_anti")
        return replace(self, configs=kept.unionByName(fresh))

    def deleted(self, provider: Column) -> "Providers":
        """Without a provider and its models."""
        keep = F.col("provider") != provider
        return Providers(self.configs.where(keep), self.models.where(keep))


@dataclass(frozen=True)
class Resources:
    """``assets``: id, pack, size, ready, partial (O-199)."""

    assets: DataFrame

    def status(self) -> DataFrame:
        return inv.pack_progress(self.assets)

    def _changed(self, ids: list[str], packs: list[str], ready: Column, partial: Column) -> "Resources":
        own = (F.col("id").isin(ids) | F.col("pack").isin(packs)) if ids or packs else F.lit(True)
        changed = {"ready": F.when(own, ready).otherwise(F.col("ready")), "partial": F.when(own, partial).otherwise(F.col("partial"))}
        return Resources(self.assets.withColumns(changed))

    def installed(self, ids: list[str], packs: list[str]) -> "Resources":
        return self._changed(ids, packs, F.lit(True), F.lit(None).cast("int"))

    def cancelled(self, ids: list[str], packs: list[str]) -> "Resources":
        """What was in transfer is dropped; what is ready stays."""
        return self._changed(ids, packs, F.col("ready"), F.lit(None).cast("int"))
