"""Joins of many rows with one row a key, where a key may hold a third of all rows (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key of more rows is spread over SALTS tasks.
HOT = 1000
SALTS = 16
#: Hashes of keys that are told apart when hot ones are marked: the bound of what is broadcast.
BUCKETS = 1 << 16


def join_spread(many: DataFrame, few: DataFrame, keys: list[str], size: str, by: list[str], how: str = "inner") -> DataFrame:
    """``many`` joined with ``few`` on ``keys``. ``few`` has a key once, and in ``size`` the number of its rows in
    ``many``. Keys whose hash falls into a bucket with a hot key stand SALTS times in ``few``, and their rows go
    to one of them by a hash of ``by``; all others stand once, so only hot keys cost more."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
    hot = few.where(F.col(size) > HOT).select(bucket.alias("__bucket")).distinct().withColumn("__hot", F.lit(True))

    def marked(df: DataFrame) -> DataFrame:
        return df.withColumn("__bucket", bucket).join(F.broadcast(hot), "__bucket", "left").drop("__bucket")

    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*by), F.lit(SALTS))).otherwise(0).cast("int")
    salts = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = marked(many).withColumn("__salt", salt).drop("__hot")
    right = marked(few).withColumn("__salt", F.explode(salts)).drop("__hot")
    return left.join(right, [*keys, "__salt"], how).drop("__salt")
