"""Joining many rows with one row of statistics per key, safe for hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has at least 1/HOT_SHARE of all rows, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 256


def join_stats(big: DataFrame, stats: DataFrame, keys: list[str], weight: str, salt: str, keep: str | None = None) -> DataFrame:
    """Inner join of `big` with `stats` (unique on `keys`; `weight` counts a key's rows in `big`).

    Keys with 1/HOT_SHARE of the summed weight or more are at most HOT_SHARE rows: these are broadcast, and their rows
    of `big` are spread by a hash of column `salt`. All other rows meet in a shuffle join on the keys. `keep` is a
    predicate on `stats` (SQL text) which rows must satisfy to be in the result; it is applied after hot keys are told.
    Null keys match nothing. No row is lost or repeated.
    """
    total = stats.agg(F.sum(weight).alias("n")).scalar()
    values = [c for c in stats.columns if c not in keys]
    packed = stats.select(*keys, F.struct(*values, F.expr(keep or "true").alias("__keep")).alias("__s"), (F.col(weight) * HOT_SHARE >= total).alias("__hot"))
    hot = packed.where("__hot").select(*keys, F.col("__s").alias("__h"))
    cold = packed.where("NOT __hot AND __s.__keep").select(*keys, F.lit(0).alias("__salt"), F.col("__s").alias("__c"))
    spread = F.when(F.col("__h").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(salt), F.lit(1 << 16)).cast("int"))
    left = big.join(F.broadcast(hot), keys, "left").where("__h IS NULL OR __h.__keep").withColumn("__salt", spread)
    joined = left.join(cold, [*keys, "__salt"], "left").withColumn("__v", F.coalesce("__h", "__c")).where("__v IS NOT NULL")
    return joined.select(*big.columns, *[F.col(f"__v.{c}").alias(c) for c in values])
