"""Drop rejected rows without moving the texts that stay, where the rejected are few."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrain.operators.joins import fits_broadcast


def row_key(*columns: str) -> Column:
    """128 bits that tell rows apart by the values of some columns, nulls included."""
    marked = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]
    return F.struct(F.xxhash64(F.lit(1), *marked).alias("a"),
                    F.xxhash64(F.lit(2), *marked).alias("b"))


def without(docs: DataFrame, key: Column, rejected: DataFrame) -> DataFrame:
    """Rows whose key is not in ``rejected`` (one column, ``key``).

    The rejected keys are measured: up to the limit of ``fits_broadcast`` they are
    broadcast and nothing is shuffled; beyond, both sides are shuffled by key.
    """
    keys = rejected.select(F.col("key").alias("_key"))
    marked = docs.withColumn("_key", key)
    found = F.broadcast(keys) if fits_broadcast(keys) else keys.distinct()
    return marked.join(found, "_key", "left_anti").drop("_key")
