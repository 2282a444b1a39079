"""Lookup joins that hold up when one key carries a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 500_000
MAX_BROADCAST_BYTES = 128 * 1024 * 1024


def fits_broadcast(dims: DataFrame, max_rows: int = MAX_BROADCAST_ROWS,
                   max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Measure (one aggregate job) whether a table may be broadcast."""
    width = F.octet_length(F.to_json(F.struct(*dims.columns))).cast("long")
    rows, size = dims.agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).head()
    return rows <= max_rows and size <= max_bytes


def salted_lookup(facts: DataFrame, dims: DataFrame, keys: list[str], salt_by: list[str],
                  salts: int = 32, how: str = "left") -> DataFrame:
    """Lookup by shuffle: each dimension row is copied ``salts`` times and the fact
    rows of one key spread over that many tasks."""
    left = facts.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int"))
    right = dims.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def frequent_split_lookup(facts: DataFrame, dims: DataFrame, key: str, weight: str,
                          spread_by: list[str] | None = None, frequent: int = 1000) -> DataFrame:
    """Inner lookup of one value by a string key when the table tells how often each occurs.

    The ``frequent`` keys of largest weight are broadcast, and their fact rows are not
    shuffled (``spread_by`` once dealt them out; it has no effect). The rest is joined by
    shuffle, where no key can hold more than one part in ``frequent`` of the total weight.
    ``facts`` are read twice.
    """
    top = dims.orderBy(F.desc(weight), key).limit(frequent).select(
        key, F.col(weight).alias("_weight"))
    known = F.broadcast(top.select(key))
    rest = dims.join(known, key, "left_anti").select(
        F.col(key).alias("_key"), F.col(weight).alias("_weight"))
    others = facts.join(known, key, "left_anti").join(
        rest, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    found = facts.join(F.broadcast(top), key).unionByName(others)
    return found.filter("_weight IS NOT NULL").withColumn(weight, F.col("_weight")).drop("_weight")


def lookup(facts: DataFrame, dims: DataFrame, keys: list[str], salt_by: list[str],
           how: str = "left") -> DataFrame:
    """Look rows up in a table unique on ``keys``: broadcast if it measures small
    enough, else :func:`salted_lookup`."""
    if fits_broadcast(dims):
        return facts.join(F.broadcast(dims), keys, how)
    return salted_lookup(facts, dims, keys, salt_by, how=how)


def first_per_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One whole row per key, the one with the smallest ``order``.

    An aggregate with map-side combine, so any number of copies of one key shrinks
    to one row per input partition before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def last_per_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One whole row per key, the one with the largest ``order``."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)
