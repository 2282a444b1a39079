"""Global order, positions and neighbours without a one-task window.

Rows fall into value ranges of a unique numeric key; windows run per range, and a
table with one row per range carries what crosses the borders. Ranges come from
the values, not from task ids, so a recomputed task gives the same answer.
"""

from __future__ import annotations

from math import isqrt

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SMALL_TOP = 1000  # up to here one task may take n rows of every task


def with_ranges(df: DataFrame, key: str, ranges: int | None = None) -> DataFrame:
    """Add ``_range``: the value range of the key, about equal in rows."""
    wanted = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = df.select(F.col(key).cast("double").alias("k"))
    cuts = sorted(set(keys.approxQuantile(
        "k", [i / wanted for i in range(1, wanted)], 1 / (4 * wanted)))) if wanted > 1 else []
    if not cuts:
        return df.withColumn("_range", F.lit(0.0))
    bucketizer = Bucketizer(splits=[float("-inf"), *cuts, float("inf")],
                            inputCol="_key", outputCol="_range", handleInvalid="keep")
    return bucketizer.transform(df.withColumn("_key", F.col(key).cast("double"))).drop("_key")


def with_position(df: DataFrame, key: str, name: str = "pos",
                  ranges: int | None = None) -> DataFrame:
    """Add the 0-based global position by a unique numeric key."""
    ranged = with_ranges(df, key, ranges)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (  # one row per range
        ranged.groupBy("_range").agg(F.count("*").alias("_n"))
        .select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")))
    within = Window.partitionBy("_range").orderBy(key)
    return (
        ranged.join(F.broadcast(offsets), "_range")
        .withColumn(name, F.col("_offset") + F.row_number().over(within) - 1)
        .drop("_range", "_offset"))


def with_previous(df: DataFrame, key: str, value: str, name: str = "previous",
                  ranges: int | None = None) -> DataFrame:
    """Add the value of the row right before in key order (null for the first)."""
    ranged = with_ranges(df, key, ranges)
    carried = (  # one row per range
        ranged.groupBy("_range").agg(F.max_by(value, key).alias("_last"))
        .select("_range", F.lag("_last").over(Window.orderBy("_range")).alias("_carried")))
    within = Window.partitionBy("_range").orderBy(key)
    first = F.row_number().over(within) == 1
    return (
        ranged.join(F.broadcast(carried), "_range")
        .withColumn(name, F.when(first, F.col("_carried")).otherwise(F.lag(value).over(within)))
        .drop("_range", "_carried"))


def drop_repeats(df: DataFrame, key: str, value: str) -> DataFrame:
    """Drop rows whose value equals that of the row right before them."""
    return (with_previous(df, key, value, "_previous")
            .filter(F.col("_previous").isNull() | (F.col("_previous") != F.col(value)))
            .drop("_previous"))


def top_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows in a total order.

    Spark's own top-k sends n rows of every task to one task. For a large n that is
    too many, so groups of tasks are cut to n rows first; any grouping gives the
    same rows.
    """
    if n > SMALL_TOP:
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        groups = max(1, isqrt(tasks))
        grouped = df.withColumn("_group", F.spark_partition_id() % groups)
        rank = F.row_number().over(Window.partitionBy("_group").orderBy(*order))
        df = grouped.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank", "_group")
    return df.orderBy(*order).limit(n)


def head(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first ``n`` rows by key."""
    return top_rows(df, [F.asc(key)], n)


def slice_rows(df: DataFrame, key: str, start: int = 0, stop: int | None = None,
               step: int = 1) -> DataFrame:
    """Rows ``start:stop:step`` in key order."""
    placed = with_position(df, key)
    keep = (F.col("pos") >= start) & (F.pmod(F.col("pos") - start, F.lit(step)) == 0)
    return placed.filter(keep if stop is None else keep & (F.col("pos") < stop))


def pick_rows(df: DataFrame, key: str, positions: DataFrame) -> DataFrame:
    """Rows at an explicit table of positions (column ``pos``)."""
    return with_position(df, key).join(positions.select("pos"), "pos", "left_semi")


def sort_for_output(df: DataFrame, *keys: str) -> DataFrame:
    """Range-partition and sort, so written files follow the order."""
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)
