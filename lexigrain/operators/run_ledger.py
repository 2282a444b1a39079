"""Run statistics kept up to date by increments.

A delivery of entries becomes partial sums per run and feed, which add up in any order.
Each delivery has a folder of its own in the ledger, so one that is repeated after a
failure overwrites itself. Both tables are cut by day, and a delivery rewrites only the
days of the runs it touches: a late file costs its own days, not the history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain.operators.feeds import run_grid

DAY = 86_400
PARTIALS = "run_id long, feed_name string, n long, latency_sum double, n_timed long, n_failed long"
STATISTICS = ("run_id long, feed_name string, article_count long, article_avg double, "
              "failed_count long, deliveries long, last_delivery string")


def partial_sums(entries: DataFrame, failed: Column | None = None, run: str = "run_id",
                 feed: str = "feed_name", latency: str = "latency") -> DataFrame:
    """Mergeable sums per run and feed: entries, their latencies (nulls apart), failures."""
    return entries.groupBy(F.col(run).cast("long").alias("run_id"),
                           F.col(feed).alias("feed_name")).agg(
        F.count("*").alias("n"), F.sum(F.col(latency).cast("double")).alias("latency_sum"),
        F.count(latency).alias("n_timed"),
        F.count_if(F.lit(False) if failed is None else failed).alias("n_failed"))


def merged_statistics(partials: DataFrame) -> DataFrame:
    """(run_id, feed_name, article_count, article_avg, failed_count, deliveries,
    last_delivery) from the partial sums of all deliveries."""
    return partials.groupBy("run_id", "feed_name").agg(
        F.sum("n").alias("article_count"),
        (F.sum("latency_sum") / F.nullif(F.sum("n_timed"), F.lit(0))).alias("article_avg"),
        F.sum("n_failed").alias("failed_count"), F.count("*").alias("deliveries"),
        F.max("delivery").alias("last_delivery"))


def deliver(entries: DataFrame, delivery: str, ledger: str, statistics: str,
            failed: Column | None = None) -> None:
    """Take a delivery into the ledger and bring the statistics of its days up to date.

    ``entries`` have ``run_id``, ``feed_name`` and ``latency``. A delivery of a name that
    is in the ledger replaces it, so it may be repeated; it must still touch every day that
    it touched. Rows without a run belong to none and are left out.
    """
    spark = entries.sparkSession
    partials = partial_sums(entries.filter(F.col("run_id").isNotNull()), failed).withColumn(
        "day", F.floor(F.col("run_id") / DAY).cast("long")).persist()
    touched = _days(partials)
    gone = _days(_read(spark, ledger, f"delivery={delivery}")) - touched
    if gone:
        raise ValueError(f"delivery {delivery} no longer has entries of days {sorted(gone)}")
    partials.write.mode("overwrite").partitionBy("day").parquet(f"{ledger}/delivery={delivery}")
    partials.unpersist()
    if touched:
        of_days = _read(spark, ledger, "delivery=*").filter(F.col("day").isin(sorted(touched)))
        merged_statistics(of_days).withColumn(
            "day", F.floor(F.col("run_id") / DAY).cast("long")).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("day").parquet(statistics)


def _read(spark: SparkSession, ledger: str, deliveries: str) -> DataFrame:
    schema = f"{PARTIALS}, delivery string, day long"
    try:
        return spark.read.schema(schema).option("basePath", ledger).parquet(
            f"{ledger}/{deliveries}")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def _days(partials: DataFrame) -> set[int]:
    """One number for each day of the calendar."""
    return {r.day for r in partials.select("day").distinct().collect()}


def read_statistics(spark: SparkSession, statistics: str) -> DataFrame:
    return spark.read.schema(f"{STATISTICS}, day long").parquet(statistics).drop("day")


def with_silent_feeds(current: DataFrame, catalogue: DataFrame) -> DataFrame:
    """The columns of ``feeds.run_statistics``: zero for feeds of the catalogue without entries."""
    grid = run_grid(current.select("run_id").distinct(), catalogue, "run_id", "feed_name")
    return grid.join(current, ["run_id", "feed_name"], "left").select(
        "run_id", "feed_name", F.coalesce("article_count", F.lit(0)).alias("article_count"),
        F.coalesce("article_avg", F.lit(0.0)).alias("article_avg"),
        F.coalesce("failed_count", F.lit(0)).alias("failed_count"))
