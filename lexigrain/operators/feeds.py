"""Feed runs: run buckets and per-run statistics (batch forms)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrain.operators.joins import fits_broadcast
from lexigrain.operators.rows import RUN_SECONDS


PARTS = 64  # of a catalogue that is too large for one array


def epoch_seconds(ts: Column) -> Column:
    """Seconds since the epoch with fraction."""
    return F.unix_micros(ts.cast("timestamp")).cast("double") / 1e6


def run_bucket(seconds: Column, window: int = RUN_SECONDS) -> Column:
    """The nearest multiple of ``window`` seconds, halves upwards (not a floor)."""
    return (F.round(seconds / F.lit(float(window))) * window).cast("long")


def run_statistics(entries: DataFrame, catalogue: DataFrame, run: str = "run_id",
                   feed: str = "feed_name", latency: str = "latency",
                   failed: Column | None = None) -> DataFrame:
    """Per run and catalogue feed: articles and mean latency, zero for silent feeds.

    Failed articles count too, as they take their time; ``failed`` adds their number.

    The catalogue is a hand-kept list: after a check of its size it becomes one array
    that every run row explodes. Past the check its feeds are dealt into parts, and
    each run meets each part. Feeds listed twice count twice, as they are run twice.
    """
    measures = {"article_count": F.count("*"), "article_avg": F.avg(latency)}
    if failed is not None:
        measures["failed_count"] = F.count_if(failed)
    stats = entries.groupBy(run, feed).agg(*[m.alias(name) for name, m in measures.items()])
    return run_grid(stats.select(run).distinct(), catalogue, run, feed).join(
        stats, [run, feed], "left").select(
        run, feed, *[F.coalesce(name, F.lit(0.0 if name == "article_avg" else 0)).alias(name)
                     for name in measures])


def run_grid(runs: DataFrame, catalogue: DataFrame, run: str, feed: str) -> DataFrame:
    """Each run with each feed of the catalogue, as often as it is listed."""
    if fits_broadcast(catalogue.select(feed)):
        names = catalogue.agg(F.array_sort(F.collect_list(feed))).scalar()
        return runs.withColumn(feed, F.explode(names))
    parts = F.sequence(F.lit(0), F.lit(PARTS - 1))
    dealt = catalogue.select(feed, F.pmod(F.xxhash64(feed), F.lit(PARTS)).cast("int").alias(
        "_part"))
    return runs.withColumn("_part", F.explode(parts)).join(dealt, "_part").drop("_part")


def window_statistics(entries: DataFrame, published: str = "published",
                      feed: str = "feed_name", latency: str = "latency",
                      width: str = "15 minutes") -> DataFrame:
    """Counts and means per tumbling window and feed; same columns batch or streaming."""
    return (entries.groupBy(F.window(published, width).alias("w"), feed)
            .agg(F.count("*").alias("article_count"), F.avg(latency).alias("article_avg"))
            .select(F.col("w.start").alias("window_start"), feed, "article_count",
                    "article_avg"))
