"""Reports over per-document topic distributions (an ``array<double>`` column)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAG_THRESHOLD = 0.1
HISTOGRAM_STEP = 0.05
FINE_HISTOGRAM_STEP = 0.01


def topic_histogram(docs: DataFrame, distribution: str = "topic_dist",
                    step: float = HISTOGRAM_STEP) -> DataFrame:
    """(topic, weight, doc_count): documents per topic and rounded weight.

    Weights round to the nearest multiple of ``step``, halves away from zero; those
    that round to zero are left out. Bins are counted as integers.
    """
    weights = docs.select(F.posexplode(distribution).alias("topic", "w"))
    bins = weights.select("topic", F.round(F.col("w") / F.lit(step)).cast("long").alias("bin"))
    return (bins.filter("bin > 0").groupBy("topic", "bin")
            .agg(F.count("*").alias("doc_count"))
            .select("topic", F.round(F.col("bin") * F.lit(step), 6).alias("weight"), "doc_count"))


def topic_tags(docs: DataFrame, *columns: str | Column, distribution: str = "topic_dist",
               threshold: float = TAG_THRESHOLD) -> DataFrame:
    """One row per document and topic whose weight reaches the threshold."""
    tagged = docs.select(F.posexplode(distribution).alias("topic", "weight"), *columns)
    return tagged.filter(F.col("weight") >= threshold)
