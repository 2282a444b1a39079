"""Corpus helpers: repetition, samples of items, inverted maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrain.operators.ordering import top_rows, with_position


def repeat_times(df: DataFrame, n: int) -> DataFrame:
    """``n`` whole copies of every row, numbered by ``copy``."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def repeat_to_length(df: DataFrame, key: str, length: int) -> DataFrame:
    """The corpus over and over again until ``length`` rows are reached.

    Each row knows from its position how many copies it gives; ``ordinal`` is the
    place in the repeated corpus.
    """
    placed = with_position(df, key)
    total = df.agg(F.count("*")).scalar()
    copies = F.floor(F.lit(length) / total).cast("int") + (
        F.col("pos") < F.pmod(F.lit(length), total)).cast("int")
    return (placed.withColumn("_copies", copies).filter("_copies > 0")
            .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
            .withColumn("ordinal", F.col("copy").cast("long") * total + F.col("pos"))
            .drop("_copies"))


def random_items(df: DataFrame, key: str, n: int, seed: str = "42") -> DataFrame:
    """``n`` random rows, the same ones for the same seed."""
    shuffled = F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string")))
    return top_rows(df.withColumn("_order", shuffled), [F.asc("_order"), F.asc(key)], n).drop(
        "_order")


def invert_map(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """value to key; where several keys share a value the largest one stays."""
    return pairs.groupBy(value).agg(F.max(key).alias(key))
