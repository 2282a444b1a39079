"""Nearest documents to a query vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrain.functions.arrays import cosine


def top_similar(vectors: DataFrame, query: Column, n: int = 10, key: str = "vec_id",
                vector: str = "embedding") -> DataFrame:
    """The ``n`` rows most similar to one query vector (a literal or scalar subquery)."""
    held = vectors.select(key, vector, query.alias("_query"))
    scored = held.select(key, cosine(F.col(vector), F.col("_query")).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), F.asc(key)).limit(n)


def with_texts(ranked: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """Join the texts of a short ranked list (its size is the requested n)."""
    return texts.join(F.broadcast(ranked), key)
