"""Array helpers that stay inside one row, so they never shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.transform(F.array(value), body).getItem(0)


def sorted_distinct(values: Column) -> Column:
    """Distinct elements in ascending order; sort based, so n log n for structs too."""
    return let(
        F.sort_array(values),
        lambda s: F.filter(s, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(s, i - 1))),
    )


def term_counts(words: Column) -> Column:
    """``array<struct<term, tf>>`` of a word array by run length on the sorted words.

    Null words count nowhere.
    """

    empty = F.array().cast("array<struct<term:string,tf:bigint>>")

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1),
                          lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda h: F.transform(h, lambda at, j: F.struct(
            F.get(s, at).alias("term"),
            (F.coalesce(F.get(h, j + 1), F.size(s)) - at).cast("long").alias("tf"))))

    return let(F.sort_array(F.array_compact(words)),
               lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(empty))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two numeric arrays; null if either has no length."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)
