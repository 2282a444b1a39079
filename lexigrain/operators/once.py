"""Keep an expensive expression from being copied into later filters.

The optimiser pushes a filter below the projection that computes its column, and
adds a non-empty check below every explode; either repeats the whole expression. An
outer generator is a boundary it does not cross.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once per row, whatever filters use it."""
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def inline_once(df: DataFrame, value: Column, not_null: str, *keys: str | Column) -> DataFrame:
    """One row per struct of an array column, its fields as columns.

    ``not_null`` names a field that is never null; rows with an empty array go.
    """
    return df.select(*keys, F.inline_outer(value)).filter(F.col(not_null).isNotNull())


def explode_once(df: DataFrame, value: Column, name: str, *keys: str | Column) -> DataFrame:
    """One row per non-null element of an array column."""
    return df.select(*keys, F.explode_outer(value).alias(name)).filter(F.col(name).isNotNull())
