"""Tables in the shared folder that the session names."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lexigrain.session import shared_path


def landed(df: DataFrame, label: str) -> DataFrame:
    """Write a table below the shared folder and read it back.

    This cuts the lineage: later jobs read the files, whatever executors are lost.
    """
    path = shared_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
