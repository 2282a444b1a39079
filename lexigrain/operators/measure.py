"""Throughput reports."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def measured_write(df: DataFrame, path: str, job: str) -> DataFrame:
    """Write a table as Parquet; one row with its row count, seconds and rows per second.

    Rows are counted while they are written, not by a second job.
    """
    seen = Observation(job)
    start = time.perf_counter()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    seconds = time.perf_counter() - start
    rows = seen.get["rows"]
    return df.sparkSession.createDataFrame(
        [(job, rows, seconds, rows / seconds)],
        "job string, rows long, seconds double, rows_per_second double")
