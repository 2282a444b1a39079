"""Streams written batch by batch: late rows kept apart, repeats of any age dropped, a run log.

Everything that a batch leaves is in a folder of its run and batch, which a batch that is
replayed after a failure overwrites, and a batch reads only what earlier batches and other
runs left. So any batch may be repeated, and a run may be started again over the same files.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexigrain.operators.joins import first_per_key, fits_broadcast

#: What a batch does with its rows: (batch, run, batch id) to named row counts.
Writer = Callable[[DataFrame, str, int], dict[str, int]]

LATE = "older than the watermark"
BUCKETS = 256


def put(rows: DataFrame, path: str, run: str, batch_id: int) -> None:
    """Write the rows of a batch into its own folder, over those of an earlier attempt."""
    rows.write.mode("overwrite").parquet(f"{path}/run={run}/batch_id={batch_id}")


def left(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What batches left below a path, with ``run`` and ``batch_id``; empty if there is none."""
    schema = f"{schema}, run string, batch_id long"
    try:
        return spark.read.schema(schema).option("basePath", path).parquet(f"{path}/run=*")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def late_apart(published: str, lateness: str, path: str, late_path: str,
               marks_path: str) -> Writer:
    """Rows on time and late rows go to two tables, the late ones with reason and watermark.

    The watermark of a batch is that of Spark's streams: the greatest event time of all
    earlier batches of the run, less ``lateness``. It is kept with each batch, so it is
    the same when the batch is replayed or the query restarted. Rows without a time are
    on time.
    """

    def write(batch: DataFrame, run: str, batch_id: int) -> dict[str, int]:
        marks = left(batch.sparkSession, marks_path, "latest timestamp")
        before = marks.filter((F.col("run") == run) & (F.col("batch_id") < batch_id))
        watermark = before.agg((F.max("latest") - F.expr(f"INTERVAL {lateness}")).alias(
            "watermark")).head()[0]
        limit = F.lit(watermark).cast("timestamp")
        late = F.coalesce(F.col(published) < limit, F.lit(False))
        put(batch.filter(~late), path, run, batch_id)
        put(batch.filter(late).withColumn("reason", F.lit(LATE)).withColumn("watermark", limit),
            late_path, run, batch_id)
        put(batch.agg(F.max(published).cast("timestamp").alias("latest")).filter(
            "latest is not null"), marks_path, run, batch_id)
        n_late = batch.filter(late).count()
        return {"n_written": batch.count() - n_late, "n_late": n_late}

    return write


def unseen_only(key: str, order: Column, path: str, seen_path: str,
                buckets: int = BUCKETS) -> Writer:
    """The first row of each key that no other batch or run has written, however long ago.

    Keys seen are kept in the order of the bucket of their hash, so a look at some buckets
    skips the rest of a file. They are not shuffled: what was seen is filtered by the
    broadcast keys of the batch, if these measure small (else joined by bucket and key).
    Of equal keys in a batch the row with the smallest ``order`` stays; null keys are rows of
    their own and all stay.
    """

    def write(batch: DataFrame, run: str, batch_id: int) -> dict[str, int]:
        spark = batch.sparkSession
        kind = batch.schema[key].dataType.simpleString()
        bucket = F.pmod(F.xxhash64("_key"), F.lit(buckets)).cast("int")
        first = first_per_key(batch.filter(F.col(key).isNotNull()), [key], order)
        keys = first.select(F.col(key).alias("_key")).withColumn("bucket", bucket).persist(
            StorageLevel.MEMORY_AND_DISK)
        met = [r.bucket for r in keys.select("bucket").distinct().collect()]  # at most buckets
        history = left(spark, seen_path, f"_key {kind}, bucket int").filter(
            F.col("bucket").isin(met) & ((F.col("run") != run) | (F.col("batch_id") < batch_id)))
        asked = F.broadcast(keys) if fits_broadcast(keys) else keys
        known = history.join(asked, ["bucket", "_key"], "left_semi").select(
            F.col("_key").alias(key)).distinct()
        fresh = first.join(known, key, "left_anti").unionByName(
            batch.filter(F.col(key).isNull())).persist(StorageLevel.MEMORY_AND_DISK)
        put(fresh, path, run, batch_id)
        put(fresh.filter(F.col(key).isNotNull()).select(F.col(key).alias("_key")).withColumn(
            "bucket", bucket).sortWithinPartitions("bucket"), seen_path, run, batch_id)
        counts = {"n_written": fresh.count()}
        fresh.unpersist()
        keys.unpersist()
        return {**counts, "n_repeated": batch.count() - counts["n_written"]}

    return write


def start_batches(df: DataFrame, write: Writer, checkpoint: str, log_path: str,
                  run: str) -> StreamingQuery:
    """Process what has landed in batches; one row of the run log for each of them.

    The log has n_rows, the counts of the writer, seconds, and rows_per_second. Its rows
    sum to the input, as a batch that is replayed overwrites its own.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        started = time.monotonic()
        held = batch.persist(StorageLevel.MEMORY_AND_DISK)
        counts = {"n_rows": held.count(), **write(held, run, batch_id)}
        held.unpersist()
        seconds = time.monotonic() - started
        spark = batch.sparkSession
        put(spark.range(1).select(
            *(F.lit(n).cast("long").alias(name) for name, n in counts.items()),
            F.lit(seconds).alias("seconds"),
            F.lit(counts["n_rows"] / max(seconds, 1e-9)).alias("rows_per_second")),
            log_path, run, batch_id)

    return (df.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
