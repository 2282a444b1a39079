"""Feed intake as Structured Streaming jobs over landed files."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lexigrain import schemas
from lexigrain.operators.feeds import epoch_seconds, run_bucket, window_statistics
from lexigrain.operators.rows import RUN_SECONDS, recent, route_rows
from lexigrain.sources.xml import entry_columns, good_records, parse_xml_records

LATENESS = "15 minutes"


def stream_feed_files(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Entries of feed files as they land."""
    return entry_columns(good_records(stream_feed_records(spark, path, max_files)))


def stream_feed_records(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Items as they land; ``start_routed`` parts good ones from those with a
    ``_corrupt_record``."""
    chunks = (spark.readStream.option("maxFilesPerTrigger", max_files)
              .text(path, lineSep="</item>"))
    return parse_xml_records(chunks, "item", schemas.RSS_ITEM)


def stream_parquet(spark: SparkSession, path: str, schema: T.StructType,
                   name_glob: str = "*.parquet", max_files: int = 1000) -> DataFrame:
    """Parquet files as they land."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", name_glob)
            .option("maxFilesPerTrigger", max_files).parquet(path))


def due_entries(entries: DataFrame, clock: Column, published: str = "published",
                window: int = RUN_SECONDS) -> DataFrame:
    """Entries recent at their run; the run is the bucket of ``clock`` (seconds).

    An entry older than the window at its run is dropped for good.
    """
    return (entries.withColumn("run_id", run_bucket(clock, window))
            .filter(recent(F.col("run_id"), epoch_seconds(F.col(published)), window)))


def stream_window_statistics(entries: DataFrame, published: str = "published",
                             lateness: str = LATENESS, **columns: str) -> DataFrame:
    """Tumbling statistics per feed over event time, late rows dropped."""
    return window_statistics(entries.withWatermark(published, lateness), published, **columns)


def stream_distinct_entries(entries: DataFrame, key: str = "entry_id",
                            published: str = "published",
                            lateness: str = LATENESS) -> DataFrame:
    """Drop repeats of an entry that arrive within the lateness bound."""
    return entries.withWatermark(published, lateness).dropDuplicatesWithinWatermark([key])


def run_available(df: DataFrame, path: str, checkpoint: str,
                  output_mode: str = "append") -> None:
    """Process what has landed, append it as Parquet and stop."""
    query = (df.writeStream.format("parquet").outputMode(output_mode)
             .option("path", path).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def start_routed(df: DataFrame, problems: dict[str, Column], good_path: str,
                 rejected_path: str, checkpoint: str) -> StreamingQuery:
    """Write good rows and rejected rows of each micro-batch to their own tables.

    The batch id is a partition column and each batch overwrites its own
    partitions, so a batch replayed after a failure is not written twice. A batch is
    kept while both tables are written, so its source is read once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist(StorageLevel.MEMORY_AND_DISK)
        good, rejected = route_rows(held, problems)
        for rows, path in ((good, good_path), (rejected, rejected_path)):
            (rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id")
             .parquet(path))
        held.unpersist()

    return (df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
