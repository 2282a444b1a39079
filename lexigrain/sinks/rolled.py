"""Text logs in files of bounded size that go on from run to run.

A run lands its lines once with running byte counts per task. The sums of the tasks give
every line its place in the log, and its place the number of its file, so numbers are dense
over all tasks and every file but the last is full. The manifest of a run lists all files
that make up the log; the next run fills up the last of them in a new version of it.
Files are never changed, and a run that is repeated starts from the same manifest.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrain.session import shared_path
from lexigrain.sinks.files import tsv_line

MANIFEST = "run long, number long, name string, bytes long, version long"


def _staged(lines: DataFrame) -> DataFrame:
    """(task, value, bytes, before): lines with the bytes of their task before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            size = pc.add(pc.cast(pc.binary_length(batch.column(0)), pa.int64()), 1)
            ends = pc.cumulative_sum(size, start=before)
            yield pa.RecordBatch.from_arrays(
                [pa.array([task] * batch.num_rows, pa.int32()), batch.column(0), size,
                 pc.subtract(ends, size)], names=["task", "value", "bytes", "before"])
            before = ends[-1].as_py() if batch.num_rows else before

    path = shared_path(lines.sparkSession, "rolled")
    lines.mapInArrow(run, "task int, value string, bytes long, before long").write.parquet(path)
    return lines.sparkSession.read.parquet(path)


def manifest(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """(run, number, name, bytes, version) of the files of the latest run (below ``before``).

    ``version`` is the run that wrote a file, ``bytes`` is before compression.
    """
    try:
        runs = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
        runs.head()
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], MANIFEST)
    runs = runs if before is None else runs.filter(F.col("run") < before)
    latest = runs.agg(F.max("run")).head()[0]
    return runs.filter(F.col("run") == F.lit(latest))


def append_rolled(df: DataFrame, folder: str, max_bytes: int, run: int, *,
                  compression: str = "gzip") -> None:
    """Append rows as tab-separated lines to the log in ``folder`` as its run ``run``.

    Runs have rising numbers; a run that is in the manifest is not written again. A file
    is full when its next line could make it larger than ``max_bytes`` (before
    compression), reckoned by the longest line of the run. A line of more than half the
    bound makes its file larger than that. No rows leave the log as it is.
    """
    spark = df.sparkSession
    if manifest(spark, folder, run + 1).filter(F.col("run") == run).head():
        return
    files = manifest(spark, folder, run).drop("run")
    columns = [F.col(f"`{name}`") for name in df.columns]
    staged = _staged(df.select(tsv_line(*columns).alias("value")))
    longest, total = staged.agg(F.coalesce(F.max("bytes"), F.lit(0)),
                                F.coalesce(F.sum("bytes"), F.lit(0))).head()
    full = max(max_bytes - min(longest, max_bytes // 2), 1)
    last = files.orderBy(F.desc("number")).head()
    kept = last is not None and last.bytes < full and total > 0
    carried, first = (last.bytes, last.number) if kept else (0, last.number + 1 if last else 0)

    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = staged.groupBy("task").agg(F.sum("bytes").alias("sum")).select(
        "task", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("_from"))  # a row a task
    placed = staged.join(F.broadcast(tasks), "task").select(
        "value", "bytes", (F.col("before") + F.col("_from") + carried).alias("place"))
    if kept:
        old = _staged(spark.read.text(f"{folder}/files/{last.name}"))
        placed = placed.unionByName(old.select("value", "bytes", F.col("before").alias("place")))
    numbered = placed.withColumn("file", F.expr(f"place div {full}").cast("int"))
    if total:
        count = (carried + total - 1) // full + 1
        (numbered.repartitionById(count, F.col("file")).sortWithinPartitions("place")
         .select("value").write.mode("overwrite").option("compression", compression)
         .text(f"{folder}/files/run-{run:09d}"))
        written = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(
            f"{folder}/files/run-{run:09d}").select(
            F.regexp_extract("path", r"(run-\d+/part-(\d+)[^/]*)$", 1).alias("name"),
            F.regexp_extract("path", r"/part-(\d+)[^/]*$", 1).cast("int").alias("file"))
        sizes = numbered.groupBy("file").agg(F.sum("bytes").alias("bytes"))
        new = written.join(sizes, "file").select(
            (F.col("file") + first).alias("number"), "name", "bytes",
            F.lit(run).cast("long").alias("version"))
        files = files.filter(F.col("number") < first).unionByName(new)
    files.select(F.lit(run).cast("long").alias("run"), "number", "name", "bytes",
                 "version").write.mode("append").parquet(f"{folder}/manifest")


def read_rolled(spark: SparkSession, folder: str) -> DataFrame:
    """(value, number): the lines of the files in the latest manifest."""
    name = F.regexp_extract("_metadata.file_path", r"(run-\d+/part-[^/]*)$", 1)
    lines = spark.read.option("recursiveFileLookup", "true").text(f"{folder}/files").select(
        "value", name.alias("name"))
    return lines.join(manifest(spark, folder).select("name", "number"), "name").drop("name")
