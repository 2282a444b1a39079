"""Session settings, shared scratch space and input spreading."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.storagelevel import StorageLevel


def build_session(app_name: str = "lexigrain", master: str | None = None,
                  **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE on)."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.serializer", "org.apache.spark.serializer.KryoSerializer")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` if it is set.

    Only a local-mode session without that setting gets a temporary folder;
    a cluster must name a shared one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    configured = tempfile.mkdtemp(prefix="lexigrain-")
    spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below :func:`shared_root`."""
    return os.path.join(shared_root(spark), "lexigrain", f"{label}-{uuid.uuid4().hex}")


def landed(df: DataFrame, label: str) -> DataFrame:
    """The same rows, computed once and written below :func:`shared_root`."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def kept_on_disk(df: DataFrame, batch: int = 1000) -> DataFrame:
    """The same rows, computed once and kept on the executors' disks, not in their memory.

    Spark writes and reads them in batches of 10,000 rows or 4 MB, and a Java stream refers to
    the last 100 of these; ``batch`` rows bound what a task holds unseen by Spark.
    """
    conf, name = df.sparkSession.conf, "spark.sql.inMemoryColumnarStorage.batchSize"
    before = conf.get(name)
    conf.set(name, str(min(int(before), batch)))
    try:
        return df.persist(StorageLevel.DISK_ONLY)
    finally:
        conf.set(name, before)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Give the context a checkpoint folder unless it already has one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(spark))


def spread(df: DataFrame, *keys: str, partitions: int | None = None) -> DataFrame:
    """Repartition a scan that yields fewer tasks than the cluster has cores.

    One row group or one unsplittable file is one task however many cores wait.
    A scan that already feeds every core passes through without a shuffle.
    """
    spark = df.sparkSession
    wanted = partitions or spark.sparkContext.defaultParallelism
    if partitions is None and df.rdd.getNumPartitions() >= wanted:
        return df
    return df.repartition(wanted, *keys)
