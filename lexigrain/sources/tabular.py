"""Delimited sources: feed catalogue, logs, code dictionaries, hierarchies, Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain import schemas


def read_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.parquet(*([path] if isinstance(path, str) else path))


def read_saved(spark: SparkSession, path: str) -> DataFrame:
    """Load results saved in the session's default format."""
    return spark.read.load(path)


def read_feed_catalogue(spark: SparkSession, path: str, dedupe: bool = False) -> DataFrame:
    """Feed names and links; stray quotes are cut, duplicates kept unless asked."""
    feeds = spark.read.csv(path, schema=schemas.FEED_CATALOGUE).select(
        "feed_name", F.rtrim(F.col("feed_link"), F.lit("'")).alias("feed_link"))
    return feeds.dropDuplicates() if dedupe else feeds


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=schemas.RUN_LOG)


def read_error_log(spark: SparkSession, path: str) -> DataFrame:
    """Error rows; a torn row (too few or too many fields) has ``_corrupt_record`` set."""
    fields = spark.read.text(path).select("value", F.split("value", "\t", -1).alias("f"))
    named = [F.get("f", F.lit(i)).alias(n) for i, n in enumerate(schemas.ERROR_LOG.names)]
    torn = F.size("f") != len(schemas.ERROR_LOG.names)
    return fields.select(*named, F.when(torn, F.col("value")).alias("_corrupt_record"))


def read_code_dictionary(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Codes and descriptions; comment lines, blank lines and extra columns go."""
    codes = spark.read.csv(path, sep="\t", comment=";", schema=schemas.CODE_DICTIONARY,
                           quote="", mode="PERMISSIVE")
    clean = codes.select(F.trim("code").alias("code"),
                         F.regexp_replace("description", r"\r$", "").alias("description"))
    return clean.filter(F.col("code").isNotNull() & (F.col("code") != ""))


def read_hierarchy(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(parent, child, description) from ``parent: child: child-description:`` lines."""
    pattern = r"^parent:\s*(.*?)\s+child:\s*(.*?)\s+child-description:\s*(.*?)\s*$"
    lines = spark.read.text(path).filter(F.col("value").rlike(pattern))
    part = lambda i: F.regexp_extract("value", pattern, i)
    return lines.select(part(1).alias("parent"), part(2).alias("child"),
                        part(3).alias("description"))


def read_wide_hierarchy(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(parent, parent_short, child, child_short, description) from ``pp: … cd:`` lines."""
    pattern = r"^pp:\s*(.*?)\s+pu:\s*(.*?)\s+cp:\s*(.*?)\s+cu:\s*(.*?)\s+cd:\s*(.*?)\s*$"
    lines = spark.read.text(path).filter(F.col("value").rlike(pattern))
    names = ("parent", "parent_short", "child", "child_short", "description")
    return lines.select(*[F.regexp_extract("value", pattern, i + 1).alias(n)
                          for i, n in enumerate(names)])
