"""Sinks: Parquet, delimited text, doc records, size-bounded files, templates."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, *, mode: str = "overwrite",
                  partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_report(df: DataFrame, path: str, sep: str = "\t", max_rows: int = 1_000_000) -> None:
    """A small aggregated report as one delimited text file.

    One task writes the file, so a result of more than ``max_rows`` is refused.
    """
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = held.count()
        if rows > max_rows:
            raise ValueError(f"{rows} rows are no report; write them as Parquet")
        held.coalesce(1).write.mode("overwrite").csv(path, sep=sep)
    finally:
        held.unpersist()


def tsv_line(*columns: str | Column) -> Column:
    """Fields joined by tabs as the crawl reader splits them: no quoting, blanks kept.

    Tabs and line ends inside a field become spaces; null is an empty field.
    """
    fields = [F.coalesce(F.regexp_replace((F.col(c) if isinstance(c, str) else c).cast("string"),
                                          r"[\t\r\n]", " "), F.lit("")) for c in columns]
    return F.concat_ws("\t", *fields)


def _columns(df: DataFrame) -> list[Column]:
    return [F.col(f"`{name}`") for name in df.columns]


def append_tsv(df: DataFrame, path: str) -> None:
    """Append rows to a tab-separated log."""
    df.select(tsv_line(*_columns(df)).alias("value")).write.mode("append").text(path)


def write_bounded(df: DataFrame, path: str, max_bytes: int, *, compression: str = "gzip",
                  tasks: int | None = None) -> None:
    """Tab-separated lines in compressed files of at most ``max_bytes`` before compression.

    Rows are dealt to tasks, and each task numbers its rows by a running sum of their
    bytes; a file holds the rows of one number. Only a row that is larger than the
    bound alone has a larger file.
    """
    parts = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = df.select(tsv_line(*_columns(df)).alias("value"))
    sized = lines.withColumn("_bytes", F.octet_length("value") + 1).withColumn(
        "_task", F.pmod(F.xxhash64("value", F.monotonically_increasing_id()), F.lit(parts)))
    so_far = F.sum("_bytes").over(Window.partitionBy("_task").orderBy("value").rowsBetween(
        Window.unboundedPreceding, -1))
    # a row starts in the half bound where its bytes begin, and ends within the next
    half = max(max_bytes // 2, 1)
    file = F.floor(F.coalesce(so_far, F.lit(0)) / half)
    large = F.col("_bytes") > half
    numbered = sized.withColumn("file", F.concat_ws(
        "-", "_task", file, F.when(large, F.xxhash64("value", so_far))))
    (numbered.select("value", "file").write.mode("overwrite").partitionBy("file")
     .option("compression", compression).text(path))


def doc_record(doc_id: Column, url: Column, title: Column, body: Column) -> Column:
    """One ``<doc>`` record: opening tag, title line, blank line, body, closing tag."""
    return F.concat(
        F.lit('<doc id="'), doc_id.cast("string"), F.lit('" url="'), url,
        F.lit('" title="'), title, F.lit('">\n'), title, F.lit("\n\n"), body,
        F.lit("\n\n</doc>\n"))


def write_doc_records(records: DataFrame, path: str, column: str = "record",
                      compression: str = "none") -> None:
    records.select(F.regexp_replace(column, "\n$", "").alias("value")).write.mode(
        "overwrite").option("compression", compression).text(path)


def write_by_topic(tags: DataFrame, path: str, topic: str = "topic") -> None:
    """One folder per topic. A rebalance groups rows by topic but splits a topic that
    holds far more rows than the others over several files."""
    tags.hint("rebalance", topic).write.mode("overwrite").partitionBy(topic).parquet(path)


def write_templates(templates: DataFrame, path: str) -> None:
    """Template and module pages as their own table."""
    templates.select("title", "ns", "id", "text").write.mode("overwrite").parquet(path)
