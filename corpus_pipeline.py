"""From raw documents to packed sequences; each stage's table is written and read again."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain.llm import compression, jaccard_join, languages, packing, string_tiling
from lexigrain.llm.keep import row_key, without
from lexigrain.session import shared_path

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
BATCH = 2 << 20  # bytes; Spark's own bounds are 10,000 rows and 64 MB

#: None: compression ratios, posteriors and token ids are not SQL; tests use brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the word rules and the compression bands."""
    return compression.judge(docs).filter("kept").select(*DOCUMENT_COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a clear language."""
    key = row_key("text", "source")
    found = languages.identify(
        languages.document_records(docs, key.alias("key")), languages.learn(docs))
    return without(docs, key, found.filter("not kept").select("key")).select(*DOCUMENT_COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard_join.one_of_each(docs).select(*DOCUMENT_COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    rows, found = string_tiling.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaked = rows.join(found.select("row").distinct(), "row").select("key")
    return without(docs, row_key("text"), leaked).select(*DOCUMENT_COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of a power of two of token ids."""
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


def in_small_batches(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage in a session that hands texts to Python ``BATCH`` bytes at a time.

    An executor and its Python workers hold some copies of a batch for every running task.
    """

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
        return stage(spark, docs, sf_dir)

    return run


STAGES = [(name, in_small_batches(stage)) for name, stage in [
    ("quality_rules", quality_rules), ("language", language),
    ("near_duplicates", near_duplicates), ("decontamination", decontamination),
    ("packing", packed)]]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
