"""Queries whose single tasks once took more than a share of the input."""

import pytest
from pyspark.sql import functions as F

from lexigrain.operators import vocabulary
from lexigrain.registry import feed_queries, topic_queries, vocabulary_queries


@pytest.fixture()
def events_dir(spark, tmp_path):
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 60)
    spark.range(4000).repartition(4).select(
        F.col("id").alias("event_id"), at.cast("timestamp_ntz").alias("ts"),
        F.lit(1).cast("long").alias("user_id"),
        F.when(F.col("id") % 2 == 0, "click").otherwise("view").alias("event_type"),
        F.lit(1.0).alias("value"), F.lit("").alias("props")).write.parquet(
        f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_a_delivery_is_written_by_all_tasks_and_is_one_batch(spark, events_dir):
    folders = feed_queries._land_files(spark, events_dir)
    files = [len(spark.read.parquet(f).inputFiles()) for f in folders]
    assert len(folders) == 5 and min(files) > 1
    log = {(r.run, r.batch_id): (r.n_rows, r.n_written)
           for r in feed_queries.stream_batch_log(spark, events_dir).collect()}
    sizes = [spark.read.parquet(f).count() for f in folders]
    assert sum(sizes) == 4000
    assert log == {(run, n): (2 * size, size if run == "first" else 0)
                   for run in ("first", "second") for n, size in enumerate(sizes)}


@pytest.mark.parametrize("rows", [0, 3, 100])
def test_a_share_of_documents_is_fitted_as_their_number(spark, rows):
    docs = spark.range(rows).select(F.array(
        F.lit("all"), F.concat(F.lit("w"), F.col("id") % 25)).alias("words"))
    vectorizer = vocabulary_queries._count_vectorizer(docs, "v", 0.05)
    assert vectorizer.getMinDF() == max(1.0, 0.05 * rows)
    if rows:
        expected = {"all"} | ({f"w{i}" for i in range(3)} if rows == 3 else set())
        assert set(vectorizer.fit(docs).vocabulary) == expected


def test_words_are_read_once_by_a_bounded_vocabulary(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def told(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    docs = spark.createDataFrame(
        [([f"w{i % 7}", "all", None, f"x{i}"],) for i in range(40)] + [(None,), ([],)],
        "words array<string>").repartition(2).mapInArrow(told, "words array<string>")
    found = vocabulary.bounded_vocabulary(docs, 3, tracked=4).collect()
    assert [(r.term, r.cf, r.df) for r in found] == [("all", 40, 40), ("w0", 6, 6), ("w1", 6, 6)]
    assert seen.value == 42


def test_topic_documents_are_written_with_their_words(spark, tmp_path):
    spark.createDataFrame([(1, "A b a.", "en", "src1", 6)], "doc_id long, text string, "
                          "lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet")
    docs = topic_queries.topic_documents(spark, str(tmp_path))
    plan = docs._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:string,dataset:string,published:string,words:array<string>>" in plan
    assert docs.count() == 1
