"""Topic models, sinks and streams."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from lexigrain.operators.feeds import window_statistics
from lexigrain.plans import topics as P
from lexigrain.session import shared_path
from lexigrain.sinks import files as K
from lexigrain.streaming import feeds as X


@pytest.fixture(scope="module")
def docs(spark):
    themes = ["rain wind storm cloud", "goal match team score", "bank rate loan market"]
    rows = [(str(i), "d1" if i % 2 else "d2", "2024-01-01",
             (themes[i % 3].split() * 3) + [f"w{i % 7}"]) for i in range(90)]
    return spark.createDataFrame(
        rows, "id string, dataset string, published string, words array<string>").persist()


CONFIG = P.TopicConfig(k=3, max_iter=10, vocab_size=100, min_df=2)


@pytest.fixture(scope="module")
def model(docs):
    return P.build_topics(docs, CONFIG)


def test_model_invariants(spark, docs, model):
    scored = P.document_topics(model, docs)
    sums = scored.select(F.aggregate("topic_dist", F.lit(0.0), lambda a, x: a + x).alias("s"))
    assert all(abs(r["s"] - 1) < 1e-6 for r in sums.collect())
    defs = P.topic_definitions(spark, model, 4)
    assert defs.count() == 12 and defs.select("topic").distinct().count() == 3
    row = P.diagnostics(model, docs).head()
    assert row["topics"] == 3 and row["vocab_size"] == 19 and row["log_likelihood"] < 0
    prevalence = P.topic_prevalence(model, docs).agg(F.max("doc_count")).head()[0]
    assert 0 < prevalence <= 90


def test_saved_model_scores_the_same(spark, docs, model, tmp_path):
    P.save_model(model, str(tmp_path / "m"))
    again = P.load_model(str(tmp_path / "m"))
    a, b = (P.document_topics(m, docs).orderBy("id").collect() for m in (model, again))
    assert a == b


def test_tags(docs, model):
    tags = P.tag_documents(model, docs, dataset="d1", threshold=0.1)
    assert tags.columns == ["topic", "published", "id", "article"]
    assert {int(r["id"]) % 2 for r in tags.collect()} == {1}
    fewer = P.tag_documents(model, docs, sample_fraction=0.3).select("id").distinct().count()
    assert 5 < fewer < 60


def test_em_and_other_settings(spark, docs):
    em = P.build_topics(docs, P.TopicConfig(k=2, max_iter=5, vocab_size=50, min_df=2,
                                            optimizer="em", learning_offset=None,
                                            topic_concentration=None))
    assert P.topic_definitions(spark, em, 3).count() == 6
    plain = P.build_topics(docs, P.TopicConfig(k=2, max_iter=3, vocab_size=50, min_df=0.1,
                                               use_idf=False, subsampling_rate=0.5,
                                               learning_decay=0.6, learning_offset=15))
    assert len(plain.stages) == 3


def test_sinks(spark, tmp_path):
    rows = spark.range(1000).select("id", F.repeat(F.lit("x"), 100).alias("t"),
                                    (F.col("id") % 3).alias("topic"))
    K.write_bounded(rows, str(tmp_path / "b"), 20_000)
    files = spark.read.text(str(tmp_path / "b")).groupBy(F.input_file_name()).agg(
        F.count("*").alias("n"), F.sum(F.length("value") + 1).alias("b")).collect()
    assert len(files) >= 6 and sum(f.n for f in files) == 1000
    assert all(f.b <= 20_000 for f in files)
    K.write_bounded(spark.range(9).select(F.repeat(F.lit("y"), 30_000)), str(tmp_path / "c"), 20_000)
    assert spark.read.text(str(tmp_path / "c")).select(F.input_file_name()).distinct().count() == 9
    K.write_report(rows.groupBy("topic").count(), str(tmp_path / "r"))
    assert sum(f.startswith("part-") for f in os.listdir(tmp_path / "r")) == 1
    for _ in range(2):
        K.append_tsv(rows.select("id", "t"), str(tmp_path / "a"))
    assert spark.read.csv(str(tmp_path / "a"), sep="\t").count() == 2000
    with pytest.raises(ValueError):
        K.write_report(rows, str(tmp_path / "r"), max_rows=10)
    K.write_by_topic(rows, str(tmp_path / "t"))
    assert {d for d in os.listdir(tmp_path / "t") if d.startswith("topic=")} == {
        "topic=0", "topic=1", "topic=2"}


def test_feed_files_arrive_in_two_runs(spark, fixtures, tmp_path):
    landed, out = tmp_path / "landed", shared_path(spark, "entries")
    landed.mkdir()
    for name in ("feed_a.xml", "feed_b.xml"):
        shutil.copy(os.path.join(fixtures, name), landed / name)
        stream = X.stream_feed_files(spark, str(landed))
        X.run_available(stream, f"{out}/rows", f"{out}/ck")
    entries = spark.read.parquet(f"{out}/rows")
    assert sorted(r["link"] for r in entries.collect()) == [
        "http://d/1", "http://d/2", "http://d/3", "http://d/4", "http://h/1", "http://h/2"]


def test_stream_statistics_equal_batch_for_closed_windows(spark, tmp_path):
    entries = spark.range(500).select(
        F.timestamp_seconds(F.col("id") * 60 + 1_700_000_100).alias("published"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise("b").alias("feed_name"),
        F.col("id").cast("double").alias("latency"))
    entries.write.parquet(str(tmp_path / "in"))
    stream = X.stream_parquet(spark, str(tmp_path / "in"), entries.schema)
    out = shared_path(spark, "windows")
    X.run_available(X.stream_window_statistics(stream), f"{out}/rows", f"{out}/ck")
    got = set(map(tuple, spark.read.parquet(f"{out}/rows").collect()))
    batch = set(map(tuple, window_statistics(entries).collect()))
    assert got <= batch and len(batch) - len(got) <= 4


def test_replayed_batch_is_not_written_twice(spark, tmp_path):
    entries = spark.range(30).select("id", (F.col("id") % 4).alias("v"))
    entries.write.parquet(str(tmp_path / "in"))
    for run in range(2):  # a new checkpoint replays batch 0 into the same tables
        stream = X.stream_parquet(spark, str(tmp_path / "in"), entries.schema)
        X.start_routed(stream, {"bad": F.col("v") == 0}, str(tmp_path / "good"),
                       str(tmp_path / "bad"), str(tmp_path / f"ck{run}")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "good")).count() == 22
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 8
