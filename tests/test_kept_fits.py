"""What fits keep between their passes: nothing in the executors' memory."""

from dataclasses import replace

import pytest
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrain.plans import topics as P
from lexigrain.session import kept_on_disk, landed

CONFIG = P.TopicConfig(k=2, max_iter=2, vocab_size=50, min_df=2, learning_offset=10)
BAGS = [["aa", "bb", "aa", None], ["bb", "cc", "the"], ["aa", "dd"], [], None]


@pytest.fixture()
def levels(spark, monkeypatch):
    """The storage level of every table that is persisted."""
    seen, kind = [], type(spark.range(0))

    def told(df, level=None, persist=kind.persist):
        out = persist(df, level) if level else persist(df)
        seen.append(out.storageLevel)
        return out

    monkeypatch.setattr(kind, "persist", told)
    return seen


@pytest.mark.parametrize("written", [False, True])
@pytest.mark.parametrize("optimizer", ["online", "em"])
def test_fits_keep_no_words_or_counts_in_memory(spark, levels, monkeypatch, optimizer, written):
    config = replace(CONFIG, optimizer=optimizer, learning_offset=None,
                     topic_concentration=None)
    bags = [[w for w in b or [] if w] for b in BAGS]
    docs = spark.createDataFrame([(b,) for b in 10 * bags], "words array<string>")
    given, fit = [], P.LDA.fit
    monkeypatch.setattr(P.LDA, "fit", lambda lda, features: (
        given.append(features.storageLevel), fit(lda, features))[1])
    model = P.build_topics(docs, config, written=written)
    P.diagnostics(model, docs)
    assert levels and not any(level.useMemory for level in levels)
    # a table that is not kept would be kept in memory by the fit itself, as objects
    assert [level.useDisk for level in given] == [optimizer == "online"]
    assert sorted(model.stages[1].vocabulary) == ["aa", "bb", "cc", "dd"]


def test_a_share_is_fitted_as_a_number_of_documents(spark):
    docs = spark.createDataFrame([(["every", f"w{i % 4}"],) for i in range(10)],
                                 "words array<string>")
    model = P.build_topics(docs, replace(CONFIG, min_df=0.3))
    assert sorted(model.stages[1].vocabulary) == ["every", "w0", "w1"]
    assert model.stages[1].getMinDF() == pytest.approx(3)


def test_vectors_are_dealt_by_their_entries(spark):
    kind = T.StructType([T.StructField("features", VectorUDT())])
    rows = spark.createDataFrame(
        [(SparseVector(90, {i: 1.0, 89: 2.0}),) for i in range(60)], kind).repartition(5)
    for vectors in (rows.coalesce(1), rows):
        vectors = landed(vectors, "vectors").coalesce(2)
        dealt = P._dealt(vectors, 30).rdd.glom()
        parts = [[int(row.features.indices[0]) for row in part] for part in dealt.collect()]
        place = [int(row.features.indices[0]) for row in vectors.collect()]
        assert sorted(sum(parts, [])) == list(range(60))
        assert len(parts) == 4 and max(map(len, parts)) < 30
        assert all(part == sorted(part, key=place.index) for part in parts)
        kept = P._dealt(vectors, 120)
        assert kept.rdd.getNumPartitions() == vectors.rdd.getNumPartitions()
    assert P._dealt(vectors.limit(0), 30).count() == 0


def test_rows_kept_on_disk_leave_the_session_as_it_was(spark):
    name = "spark.sql.inMemoryColumnarStorage.batchSize"
    before = spark.conf.get(name)
    kept = kept_on_disk(spark.range(5000).select(F.col("id") + 1), batch=7)
    assert kept.agg(F.sum(kept[0])).head()[0] == 5000 * 5001 // 2
    assert kept.storageLevel.useDisk and not kept.storageLevel.useMemory
    assert spark.conf.get(name) == before
    kept.unpersist()
