"""What weights keep between their passes: nothing in the executors' memory."""

import math

import pytest

from lexigrain.operators import joins as J
from lexigrain.operators import vocabulary as V

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


@pytest.mark.parametrize("limits", [{}, {"min_df": 2, "vocab_size": 1}])
def test_weights_keep_no_bags_in_memory(spark, levels, limits):
    docs = spark.createDataFrame(list(enumerate(BAGS)), "id long, words array<string>")
    found = {(r.id, r.term): (r.tf, r.tfidf) for r in V.tf_idf(docs, "id", **limits).collect()}
    assert not any(level.useMemory for level in levels)
    df = {t: sum(t in (b or []) for b in BAGS) for t in ("aa", "bb", "cc", "dd", "the")}
    terms = {"aa"} if limits else set(df)
    expected = {(i, t): (b.count(t), b.count(t) * math.log(6 / (df[t] + 1)))
                for i, b in enumerate(BAGS) for t in set(b or []) & terms}
    assert {k: (tf, pytest.approx(w)) for k, (tf, w) in expected.items()} == found


def test_rows_of_frequent_keys_are_not_shuffled(spark):
    names = ["a"] * 90 + ["b"] * 60 + ["c"] * 5 + ["d"] * 4 + [None] * 2 + ["none"]
    facts = spark.createDataFrame(list(enumerate(names)), "id long, term string").repartition(4)
    dims = spark.createDataFrame([("a", 90), ("b", 60), ("c", 5), ("d", None), (None, 2)],
                                 "term string, df long")
    got = J.frequent_split_lookup(facts, dims, "term", "df", ["id"], frequent=2)
    df = {"a": 90, "b": 60, "c": 5, None: 2}
    rows = got.select("id", "term", "df").collect()
    assert sorted(map(tuple, rows)) == [(i, t, df[t]) for i, t in enumerate(names) if t in df]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = J.frequent_split_lookup(facts, dims, "term", "df", frequent=2)
        plan = plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("LeftAnti, BuildRight") == 2 and "Inner, BuildRight" in plan
