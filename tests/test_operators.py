"""Ordering, joins, vocabularies and reports against brute force on skewed tables."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexigrain.functions.stopwords import remove_stop_words
from lexigrain.operators import corpus as C
from lexigrain.operators import feeds as B
from lexigrain.operators import joins as J
from lexigrain.operators import ordering as O
from lexigrain.operators import rows as R
from lexigrain.operators import topic_reports as T
from lexigrain.operators import vocabulary as V


@pytest.fixture(scope="module")
def skewed(spark):
    """300 rows; one key holds more than a third of them."""
    rng = random.Random(7)
    rows = [(i * 3 + 1, "hot" if i % 5 < 2 else f"k{rng.randrange(40)}", rng.randrange(100))
            for i in range(300)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "id long, key string, v long").repartition(7).persist()


def test_positions_and_slices(skewed):
    rows, df = skewed
    ids = sorted(r[0] for r in rows)
    placed = {r["id"]: r["pos"] for r in O.with_position(df, "id").collect()}
    assert placed == {x: i for i, x in enumerate(ids)}
    got = sorted(r["id"] for r in O.slice_rows(df, "id", 5, 200, 9).collect())
    assert got == ids[5:200:9]
    assert sorted(r["id"] for r in O.slice_rows(df, "id", 290).collect()) == ids[290:]
    assert [r["id"] for r in O.head(df, "id", 4).collect()] == ids[:4]


def test_top_rows_in_groups(skewed, monkeypatch):
    rows, df = skewed
    order = [F.desc("v"), F.asc("id")]
    want = [r[0] for r in sorted(rows, key=lambda r: (-r[2], r[0]))][:50]
    assert [r["id"] for r in O.top_rows(df, order, 50).collect()] == want
    monkeypatch.setattr(O, "SMALL_TOP", 10)
    assert [r["id"] for r in O.top_rows(df, order, 50).collect()] == want


def test_positions_with_one_range_and_empty_table(spark, skewed):
    rows, df = skewed
    assert O.with_position(df, "id", ranges=1).agg(F.max("pos")).head()[0] == 299
    assert O.with_position(df.filter("id < 0"), "id").count() == 0


def test_drop_repeats(skewed):
    rows, df = skewed
    ordered = sorted(rows)
    want = [r[0] for i, r in enumerate(ordered) if i == 0 or ordered[i - 1][1] != r[1]]
    assert sorted(r["id"] for r in O.drop_repeats(df, "id", "key").collect()) == want


def test_lookups_agree(spark, skewed):
    rows, df = skewed
    weights = {}
    for _, key, _ in rows:
        weights[key] = weights.get(key, 0) + 1
    kept = {k: w for k, w in weights.items() if k != "k3"}
    dims = spark.createDataFrame(list(kept.items()), "key string, df long")
    want = sorted((i, k, kept[k]) for i, k, _ in rows if k in kept)
    for got in (J.salted_lookup(df, dims, ["key"], ["id"], salts=4, how="inner"),
                J.frequent_split_lookup(df, dims, "key", "df", ["id"], frequent=2),
                J.lookup(df, dims, ["key"], ["id"], how="inner")):
        assert sorted((r["id"], r["key"], r["df"]) for r in got.collect()) == want
    left = J.salted_lookup(df, dims, ["key"], ["id"], salts=4)
    assert left.count() == 300 and left.filter("df is null").count() == weights.get("k3", 0)
    assert J.fits_broadcast(dims) and not J.fits_broadcast(dims, max_rows=3)
    assert not J.fits_broadcast(dims, max_bytes=10)


def test_first_and_last_per_key(skewed):
    rows, df = skewed
    first, last = {}, {}
    for r in sorted(rows):
        first.setdefault(r[1], r)
        last[r[1]] = r
    assert {r["key"]: tuple(r) for r in J.first_per_key(df, ["key"], F.col("id")).collect()} == first
    assert {r["key"]: tuple(r) for r in J.last_per_key(df, ["key"], F.col("id")).collect()} == last


def test_corpus_repetition(spark):
    df = spark.createDataFrame([(10, "a"), (20, "b"), (30, "c")], "id long, t string")
    got = sorted((r["ordinal"], r["t"]) for r in C.repeat_to_length(df, "id", 7).collect())
    assert got == list(enumerate("abcabca"))
    assert sorted(r["t"] for r in C.repeat_to_length(df, "id", 2).collect()) == ["a", "b"]
    assert sorted((r["copy"], r["t"]) for r in C.repeat_times(df, 2).collect()) == [
        (c, t) for c in range(2) for t in "abc"]


def test_hash_sample_ignores_partitioning(spark):
    df = spark.range(2000).toDF("id")
    a = {r["id"] for r in R.hash_sample(df.repartition(3), "id", 0.25).collect()}
    b = {r["id"] for r in R.hash_sample(df.repartition(11), "id", 0.25).collect()}
    assert a == b and 400 < len(a) < 600


def test_route_rows_is_complete(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "id long, t string")
    good, bad = R.route_rows(df, {"missing": F.col("t").isNull(), "empty": F.col("t") == ""})
    assert [r["id"] for r in good.collect()] == [1]
    assert sorted((r["id"], r["reason"]) for r in bad.collect()) == [(2, "missing"), (3, "empty")]


@pytest.fixture(scope="module")
def bags(spark):
    docs = [(1, "a a b".split()), (2, "a c".split()), (3, "a".split()), (4, [])]
    return spark.createDataFrame(docs, "id long, words array<string>")


def test_vocabulary(bags):
    got = [tuple(r) for r in V.vocabulary(bags, vocab_size=2).orderBy("term_idx").collect()]
    assert got == [(0, "a", 4, 3), (1, "b", 1, 1)]
    assert [r["term"] for r in V.vocabulary(bags, min_df=0.5).collect()] == ["a"]
    assert [r["term"] for r in V.vocabulary(bags, min_df=2).collect()] == ["a"]


def test_tf_idf_matches_ml_and_both_join_forms(bags, spark, monkeypatch):
    from math import log

    want = {(1, "a"): 2 * log(5 / 4), (1, "b"): log(5 / 2), (2, "a"): log(5 / 4),
            (2, "c"): log(5 / 2), (3, "a"): log(5 / 4)}

    def result(**kw):
        return {(r["id"], r["term"]): r["tfidf"] for r in V.tf_idf(bags, "id", **kw).collect()}

    assert result() == pytest.approx(want) and result(vocab_size=10) == pytest.approx(want)
    monkeypatch.setattr(V, "fits_broadcast", lambda df: False)
    assert result() == pytest.approx(want)


def test_prune_rules(spark):
    terms = spark.createDataFrame([("a", 5), ("b", 1), ("c", 1), ("d", 9)], "term string, cf long")
    pruned = V.prune(terms, 2, keep=F.col("term") == "b", discard=F.col("term") == "d")
    assert sorted(r["term"] for r in pruned.filter("kept").collect()) == ["a", "b"]
    assert V.pruned_total(pruned).head() == (2, 2, 10)
    assert V.max_term_id(terms.filter("cf < 0").withColumn("term_idx", F.lit(0))).head()[0] == -1


def test_top_terms_of_a_hot_topic(spark):
    weights = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 50)).alias("topic"),
        F.col("id").cast("string").alias("term"), (F.col("id") % 97).cast("double").alias("weight"))
    top = V.top_terms(weights, "topic", 5)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # cut before and after the shuffle
    pdf = weights.toPandas().sort_values(["topic", "weight", "term"], ascending=[True, False, True])
    want = set(map(tuple, pdf.groupby("topic").head(5)[["topic", "term"]].values))
    assert {(r["topic"], r["term"]) for r in top.collect()} == want
    grouped = {r["topic"]: len(r["members"]) for r in V.group_members(top, "topic").collect()}
    assert set(grouped.values()) == {5}


def test_histogram_rounds_half_up_and_drops_zero(spark):
    docs = spark.createDataFrame([([0.025, 0.975],), ([0.024, 0.976],), ([0.5, 0.5],)],
                                 "topic_dist array<double>")
    got = {(r["topic"], r["weight"]): r["doc_count"] for r in T.topic_histogram(docs).collect()}
    assert got == {(0, 0.05): 1, (0, 0.5): 1, (1, 1.0): 2, (1, 0.5): 1}
    tags = T.topic_tags(docs, threshold=0.5).groupBy("topic").count().collect()
    assert sorted(map(tuple, tags)) == [(0, 1), (1, 3)]


def test_run_buckets_round_to_nearest(spark):
    got = spark.createDataFrame([(0.0,), (449.0,), (450.0,), (1349.9,)], "s double").select(
        B.run_bucket(F.col("s")).alias("b")).collect()
    assert [r["b"] for r in got] == [0, 0, 900, 900]


def test_recency_edges(spark):
    ages = spark.createDataFrame([(899,), (900,), (901,), (-5,)], "age long")
    kept = ages.filter(R.recent(F.lit(0), -F.col("age")))
    assert sorted(r["age"] for r in kept.collect()) == [-5, 899, 900]
    assert ages.filter(R.recent(F.lit(0), -F.col("age"), 900, 0)).count() == 2


def test_run_statistics_lists_silent_feeds(spark, monkeypatch):
    entries = spark.createDataFrame([(900, "a", 2.0), (900, "a", 4.0), (1800, "b", 1.0)],
                                    "run_id long, feed_name string, latency double")
    feeds = spark.createDataFrame([("a",), ("b",), ("b",)], "feed_name string")
    want = [(900, "a", 2, 3.0), (900, "b", 0, 0.0), (900, "b", 0, 0.0), (1800, "a", 0, 0.0),
            (1800, "b", 1, 1.0), (1800, "b", 1, 1.0)]
    assert sorted(map(tuple, B.run_statistics(entries, feeds).collect())) == want
    flagged = B.run_statistics(entries, feeds, failed=F.col("latency") > 3)
    assert {(r["run_id"], r["feed_name"], r["failed_count"]) for r in flagged.collect()} == {
        (900, "a", 1), (900, "b", 0), (1800, "a", 0), (1800, "b", 0)}
    monkeypatch.setattr(B, "fits_broadcast", lambda df: False)
    assert sorted(map(tuple, B.run_statistics(entries, feeds).collect())) == want


def test_counts_need_no_shuffle(spark, bags):
    counted = V.bag_of_words(bags.select("id", remove_stop_words(F.col("words")).alias("words")), "id")
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    vocab = V.term_frequencies(bags)._jdf.queryExecution().executedPlan().toString()
    assert vocab.count("Exchange hashpartitioning") == 1


def test_null_words_are_no_terms(spark):
    docs = spark.createDataFrame(
        [(1, ["b", None, "a", "b", None]), (2, [None]), (3, []), (4, None)],
        "id long, words array<string>")
    found = sorted(tuple(r) for r in V.bag_of_words(docs, "id").select("id", "term", "tf").collect())
    assert found == [(1, "a", 1), (1, "b", 2)]


def _texts(seed):
    """300 documents; one term holds a third of the words, most terms are rare, some tie."""
    rng = random.Random(seed)
    return [[rng.choice([None, "the", "the", "the", f"a{rng.randrange(8)}", f"b{rng.randrange(60)}",
                         f"c{rng.randrange(3000)}", f"c{rng.randrange(3000)}"])
             for _ in range(rng.randrange(40))] for _ in range(300)] + [None, []]


@pytest.mark.parametrize("size,tracked,most", [
    (5, None, V.MAX_TRACKED), (30, 30, V.MAX_TRACKED), (30, 30, 200), (5000, None, 1000),
    (5000, None, V.MAX_TRACKED)], ids=["easy", "widened", "counted", "all counted", "whole"])
def test_bounded_vocabulary(spark, monkeypatch, size, tracked, most):
    texts = _texts(size)
    cf, df = Counter(), Counter()
    for words in texts:
        cf.update(w for w in words or [] if w is not None)
        df.update({w for w in words or [] if w is not None})
    docs = spark.createDataFrame([(t, 1, 2) for t in texts],
                                 "words array<string>, term int, tf int").repartition(6)
    monkeypatch.setattr(V, "MAX_TRACKED", most)
    rows = V.bounded_vocabulary(docs, size, tracked=tracked, buckets=64).collect()
    want = sorted(cf, key=lambda w: (-cf[w], w))[:size]
    assert [(r.term_idx, r.term, r.cf, r.df) for r in sorted(rows)] == [
        (i, w, cf[w], df[w]) for i, w in enumerate(want)]
    assert all(r.rest_most < r.cf for r in rows)
    assert V.bounded_vocabulary(docs.limit(0), size).count() == 0
