import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrain.llm import languages as L
from lexigrain.llm import rule_ensemble as R
from llm_samples import prose

SF_DIR = "/root/testdata/sf0.01"


def brute_posteriors(rows, weights, names):
    """Fusion in plain Python: rows of (text, host, domain, suffix, declared)."""
    told = []
    for text, *_ in rows:
        total, grams = np.zeros(len(names)), 0
        for part in L.blocks_of_text(text or ""):
            cells = L.trigram_cells(part)
            grams += len(cells)
            for cell in cells:
                total += weights[cell]
        odds = np.exp(L.TEMPER * (total - total.max()))
        told.append((grams, odds / odds.sum()))

    def summed(column, value, without=None):
        return sum((p for i, ((g, p), row) in enumerate(zip(told, rows, strict=True))
                    if g and row[column] == value and i != without), np.zeros(len(names)))

    overall = sum((p for g, p in told if g), np.zeros(len(names)))
    share = (overall + 1) / (overall.sum() + len(names))
    out = []
    for i, ((_, p), row) in enumerate(zip(told, rows, strict=True)):
        odds = np.log(p)
        for column in (3, 4):
            values = {r[column] for r, (g, _) in zip(rows, told, strict=True) if g and r[column]}
            if row[column] in values:
                all_values = sum(summed(column, v) for v in values)
                odds = odds + np.log((summed(column, row[column]) + L.SMOOTH)
                                     / (all_values + L.SMOOTH * len(values)))
        prior = share
        for column in (2, 1):
            own = summed(column, row[column], i) if row[column] else np.zeros(len(names))
            prior = (own + L.PULL * prior) / (own.sum() + L.PULL)
        odds = np.exp(odds + np.log(prior) - (odds + np.log(prior)).max())
        out.append(odds / odds.sum())
    return out


def test_fusion_equals_brute_force(spark):
    rng = random.Random(8)
    sides = {"aa": "xyz vwq zzy xxw", "bb": "efg hij ghe jif"}
    docs = [(i, " ".join(rng.choice(sides[s].split()) for _ in range(30)), s)
            for i, s in enumerate(["aa", "bb"] * 10)]
    model = L.learn(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert model.languages == ("aa", "bb")
    rows = []
    for i in range(40):
        side = rng.choice(["aa", "bb"])
        text = rng.choice([None, "", "12 3", sides[side], sides[side][:4], "xyz efg"])
        rows.append((text, rng.choice([None, "h1.a.com", "h2.a.com"]), rng.choice([None, "a.com"]),
                     rng.choice([None, "com", "org"]), rng.choice([None, "aa", "bb", "cc"])))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                               "id int, text string, host string, domain string, suffix string, "
                               "declared string").repartition(3)
    got = {r.id: r for r in L.identify(df, model).collect()}
    for i, posterior in enumerate(brute_posteriors(rows, model.weights, model.languages)):
        assert abs(got[i].confidence - posterior.max()) < 1e-9
        if abs(posterior[0] - posterior[1]) > 1e-9:
            assert got[i].lang == model.languages[int(posterior.argmax())]
        assert got[i].kept == (got[i].n_grams > 0 and got[i].confidence >= 0.5)


def test_rare_languages_stay_known(spark):
    """A language of few documents is known however many rows the table has."""
    rows = [(i, "ka lo mi ren tas", "aa") for i in range(3000)]
    rows += [(5000 + i, "xyz vwq zzy xxw", "bb") for i in range(3)]
    rows += [(6000 + i, "efg hij ghe jif", "cc") for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = L.learn(df, size=30)
    assert model.languages == ("aa", "bb")
    docs = df.filter("lang <> 'cc'").withColumn("source", F.lit("s"))
    found = L.identify(L.document_records(docs, F.col("lang").alias("told")), model)
    assert found.filter("lang <> told").count() == 0


def invented(rng, alphabet, words):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 9)))
                    for _ in range(words))


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_strange_and_mixed_texts_are_not_kept(spark):
    """Gibberish, another script and halves of two languages go; plain text of any length stays."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").repartition(8)
    rng = random.Random(3)
    plain = {lang: [r.text.split() for r in docs.filter(
        (F.col("lang") == lang) & ~F.col("text").rlike(r"[$%|!@0-9]")).orderBy("doc_id").collect()
        if len(r.text.split()) >= 200][:20] for lang in ("en", "de")}
    rows = []
    for n in (15, 50, 200, 2000):
        for i in range(20):
            en, de = plain["en"][i % len(plain["en"])], plain["de"][i % len(plain["de"])]
            rows += [("latin", invented(rng, "abcdefghijklmnopqrstuvwxyz", n)),
                     ("script", invented(rng, "абвгдежзийклмнопрстуфхцчшщыэюя", n)),
                     ("mixed", " ".join(en[:n] + de[:min(n, len(en))]))]
    for n in (1, 2, 5, 15, 50, 200):
        rows += [("plain", " ".join(words[:n])) for side in plain.values() for words in side]
    df = spark.createDataFrame([(i, k, t, "s") for i, (k, t) in enumerate(rows)],
                               "doc_id long, kind string, text string, source string")
    found = L.identify(L.document_records(df, "doc_id", "kind"), L.learn(docs))
    share = {r.kind: r.s for r in found.groupBy("kind").agg(
        F.avg(F.col("kept").cast("int")).alias("s")).collect()}
    assert share["latin"] == 0 and share["script"] == 0
    assert share["mixed"] < 0.1 and share["plain"] > 0.98


def test_evidence_beside_the_text(spark):
    """A text that fits two languages alike follows declaration and host."""
    rows = [(i, "aaa bbb", f"{side}.x.org", "x.org", "org", side)
            for i, side in enumerate(["p", "q"] * 20)]
    docs = [(i, t, s) for i, (t, s) in enumerate([("aaa ccc ccc ccc", "p"),
                                                  ("bbb ddd ddd ddd", "q")] * 5)]
    model = L.learn(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    strong = [(100 + i, "ccc ccc" if s == "p" else "ddd ddd", f"{s}.x.org", "x.org", "org", s)
              for i, s in enumerate(["p", "q"] * 30)]
    df = spark.createDataFrame(rows + strong, "id int, text string, host string, domain string, "
                                              "suffix string, declared string")
    got = L.identify(df, model).collect()
    assert all(r.lang == r.declared for r in got)


def test_pages(spark):
    rows = [(1, "https://u@De.News.example.de:80/x", '<html class=a lang="de-AT"><p>Hallo</p>'),
            (2, "nonsense", "<p>x"), (3, None, None), (4, "http://localhost", "<HTML LANG=fr>")]
    got = L.page_records(spark.createDataFrame(rows, "page_id int, url string, html string"),
                         "page_id").orderBy("page_id").collect()
    assert [(r.host, r.domain, r.suffix, r.declared) for r in got] == [
        ("de.news.example.de", "example.de", "de", "de"), (None, None, None, None),
        (None, None, None, None), ("localhost", None, None, "fr")]


def test_language_edges(spark, edge, empty):
    for labelled in (edge, empty):
        model = L.learn(labelled)
        rows = L.identify(L.document_records(edge, "doc_id"), model).collect()
        assert len(rows) == edge.count()
    assert L.identify(L.document_records(empty, "doc_id"), L.learn(edge)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").repartition(8)
    model = L.learn(docs.filter("doc_id % 2 = 0"))
    found = L.identify(L.document_records(docs.filter("doc_id % 2 = 1"), "doc_id"), model)
    right = found.join(docs.select("doc_id", F.col("lang").alias("told")), "doc_id").agg(
        F.avg((F.col("lang") == F.col("told")).cast("int")), F.avg(F.col("kept").cast("int"))).head()
    assert right[0] > 0.98 and right[1] > 0.98

    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    rows = R.classify(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").filter(
        "held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_pages_table(spark):
    """Pages with all evidence get the language of their markup, and nearly all are kept."""
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet").repartition(8)
    model = L.learn(spark.read.parquet(f"{SF_DIR}/documents.parquet").repartition(8))
    found = L.identify(L.page_records(pages, "page_id"), model).join(
        L.page_records(pages, "page_id").select("page_id", F.col("declared").alias("told")),
        "page_id")
    right = found.filter("told IS NOT NULL").agg(
        F.count("*"), F.avg((F.col("lang") == F.col("told")).cast("int")),
        F.avg(F.col("kept").cast("int"))).head()
    assert right[0] == 250 and right[1] > 0.98 and right[2] > 0.98


def test_rules_of_a_tree():
    described = """DecisionTreeClassificationModel: uid=x, depth=2
  If (feature 0 <= 2.5)
   If (feature 2 <= 0.125)
    Predict: 1.0
   Else (feature 2 > 0.125)
    Predict: 0.0
  Else (feature 0 > 2.5)
   Predict: 0.0
"""
    inf = np.inf
    assert [r.conditions for r in R.tree_paths(described)] == [
        (("log_words", -inf, 2.5),), (("log_words", -inf, 2.5), ("symbol_share", -inf, 0.125)),
        (("log_words", -inf, 2.5), ("symbol_share", 0.125, inf)), (("log_words", 2.5, inf),)]


def test_rule_columns_equal_brute_force(spark):
    rules = ((1.5, R.Rule((("upper_share", 0.1, np.inf), ("log_words", -np.inf, 3.0)))),
             (-2.0, R.Rule((("bar_share", -np.inf, 0.0),))))
    ensemble = R.Ensemble(0.25, rules)
    texts = ["", "A b", "ABC DEF", "a | b", prose(3), "Z" * 9, None]
    df = R.with_statistics(spark.createDataFrame(list(enumerate(texts)), "id int, text string"))
    for r in df.select("id", ensemble.score().alias("s")).collect():
        values = dict(zip(R.STATISTICS, R.statistics(texts[r.id] or ""), strict=True))
        total = 0.25 + sum(w for w, rule in rules if all(
            low < values[n] <= high for n, low, high in rule.conditions))
        assert abs(r.s - 1 / (1 + np.exp(-total))) < 1e-12


def test_classifier_edges(spark, edge, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in R.classify(edge, none).collect()} == {0.5}
    one_sided = spark.createDataFrame([(1, 1), (2, 1), (None, 0), (3, None)], "doc_id long, quality int")
    assert all(r.score > 0.5 for r in R.classify(edge, one_sided).collect())
    both = spark.createDataFrame([(1, 1), (2, 1), (5, 0), (4, 0), (6, 0), (9, 0), (7, 1), (1, 1)],
                                 "doc_id long, quality int")
    rows = R.classify(edge, both).collect()
    assert len(rows) == edge.count() and all(0 <= r.score <= 1 for r in rows)
    assert R.classify(empty, both).count() == 0
