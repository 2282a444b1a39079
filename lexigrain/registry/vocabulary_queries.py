"""Vocabulary, counts, weights and corpus statistics over all documents."""

from __future__ import annotations

from pyspark.ml.feature import IDF, CountVectorizer
from pyspark.sql import Window
from pyspark.sql import functions as F

from lexigrain.functions.stopwords import remove_stop_words
from lexigrain.functions.tokens import alphabetic_words, document_words
from lexigrain.operators import vocabulary as V
from lexigrain.operators.joins import lookup
from lexigrain.operators.once import with_once
from lexigrain.operators.rows import is_article_title, long_enough
from lexigrain.registry import sql as S
from lexigrain.registry.core import documents, query

_WORDS = S.no_stop_words(S.words("text"))
_TERMS = f"t AS (SELECT doc_id, lang, unnest({_WORDS}) AS term FROM documents)"
_FREQ = f"""{_TERMS},
    v AS (SELECT term, count(*) AS cf, count(DISTINCT doc_id) AS df FROM t GROUP BY term)"""


def word_documents(spark, sf_dir):
    """doc_id, lang, words (stop words removed)."""
    return documents(spark, sf_dir).select(
        "doc_id", "lang",
        remove_stop_words(document_words(F.col("text"))).alias("words"))


@query("vocabulary_top_terms", f"""
    WITH {_FREQ} SELECT row_number() OVER (ORDER BY cf DESC, term) - 1 AS term_idx,
    term, cf, df FROM v ORDER BY cf DESC, term LIMIT 25""")
def vocabulary_top_terms(spark, sf_dir):
    top = V.vocabulary(word_documents(spark, sf_dir), vocab_size=25)
    return top.withColumn("term_idx", F.col("term_idx").cast("long"))


@query("vocabulary_bounded", f"""
    WITH {_FREQ} SELECT row_number() OVER (ORDER BY cf DESC, term) - 1 AS term_idx,
    term, cf, df, true AS proven FROM v ORDER BY cf DESC, term LIMIT 25""")
def vocabulary_bounded(spark, sf_dir):
    """The top terms by frequent-item summaries; no other term can count as much."""
    top = V.bounded_vocabulary(word_documents(spark, sf_dir), 25)
    return top.select(F.col("term_idx").cast("long").alias("term_idx"), "term", "cf", "df",
                      (F.col("rest_most") < F.col("cf")).alias("proven"))


@query("vocabulary_min_count", f"WITH {_FREQ} SELECT term, cf, df FROM v WHERE df >= 5")
def vocabulary_min_count(spark, sf_dir):
    return V.vocabulary(word_documents(spark, sf_dir), min_df=5)


@query("vocabulary_min_share", f"""
    WITH {_FREQ} SELECT term, cf, df FROM v
    WHERE df >= (SELECT count(*) FROM documents) * 0.005""")
def vocabulary_min_share(spark, sf_dir):
    return V.vocabulary(word_documents(spark, sf_dir), min_df=0.005)


@query("bag_of_words", f"""
    WITH {_TERMS} SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL""")
def bag_of_words(spark, sf_dir):
    return V.bag_of_words(word_documents(spark, sf_dir), "doc_id")


_TFIDF = """
    n AS (SELECT count(*) AS m FROM documents),
    c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL)
    SELECT doc_id, term, tf, round(tf * ln((m + 1) / (df + 1)), 6) AS tfidf
    FROM c JOIN {terms} USING (term), n"""


@query("tf_idf", f"WITH {_FREQ}, {_TFIDF.format(terms='v')}")
def tf_idf(spark, sf_dir):
    return V.tf_idf(word_documents(spark, sf_dir), "doc_id").withColumn(
        "tfidf", F.round("tfidf", 6))


@query("tf_idf_sized", f"""WITH {_FREQ},
    s AS (SELECT * FROM v WHERE df >= 2 ORDER BY cf DESC, term LIMIT 2000),
    {_TFIDF.format(terms='s')}""")
def tf_idf_sized(spark, sf_dir):
    return V.tf_idf(word_documents(spark, sf_dir), "doc_id", min_df=2,
                    vocab_size=2000).withColumn("tfidf", F.round("tfidf", 6))


@query("idf_weights", f"""
    WITH {_FREQ} SELECT term, df,
    round(ln(((SELECT count(*) FROM documents) + 1) / (df + 1)), 6) AS idf FROM v""")
def idf_weights(spark, sf_dir):
    docs = word_documents(spark, sf_dir)
    total = docs.agg(F.count("*")).scalar()
    return V.term_frequencies(docs).select(
        "term", "df", F.round(V.idf_weight(total, F.col("df")), 6).alias("idf"))


def _count_vectorizer(docs, column, share):
    """A vectorizer of terms in at least a share of the documents.

    The share is passed as a number of documents: given a share, the fit keeps all words of
    a partition as objects, many times their text, only to count the rows.
    """
    least = max(1.0, share * docs.count())
    return CountVectorizer(inputCol="words", outputCol=column, minDF=least, vocabSize=1 << 18)


@query("ml_count_vectors", f"""
    WITH {_FREQ}, k AS (SELECT term FROM v WHERE df >= 0.05 * (SELECT count(*) FROM documents)),
    c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL)
    SELECT doc_id, term, tf FROM c JOIN k USING (term)""")
def ml_count_vectors(spark, sf_dir):
    docs = word_documents(spark, sf_dir)
    model = _count_vectorizer(docs, "v", 0.05).fit(docs)
    return _decode(model, model.transform(docs), "v", "tf").withColumn(
        "tf", F.col("tf").cast("long"))


@query("ml_tf_idf_vectors", f"""
    WITH {_FREQ}, k AS (SELECT term, df FROM v
        WHERE df >= 0.05 * (SELECT count(*) FROM documents)),
    n AS (SELECT count(*) AS m FROM documents),
    c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL)
    SELECT doc_id, term, round(tf * ln((m + 1) / (df + 1)), 6) AS tfidf
    FROM c JOIN k USING (term), n""")
def ml_tf_idf_vectors(spark, sf_dir):
    docs = word_documents(spark, sf_dir)
    model = _count_vectorizer(docs, "tf", 0.05).fit(docs)
    counts = model.transform(docs)
    weighted = IDF(inputCol="tf", outputCol="v").fit(counts).transform(counts)
    return _decode(model, weighted, "v", "tfidf").withColumn("tfidf", F.round("tfidf", 6))


def _decode(model, vectors, column, value):
    """(doc_id, term, value) of the non-zero vector entries.

    The vectors are sparse: their indices and values become rows, never the whole
    width. The vocabulary is a table; a lookup measures it.
    """
    spark = vectors.sparkSession
    terms = spark.createDataFrame(list(enumerate(model.vocabulary)), "i int, term string")
    entries = vectors.select("doc_id", F.unwrap_udt(column).alias("_v")).select(
        "doc_id", F.inline(F.arrays_zip(F.col("_v.indices").alias("i"),
                                        F.col("_v.values").alias(value))))
    return lookup(entries.filter(F.col(value) > 0), terms, ["i"], ["doc_id"], how="inner").select(
        "doc_id", "term", value)


@query("vocabulary_pruned", rf"""
    WITH {_FREQ} SELECT term, cf, CASE WHEN starts_with(term, 'th') THEN true
    WHEN length(term) > 12 THEN false ELSE cf >= 3 END AS kept FROM v""")
def vocabulary_pruned(spark, sf_dir):
    terms = V.term_frequencies(word_documents(spark, sf_dir)).select("term", "cf")
    return V.prune(terms, 3, keep=F.col("term").startswith("th"),
                   discard=F.length("term") > 12)


@query("vocabulary_prune_summary", f"""
    WITH {_FREQ} SELECT count(*) FILTER (cf >= 3) AS kept_terms,
    count(*) FILTER (cf < 3) AS pruned_terms,
    coalesce(sum(cf) FILTER (cf < 3), 0)::BIGINT AS pruned_total FROM v""")
def vocabulary_prune_summary(spark, sf_dir):
    terms = V.term_frequencies(word_documents(spark, sf_dir))
    return V.pruned_total(V.prune(terms, 3))


@query("max_term_id", f"""
    WITH {_FREQ}, s AS (SELECT term FROM v WHERE df >= 2)
    SELECT least(count(*), 5000) - 1 AS max_term_id, least(count(*), 5000) AS n_features
    FROM s""")
def max_term_id(spark, sf_dir):
    vocab = V.vocabulary(word_documents(spark, sf_dir), min_df=2, vocab_size=5000)
    return V.max_term_id(vocab.withColumn("term_idx", F.col("term_idx").cast("long")))


@query("corpus_statistics", r"""
    WITH d AS (SELECT CASE lang WHEN 'de' THEN 'Help:' WHEN 'es' THEN 'Helper:' ELSE '' END
        || source AS title, len(list_filter(
        regexp_extract_all(lower(text), '([\p{L}\p{Nl}\p{No}_]+)', 1),
        lambda t: length(t) BETWEEN 2 AND 15 AND NOT starts_with(t, '_'))) AS n FROM documents),
    f AS (SELECT n, n >= 50 AND NOT starts_with(title, 'Help:') AS kept FROM d)
    SELECT count(*) AS articles_all, sum(n)::BIGINT AS positions_all,
           count(*) FILTER (kept) AS articles,
           coalesce(sum(n) FILTER (kept), 0)::BIGINT AS positions FROM f""")
def corpus_statistics(spark, sf_dir):
    title = F.concat(F.when(F.col("lang") == "de", "Help:").when(
        F.col("lang") == "es", "Helper:").otherwise(""), "source")
    docs = documents(spark, sf_dir).select(
        title.alias("title"), alphabetic_words(F.col("text")).alias("words"))
    return V.corpus_statistics(docs, long_enough(F.col("words")) & is_article_title(F.col("title")))


@query("long_documents", f"""
    SELECT doc_id, len(w) AS n_words FROM (SELECT doc_id, {S.words('text')} AS w FROM documents)
    WHERE len(w) >= 50""")
def long_documents(spark, sf_dir):
    docs = with_once(documents(spark, sf_dir), "words", document_words(F.col("text")))
    return docs.filter(long_enough(F.col("words"))).select(
        "doc_id", F.size("words").cast("long").alias("n_words"))


# languages stand for topics: the weight of a term is its count there times its idf
_BY_LANG = f"""{_FREQ},
    g AS (SELECT lang, term, count(*) AS cf FROM t GROUP BY ALL),
    w AS (SELECT lang, term, round(g.cf * ln(((SELECT count(*) FROM documents) + 1)
          / (v.df + 1)), 6) AS weight FROM g JOIN v USING (term)),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY weight DESC, term) AS rank
          FROM w QUALIFY rank <= 25)"""


def language_terms(spark, sf_dir):
    docs = word_documents(spark, sf_dir)
    total = docs.agg(F.count("*")).scalar()
    per_lang = V.term_frequencies(docs, by=["lang"])
    # every document has one language, so df over the corpus is the sum over languages
    all_df = F.sum("df").over(Window.partitionBy("term"))  # a row per language
    return per_lang.select("lang", "term", F.round(
        F.col("cf") * V.idf_weight(total, all_df), 6).alias("weight"))


@query("top_terms_per_language", f"""
    WITH {_BY_LANG} SELECT lang, rank, term, weight FROM r""")
def top_terms_per_language(spark, sf_dir):
    return V.top_terms(language_terms(spark, sf_dir), "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "term", "weight")


@query("language_members", f"""
    WITH {_BY_LANG} SELECT lang, count(*) AS n_terms,
    string_agg(term, ' ' ORDER BY rank) AS terms FROM r GROUP BY lang""")
def language_members(spark, sf_dir):
    grouped = V.group_members(V.top_terms(language_terms(spark, sf_dir), "lang"), "lang")
    return grouped.select("lang", F.size("members").cast("long").alias("n_terms"), F.array_join(
        F.transform("members", lambda m: m["term"]), " ").alias("terms"))


@query("decoded_topics", f"""
    WITH {_BY_LANG} SELECT dense_rank() OVER (ORDER BY lang) - 1 AS topic, term, weight,
    rank - 1 AS place FROM r""")
def decoded_topics(spark, sf_dir):
    """Languages as topics given by term indices, decoded through the vocabulary."""
    ranked = V.top_terms(language_terms(spark, sf_dir), "lang").persist()
    vocab = ranked.select("term").distinct().select(  # at most 25 terms per language
        (F.row_number().over(Window.orderBy("term")) - 1)
        .alias("term_idx"), "term")
    indexed = ranked.join(F.broadcast(vocab), "term").groupBy("lang").agg(F.array_sort(
        F.collect_list(F.struct("rank", "term_idx", "weight"))).alias("e"))
    topics = indexed.select(
        (F.dense_rank().over(Window.orderBy("lang")) - 1)
        .alias("topic"), F.col("e.term_idx").alias("termIndices"),
        F.col("e.weight").alias("termWeights"))
    decoded = V.decode_topics(topics, vocab)
    return decoded.select(F.col("topic").cast("long").alias("topic"), "term", "weight",
                          F.col("place").cast("long").alias("place"))
