"""Projections, filters, samples, quarantine, unions and key access."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrain.functions.tokens import document_words
from lexigrain.operators import corpus as C
from lexigrain.operators import ordering as O
from lexigrain.operators import rows as R
from lexigrain.operators.codes import describe_codes
from lexigrain.operators.similarity import top_similar, with_texts
from lexigrain.plans.ingest import union_sources
from lexigrain.registry import sql as S
from lexigrain.registry.core import documents, query, table


@query("selected_columns", "SELECT doc_id, lang FROM documents")
def selected_columns(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang")


@query("named_by_position", "SELECT l_orderkey AS id, l_partkey AS part FROM lineitem")
def named_by_position(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").toDF("id", "part")


@query("provenance_columns", """
    SELECT item_id, 'bench' AS dataset, '' AS cat, '' AS url FROM benchmark""")
def provenance_columns(spark, sf_dir):
    return R.constant_columns(table(spark, sf_dir, "benchmark").select("item_id"),
                              dataset="bench", cat="", url="")


@query("epoch_text", """
    SELECT event_id, strftime(make_timestamp(epoch_us(ts) // 1000000 * 1000000),
    '%Y-%m-%d %H:%M:%S') AS published FROM events""")
def epoch_text(spark, sf_dir):
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        "event_id", R.epoch_text(seconds).alias("published"))


@query("dataset_filter", "SELECT doc_id, source FROM documents WHERE source = 'src1'")
def dataset_filter(spark, sf_dir):
    return R.only_dataset(table(spark, sf_dir, "documents").select("doc_id", "source"),
                          "src1", "source")


@query("present_fields", """
    SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)
    WHERE quality IS NOT NULL AND toxic IS NOT NULL""")
def present_fields(spark, sf_dir):
    labelled = table(spark, sf_dir, "documents").select("doc_id").join(
        table(spark, sf_dir, "labels"), "doc_id", "left")
    return R.with_fields(labelled, "quality", "toxic")


@query("arity_filter", """
    SELECT doc_id, len(string_split(text, ',')) = 5 AS exactly_five FROM documents
    WHERE len(string_split(text, ',')) >= 5""")
def arity_filter(spark, sf_dir):
    docs = documents(spark, sf_dir)
    kept = docs.filter(R.has_arity(F.col("text"), 5, exact=False, sep=","))
    return kept.select("doc_id", R.has_arity(F.col("text"), 5, sep=",").alias("exactly_five"))


_ROUTE = """CASE WHEN n_chars < 200 THEN 'too short' WHEN lang NOT IN ('en', 'fr', 'es')
            THEN 'language' WHEN NOT contains(text, '. ') THEN 'no sentence' END"""


def _routed(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return R.route_rows(docs, {
        "too short": F.col("n_chars") < 200,
        "language": ~F.col("lang").isin("en", "fr", "es"),
        "no sentence": ~F.col("text").contains(". ")})


@query("good_rows", f"""
    SELECT doc_id, text FROM documents WHERE ({_ROUTE}) IS NULL""")
def good_rows(spark, sf_dir):
    return _routed(spark, sf_dir)[0].select("doc_id", "text")


@query("quarantined_rows", f"""
    SELECT doc_id, {_ROUTE} AS reason FROM documents WHERE ({_ROUTE}) IS NOT NULL""")
def quarantined_rows(spark, sf_dir):
    return _routed(spark, sf_dir)[1].select("doc_id", "reason")


@query("bernoulli_sample", """
    SELECT count(*) AS n_docs, 0::BIGINT AS not_given, true AS near_share FROM documents""")
def bernoulli_sample(spark, sf_dir):
    """Draws differ by partitioning; each row comes once and about a quarter comes at all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    drawn = R.bernoulli_sample(docs, 0.25).groupBy("doc_id", "lang").agg(F.count("*").alias("n"))
    both = docs.join(drawn, ["doc_id", "lang"], "full")
    share = F.sum("n") / F.count("*")
    return both.agg(
        F.count("*").alias("n_docs"), F.count_if(F.col("n") > 1).alias("not_given"),
        # five standard deviations of a draw of a quarter
        (F.abs(share - 0.25) < 5 * F.sqrt(0.1875 / F.count("*"))).alias("near_share"))


@query("hash_sample", """
    SELECT doc_id FROM documents
    WHERE ('0x' || substr(md5('42:' || doc_id), 1, 8))::BIGINT / 4294967296.0 < 0.25""")
def hash_sample(spark, sf_dir):
    return R.hash_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.25)


@query("article_titles", """
    WITH d AS (SELECT doc_id, CASE lang WHEN 'de' THEN 'Help:' WHEN 'es' THEN 'Helper:'
        WHEN 'fr' THEN 'Category:' ELSE '' END || source AS title FROM documents)
    SELECT doc_id, title FROM d WHERE NOT starts_with(title, 'Help:')
    AND NOT starts_with(title, 'Category:')""")
def article_titles(spark, sf_dir):
    prefix = (F.when(F.col("lang") == "de", "Help:").when(F.col("lang") == "es", "Helper:")
              .when(F.col("lang") == "fr", "Category:").otherwise(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(prefix, "source").alias("title"))
    return docs.filter(R.is_article_title(F.col("title")))


@query("namespace_filter", """
    SELECT doc_id, CASE WHEN lang IN ('en', 'fr') THEN text ELSE '' END AS text FROM documents""")
def namespace_filter(spark, sf_dir):
    ns = F.when(F.col("lang") == "de", 10).when(F.col("lang") == "es", 4).when(
        F.col("lang") == "fr", 0)  # English pages carry no number, which means 0
    return documents(spark, sf_dir).select(
        "doc_id", F.when(R.in_namespaces(ns), F.col("text")).otherwise("").alias("text"))


@query("quality_flag_counts", """
    SELECT lang <> 'de' AS plain, count(*) AS n_docs FROM documents GROUP BY 1""")
def quality_flag_counts(spark, sf_dir):
    tags = table(spark, sf_dir, "documents").select(F.when(
        F.col("lang") == "de", F.concat(F.lit('"'), "source")).otherwise(
        F.concat(F.lit("set("), "source", F.lit(")"))).alias("tags"))
    return tags.groupBy(R.is_plain_value(F.col("tags")).alias("plain")).agg(
        F.count("*").alias("n_docs"))


_SOURCES = """
    SELECT 'd' || doc_id AS id, 'signal' AS dataset, lang AS cat, source, '' AS url, text AS content
    FROM documents
    UNION ALL SELECT 'b' || item_id, 'ag', '', '', '', text FROM benchmark
    UNION ALL SELECT 'c' || conv_id || '-' || turn, 'crawl', role, '', '', text FROM conversations"""


@query("union_of_sources", f"""
    WITH u AS ({_SOURCES}), w AS (SELECT *, {S.words('content')} AS w FROM u)
    SELECT id, dataset, cat, source, url, array_to_string(w, ' ') AS words FROM w""")
def union_of_sources(spark, sf_dir):
    def common(df, id_, dataset, cat, source):
        return df.select(id_.alias("id"), F.lit(dataset).alias("dataset"), cat.alias("cat"),
                         source.alias("source"), F.lit("").alias("url"),
                         F.col("text").alias("content"))

    none = F.lit("")
    turn = F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn")
    union = union_sources(
        common(documents(spark, sf_dir), F.concat(F.lit("d"), "doc_id"), "signal",
               F.col("lang"), F.col("source")),
        common(table(spark, sf_dir, "benchmark"), F.concat(F.lit("b"), "item_id"), "ag", none, none),
        common(table(spark, sf_dir, "conversations"), turn, "crawl", F.col("role"), none))
    return union.select("id", "dataset", "cat", "source", "url", F.array_join(
        document_words(F.col("content")), " ").alias("words"))


@query("json_key", """
    SELECT event_id, (props->>'k')::BIGINT AS k FROM events""")
def json_key(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("inverted_map", """
    SELECT c_acctbal, max(c_name) AS c_name FROM customer GROUP BY c_acctbal""")
def inverted_map(spark, sf_dir):
    return C.invert_map(table(spark, sf_dir, "customer"), "c_name", "c_acctbal")


@query("corpus_copies", """
    SELECT doc_id, copy FROM documents, (SELECT unnest(range(3)) AS copy)""")
def corpus_copies(spark, sf_dir):
    copies = C.repeat_times(table(spark, sf_dir, "documents").select("doc_id"), 3)
    return copies.withColumn("copy", F.col("copy").cast("long"))


@query("corpus_to_length", """
    WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos,
               count(*) OVER () AS n FROM documents),
    c AS (SELECT unnest(range(3)) AS copy)
    SELECT doc_id, copy * n + pos AS ordinal FROM d, c WHERE copy * n + pos < n * 5 // 2""")
def corpus_to_length(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    length = docs.count() * 5 // 2
    return C.repeat_to_length(docs, "doc_id", length).select("doc_id", "ordinal")


@query("first_rows", "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 50")
def first_rows(spark, sf_dir):
    return O.head(documents(spark, sf_dir).select("doc_id", "text"), "doc_id", 50)


@query("page_ordinals", """
    SELECT doc_id, row_number() OVER (ORDER BY n_chars * 1000000 + doc_id) - 1 AS pos
    FROM documents""")
def page_ordinals(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.col("n_chars") * 1_000_000 + F.col("doc_id")).alias("place"))
    return O.with_position(docs, "place").select("doc_id", "pos")


@query("sliced_rows", """
    SELECT event_id, pos FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS pos,
           count(*) OVER () AS n FROM events)
    WHERE pos >= 10 AND (pos - 10) % 7 = 0 AND pos < n - 5""")
def sliced_rows(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id")
    return O.slice_rows(events, "event_id", 10, events.count() - 5, 7)


@query("picked_rows", """
    SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos
    FROM documents) WHERE pos IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def picked_rows(spark, sf_dir):
    wanted = table(spark, sf_dir, "labels").filter("quality = 1").select(
        F.col("doc_id").alias("pos"))
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return O.pick_rows(docs, "doc_id", wanted).select("doc_id")


@query("repeated_neighbours_dropped", """
    SELECT doc_id, lang FROM (SELECT doc_id, lang, lag(lang) OVER (ORDER BY doc_id) AS p
    FROM documents) WHERE p IS NULL OR p <> lang""")
def repeated_neighbours_dropped(spark, sf_dir):
    return O.drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "lang"),
                          "doc_id", "lang")


@query("sorted_by_length", """
    SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id""")
def sorted_by_length(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").orderBy(
        F.desc("n_chars"), "doc_id")


@query("top_similar_documents", """
    WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
    s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) AS s
          FROM embeddings, q),
    r AS (SELECT * FROM s ORDER BY s DESC, vec_id LIMIT 10)
    SELECT vec_id, round(s, 6) AS similarity, text FROM r JOIN documents ON doc_id = vec_id""")
def top_similar_documents(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    wanted = vectors.filter("vec_id = 0").select("embedding").scalar()
    ranked = top_similar(vectors, wanted, 10)
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    return with_texts(ranked, texts, "vec_id").withColumn("similarity", F.round("similarity", 6))


@query("random_items", """
    SELECT c_custkey, c_name FROM customer ORDER BY md5('42:' || c_custkey) LIMIT 20""")
def random_items(spark, sf_dir):
    return C.random_items(table(spark, sf_dir, "customer").select("c_custkey", "c_name"),
                          "c_custkey", 20)


@query("described_codes", """
    SELECT c_custkey, n_name AS description FROM customer
    LEFT JOIN nation ON n_nationkey = c_nationkey""")
def described_codes(spark, sf_dir):
    codes = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("code"), F.col("n_name").alias("description"))
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_nationkey").alias("nation"))
    return describe_codes(customers, codes, "nation").select("c_custkey", "description")


@query("repartitioned_by_column", """
    SELECT source, count(*) AS n_docs FROM documents GROUP BY source""")
def repartitioned_by_column(spark, sf_dir):
    """Rows are rebalanced by source: a source with most rows is split over tasks, and
    counts are combined before the second shuffle."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    dealt = docs.hint("rebalance", "source")
    return dealt.groupBy("source").agg(F.count("*").alias("n_docs"))
