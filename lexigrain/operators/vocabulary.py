"""Vocabularies, term counts and weights as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrain.functions.arrays import term_counts
from lexigrain.operators.joins import fits_broadcast, frequent_split_lookup, lookup
from lexigrain.operators.once import inline_once
from lexigrain.operators.ordering import top_rows
from lexigrain.session import ensure_checkpoint_dir, landed

MAX_TRACKED = 1_000_000  # terms of the widest summary
BUCKETS = 1 << 16  # of the terms that are not candidates


def document_bags(docs: DataFrame, *keys: str, words: str = "words") -> DataFrame:
    """(keys, bag): the term counts of a row as one array, counted inside the row."""
    return docs.select(*keys, term_counts(F.col(words)).alias("bag"))


def bag_of_words(docs: DataFrame, key: str, words: str = "words") -> DataFrame:
    """(key, term, tf), without a shuffle."""
    return inline_once(document_bags(docs, key, words=words), F.col("bag"), "term", key)


def bag_frequencies(bags: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(term, cf, df): corpus and document frequency, in one shuffle on the term.

    A row emits each of its terms once with its count, so document frequency needs
    no distinct, and map-side combine shrinks frequent terms before the shuffle.
    """
    groups = by or []
    return inline_once(bags, F.col("bag"), "term", *groups).groupBy(*groups, "term").agg(
        F.sum("tf").alias("cf"), F.count("*").alias("df"))


def term_frequencies(docs: DataFrame, words: str = "words",
                     by: list[str] | None = None) -> DataFrame:
    return bag_frequencies(document_bags(docs, *(by or []), words=words), by)


def _choose(terms: DataFrame, docs: DataFrame, min_df: float,
            vocab_size: int | None) -> DataFrame:
    if min_df >= 1:
        terms = terms.filter(F.col("df") >= min_df)
    else:
        total = docs.agg(F.count("*")).scalar()
        terms = terms.filter(F.col("df") >= total * F.lit(float(min_df)))
    if vocab_size is None:
        return terms
    order = [F.desc("cf"), F.asc("term")]
    top = top_rows(terms, order, vocab_size)
    return top.select(  # at most vocab_size rows
        (F.row_number().over(Window.orderBy(*order)) - 1).alias("term_idx"), "term", "cf", "df")


def vocabulary(docs: DataFrame, words: str = "words", min_df: float = 1,
               vocab_size: int | None = None) -> DataFrame:
    """(term, cf, df) with document frequency at least ``min_df``, largest cf first.

    ``min_df`` below 1 is a share of the documents, else a count. ``vocab_size``
    keeps that many terms (ties by term) and numbers them as ``term_idx``.
    """
    return _choose(term_frequencies(docs, words), docs, min_df, vocab_size)


def bounded_vocabulary(docs: DataFrame, vocab_size: int, words: str = "words",
                       tracked: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(term_idx, term, cf, df, rest_most): the same terms as :func:`vocabulary` with
    ``vocab_size``, from shuffles whose size does not depend on the number of distinct terms.

    A first pass keeps a mergeable summary of frequent terms a task, ``tracked`` terms wide
    (at first 8 times the size of the vocabulary), and takes the terms it still holds as
    candidates. A second pass counts candidates exactly and all other terms by the bucket
    of their hash. ``rest_most``, the fullest bucket, is as much as any other term can
    count: below the least count of the vocabulary it proves that no term is missing. If it
    is not, a round with four times the terms and buckets follows; past ``MAX_TRACKED``
    terms all are counted one by one, and ``rest_most`` is 0. The term counts of each row are
    written once, at once, and read by every pass. Ties go by term; null terms
    are no terms; a vocabulary of fewer terms than asked for is whole.
    """
    if vocab_size < 1:
        raise ValueError("vocab_size must be positive")
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    spoken = docs.select(F.array_compact(words).alias("words"))
    bags = landed(document_bags(spoken.withColumn("_doc", F.xxhash64("words")), "_doc"), "bags")
    counts = inline_once(bags, F.col("bag"), "term", "_doc")
    spelled = counts.select(F.explode(F.expr("array_repeat(term, int(tf))")).alias("term"))
    order = [F.desc("cf"), F.asc("term")]
    number = (F.row_number().over(Window.orderBy(*order)) - 1).alias("term_idx")
    tracked = tracked or 8 * vocab_size
    while tracked <= MAX_TRACKED:
        held = spelled.agg(F.expr(
            f"approx_top_k_estimate(approx_top_k_accumulate(term, {tracked}), {tracked})").alias(
            "held")).select(F.explode("held.item").alias("term")).checkpoint()
        marked = lookup(counts, held.withColumn("_held", F.lit(True)), ["term"], ["_doc"])
        bucket = F.when(F.col("_held").isNull(), F.pmod(F.xxhash64("term"), F.lit(buckets)))
        sums = marked.groupBy(F.when(F.col("_held"), F.col("term")).alias("term"),
                              bucket.alias("_bucket")).agg(
            F.sum("tf").alias("cf"), F.count("*").alias("df")).checkpoint()
        top = top_rows(sums.filter("term IS NOT NULL").drop("_bucket"), order, vocab_size)
        least, found = top.agg(F.min("cf"), F.count("*")).head()
        most = sums.filter("term IS NULL").agg(F.max("cf")).head()[0] or 0
        if not most or (found == vocab_size and most < least):
            return top.select(number, "term", "cf", "df", F.lit(most).cast("long").alias(
                "rest_most"))
        tracked, buckets = 4 * tracked, 4 * buckets
    every = counts.groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))
    return _choose(every, docs, 1, vocab_size).withColumn("rest_most", F.lit(0).cast("long"))


def idf_weight(documents: Column, df: Column) -> Column:
    return F.log((documents + 1) / (df + 1))


def tf_idf(docs: DataFrame, key: str, words: str = "words", min_df: float = 1,
           vocab_size: int | None = None) -> DataFrame:
    """(key, term, tf, tfidf) over the vocabulary.

    The counts are read twice (vocabulary, then weights), so they are written once; as
    rows they are several times the text, too much for the executors' memory. The
    vocabulary is checkpointed and measured: broadcast if small, else joined by shuffle
    with the most frequent terms taken out of the shuffle keys.
    """
    bags = landed(document_bags(docs, key, words=words), "bags")
    total = bags.agg(F.count("*")).scalar()
    counts = inline_once(bags, F.col("bag"), "term", key)
    terms = _choose(bag_frequencies(bags), bags, min_df, vocab_size).select("term", "df")
    ensure_checkpoint_dir(docs.sparkSession)
    terms = terms.checkpoint()
    if fits_broadcast(terms):
        joined = counts.join(F.broadcast(terms), "term")
    else:
        joined = frequent_split_lookup(counts, terms, "term", "df", [key])
    weight = F.col("tf") * idf_weight(total, F.col("df"))
    return joined.select(key, "term", "tf", weight.alias("tfidf"))


def prune(terms: DataFrame, min_count: int, keep: Column | None = None,
          discard: Column | None = None, count: str = "cf") -> DataFrame:
    """Add ``kept``: the rule columns decide first, the count decides the rest."""
    kept = F.col(count) >= min_count
    if discard is not None:
        kept = F.when(discard, False).otherwise(kept)
    if keep is not None:
        kept = F.when(keep, True).otherwise(kept)
    return terms.withColumn("kept", kept)


def pruned_total(terms: DataFrame, count: str = "cf") -> DataFrame:
    """How many terms stay, how many go, and the sum of the counts that go."""
    return terms.agg(
        F.count_if("kept").alias("kept_terms"),
        F.count_if(~F.col("kept")).alias("pruned_terms"),
        F.coalesce(F.sum(F.when(~F.col("kept"), F.col(count))), F.lit(0)).alias("pruned_total"))


def max_term_id(vectors: DataFrame, term_id: str = "term_idx") -> DataFrame:
    """Highest feature id, -1 for an empty corpus, and the feature count."""
    return vectors.agg(
        F.coalesce(F.max(term_id), F.lit(-1)).alias("max_term_id"),
        (F.coalesce(F.max(term_id), F.lit(-1)) + 1).alias("n_features"))


def corpus_statistics(docs: DataFrame, kept: Column, words: str = "words") -> DataFrame:
    """Articles and word positions before and after pruning."""
    size = F.size(words).cast("long")
    return docs.agg(
        F.count("*").alias("articles_all"),
        F.coalesce(F.sum(size), F.lit(0)).alias("positions_all"),
        F.count_if(kept).alias("articles"),
        F.coalesce(F.sum(F.when(kept, size)), F.lit(0)).alias("positions"))


def top_terms(weights: DataFrame, topic: str, n: int = 25, term: str = "term",
              weight: str = "weight") -> DataFrame:
    """The ``n`` heaviest terms per topic, ties by term.

    Filtering on the rank lets Spark cut every task's input to n rows per topic
    before the shuffle.
    """
    rank = F.row_number().over(Window.partitionBy(topic).orderBy(F.desc(weight), F.asc(term)))
    return weights.withColumn("rank", rank).filter(F.col("rank") <= n)


def group_members(ranked: DataFrame, topic: str, term: str = "term",
                  weight: str = "weight") -> DataFrame:
    """Topic to the list of (term, weight) in rank order; takes :func:`top_terms` output."""
    entry = F.struct("rank", F.col(term).alias("term"), F.col(weight).alias("weight"))
    members = F.transform(F.array_sort(F.collect_list(entry)),
                          lambda e: F.struct(e["term"].alias("term"), e["weight"].alias("weight")))
    return ranked.groupBy(topic).agg(members.alias("members"))


def decode_topics(topics: DataFrame, vocab: DataFrame) -> DataFrame:
    """(topic, term, weight) from term indices and a (term_idx, term) table.

    The vocabulary of a fitted model sits in driver memory already, so it is small
    enough to broadcast.
    """
    pairs = topics.select("topic", F.posexplode(
        F.arrays_zip("termIndices", "termWeights")).alias("place", "pair")).select(
        "topic", "place", F.col("pair.termIndices").alias("term_idx"),
        F.col("pair.termWeights").alias("weight"))
    return pairs.join(F.broadcast(vocab), "term_idx").select("topic", "term", "weight", "place")
