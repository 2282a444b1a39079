"""Raw sources to the common document table with words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrain.functions.html import visible_text
from lexigrain.functions.lines import compact_lines
from lexigrain.functions.markup import clean_markup
from lexigrain.functions.text import page_url
from lexigrain.functions.tokens import document_words, encyclopedia_words, feed_words
from lexigrain.operators.feeds import run_statistics
from lexigrain.operators.joins import last_per_key, lookup
from lexigrain.operators.once import with_once
from lexigrain.operators.pages import content_pages, split_templates
from lexigrain.operators.rows import RUN_SECONDS, recent, route_rows


def union_sources(*sources: DataFrame) -> DataFrame:
    """Bag union by column name."""
    return reduce(lambda a, b: a.unionByName(b), sources)


def tokenize_documents(raw: DataFrame) -> DataFrame:
    """RAW_DOCUMENT rows to the common document table."""
    return raw.select(
        "id", "dataset", "cat", "source", "url",
        F.try_to_timestamp("published").alias("published"),
        document_words(F.col("content")).alias("words"))


def tokenize_encyclopedia(docs: DataFrame) -> DataFrame:
    """Parsed encyclopedia documents to token rows."""
    return docs.withColumn("words", encyclopedia_words(F.col("text"))).drop("text")


def extract_articles(pages: DataFrame, url_base: str, *, keep_sections: bool = True,
                     keep_lists: bool = False, **cleaning: object) -> DataFrame:
    """Dump pages to (id, url, title, text): markup removed, lines compacted.

    Further options go to ``clean_markup``.
    """
    articles, _ = split_templates(content_pages(pages))
    body = F.array_join(compact_lines(
        clean_markup(F.col("text"), **cleaning),
        keep_sections=keep_sections, keep_lists=keep_lists), "\n")
    return articles.select(
        "id", page_url(F.lit(url_base), F.col("id")).alias("url"), "title", body.alias("text"))


def run_feeds(entries: DataFrame, landed_pages: DataFrame, run_id: int,
              window: int = RUN_SECONDS) -> tuple[DataFrame, DataFrame]:
    """One feed run: (articles, errors) from feed entries and landed raw pages.

    Entries need an id and a date within the window. An entry whose page did not
    land, or whose page gives no text, is an error row. Pages that no entry asks for go
    before any shuffle; of several copies of a page the latest counts, by a column
    ``landed`` (by the text of the page where there is no such column).
    """
    due = entries.filter(
        F.col("article_id").isNotNull()
        & recent(F.lit(run_id), F.unix_timestamp("published"), window))
    time = [F.col("landed")] if "landed" in landed_pages.columns else []
    asked = lookup(landed_pages.select(F.col("url").alias("article_link"), "html",
                                       *[t.alias("_landed") for t in time]),
                   due.select("article_link").distinct(), ["article_link"], ["html"],
                   how="left_semi")
    order = F.struct("_landed", "html") if time else F.col("html")
    pages = last_per_key(asked, ["article_link"], order).select("article_link", "html")
    joined = due.join(pages, "article_link", "left")
    words = with_once(joined, "text", F.array_join(feed_words(visible_text(F.col("html"))), " "))
    good, bad = route_rows(words, {
        "page missing": F.col("html").isNull(), "no text": F.col("text") == ""})
    articles = good.select(
        F.lit(run_id).cast("long").alias("run_id"), "feed_name", "feed_link", "article_id",
        "article_link", F.unix_timestamp("published").alias("publish_time"), "text")
    errors = bad.select("feed_name", "article_id", "article_link", F.col("reason").alias("error"))
    return articles, errors


def feed_run_log(articles: DataFrame, errors: DataFrame, catalogue: DataFrame,
                 run_id: int) -> DataFrame:
    """One row per catalogue feed of a run: articles, their mean age in seconds, failures.

    Failed articles count as articles too. Nothing is fetched here, so the age of an
    article at the run stands where a crawler logs its time.
    """
    run = F.lit(run_id).cast("long").alias("run_id")
    tried = articles.select(
        run, "feed_name", (F.lit(run_id) - F.col("publish_time")).alias("latency"),
        F.lit(False).alias("failed")).unionByName(errors.select(
            run, "feed_name", F.lit(None).cast("long").alias("latency"),
            F.lit(True).alias("failed")))
    return run_statistics(tried, catalogue, failed=F.col("failed"))
