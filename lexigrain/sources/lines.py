"""Line-oriented sources: JSON lines, tagged records, crawl tables, doc records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain import schemas
from lexigrain.functions.html import distinct_links, raw_text
from lexigrain.functions.text import ascii_only
from lexigrain.operators.once import with_once
from lexigrain.operators.rows import epoch_text

# Provenance labels of the two public news sets. The label of a
# crawl is the caller's.
NEWS_DATASET = "signal"
TAGGED_DATASET = "ag"


def read_lines(spark: SparkSession, path: str | list[str], whole: bool = False) -> DataFrame:
    """Lines (or whole files) below one or many paths; gz and bz2 by extension."""
    return spark.read.text(path, wholetext=whole)


def _columns(**values: Column) -> list[Column]:
    return [values[f.name].cast(f.dataType).alias(f.name) for f in schemas.RAW_DOCUMENT.fields]


def _rejected(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("reason").isNotNull()).select(
        F.col("value").alias("record"), "reason")


def _news_objects(lines: DataFrame) -> DataFrame:
    is_object = F.col("value").startswith("{") & F.col("value").endswith("}")
    parsed = with_once(lines, "d", F.when(is_object, F.from_json("value", schemas.NEWS_JSON)))
    known = F.coalesce(*[F.col("d")[f.name].cast("string") for f in schemas.NEWS_JSON.fields])
    return parsed.withColumn("reason", F.when(~is_object, "no object").when(
        known.isNull(), "no known field"))


def parse_news_json(lines: DataFrame, dataset: str = NEWS_DATASET) -> DataFrame:
    """News objects, one per line; ``reject_news_json`` has the other lines."""
    return _news_objects(lines).filter(F.col("reason").isNull()).select(*_columns(
        id=F.col("d.id"), dataset=F.lit(dataset), cat=F.col("d")["media-type"],
        source=F.col("d.source"), url=F.lit(""), published=F.col("d.published"),
        content=F.col("d.content")))


def reject_news_json(lines: DataFrame) -> DataFrame:
    """(record, reason) of lines that are no news objects."""
    return _rejected(_news_objects(lines))


def _with_fields(lines: DataFrame, fields: Column, least: int, most: int | None = None) -> DataFrame:
    size = F.size("f")
    reason = F.when(size < least, f"fewer than {least} fields")
    if most is not None:
        reason = reason.when(size > most, f"more than {most} fields")
    return with_once(lines, "f", fields).withColumn("reason", reason)


def _tagged_fields(lines: DataFrame) -> DataFrame:
    body = F.substr("value", F.lit(5), F.length("value") - 14)
    return _with_fields(lines, F.split(body, "<.*?><.*?>", -1), 9)


def parse_tagged(lines: DataFrame, dataset: str = TAGGED_DATASET) -> DataFrame:
    """Records of nine fields between tag pairs, framed by 4 and 10 characters."""
    fields = _tagged_fields(lines).filter(F.col("reason").isNull())
    at = lambda i: F.get("f", F.lit(i))
    return fields.select(*_columns(
        id=at(0), dataset=F.lit(dataset), cat=at(5), source=at(1), url=at(2),
        published=at(8), content=F.concat_ws(" ", at(3), at(6))))


def reject_tagged(lines: DataFrame) -> DataFrame:
    """(record, reason) of lines with too few fields."""
    return _rejected(_tagged_fields(lines))


def _crawl_fields(lines: DataFrame) -> DataFrame:
    return _with_fields(lines, F.split("value", "\t", -1), 7)


def parse_crawl(lines: DataFrame, dataset: str = "crawl") -> DataFrame:
    """Crawled articles; tabs inside the text are kept as spaces, the key is the url."""
    fields = _crawl_fields(lines).filter(F.col("reason").isNull())
    at = lambda i: F.get("f", F.lit(i))
    return fields.select(*_columns(
        id=at(4), dataset=F.lit(dataset), cat=F.lit(""), source=at(1), url=at(4),
        published=epoch_text(at(5).try_cast("double").cast("long")),
        content=F.array_join(F.slice("f", 7, F.size("f")), " ")))


def reject_crawl(lines: DataFrame) -> DataFrame:
    """(record, reason) of rows with too few fields."""
    return _rejected(_crawl_fields(lines))


def read_doc_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``<doc id url title>`` records with their links and plain text.

    Bodies are not well-formed XML, so records are cut at the closing line and the
    attributes taken from the opening tag.
    """
    records = spark.read.text(path, lineSep="\n</doc>").filter(F.col("value").contains("<doc "))
    joined = ascii_only(F.trim(F.regexp_replace("value", r"[ \t\r]*\n[ \t\r]*", " ")))
    docs = records.select(joined.alias("value")).select(
        F.regexp_extract("value", r"(<doc [^\n]*?\">)", 1).alias("tag"),
        F.regexp_extract("value", r"<doc [^\n]*?\">(.*)$", 1).alias("body"))
    attribute = lambda name: F.regexp_extract(
        "tag", rf'\s{name}="(.*?)"(?=\s\w+="|>)', 1)
    return docs.select(
        attribute("url").alias("url"), attribute("id").alias("id"),
        attribute("title").alias("title"), distinct_links(F.col("body")).alias("links"),
        F.trim(raw_text(F.col("body"))).alias("text"))


def read_doc_rejects(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(record, reason) of closed records without an opening tag."""
    return spark.read.text(path, lineSep="\n</doc>").filter(
        ~F.col("value").contains("<doc ") & F.col("value").rlike(r"\S")).select(
        F.col("value").alias("record"), F.lit("no opening tag").alias("reason"))


def _wiki_fields(lines: DataFrame) -> DataFrame:
    return _with_fields(lines, F.split("value", "\t", -1), 5, 5)


def parse_wiki_rows(lines: DataFrame) -> DataFrame:
    """Five tab-separated fields ``url, id, title, tags, text``."""
    names = ("url", "id", "title", "tags", "text")
    return _wiki_fields(lines).filter(F.col("reason").isNull()).select(
        *[F.get("f", F.lit(i)).alias(n) for i, n in enumerate(names)])


def reject_wiki_rows(lines: DataFrame) -> DataFrame:
    """(record, reason) of lines with fewer or more fields."""
    return _rejected(_wiki_fields(lines))
