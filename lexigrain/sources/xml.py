"""XML sources: news corpora, encyclopedia dumps, landed feed files.

Records are cut at their closing tag by the text reader, which splits plain and
bz2 files over many tasks, chunks whose closing tag stands in CDATA or in a comment are
glued to the next (``xml_sections``), and what is left is cut before every opening tag and
parsed record by record with ``from_xml``. So one huge file feeds the whole cluster, files
glued together need no common root, and a malformed, torn or unclosed record spoils only
itself. What stands in comments is no record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrain import schemas
from lexigrain.operators.once import with_once
from lexigrain.operators.pages import dump_pages
from lexigrain.session import landed
from lexigrain.sources.xml_sections import glue_sections, place, plain_sections

CORRUPT = "_corrupt_record"
REASON = "_corrupt_reason"


def parse_xml_records(chunks: DataFrame, row_tag: str, schema: T.StructType) -> DataFrame:
    """Parse chunks that end where ``</row_tag>`` stood; other columns are kept.

    Comments go and CDATA becomes text, then a chunk is cut before every opening tag: what
    stands before the last one was never closed. Unclosed and malformed records have their
    text in ``_corrupt_record``, with the reason. So has a chunk without an opening tag,
    unless only closing tags and white space are in it or a Boolean column ``tail``, which
    is not kept, tells that it is the rest of a file.
    """
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT,
               "rowTag": row_tag, "ignoreSurroundingSpaces": "false"}
    others = [c for c in chunks.columns if c not in ("value", "tail")]
    opening = rf"<{row_tag}[\s>]"
    tail = F.col("tail") if "tail" in chunks.columns else F.lit(False)
    parts = F.split(plain_sections(F.col("value")), f"(?={opening})", -1)
    cut = with_once(chunks, "_parts", parts)
    started = F.filter("_parts", lambda p: p.rlike(f"^{opening}"))
    around = F.regexp_replace(F.col("_parts")[0], r"</[^<>]*>|<\?.*?\?>", "")
    torn = (F.size(started) == 0) & ~tail & around.rlike(r"\S")
    closing = F.lit(f"</{row_tag}>")
    pieces = with_once(cut, "_pieces", F.when(torn, F.col("_parts")).otherwise(started))
    closed = F.transform("_pieces", lambda p, i: F.when(
        i == F.size("_pieces") - 1, F.concat(p, closing)).otherwise(p))
    records = pieces.filter(F.size("_pieces") > 0).select(
        *others, F.explode_outer(closed).alias("_xml"))
    whole = F.col("_xml").rlike(f"^{opening}")
    parsed = with_once(records, "_r", F.from_xml(F.when(whole, F.col("_xml")), full, options))
    corrupt = F.when(whole, F.col(f"_r.{CORRUPT}")).otherwise(F.col("_xml"))
    reason = F.when(~whole, "no opening tag").when(corrupt.isNotNull(), "malformed record")
    return parsed.select(*others, *(F.col("_r")[f.name].alias(f.name) for f in schema.fields),
                         corrupt.alias(CORRUPT), reason.alias(REASON))


def read_xml_records(spark: SparkSession, path: str | list[str], row_tag: str,
                     schema: T.StructType) -> DataFrame:
    """Records by row tag below one or many paths; gz and bz2 by extension.

    A gz file cannot be split and arrives in one task; ``session.spread`` afterwards
    shares its records out.
    """
    return _records(spark, path, row_tag, schema).drop("pos")


def _records(spark: SparkSession, path: str | list[str], row_tag: str,
             schema: T.StructType) -> DataFrame:
    chunks = spark.read.text(path, lineSep=f"</{row_tag}>").select("value", place().alias("pos"))
    return parse_xml_records(glue_sections(chunks, f"</{row_tag}>"), row_tag, schema)


def good_records(records: DataFrame) -> DataFrame:
    return records.filter(F.col(CORRUPT).isNull()).drop(CORRUPT, REASON)


def rejected_records(records: DataFrame) -> DataFrame:
    """(record, reason) of unclosed, malformed and torn records."""
    return records.filter(F.col(CORRUPT).isNotNull()).select(
        F.col(CORRUPT).alias("record"), F.col(REASON).alias("reason"))


def record_counts(records: DataFrame) -> DataFrame:
    """How many records were read well and how many are corrupt."""
    corrupt = F.col(CORRUPT).isNotNull()
    return records.agg(F.count_if(~corrupt).alias("good"), F.count_if(corrupt).alias("corrupt"))


def _dump_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return _records(spark, path, "page", schemas.DUMP_PAGE)


def read_dump(spark: SparkSession, path: str | list[str], land: bool = False) -> DataFrame:
    """Encyclopedia pages (id, title, ns, text, redirect, is_redirect, pos).

    ``pos`` is the place in the files: file, block and row within the block. With ``land``
    the pages are parsed once, at once, and written below the shared folder: for flows that
    read them more than once, often a few columns only.
    """
    pages = dump_pages(good_records(_dump_records(spark, path)))
    return landed(pages, "dump-pages") if land else pages


def read_dump_rejects(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(record, reason) of the pages that ``read_dump`` cannot read."""
    return rejected_records(_dump_records(spark, path))


def read_site_info(spark: SparkSession, path: str) -> DataFrame:
    """(url_base, ns_key, ns_name) of a dump's header.

    ``path`` is the file that starts the dump. The text reader cuts at the end of the
    header, and only its first block is searched.
    """
    header = spark.read.text(path, lineSep="</siteinfo>").filter(
        (F.col("_metadata.file_block_start") == 0) & F.col("value").contains("<siteinfo"))
    space = r'<namespace [^>]*?\bkey="(-?\d+)"[^>]*?(?:/>|>([^<]*)</namespace>)'
    found = header.select(
        F.regexp_extract("value", "<base>(.*)/[^/]*</base>", 1).alias("url_base"),
        F.regexp_extract_all("value", F.lit(space), F.lit(1)).alias("keys"),
        F.regexp_extract_all("value", F.lit(space), F.lit(2)).alias("names"))
    return found.select("url_base", F.inline(F.transform(
        F.arrays_zip("keys", "names"), lambda s: F.struct(
            s["keys"].cast("int").alias("ns_key"),
            F.coalesce(s["names"], F.lit("")).alias("ns_name")))))


def entry_columns(items: DataFrame) -> DataFrame:
    """(entry_id, link, title, description, published) of feed items."""
    return items.select(
        F.col("guid").alias("entry_id"), "link", "title", "description",
        publication_time(F.col("pubDate")).alias("published"))


def publication_time(text: Column) -> Column:
    """``Wed, 05 Oct 2016 10:15:00 GMT`` to a timestamp, null if it is none."""
    day = F.regexp_replace(text, r"^\w+,\s*", "")
    return F.coalesce(F.try_to_timestamp(day, F.lit("d MMM yyyy HH:mm:ss z")),
                      F.try_to_timestamp(day, F.lit("d MMM yyyy HH:mm:ss Z")))


def read_feed_entries(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Entries of landed feed files; ``read_feed_rejects`` has the malformed items."""
    return entry_columns(good_records(
        read_xml_records(spark, path, "item", schemas.RSS_ITEM)))


def read_feed_rejects(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(record, reason) of the items that are no entries."""
    return rejected_records(read_xml_records(spark, path, "item", schemas.RSS_ITEM))
