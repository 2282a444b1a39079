"""Encyclopedia pages: scan rules, template inventory and template calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrain.functions.text import decode_entities, qualify_template_title
from lexigrain.operators.joins import first_per_key, last_per_key, lookup
from lexigrain.operators.once import explode_once, with_once
from lexigrain.session import ensure_checkpoint_dir

TEMPLATE_NAMESPACES = (10, 828)


def dump_pages(raw: DataFrame) -> DataFrame:
    """(id, title, ns, text, redirect, is_redirect) from XML page rows; missing ns is 0.

    A ``pos`` column (place in the dump) is passed on.
    """
    place = [F.col("pos")] if "pos" in raw.columns else []
    return raw.select(
        "id", "title", F.coalesce("ns", F.lit(0)).alias("ns"),
        F.coalesce("revision.text._VALUE", F.lit("")).alias("text"),
        F.col("redirect._title").alias("redirect"),
        F.col("redirect").isNotNull().alias("is_redirect"), *place)


def content_pages(pages: DataFrame) -> DataFrame:
    """Pages that are no redirects, one per id (the first in the dump).

    With a place in the dump (``pos``) only ids and places are compared. The later
    copies of an id are few; their places are taken out by a lookup, and the texts stay
    where they are. Null ids are no copies of each other.
    """
    kept = pages.filter(~F.col("is_redirect")).drop("redirect", "is_redirect")
    if "pos" not in pages.columns:
        return first_per_key(kept, ["id"], F.struct("title", "text"))
    places = kept.filter(F.col("id").isNotNull()).groupBy("id").agg(
        F.min("pos").alias("first"), F.count("*").alias("n")).filter("n > 1")
    ensure_checkpoint_dir(pages.sparkSession)
    later = kept.select("id", "pos").join(places, "id").filter("pos > first").select("pos")
    return lookup(kept, later.checkpoint(), ["pos"], ["id"], how="left_anti")


def split_templates(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(articles, templates) by namespace."""
    is_template = F.col("ns").isin(*TEMPLATE_NAMESPACES)
    return pages.filter(~is_template), pages.filter(is_template)


def template_body(text: Column) -> Column:
    """What a page contributes when it is transcluded; null if nothing is left."""
    out = decode_entities(text)
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", "")
    out = F.regexp_replace(out, r"(?s)<noinclude>.*?</noinclude>", "")
    out = F.regexp_replace(out, r"(?s)<noinclude\s*>.*$", "")
    out = F.replace(out, F.lit("<noinclude/>"), F.lit(""))
    only = F.array_join(F.regexp_extract_all(
        out, F.lit(r"(?s)<onlyinclude>(.*?)</onlyinclude>"), F.lit(1)), "")
    unwrapped = F.regexp_replace(out, r"</?includeonly>", "")
    body = F.when(only != "", only).otherwise(unwrapped)
    return F.when(body != "", body)


def template_inventory(pages: DataFrame, order: str = "id") -> tuple[DataFrame, DataFrame]:
    """(title, body) of templates, last definition wins, and (title, target) redirects."""
    listed = pages.filter(F.col("ns").isin(*TEMPLATE_NAMESPACES))
    bodies = (with_once(listed.filter(~F.col("is_redirect")), "body",
                        template_body(F.col("text")))
              .filter(F.col("body").isNotNull()).select("title", "body", order))
    redirects = listed.filter("is_redirect").select(
        "title", F.col("redirect").alias("target"), order)
    return (last_per_key(bodies, ["title"], F.col(order)).select("title", "body"),
            last_per_key(redirects, ["title"], F.col(order)).select("title", "target"))


def template_calls(pages: DataFrame, namespaces: list[str], key: str = "id",
                   prefix: str = "Template:") -> DataFrame:
    """(page, title): one row per transclusion, title fully qualified.

    Parameters (``{{{n}}}``) and parser functions (``{{#if:}}``) are no calls.
    """
    names = F.regexp_extract_all(
        "text", F.lit(r"(?<!\{)\{\{\s*([^{}|#<>\[\]\n]+?)\s*(?=\||\}\}|\n)"), F.lit(1))
    return explode_once(pages, names, "name", key).select(
        key, qualify_template_title(F.col("name"), namespaces, prefix).alias("title"))


def template_usage(calls: DataFrame, bodies: DataFrame, redirects: DataFrame) -> DataFrame:
    """(title, calls, resolved, found): how often each target is used.

    Calls are counted per title before any join, so a template used everywhere is
    one row by then.
    """
    counts = calls.groupBy("title").agg(F.count("*").alias("calls"))
    via = redirects.select("title", "target")
    resolved = counts.join(via, "title", "left").select(
        F.coalesce("target", "title").alias("resolved"), "calls")
    totals = resolved.groupBy("resolved").agg(F.sum("calls").alias("calls"))
    known = bodies.select(F.col("title").alias("resolved"), F.lit(True).alias("found"))
    return totals.join(known, "resolved", "left").select(
        F.col("resolved").alias("title"), "calls",
        F.coalesce("found", F.lit(False)).alias("found"))


def resolve_calls(calls: DataFrame, bodies: DataFrame, redirects: DataFrame,
                  key: str = "id") -> DataFrame:
    """(page, title, body): one redirect followed, a missing template is empty text."""
    followed = lookup(calls, redirects, ["title"], [key]).select(
        key, F.coalesce("target", "title").alias("title"))
    return lookup(followed, bodies, ["title"], [key]).select(
        key, "title", F.coalesce("body", F.lit("")).alias("body"))


def known_namespaces(titles: DataFrame, namespaces: DataFrame) -> DataFrame:
    """Titles whose prefix names a namespace of the site (left semi join)."""
    prefixed = titles.withColumn("ns_name", F.regexp_extract("title", "^([^:]+):", 1))
    names = namespaces.select("ns_name").filter("ns_name <> ''").distinct()
    return lookup(prefixed, names, ["ns_name"], ["title"], how="left_semi")
