"""Links and visible text of raw HTML, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigrain.functions.arrays import let, sorted_distinct
from lexigrain.functions.text import decode_entities

# Elements whose text is not visible article text.
HIDDEN_ELEMENTS = ("script", "style", "head", "header", "title", "footer", "img", "a")
HIDDEN_ELEMENTS_FIRST_VERSION = ("style", "script", "head", "title")

_RAW_TEXT = ("script", "style")  # their body is not markup
_VOID = ("img",)  # never has a body


def raw_text(html: Column) -> Column:
    """Text with every tag dropped."""
    return F.regexp_replace(html, r"(?s)<.*?>", "")


def visible_text(html: Column, hidden: tuple[str, ...] = HIDDEN_ELEMENTS,
                 lower: bool = True) -> Column:
    """Visible text: hidden elements, comments and tags become spaces, then collapse.

    Comments and raw-text elements go in one leftmost pass (either may contain the
    other's delimiter), remaining hidden elements in a second one.
    """
    raw = "|".join(t for t in hidden if t in _RAW_TEXT)
    rest = "|".join(t for t in hidden if t not in _RAW_TEXT + _VOID)
    first = "<!--.*?-->"
    if raw:
        first += rf"|<({raw})(?:\s[^>]*)?>.*?</\1\s*>"
    out = F.regexp_replace(html, f"(?is){first}", " ")
    if rest:
        out = F.regexp_replace(out, rf"(?is)<({rest})(?:\s[^>]*)?>.*?</\1\s*>", " ")
    out = decode_entities(F.regexp_replace(out, r"(?s)<.*?>", " "))
    out = F.trim(F.regexp_replace(out, r"[\s\p{Z}]+", " "))
    return F.lower(out) if lower else out


def all_links(html: Column) -> Column:
    """``array<struct<href, text>>`` of every anchor with a target, in page order."""
    anchors = F.regexp_extract_all(html, F.lit(r"(?is)(<a\s[^>]*>.*?</a\s*>)"), F.lit(1))

    def link(a: Column) -> Column:
        quoted = F.regexp_extract(a, r"""(?is)^<a\s(?:[^>]*?\s)?href\s*=\s*["']([^"'>]*)""", 1)
        bare = F.regexp_extract(a, r"(?is)^<a\s(?:[^>]*?\s)?href\s*=\s*([^\s\"'>]+)", 1)
        return F.struct(
            decode_entities(F.when(quoted != "", quoted).otherwise(bare)).alias("href"),
            decode_entities(raw_text(a)).alias("text"))

    with_target = F.filter(anchors, lambda a: a.rlike(r"(?is)^<a\s(?:[^>]*?\s)?href\s*="))
    return F.transform(with_target, link)


def distinct_links(html: Column) -> Column:
    """The set of (href, text) pairs of one page, sorted."""
    return sorted_distinct(all_links(html))


def link_map(html: Column) -> Column:
    """``map<href, text>``; the last text of a repeated target wins."""
    placed = F.transform(all_links(html), lambda x, i: F.struct(
        x["href"].alias("href"), i.alias("at"), x["text"].alias("text")))

    def last_per_target(s: Column) -> Column:
        kept = F.filter(s, lambda x, i: F.get(s, i + 1).isNull()
                        | (F.get(s, i + 1)["href"] != x["href"]))
        return F.map_from_entries(F.transform(kept, lambda x: F.struct(x["href"], x["text"])))

    return let(F.sort_array(placed), last_per_target)
