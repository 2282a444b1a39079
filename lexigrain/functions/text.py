"""Scalar text repair: accents, bytes, entities, titles, escapes."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigrain.functions.arrays import let


@cache
def _unmarked() -> tuple[dict[str, str], dict[str, str]]:
    """What characters become without combining marks: one character or none, and several."""
    single, several = {}, {}
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        category = unicodedata.category(char)
        if category == "Mn":
            single[char] = ""
        elif unicodedata.decomposition(char) and category != "Cs":
            bare = "".join(c for c in unicodedata.normalize("NFD", char)
                           if unicodedata.category(c) != "Mn")
            bare = unicodedata.normalize("NFC", bare)
            if bare != char:
                (single if len(bare) < 2 else several)[char] = bare
    return single, several


def remove_accents(text: Column) -> Column:
    """Drop combining marks, precomposed or not.

    The table of characters comes from the Unicode database when the plan is made.
    Characters that only other normal forms would join (Korean letters) stay apart.
    """
    single, several = _unmarked()
    changed = sorted(single, key=lambda c: single[c] == "")  # those without a target last
    out = F.translate(text, "".join(changed), "".join(single[c] for c in changed))
    for char, bare in several.items():
        out = F.replace(out, F.lit(char), F.lit(bare))
    return F.when(text.rlike(r"[^\x00-\x7F]"), out).otherwise(text)


def to_unicode(data: Column, errors: str = "strict") -> Column:
    """UTF-8 bytes to text; ``strict`` gives null for invalid bytes, ``ignore`` drops them."""
    if errors == "strict":
        return F.try_validate_utf8(data.cast("string"))
    if errors == "ignore":
        return F.replace(F.make_valid_utf8(data.cast("string")), F.lit("�"), F.lit(""))
    raise ValueError(f"errors must be 'strict' or 'ignore', not {errors!r}")


def _code_point(hex_digits: Column) -> Column:
    """Character of a hexadecimal code point; null outside Unicode."""
    trimmed = F.regexp_replace(hex_digits, "^0+(?=.)", "")
    number = F.when(F.length(trimmed) <= 6, F.conv(trimmed, 16, 10).cast("int"))
    valid = (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(trimmed, 8, "0")), "UTF-32"))


def _entity(piece: Column) -> Column:
    named = F.create_map(*[F.lit(part) for name, code in name2codepoint.items()
                           for part in (name, chr(code))])
    decimal = F.regexp_extract(piece, r"^&#(\d+);$", 1)
    hexa = F.regexp_extract(piece, r"^&#[xX]([0-9A-Fa-f]+);$", 1)
    short_decimal = F.regexp_replace(decimal, "^0+(?=.)", "")
    found = (
        F.when(decimal != "", F.when(
            F.length(short_decimal) <= 7, _code_point(F.hex(short_decimal.cast("long")))))
        .when(hexa != "", _code_point(hexa))
        .otherwise(F.try_element_at(named, F.regexp_extract(piece, r"^&(\w+);$", 1)))
    )
    return F.coalesce(found, piece)


def decode_entities(text: Column) -> Column:
    """Decode named, decimal and hexadecimal references once; unknown ones stay."""

    def piece(p: Column) -> Column:
        return F.when(p.startswith("&") & (F.length(p) > 1), _entity(p)).otherwise(p)

    def decode(t: Column) -> Column:
        pieces = F.regexp_extract_all(t, F.lit(r"([^&]+|&#?\w+;|&)"), F.lit(1))
        return F.when(t.contains("&"), F.array_join(F.transform(pieces, piece), "")).otherwise(t)

    return let(text, decode)


def decode_outside_code(text: Column) -> Column:
    """Decode entities except inside syntax-highlight blocks, whose body stays raw."""
    block = r"&lt;syntaxhighlight .*?&gt;.*?&lt;/syntaxhighlight&gt;"
    pieces = F.regexp_extract_all(
        text, F.lit(rf"(?s)({block}|[^&]+|&#?\w+;|&)"), F.lit(1))

    def piece(p: Column) -> Column:
        body = F.regexp_extract(
            p, r"(?s)^&lt;syntaxhighlight .*?&gt;(.*?)&lt;/syntaxhighlight&gt;$", 1)
        return (F.when(p.startswith("&lt;syntaxhighlight "), body)
                .when(p.startswith("&") & (F.length(p) > 1), _entity(p))
                .otherwise(p))

    return F.array_join(F.transform(pieces, piece), "")


def ascii_only(text: Column) -> Column:
    """Replace runs of characters outside ASCII by one space."""
    return F.regexp_replace(text, r"[^\x00-\x7F\t]+", " ")


def literal_fixes(text: Column) -> Column:
    """Make loose markup safe for an XML reader: breaks, bare brackets, ampersands."""
    # Replacements applied in this order.
    for old, new in (("<br>", ""), ("</br>", ""), (" < ", " lt "), (" > ", " gt ")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.replace(ascii_only(text), F.lit("&"), F.lit("and"))


def escape_markup(text: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def upper_first(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def lower_first(text: Column) -> Column:
    return F.concat(F.lower(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def normalize_title(title: Column, namespaces: list[str]) -> Column:
    """Canonical page title: spacing, and a capital after a known namespace."""
    clean = F.regexp_replace(F.regexp_replace(title, "^[ _]+|[ _]+$", ""), r"[\s_]+", " ")

    def build(t: Column) -> Column:
        prefix = upper_first(F.regexp_extract(t, r"^([^:]*):", 1))
        gap = F.regexp_extract(t, r"^[^:]*:(\s?)", 1)
        rest = upper_first(F.regexp_extract(t, r"^[^:]*:\s*(\S.*)$", 1))
        return (F.when(~t.rlike(r"^[^:]*:\s*\S"), upper_first(t))
                .when(prefix.isin(namespaces), F.concat(prefix, F.lit(":"), rest))
                .otherwise(F.concat(prefix, F.lit(":"), gap, rest)))

    return let(clean, build)


def qualify_template_title(title: Column, namespaces: list[str],
                           template_prefix: str = "Template:") -> Column:
    """Title of the page a transclusion names."""

    def build(t: Column) -> Column:
        prefix = upper_first(F.regexp_extract(t, "^([^:]*):", 1))
        tail = F.regexp_extract(t, "^[^:]*(:.*)$", 1)
        return (F.when(t.startswith(":"), upper_first(F.substr(t, F.lit(2))))
                .when(t.contains(":") & prefix.isin(namespaces), F.concat(prefix, tail))
                .when(t == "", F.lit(""))
                .otherwise(F.concat(F.lit(template_prefix), upper_first(t))))

    return let(title, build)


def page_url(base: Column, page_id: Column) -> Column:
    return F.concat(base, F.lit("?curid="), page_id.cast("string"))


def percent_quote(text: Column) -> Column:
    """Percent-encode, with spaces as ``%20`` and slashes left alone."""
    quoted = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    return F.replace(F.replace(quoted, F.lit("%2F"), F.lit("/")), F.lit("*"), F.lit("%2A"))
