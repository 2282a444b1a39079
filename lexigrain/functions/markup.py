"""Wiki-markup cleaning steps, each one a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigrain.functions.arrays import let
from lexigrain.functions.text import decode_entities, escape_markup, percent_quote

# Markup vocabulary.
ACCEPTED_NAMESPACES = ("w", "wiktionary", "wikt")
URL_PROTOCOLS = (
    "bitcoin:", "ftp://", "ftps://", "geo:", "git://", "gopher://", "http://", "https://",
    "irc://", "ircs://", "magnet:", "mailto:", "mms://", "news:", "nntp://", "redis://",
    "sftp://", "sip:", "sips:", "sms:", "ssh://", "svn://", "tel:", "telnet://", "urn:",
    "worldwind://", "xmpp:", "//",
)
BEHAVIOUR_SWITCHES = (
    "NOTOC", "FORCETOC", "TOC", "NEWSECTIONLINK", "NONEWSECTIONLINK", "NOGALLERY",
    "HIDDENCAT", "NOCONTENTCONVERT", "NOCC", "NOTITLECONVERT", "NOTC", "START", "END",
    "INDEX", "NOINDEX", "STATICREDIRECT", "DISAMBIG",
)
SELF_CLOSING_TAGS = ("br", "hr", "nobr", "ref", "references", "nowiki")
UNWRAPPED_TAGS = (
    "abbr", "b", "big", "blockquote", "center", "cite", "em", "font", "h1", "h2", "h3",
    "h4", "hiero", "i", "kbd", "nowiki", "p", "plaintext", "s", "span", "strike", "strong",
    "tt", "u", "var",
)
DISCARDED_ELEMENTS = (
    "gallery", "timeline", "noinclude", "pre", "table", "tr", "td", "th", "caption", "div",
    "form", "input", "select", "option", "textarea", "ul", "li", "ol", "dl", "dt", "dd",
    "menu", "dir", "ref", "references", "img", "imagemap", "source", "small", "sub", "sup",
)
_IMAGE_URL = r'https?://[^\]\[<>"\x00-\x20\x7F\s]+/[A-Za-z0-9_.,~%\-+&;#*?!=()@]+\.(?:gif|png|jpe?g)'
PLACEHOLDERS = {"math": "formula", "code": "codice"}

_HOLE = "\x02"  # marks where a span was cut while nested spans are still open
_CTRL = r"\x00-\x08\x0a-\x1F"
LEVELS = 12  # nested spans that one pass over a text takes


def _replace(text: Column, pattern: str, new: str = "") -> Column:
    return F.regexp_replace(text, pattern, new)


def _replace_at(text: Column, mark: str, pattern: str, new: str = "") -> Column:
    """``_replace`` with a pattern that matches only texts with ``mark``; those without it are
    passed on untried."""
    return let(text, lambda t: F.when(t.contains(mark), _replace(t, pattern, new)).otherwise(t))


def until_stable(text: Column, passes: Column, step: Callable[[Column], Column],
                 left: Callable[[Column], Column] = lambda t: F.lit(True)) -> Column:
    """Apply ``step`` until it changes nothing, at most ``passes`` times.

    ``passes`` comes from the row itself (how many closing delimiters it has), so
    any nesting depth is covered and a flat text costs one pass plus a check. ``left``
    tells cheaply whether a text can be changed at all, which spares the last pass.
    """
    start = F.struct(text.alias("text"), F.lit(False).alias("done"))

    def again(acc: Column, _: Column) -> Column:
        return F.when(acc["done"], acc).otherwise(let(step(acc["text"]), lambda new: F.struct(
            new.alias("text"), (~left(new) | (new == acc["text"])).alias("done"))))

    return F.aggregate(F.array_repeat(F.lit(0), passes), start, again, lambda acc: acc["text"])


def balanced(opening: str, closing: str, other: str, first: str | None = None) -> str:
    """A pattern of spans between delimiters with up to ``LEVELS`` levels of nested ones.

    One pass over the tokens of a text: ``other`` matches what is no delimiter, and every
    loop is possessive, so nothing is tried twice from the same start. ``first`` is the
    opening of the outermost span, if it differs.
    """
    inside = rf"(?:{other})*+"
    for _ in range(LEVELS):
        inside = rf"(?:{other}|{opening}{inside}{closing})*+"
    return rf"{first or opening}{inside}{closing}"


def drop_nested(text: Column, opening: str, closing: str, unclosed: str = "last") -> Column:
    """Drop spans between two delimiters of two characters, nested ones included.

    An opening that never closes takes everything up to the last closed span after
    it (``unclosed='last'``) or the rest of the text (``unclosed='cut'``).
    """
    (o, p), (c, d) = (tuple(rf"\{char}" for char in pair) for pair in (opening, closing))
    # of a run of equal characters every second one begins a token
    # looking ahead before behind: the look behind tries 64 widths
    first = rf"(?={o}{p})(?<=(?<!{o})(?:{o}{p}){{0,64}}){o}{p}" if o == p else None
    span = balanced(o + p, c + d, rf"[^{o}{c}]++|{o}(?!{p})|{c}(?!{d})", first)

    def clean(t: Column) -> Column:
        holes = until_stable(t, F.regexp_count(t, F.lit(c + d)), lambda x: _replace(x, span, _HOLE),
                             lambda x: x.contains(closing))
        tail = rf"(?s){o}{p}.*" + ("" if unclosed == "cut" else _HOLE)
        return F.when(t.contains(opening), _replace(_replace_at(holes, opening, tail), _HOLE)
                      ).otherwise(t)

    return let(text, clean)


def drop_brace_templates(text: Column) -> Column:
    """Drop transclusions by counting braces: one starts at ``{{`` and ends where as many
    single braces are closed as were opened. One that never ends takes the rest of the text.
    """
    start = rf"\{{(?=[{{{_HOLE}])"  # a hole began with a brace
    span = balanced(r"\{", r"\}", "[^{}]++", start)

    def clean(t: Column) -> Column:
        holes = until_stable(t, F.regexp_count(t, F.lit(r"\}")), lambda x: _replace(x, span, _HOLE),
                             lambda x: x.contains("}"))
        return F.when(t.contains("{{"), _replace(_replace(holes, rf"(?s){start}.*"), _HOLE)
                      ).otherwise(t)

    return let(text, clean)


def drop_comments(text: Column) -> Column:
    return _replace_at(text, "<!--", r"(?s)<!--.*?-->")


def drop_templates(text: Column, unclosed: str = "last") -> Column:
    """Drop transclusions ``{{...}}`` at any depth."""
    return drop_nested(text, "{{", "}}", unclosed)


def drop_tables(text: Column) -> Column:
    """Drop tables ``{|...|}`` at any depth."""
    return drop_nested(text, "{|", "|}")


def drop_table_rows(text: Column) -> Column:
    """Cells on lines of their own, formatting lines emptied, cell prefixes dropped."""
    out = F.replace(text, F.lit("||"), F.lit("\n|"))

    def dropped(t: Column) -> Column:
        rows = _replace(t, r"\n(?:\{\||\|-|\|\})[^\n]*(?=\n)", "\n")
        return F.when(t.contains("\n|") | t.contains("\n!") | t.contains("\n{|"), _replace(
            rows, r"\n[|!](?:[^\n]*\|)?", "\n")).otherwise(t)

    return let(out, dropped)


_PROTOCOL = "(?:" + "|".join(URL_PROTOCOLS) + ")"
_URL = rf'{_PROTOCOL}[^\]\[<>"\x00-\x20\x7F\s]+'
_LABEL = rf"(?:[^\]\[{_CTRL}]++|\[\[[^\]\[{_CTRL}]++\]\])*+"


def replace_external_links(text: Column, keep_links: bool = False) -> Column:
    """``[url label]`` becomes its label (an image address as label becomes nothing)."""
    link = rf"(?i)\[({_URL})\s*({_LABEL})\]"
    if not keep_links:
        out = _replace(text, rf"(?i)\[{_URL}\s*{_IMAGE_URL}\]")
        return _replace(out, link, "$2")
    pieces = F.regexp_extract_all(
        text, F.lit(rf"(?i)(\[{_URL}\s*{_LABEL}\]|[^\[]+|\[)"), F.lit(1))

    def anchor(p: Column) -> Column:
        url, label = F.regexp_extract(p, link, 1), F.regexp_extract(p, link, 2)
        shown = F.when(label.rlike(rf"(?i)^{_IMAGE_URL}$"),
                       F.concat(F.lit('<img src="'), label, F.lit('" alt="">'))).otherwise(label)
        return F.when(url != "", F.concat(
            F.lit('<a href="'), percent_quote(url), F.lit('">'), shown, F.lit("</a>"))
        ).otherwise(p)

    return F.array_join(F.transform(pieces, anchor), "")


def replace_internal_links(text: Column, keep_links: bool = False,
                           accepted: tuple[str, ...] = ACCEPTED_NAMESPACES) -> Column:
    """``[[title|label]]`` becomes its label; links into other namespaces vanish.

    Inner links are resolved before the links around them.
    """
    names = "|".join(accepted)
    foreign = rf"\[\[(?!:?(?:{names}):)(?:[^\[\]|:]+|:[^\[\]|:]+):[^\[\]]*\]\]"
    labelled = r"\[\[[^\[\]]*\|\s*([^\[\]|]*?)\s*\]\]"
    plain = r"\[\[([^\[\]|]*)\]\]"

    def flat(t: Column) -> Column:
        return _replace(_replace(_replace(t, foreign), labelled, "$1"), plain, "$1")

    def linked(t: Column) -> Column:
        pieces = F.regexp_extract_all(
            _replace(t, foreign), F.lit(r"(\[\[[^\[\]]*\]\]|[^\[]+|\[)"), F.lit(1))

        def anchor(p: Column) -> Column:
            inner = F.regexp_extract(p, r"^\[\[([^\[\]]*)\]\]$", 1)
            title = F.rtrim(F.substring_index(inner, "|", 1))
            label = F.when(inner.contains("|"), F.trim(F.substring_index(inner, "|", -1))
                           ).otherwise(inner)
            return F.when(p.rlike(r"^\[\[[^\[\]]*\]\]$"), F.concat(
                F.lit('<a href="'), percent_quote(title), F.lit('">'), label, F.lit("</a>"))
            ).otherwise(p)

        return F.array_join(F.transform(pieces, anchor), "")

    step = linked if keep_links else flat
    return let(text, lambda t: F.when(t.contains("[["), until_stable(
        t, F.regexp_count(t, F.lit(r"\]\]")), step, lambda x: x.contains("]]"))).otherwise(t))


def file_captions(text: Column) -> Column:
    """File and image links become their caption (the last pipe segment)."""
    out = _replace(text, r"\[\[(?:[fF]ile:|[iI]mage)[^\]]*\|([^\]|]*)\]\]", "$1")
    return _replace(out, r"(\[\[(?:[fF]ile:|[iI]mage)[^\]|]*)\]\]", "$1")


def drop_language_links(text: Column) -> Column:
    """Drop the block of interlanguage links at the end."""
    return _replace(text, r"(?:\n\[\[[a-z][a-z][\w-]*:[^:\]]+\]\])++$")


def drop_categories(text: Column) -> Column:
    return _replace_at(text, "[[Category:", r"\[\[Category:[^\]\[]*\]\]")


def drop_inline_blocks(text: Column) -> Column:
    """Drop footnotes, nowiki and math blocks."""
    for tag in ("ref", "nowiki", "math"):
        text = _replace_at(text, f"<{tag}", rf"(?s)<{tag}[> ].*?(?:</{tag}>|/>)")
    return text


def drop_switches(text: Column) -> Column:
    return _replace_at(text, "__", "__(?:" + "|".join(BEHAVIOUR_SWITCHES) + ")__")


def unquote_emphasis(text: Column) -> Column:
    """Bold and italic marks go; italics become double quotes."""
    out = _replace(text, r"'''''([^\n]*?)'''''", "$1")
    out = _replace(out, r"'''([^\n]*?)'''", "$1")
    out = _replace(out, r"''\"([^\"]*?)\"''", '"$1"')
    out = _replace(out, r"''([^\n]*?)''", '"$1"')
    out = _replace(out, r'""([^"]*?)""', '"$1"')
    out = F.replace(out, F.lit("'''"), F.lit(""))
    return F.replace(out, F.lit("''"), F.lit('"'))


def drop_tags(text: Column, keep_links: bool = False) -> Column:
    """One pass over comments, self-closing tags and tags whose content stays."""
    kept = UNWRAPPED_TAGS if keep_links else UNWRAPPED_TAGS + ("a",)
    single, wrapped = "|".join(SELF_CLOSING_TAGS), "|".join(kept)
    return _replace(text, rf"(?is)<!--.*?-->|<\s*(?:{single})\b[^>]*/\s*>"
                          rf"|<(?:{wrapped})\b.*?>|</\s*(?:{wrapped})>")


def drop_elements(text: Column, elements: tuple[str, ...] = DISCARDED_ELEMENTS) -> Column:
    """Drop listed elements with their content, nested ones included."""
    names = "|".join(elements)
    opening = rf"<\s*({names})\b[^>/]*>"
    span = (rf"(?is){opening}(?:[^<]++|(?!<\s*\1\b[^>/]*>|<\s*/\s*\1\s*>)<)*+<\s*/\s*\1\s*>")
    closing = rf"(?i)<\s*/\s*(?:{names})\s*>"

    def clean(t: Column) -> Column:
        closings = F.regexp_count(t, F.lit(closing))
        holes = until_stable(t, closings, lambda x: _replace(x, span, f"{_HOLE}$1{_HOLE}"),
                             lambda x: x.rlike(closing))
        unclosed = _replace(holes, rf"(?is){opening}.*{_HOLE}\1{_HOLE}")
        return F.when(closings > 0, _replace(unclosed, rf"{_HOLE}\w+{_HOLE}")).otherwise(t)

    return let(text, clean)


def shield_code(text: Column) -> Column:
    """Unwrap syntax-highlight blocks and escape their body, so that later steps see
    no tags in it; the final entity decoding restores it."""
    block = r"<syntaxhighlight .*?>.*?</syntaxhighlight>"

    def piece(p: Column) -> Column:
        body = F.regexp_extract(p, r"(?s)^<syntaxhighlight .*?>(.*)</syntaxhighlight>$", 1)
        return F.when(p.startswith("<syntaxhighlight ") & p.endswith("</syntaxhighlight>"),
                      escape_markup(body)).otherwise(p)

    def shield(t: Column) -> Column:
        pieces = F.regexp_extract_all(t, F.lit(rf"(?s)({block}|[^<]+|<)"), F.lit(1))
        return F.when(t.contains("<syntaxhighlight "),
                      F.array_join(F.transform(pieces, piece), "")).otherwise(t)

    return let(text, shield)


def name_placeholders(text: Column) -> Column:
    """The n-th math block becomes ``formula_n``, the n-th code block ``codice_n``."""

    def numbered(tag: str, label: str) -> Callable[[Column], Column]:
        block = rf"(?is)(<\s*{tag}(?:\s*| [^>]+?)>.*?<\s*/\s*{tag}\s*>)"

        def number(t: Column) -> Column:
            found = F.transform(F.regexp_extract_all(t, F.lit(block), F.lit(1)),
                                lambda x, i: F.struct(x.alias("block"), (i + 1).alias("n")))
            return F.aggregate(found, t, lambda acc, m: F.replace(
                acc, m["block"], F.concat(F.lit(f"{label}_"), m["n"].cast("string"))))

        return number

    for tag, label in PLACEHOLDERS.items():
        text = let(text, numbered(tag, label))
    return text


def tidy_whitespace(text: Column) -> Column:
    """Tabs, runs of spaces and dots, guillemets, punctuation-only lines, stray commas."""
    out = F.replace(F.replace(text, F.lit("<<"), F.lit("«")), F.lit(">>"), F.lit("»"))
    out = _replace(F.replace(out, F.lit("\t"), F.lit(" ")), " {2,}", " ")
    out = _replace(out, r"\.{4,}", "...")
    out = _replace(out, r"\n[^\p{L}\p{N}_]+?\n", "\n")
    return F.replace(F.replace(out, F.lit(",,"), F.lit(",")), F.lit(",."), F.lit("."))


def light_clean(text: Column, passes: int | None = 3) -> Column:
    """Approximate all-in-one cleaner: passes over the flat rules until nothing changes,
    ``passes`` at most (None: as many as the text has characters)."""

    def once(t: Column) -> Column:
        out = drop_categories(raw_tags_dropped(drop_inline_blocks(drop_comments(t))))
        out = _replace_at(out, "://", r"\[\w+://[^\n]*?(?:( [^\n]*?)|)\]", "$1")
        out = _replace_at(out, "[", r"\[[^\]\[]*\|([^\]\[]*)\]", "$1")
        return F.replace(drop_table_rows(out), F.lit("[]"), F.lit(""))

    def raw_tags_dropped(t: Column) -> Column:
        return _replace_at(t, "<", r"(?s)<.*?>")

    start = file_captions(drop_brace_templates(drop_language_links(decode_entities(text))))
    return F.translate(until_stable(
        start, F.length(start) if passes is None else F.lit(passes), once), "[]", "")


def clean_markup(text: Column, *, keep_links: bool = False, escape: bool = False,
                 accepted: tuple[str, ...] = ACCEPTED_NAMESPACES,
                 discard: tuple[str, ...] = DISCARDED_ELEMENTS) -> Column:
    """The full cleaner for a page's text as an XML reader delivers it (decoded once).

    The order of steps matters: nested markup first, then links, switches,
    emphasis, tags, elements with content, references and whitespace.
    """
    out = drop_tables(drop_templates(text))
    out = replace_internal_links(replace_external_links(out, keep_links), keep_links, accepted)
    out = unquote_emphasis(shield_code(drop_switches(out)))
    out = drop_elements(drop_tags(out, keep_links), discard)
    out = tidy_whitespace(name_placeholders(decode_entities(out)))
    return escape_markup(out) if escape else out
