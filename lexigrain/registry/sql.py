"""SQL fragments shared by the oracles (DuckDB dialect)."""

from __future__ import annotations

from lexigrain.functions.stopwords import ENGLISH

SPACE = r"\s\x0b\p{Z}\x1c-\x1f\x{85}"
WORD = r"[\p{L}\p{N}_]"
PUNCT = r"[!-/:-@\[-`{-~]"
DIGIT = (r"[\p{Nd}\x{b2}\x{b3}\x{b9}\x{1369}-\x{1371}\x{19da}\x{2070}\x{2074}-\x{2079}"
         r"\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247c}\x{2488}-\x{2490}\x{24ea}"
         r"\x{24f5}-\x{24fd}\x{24ff}\x{2776}-\x{277e}\x{2780}-\x{2788}\x{278a}-\x{2792}]")


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(column: str, pattern: str, new: str = "") -> str:
    """Replace every match."""
    return f"regexp_replace({column}, {quote(pattern)}, {quote(new)}, 'g')"


def chain(column: str, *steps: tuple[str, str]) -> str:
    for pattern, new in steps:
        column = sub(column, pattern, new)
    return column


def raw_tokens(column: str) -> str:
    return f"regexp_extract_all({column}, {quote(f'({WORD}+|[^{SPACE}]+)')}, 1)"


def trimmed_tokens(column: str) -> str:
    return f"list_transform({raw_tokens(column)}, lambda t: {sub('t', PUNCT)})"


def words(column: str, tags: bool = True, lower_first: bool = True, lo: int = 3,
          hi: int = 20) -> str:
    text = sub(column, r"<[^\n]*?>") if tags else column
    text = sub(text, r"\W+ ", " ")
    if lower_first:
        text = f"lower({text})"
    kept = (f"list_filter({trimmed_tokens(text)}, lambda t: length(t) BETWEEN {lo} AND {hi} "
            f"AND NOT regexp_matches(t, {quote(DIGIT)}))")
    return kept if lower_first else f"list_transform({kept}, lambda t: lower(t))"


STOP_LIST = "[" + ", ".join(quote(w) for w in ENGLISH) + "]"


def no_stop_words(column: str) -> str:
    return f"list_filter({column}, lambda w: NOT list_contains({STOP_LIST}, lower(w)))"


def entities(column: str) -> str:
    """Decode the entities the page table holds (unknown ones stay)."""
    for name, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"),
                       ("&gt;", ">"), ("&nbsp;", "\u00a0"), ("&#39;", "'"), ("&amp;", "&")):
        column = f"replace({column}, {quote(name)}, {quote(char)})"
    return column


def visible(column: str, second: tuple[str, ...], lower: bool = True) -> str:
    first = (r"(?is)<!--.*?-->|<script(?:\s[^>]*)?>.*?</script\s*>"
             r"|<style(?:\s[^>]*)?>.*?</style\s*>")
    rest = "(?is)" + "|".join(rf"<{t}(?:\s[^>]*)?>.*?</{t}\s*>" for t in second)
    text = entities(chain(column, (first, " "), (rest, " "), (r"(?s)<.*?>", " ")))
    text = f"trim({sub(text, r'[\s\p{Z}]+', ' ')})"
    return f"lower({text})" if lower else text
