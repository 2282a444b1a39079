"""Tokenisers as single column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes the token rules are defined over.
WORD_CHAR = r"\p{L}\p{N}_"
SPACE_CHAR = r"\s\p{Z}\x1c-\x1f\x85"
ASCII_PUNCT = r"[!-/:-@\[-`{-~]"
# decimal digits plus the superscript, subscript, circled and similar digit signs
DIGIT_CHAR = (
    r"\p{Nd}\x{b2}\x{b3}\x{b9}\x{1369}-\x{1371}\x{19da}\x{2070}\x{2074}-\x{2079}"
    r"\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247c}\x{2488}-\x{2490}\x{24ea}"
    r"\x{24f5}-\x{24fd}\x{24ff}\x{2776}-\x{277e}\x{2780}-\x{2788}\x{278a}-\x{2792}"
    r"\x{10a40}-\x{10a43}\x{10e60}-\x{10e68}\x{11052}-\x{1105a}\x{1f100}-\x{1f10a}"
)


def strip_tags(text: Column, replacement: str = "") -> Column:
    """Remove ``<...>`` runs (within a line)."""
    return F.regexp_replace(text, r"<[^\n]*?>", replacement)


def collapse_nonword(text: Column, unicode_boundary: bool = False) -> Column:
    """Turn non-word characters followed by a space into one space.

    The default counts only ASCII letters, digits and ``_`` as word characters, so
    an accented letter right before a space goes too; ``unicode_boundary=True``
    keeps it.
    """
    pattern = rf"[^{WORD_CHAR}]+ " if unicode_boundary else r"\W+ "
    return F.regexp_replace(text, pattern, " ")


def word_or_run_tokens(text: Column) -> Column:
    """Tokens that are a run of word characters or, failing that, of non-spaces."""
    return F.regexp_extract_all(
        text, F.lit(rf"([{WORD_CHAR}]+|[^{SPACE_CHAR}]+)"), F.lit(1))


def drop_punctuation(words: Column) -> Column:
    """Delete ASCII punctuation characters from every token."""
    return F.transform(words, lambda w: F.regexp_replace(w, ASCII_PUNCT, ""))


def has_digit(word: Column) -> Column:
    """The word holds a digit sign; the wide class is tried only on numeric characters."""
    return word.rlike(r"\p{N}") & word.rlike(f"[{DIGIT_CHAR}]")


def drop_tokens_with_digits(words: Column) -> Column:
    return F.filter(words, lambda w: ~has_digit(w))


def keep_lengths(words: Column, min_len: int = 3, max_len: int | None = 20) -> Column:
    if max_len is None:
        return F.filter(words, lambda w: F.length(w) >= min_len)
    return F.filter(words, lambda w: F.length(w).between(min_len, max_len))


def clean_words(text: Column, *, tags: bool = True, lower_first: bool = True,
                min_len: int = 3, max_len: int | None = 20,
                keep_digits: bool = False, unicode_boundary: bool = False) -> Column:
    """The composite tokeniser: text to an array of clean words.

    Works on the whole text with a handful of regex passes instead of calling
    functions per token: a space is set after the leading word run of every
    non-space run (that is where a word token ends), punctuation is deleted
    everywhere, and one split yields the tokens.
    """
    out = strip_tags(text) if tags else text
    out = collapse_nonword(out, unicode_boundary)
    if lower_first:
        out = F.lower(out)
    out = F.regexp_replace(out, rf"(?<![^{SPACE_CHAR}])[{WORD_CHAR}]++", "$0 ")
    out = F.regexp_replace(out, f"{ASCII_PUNCT}+", "")
    pieces = F.split(out, f"[{SPACE_CHAR}]+")

    def wanted(w: Column) -> Column:
        size = F.length(w)
        ok = size >= min_len if max_len is None else size.between(min_len, max_len)
        return ok if keep_digits else ok & ~has_digit(w)

    words = F.filter(pieces, wanted)
    return words if lower_first else F.transform(words, F.lower)


def feed_words(text: Column) -> Column:
    """Words of a crawled page (text already lower-cased by the page reader)."""
    return clean_words(text)


def document_words(text: Column) -> Column:
    """Words of a document of the common table."""
    return clean_words(text)


def encyclopedia_words(text: Column) -> Column:
    """Words of an encyclopedia text: no tags to strip, lower-cased last."""
    return clean_words(text, tags=False, lower_first=False)


def gap_words(text: Column, min_len: int = 1) -> Column:
    """Lower-cased words between ASCII non-word gaps."""
    return F.filter(F.split(F.lower(text), r"\W"), lambda w: F.length(w) >= min_len)


def alphabetic_words(text: Column, min_len: int = 2, max_len: int = 15,
                     lower: bool = True) -> Column:
    """Maximal runs of letters (no digits), without a leading underscore."""
    source = F.lower(text) if lower else text
    runs = F.regexp_extract_all(source, F.lit(r"([\p{L}\p{Nl}\p{No}_]+)"), F.lit(1))
    return F.filter(
        runs, lambda w: F.length(w).between(min_len, max_len) & ~w.startswith("_"))
