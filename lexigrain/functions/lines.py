"""Line compaction of a cleaned page, inside one row (no explode, no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigrain.functions.arrays import let

# Fixed value: a section title line; the marker length is the section level.
SECTION_LINE = r"^(==+)\s*(.*?)\s*\1"

# blocks of lines folded before their output is set aside, keeps the fold linear
_BLOCKS = r"((?:[^\n]*+\n){1,256}+|[^\n]++)"

_EMPTY, _SECTION, _TITLE, _INDENT, _LIST, _RESIDUE, _BODY = range(7)
_HEADINGS = "array<struct<level:int,title:string>>"


def _sentence(title: Column) -> Column:
    return F.when((title == "") | title.rlike("[!?]$"), title).otherwise(
        F.concat(title, F.lit(".")))


def classify_line(line: Column) -> Column:
    """Kind of a line as an integer, see the constants above."""
    return (
        F.when(line == "", _EMPTY)
        .when(line.rlike(SECTION_LINE), _SECTION)
        .when(line.startswith("++"), _TITLE)
        .when(line.startswith(":"), _INDENT)
        .when(line.rlike("^[*#;]"), _LIST)
        .when(line.rlike(r"^[{|]|\}$|^\(.*\)$|^[.-]*$") | (line == "("), _RESIDUE)
        .otherwise(_BODY)
    )


def compact_lines(text: Column, *, keep_sections: bool = True,
                  keep_lists: bool = False) -> Column:
    """Lines worth keeping, as an array.

    A section title waits until the first body line below it; titles of sections
    that stay empty are dropped. List, indented and table-residue lines go, and
    preformatted lines stay only right below a title.
    """

    def described(line: Column) -> Column:
        marks = F.regexp_extract(line, "^([*#;:]+)", 1)
        bullet = F.when(marks.endswith("#"), "1. ").otherwise("- ")
        return F.struct(
            line.alias("line"), classify_line(line).alias("kind"),
            F.length(F.regexp_extract(line, SECTION_LINE, 1)).alias("level"),
            _sentence(F.regexp_extract(line, SECTION_LINE, 2)).alias("section"),
            _sentence(F.regexp_extract(line, r"^\+\+(.*)..$", 1)).alias("title"),
            F.trim(F.regexp_extract(line, "^[*#;:]+(.*)$", 1)).alias("item"),
            F.rpad(bullet, F.greatest(F.length(marks), F.length(bullet)), F.lit(" "))
            .alias("bullet"),
        )

    no_headings = F.array().cast(_HEADINGS)

    def step(acc: Column, x: Column) -> Column:
        kind, waiting = x["kind"], acc["waiting"]
        line = F.concat(x["line"], F.lit("\n"))
        titles = F.array_join(F.transform(
            waiting, lambda h: F.concat(h["title"], F.lit("\n"))), "")
        textual = kind.isin(_BODY, _RESIDUE)
        after_list = textual & acc["in_list"]
        first_body = (kind == _BODY) & ~acc["in_list"] & (F.size(waiting) > 0)
        item = F.lit(keep_lists) & (kind == _LIST) & (x["item"] != "")
        emitted = (
            F.when((kind == _TITLE) & (x["title"] != ""), F.concat(x["title"], F.lit("\n")))
            .when(item, F.concat(titles, x["bullet"], x["item"], F.lit("\n")))
            .when(after_list, line)
            .when(first_body, F.concat(titles, line) if keep_sections else line)
            .when((kind == _BODY) & ~acc["empty_section"] & ~x["line"].startswith(" "), line)
            .otherwise("")
        )
        section = F.struct(x["level"].alias("level"), x["section"].alias("title"))
        return F.struct(
            F.when(kind == _SECTION, F.array_append(
                F.filter(waiting, lambda h: h["level"] < x["level"]), section))
            .when(first_body | item, no_headings).otherwise(waiting).alias("waiting"),
            F.when(kind == _SECTION, True).when(first_body, False)
            .otherwise(acc["empty_section"]).alias("empty_section"),
            F.when(kind == _LIST, True).when((kind == _SECTION) | after_list, False)
            .otherwise(acc["in_list"]).alias("in_list"),
            F.concat(acc["out"], emitted).alias("out"),
        )

    def block(acc: Column, lines: Column) -> Column:
        inner = F.aggregate(F.transform(F.split(lines, "\n"), described), F.struct(
            acc["waiting"].alias("waiting"), acc["empty_section"].alias("empty_section"),
            acc["in_list"].alias("in_list"), F.lit("").alias("out")), step)
        return let(inner, lambda r: F.struct(
            r["waiting"].alias("waiting"), r["empty_section"].alias("empty_section"),
            r["in_list"].alias("in_list"), F.array_append(acc["out"], r["out"]).alias("out")))

    start = F.struct(
        no_headings.alias("waiting"), F.lit(False).alias("empty_section"),
        F.lit(False).alias("in_list"), F.array().cast("array<string>").alias("out"))
    blocks = F.regexp_extract_all(text, F.lit(_BLOCKS), F.lit(1))
    joined = F.array_join(F.aggregate(blocks, start, block, lambda acc: acc["out"]), "")
    return let(joined, lambda j: F.when(j == "", F.array().cast("array<string>")).otherwise(
        F.split(F.substr(j, F.lit(1), F.length(j) - 1), "\n")))
