"""Wiki-markup steps over markup that is woven into the whole document texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrain.functions import lines, markup, text
from lexigrain.registry import sql as S
from lexigrain.registry.core import documents, query

# pieces of a page: $name$ stands for a column, the rest is literal
_HEAD = (
    "<!-- $source$ -->{{Infobox|name=$source$|{{lang|$lang$}}}}\n"
    "{| class=\"t\"\n|-\n| $lang$ || {| inner |} $source$\n|}\n"
    "__NOTOC__'''''$source$''''' ''$lang$'' '''b $lang$''' <nowiki>n</nowiki>\n"
)
_TAIL = (
    "\n== Links ==\n* [http://x.org/$doc_id$ site $source$] and [ftp://y.net/$lang$]\n"
    "# one [http://x.org/q http://x.org/$source$.png] [[w:$lang$]] [[:en:$lang$]]\n"
    "[[File:$source$.jpg|thumb|a [[$lang$|word]] caption]] [[$source$ page]]es\n"
    "<div class=\"a\">a<div>b $source$</div>c</div><br /> <b>bold $lang$</b> <sup>2</sup>\n"
    "<math>x_$source$</math> <math>y</math> <code>$lang$</code> <math>x_$source$</math>\n"
    "__INDEX__ a....b  c\td ,, e,. <<$lang$>>\n---\n[[Category:$lang$]] \n"
    "[[de:$source$]]\n[[fr:$lang$]]"
)


def _parts(template: str) -> list[tuple[bool, str]]:
    """Pieces of a template: (is it a column, name or literal)."""
    return [(i % 2 == 1, piece) for i, piece in enumerate(template.split("$")) if piece]


def _spark_concat(template: str):
    return F.concat(*[F.col(p).cast("string") if is_col else F.lit(p)
                      for is_col, p in _parts(template)])


def _sql_concat(template: str) -> str:
    return "(" + " || ".join(p if is_col else S.quote(p) for is_col, p in _parts(template)) + ")"


def _spark_body():
    linked = F.regexp_replace("text", r"([A-Za-z]+), ", "[[$1|''$1'']]s, ")
    return F.regexp_replace(
        linked, r"([a-z]+)\. ", '$1.<ref name="r">{{cite|{{nested|$1}}}}</ref> ')


_SQL_BODY = S.chain("text", (r"([A-Za-z]+), ", r"[[\1|''\1'']]s, "),
                    (r"([a-z]+)\. ", r'\1.<ref name="r">{{cite|{{nested|\1}}}}</ref> '))
WIKI = f"({_sql_concat(_HEAD)} || {_SQL_BODY} || {_sql_concat(_TAIL)})"


def wiki_pages(spark, sf_dir):
    """documents as pages: doc_id, source, lang and the marked-up text."""
    return documents(spark, sf_dir).select(
        "doc_id", "source", "lang",
        F.concat(_spark_concat(_HEAD), _spark_body(), _spark_concat(_TAIL)).alias("wiki"))


def _step(name: str, sql: str, cleaner) -> None:
    """Register one cleaning step applied to every page."""

    @query(name, f"SELECT doc_id, {sql} AS text FROM "
                 f"(SELECT doc_id, source, lang, text, {WIKI} AS wiki FROM documents)")
    def run(spark, sf_dir):
        return wiki_pages(spark, sf_dir).select("doc_id", cleaner(F.col("wiki")).alias("text"))


_CTRL = r"\x00-\x08\x0a-\x1F"
_PROTO = "(?:" + "|".join(markup.URL_PROTOCOLS) + ")"
_URL = rf'{_PROTO}[^\]\[<>"\x00-\x20\x7F\s]+'
_LABEL = rf"(?:[^\]\[{_CTRL}]|\[\[[^\]\[{_CTRL}]+\]\])*?"


def _comments(c: str) -> str:
    return S.sub(c, r"(?s)<!--.*?-->")


def _templates(c: str) -> str:
    return S.chain(c, *[(r"\{\{[^{}]*\}\}", "")] * 4)


def _tables(c: str) -> str:
    return S.chain(c, *[(r"\{\|[^{}]*\|\}", "")] * 3)


def _external(c: str) -> str:
    image = rf'(?i)\[{_URL}\s*https?://[^\]\[<>"\x00-\x20\s]+/[A-Za-z0-9_.-]+\.png\]'
    return S.chain(c, (image, ""), (rf"(?i)\[({_URL})\s*({_LABEL})\]", r"\2"))


def _internal(c: str) -> str:
    for _ in range(3):
        c = S.sub(c, r"\[\[(:?)(w|wiktionary|wikt):([^\[\]]*)\]\]", "[[\\1\\2\x05\\3]]")
        c = S.chain(c, (r"\[\[:?[^\[\]|:]+:[^\[\]]*\]\]", ""),
                    (r"\[\[[^\[\]]*\|\s*([^\[\]|]*?)\s*\]\]", r"\1"),
                    (r"\[\[([^\[\]|]*)\]\]", r"\1"))
        c = f"replace({c}, '\x05', ':')"
    return c


def _switches(c: str) -> str:
    return S.sub(c, "__(" + "|".join(sorted(markup.BEHAVIOUR_SWITCHES, key=len, reverse=True))
                 + ")__")


def _emphasis(c: str) -> str:
    c = S.chain(c, (r"'''''([^\n]*?)'''''", r"\1"), (r"'''([^\n]*?)'''", r"\1"),
                (r"''\"([^\"]*?)\"''", r'"\1"'), (r"''([^\n]*?)''", r'"\1"'),
                (r'""([^"]*?)""', r'"\1"'))
    return f"replace(replace({c}, '''''''', ''), '''''', '\"')"


def _tags(c: str) -> str:
    single = "|".join(markup.SELF_CLOSING_TAGS)
    kept = "|".join((*markup.UNWRAPPED_TAGS, "a"))
    return S.sub(c, rf"(?is)<!--.*?-->|<\s*(?:{single})\b[^>]*/\s*>"
                    rf"|<(?:{kept})\b.*?>|</\s*(?:{kept})>")


def _elements(c: str) -> str:
    for tag in ("div", "ref", "sup"):
        c = S.chain(c, *[(rf"(?i)<\s*{tag}\b[^>/]*>[^<]*<\s*/\s*{tag}\s*>", "")] * 2)
    return c


def _placeholders(c: str) -> str:
    for found, new in (("'<math>x_' || source || '</math>'", "'formula_1'"),
                       ("'<math>y</math>'", "'formula_2'"),
                       ("'<code>' || lang || '</code>'", "'codice_1'")):
        c = f"replace({c}, {found}, {new})"
    return c


def _tidy(c: str) -> str:
    c = f"replace(replace(replace({c}, '<<', '«'), '>>', '»'), chr(9), ' ')"
    c = S.chain(c, (" {2,}", " "), (r"\.{4,}", "..."), (r"\n[^\p{L}\p{N}_]+?\n", "\n"))
    return f"replace(replace({c}, ',,', ','), ',.', '.')"


def _captions(c: str) -> str:
    return S.chain(c, (r"\[\[(?:[fF]ile:|[iI]mage)[^\]]*\|([^\]|]*)\]\]", r"\1"),
                   (r"(\[\[(?:[fF]ile:|[iI]mage)[^\]|]*)\]\]", r"\1"))


def _languages(c: str) -> str:
    return S.sub(c, r"(?:\n\[\[[a-z][a-z][\w-]*:[^:\]]+\]\])+$")


def _inline(c: str) -> str:
    for tag in ("ref", "nowiki", "math"):
        c = S.sub(c, rf"(?s)<{tag}[> ].*?(?:</{tag}>|/>)")
    return c


def _rows(c: str) -> str:
    c = f"replace({c}, '||', chr(10) || '|')"
    return S.chain(c, (r"\n(?:\{\||\|-|\|\})[^\n]*", "\n"), (r"\n[|!](?:[^\n]*\|)?", "\n"))


def _light(c: str) -> str:
    c = _captions(_templates(_languages(S.entities(c))))
    for _ in range(3):
        c = S.chain(_inline(_comments(c)), (r"(?s)<.*?>", ""), (r"\[\[Category:[^\]\[]*\]\]", ""),
                    (r"\[\w+://[^\n]*?(?:( [^\n]*?)|)\]", r"\1"),
                    (r"\[[^\]\[]*\|([^\]\[]*)\]", r"\1"))
        c = f"replace({_rows(c)}, '[]', '')"
    return f"replace(replace({c}, '[', ''), ']', '')"


def _full(c: str) -> str:
    c = _internal(_external(_tables(_templates(c))))
    return _tidy(_placeholders(S.entities(_elements(_tags(_emphasis(_switches(c)))))))


_step("wiki_comments", _comments("wiki"), markup.drop_comments)
_step("wiki_templates", _templates("wiki"), markup.drop_templates)
_step("wiki_tables", _tables(_templates("wiki")),
      lambda c: markup.drop_tables(markup.drop_templates(c)))
_step("wiki_table_rows", _rows("wiki"), markup.drop_table_rows)
_step("wiki_external_links", _external("wiki"), markup.replace_external_links)
_step("wiki_internal_links", _internal("wiki"), markup.replace_internal_links)
_step("wiki_file_captions", _captions("wiki"), markup.file_captions)
_step("wiki_language_links", _languages("wiki"), markup.drop_language_links)
_step("wiki_categories", S.sub("wiki", r"\[\[Category:[^\]\[]*\]\]"), markup.drop_categories)
_step("wiki_inline_blocks", _inline("wiki"), markup.drop_inline_blocks)
_step("wiki_switches", _switches("wiki"), markup.drop_switches)
_step("wiki_emphasis", _emphasis("wiki"), markup.unquote_emphasis)
_step("wiki_tags", _tags("wiki"), markup.drop_tags)
_step("wiki_elements", _elements(_templates("wiki")),
      lambda c: markup.drop_elements(markup.drop_templates(c)))
_step("wiki_placeholders", _placeholders("wiki"), markup.name_placeholders)
_step("wiki_whitespace", _tidy("wiki"), markup.tidy_whitespace)
_step("wiki_light_clean", _light("wiki"), markup.light_clean)
_step("wiki_clean", _full("wiki"), markup.clean_markup)


@query("wiki_single_braces", f"""
    SELECT doc_id, source || '  {{' || lang || '}} end' || chr(10) || {_light('wiki')} AS text FROM (
        SELECT doc_id, source, lang, text, {WIKI} AS wiki FROM documents)""")
def wiki_single_braces(spark, sf_dir):
    """The light cleaner counts single braces in a template, and keeps those outside."""
    before = F.concat("source", F.lit(" {{"), "source", F.lit("|x={"), "lang", F.lit(
        "|{{b|{c}}}}}} {"), "lang", F.lit("} end\n"))
    return wiki_pages(spark, sf_dir).select(
        "doc_id", markup.light_clean(F.concat(before, "wiki")).alias("text"))


@query("wiki_keep_links", f"""
    WITH p AS (SELECT doc_id, source, lang,
        '[[' || source || ' page|the ' || lang || ']]s [[' || lang || ']] [http://x.org/'
        || doc_id || ' site] ' || {S.chain('text', (r'[\[\]]', ''))} AS wiki FROM documents)
    SELECT doc_id, '<a href="' || source || '%20page">the ' || lang || '</a>s <a href="'
        || lang || '">' || lang || '</a> <a href="http%3A//x.org/' || doc_id || '">site</a> '
        || substr(wiki, length('[[' || source || ' page|the ' || lang || ']]s [[' || lang
        || ']] [http://x.org/' || doc_id || ' site] ') + 1) AS text FROM p""")
def wiki_keep_links(spark, sf_dir):
    page = F.concat(
        F.lit("[["), "source", F.lit(" page|the "), "lang", F.lit("]]s [["), "lang",
        F.lit("]] [http://x.org/"), F.col("doc_id").cast("string"), F.lit(" site] "),
        F.regexp_replace("text", r"[\[\]]", ""))
    return documents(spark, sf_dir).select("doc_id", markup.replace_internal_links(
        markup.replace_external_links(page, True), True).alias("text"))


@query("wiki_code_blocks", """
    SELECT doc_id, 'a &amp;lt; ' || source || ' <b> ' || text || ' & "' AS text
    FROM documents""")
def wiki_code_blocks(spark, sf_dir):
    page = F.concat(
        F.lit('&lt;syntaxhighlight lang="x"&gt;a &amp;lt; '), "source",
        F.lit("&lt;/syntaxhighlight&gt; &lt;b&gt; "),
        F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit(" &amp; &quot;"))
    return documents(spark, sf_dir).select(
        "doc_id", text.decode_outside_code(page).alias("text"))


_SECTIONED = (
    "\n== $lang$ ==\n=== $source$ ===\n* item\n\n:indented\nafter list $source$\n"
    "(aside)\n pre\n==== deep! ====\n{| rest\n== tail ==\n"
)
_SQL_SECTIONED = f"replace(text, chr(10), {_sql_concat(_SECTIONED)})"


def _compact_sql(sections: bool) -> str:
    headings = "" if not sections else """
        UNION ALL SELECT doc_id, f AS place, 0 AS ord, level, title AS line FROM (
            SELECT *, min(level) OVER (PARTITION BY doc_id, f ORDER BY pos
                ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS deeper FROM ev
            WHERE kind = 'section' AND f IS NOT NULL)
        WHERE deeper IS NULL OR level < deeper"""
    return rf"""
    WITH raw AS (SELECT doc_id, string_split({_SQL_SECTIONED}, chr(10)) AS ls FROM documents),
    l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM raw),
    k AS (SELECT *, CASE WHEN line = '' THEN 'empty'
              WHEN regexp_matches(line, '^==+[^=]*==') THEN 'section'
              WHEN starts_with(line, '++') THEN 'title'
              WHEN starts_with(line, ':') THEN 'indent'
              WHEN regexp_matches(line, '^[*#;]') THEN 'list'
              WHEN regexp_matches(line, '^[{{|]|\}}$|^\(.*\)$|^[.-]*$') THEN 'residue'
              ELSE 'body' END AS kind,
              length(regexp_extract(line, '^(==+)', 1)) AS level,
              trim(regexp_extract(line, '^==+([^=]*)==', 1)) AS bare FROM l),
    s AS (SELECT *, CASE WHEN bare = '' OR regexp_matches(bare, '[!?]$') THEN bare
                         ELSE bare || '.' END AS title,
              last_value(CASE WHEN kind NOT IN ('empty', 'indent', 'title') THEN kind END
                  IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k),
    c AS (SELECT *, kind IN ('body', 'residue') AND before IS NOT DISTINCT FROM 'list'
                    AS after_list,
              kind = 'body' AND before IS DISTINCT FROM 'list' AS cand FROM s),
    ev AS (SELECT *, min(CASE WHEN cand THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos
                  ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS f,
              last_value(CASE WHEN cand THEN 'c' WHEN kind = 'section' THEN 's' END IGNORE NULLS)
                  OVER (PARTITION BY doc_id ORDER BY pos
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS event FROM c),
    o AS (SELECT doc_id, pos AS place, 1 AS ord, 0 AS level, line FROM ev
          WHERE after_list OR (cand AND (event = 's' OR NOT starts_with(line, ' '))){headings})
    SELECT doc_id, string_agg(line, chr(10) ORDER BY place, ord, level) AS text FROM o
    GROUP BY doc_id"""


def _sectioned(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", F.replace("text", F.lit("\n"), _spark_concat(_SECTIONED)).alias("wiki"))


@query("wiki_compact", _compact_sql(True))
def wiki_compact(spark, sf_dir):
    return _sectioned(spark, sf_dir).select("doc_id", F.array_join(
        lines.compact_lines(F.col("wiki")), "\n").alias("text"))


@query("wiki_compact_no_sections", _compact_sql(False))
def wiki_compact_no_sections(spark, sf_dir):
    return _sectioned(spark, sf_dir).select("doc_id", F.array_join(
        lines.compact_lines(F.col("wiki"), keep_sections=False), "\n").alias("text"))


@query("wiki_line_kinds", rf"""
    WITH l AS (SELECT unnest(string_split({_SQL_SECTIONED}, chr(10))) AS line FROM documents)
    SELECT CASE WHEN line = '' THEN 0 WHEN regexp_matches(line, '^==+[^=]*==') THEN 1
                WHEN starts_with(line, '++') THEN 2 WHEN starts_with(line, ':') THEN 3
                WHEN regexp_matches(line, '^[*#;]') THEN 4
                WHEN regexp_matches(line, '^[{{|]|\}}$|^\(.*\)$|^[.-]*$') THEN 5 ELSE 6 END
           AS kind, count(*) AS n_lines FROM l GROUP BY 1""")
def wiki_line_kinds(spark, sf_dir):
    line = _sectioned(spark, sf_dir).select(F.explode(F.split("wiki", "\n")).alias("line"))
    return line.groupBy(lines.classify_line(F.col("line")).alias("kind")).agg(
        F.count("*").alias("n_lines"))
