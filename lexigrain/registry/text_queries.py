"""Tokenisers and scalar text functions over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrain.functions import html, stopwords, text, tokens
from lexigrain.operators.once import inline_once
from lexigrain.registry import sql as S
from lexigrain.registry.core import documents, pages, query, table
from lexigrain.session import spread

NAMESPACES = ["Template", "Category", "Subject", "Re"]
_NS_SQL = "(" + ", ".join(S.quote(n) for n in NAMESPACES) + ")"


def _joined(words):
    return F.array_join(words, " ")


@query("document_words", f"""
    SELECT doc_id, len(w) AS n_words, array_to_string(w, ' ') AS words
    FROM (SELECT doc_id, {S.words('text')} AS w FROM documents)""")
def document_words(spark, sf_dir):
    docs = documents(spark, sf_dir).select(
        "doc_id", tokens.document_words(F.col("text")).alias("w"))
    return docs.select("doc_id", F.size("w").cast("long").alias("n_words"),
                       _joined("w").alias("words"))


@query("encyclopedia_words", f"""
    SELECT doc_id, array_to_string({S.words('text', tags=False, lower_first=False)}, ' ')
           AS words FROM documents""")
def encyclopedia_words(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", _joined(tokens.encyclopedia_words(F.col("text"))).alias("words"))


@query("crawled_page_words", f"""
    SELECT page_id, array_to_string({S.words('v')}, ' ') AS words
    FROM (SELECT page_id, {S.visible('html', ('head', 'header', 'title', 'footer', 'a'))} AS v
          FROM pages)""")
def crawled_page_words(spark, sf_dir):
    shown = pages(spark, sf_dir).select("page_id", html.visible_text(F.col("html")).alias("v"))
    return shown.select("page_id", _joined(tokens.feed_words(F.col("v"))).alias("words"))


@query("conversation_words", f"""
    SELECT conv_id, turn, array_to_string({S.words('text')}, ' ') AS words FROM conversations""")
def conversation_words(spark, sf_dir):
    turns = spread(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return turns.select("conv_id", "turn",
                        _joined(tokens.document_words(F.col("text"))).alias("words"))


@query("strip_tags", rf"""
    SELECT page_id, {S.sub('html', r'<[^\n]*?>')} AS text FROM pages""")
def strip_tags(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", tokens.strip_tags(F.col("html")).alias("text"))


@query("collapse_nonword", rf"""
    SELECT doc_id, {S.sub('text', r'\W+ ', ' ')} AS text,
           {S.sub('text', r'[^\p{L}\p{N}_]+ ', ' ')} AS unicode_text FROM documents""")
def collapse_nonword(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", tokens.collapse_nonword(F.col("text")).alias("text"),
        tokens.collapse_nonword(F.col("text"), True).alias("unicode_text"))


@query("token_steps", f"""
    WITH t AS (SELECT doc_id, {S.raw_tokens('lower(text)')} AS raw FROM documents),
    p AS (SELECT doc_id, raw,
                 list_transform(raw, lambda x: {S.sub('x', S.PUNCT)}) AS bare FROM t),
    d AS (SELECT doc_id, raw, bare, list_filter(bare, lambda x:
                 NOT regexp_matches(x, {S.quote(S.DIGIT)})) AS alpha FROM p)
    SELECT doc_id, array_to_string(raw, ' ') AS raw, array_to_string(bare, ' ') AS bare,
           array_to_string(alpha, ' ') AS alpha,
           array_to_string(list_filter(alpha, lambda x: length(x) >= 3), ' ') AS long_enough
    FROM d""")
def token_steps(spark, sf_dir):
    out = documents(spark, sf_dir).select(
        "doc_id", tokens.word_or_run_tokens(F.lower("text")).alias("raw"))
    out = out.withColumn("bare", tokens.drop_punctuation(F.col("raw")))
    out = out.withColumn("alpha", tokens.drop_tokens_with_digits(F.col("bare")))
    kept = tokens.keep_lengths(F.col("alpha"), 3, None)
    return out.select("doc_id", _joined("raw").alias("raw"), _joined("bare").alias("bare"),
                      _joined("alpha").alias("alpha"), _joined(kept).alias("long_enough"))


@query("gap_words", r"""
    SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(lower(text), '\W'),
           lambda t: length(t) >= 3), ' ') AS words FROM documents""")
def gap_words(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", _joined(tokens.gap_words(F.col("text"), 3)).alias("words"))


@query("stop_words_removed", f"""
    SELECT doc_id, len(k) AS n_kept, array_to_string(k, ' ') AS words
    FROM (SELECT doc_id, {S.no_stop_words(S.words('text'))} AS k FROM documents)""")
def stop_words_removed(spark, sf_dir):
    docs = documents(spark, sf_dir).select(
        "doc_id", stopwords.remove_stop_words(
            tokens.document_words(F.col("text"))).alias("k"))
    return docs.select("doc_id", F.size("k").cast("long").alias("n_kept"),
                       _joined("k").alias("words"))


@query("alphabetic_words", r"""
    SELECT doc_id, array_to_string(list_filter(
        regexp_extract_all(lower(text), '([\p{L}\p{Nl}\p{No}_]+)', 1),
        lambda t: length(t) BETWEEN 2 AND 15 AND NOT starts_with(t, '_')), ' ') AS words
    FROM documents""")
def alphabetic_words(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", _joined(tokens.alphabetic_words(F.col("text"))).alias("words"))


@query("remove_accents", "SELECT doc_id, strip_accents(text) AS text FROM documents")
def remove_accents(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", text.remove_accents(F.col("text")).alias("text"))


@query("bytes_to_text", """
    SELECT doc_id, text AS strict_text,
           CASE WHEN length(text) = strlen(text) THEN text END AS latin_strict,
           text || '|' AS ignoring FROM documents""")
def bytes_to_text(spark, sf_dir):
    # valid bytes; bytes of another encoding (kept only if plain ASCII); a broken tail byte
    broken = F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF")), F.encode(F.lit("|"), "UTF-8"))
    mixed = F.concat(F.encode("text", "UTF-8"), F.when(
        F.length("text") != F.octet_length("text"), F.unhex(F.lit("C3"))).otherwise(
        F.unhex(F.lit(""))))
    return documents(spark, sf_dir).select(
        "doc_id", text.to_unicode(F.encode("text", "UTF-8")).alias("strict_text"),
        text.to_unicode(mixed).alias("latin_strict"),
        text.to_unicode(broken, "ignore").alias("ignoring"))


@query("decode_entities", f"""
    SELECT page_id, {S.entities('html')} AS html FROM pages""")
def decode_entities(spark, sf_dir):
    return pages(spark, sf_dir).select(
        "page_id", text.decode_entities(F.col("html")).alias("html"))


@query("numeric_entities", """
    SELECT doc_id, text || '©é' || chr(8364) || '&unknown; &#xD800;' AS text FROM documents""")
def numeric_entities(spark, sf_dir):
    coded = F.concat(F.replace("text", F.lit("&"), F.lit("&amp;")),
                     F.lit("&#169;&#xE9;&euro;&unknown; &#xD800;"))
    return documents(spark, sf_dir).select(
        "doc_id", text.decode_entities(coded).alias("text"))


@query("ascii_only", r"""
    SELECT doc_id, regexp_replace(text, '[^\x00-\x7F\t]+', ' ', 'g') AS text FROM documents""")
def ascii_only(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", text.ascii_only(F.col("text")).alias("text"))


@query("literal_fixes", r"""
    SELECT page_id, replace(regexp_replace(replace(replace(replace(replace(html,
           '<br>', ''), '</br>', ''), ' < ', ' lt '), ' > ', ' gt '),
           '[^\x00-\x7F\t]+', ' ', 'g'), '&', 'and') AS html FROM pages""")
def literal_fixes(spark, sf_dir):
    return pages(spark, sf_dir).select(
        "page_id", text.literal_fixes(F.col("html")).alias("html"))


_ANCHORS = (r"regexp_extract_all(html, '(?is)(<a\s[^>]*>.*?</a\s*>)', 1)")
_LINK_ROWS = rf"""
    WITH a AS (SELECT page_id, unnest({_ANCHORS}) AS a,
                      generate_subscripts({_ANCHORS}, 1) AS place FROM pages),
    l AS (SELECT page_id, place,
                 {S.entities("regexp_extract(a, '(?is)href\\s*=\\s*\"([^\">]*)', 1)")} AS href,
                 {S.entities(S.sub('a', '(?s)<.*?>'))} AS text FROM a)"""


@query("page_links", f"{_LINK_ROWS} SELECT DISTINCT page_id, href, text FROM l")
def page_links(spark, sf_dir):
    return inline_once(pages(spark, sf_dir), html.distinct_links(F.col("html")), "href", "page_id")


@query("link_map", f"""{_LINK_ROWS}
    SELECT page_id, href, arg_max(text, place) AS text FROM l GROUP BY ALL""")
def link_map(spark, sf_dir):
    return inline_once(pages(spark, sf_dir), F.map_entries(html.link_map(F.col("html"))), "key",
                       "page_id").toDF("page_id", "href", "text")


@query("distinct_link_counts", f"""{_LINK_ROWS}
    SELECT page_id, count(DISTINCT (href, text)) AS n_links FROM l GROUP BY page_id
    UNION ALL SELECT page_id, 0 FROM pages WHERE page_id NOT IN (SELECT page_id FROM l)""")
def distinct_link_counts(spark, sf_dir):
    return pages(spark, sf_dir).select(
        "page_id", F.size(html.distinct_links(F.col("html"))).cast("long").alias("n_links"))


@query("visible_text", f"""
    SELECT page_id, {S.visible('html', ('head', 'header', 'title', 'footer', 'a'))} AS text
    FROM pages""")
def visible_text(spark, sf_dir):
    return pages(spark, sf_dir).select(
        "page_id", html.visible_text(F.col("html")).alias("text"))


@query("visible_text_first_version", f"""
    SELECT page_id, {S.visible('html', ('head', 'title'), lower=False)} AS text FROM pages""")
def visible_text_first_version(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", html.visible_text(
        F.col("html"), html.HIDDEN_ELEMENTS_FIRST_VERSION, lower=False).alias("text"))


@query("raw_page_text", f"SELECT page_id, {S.sub('html', '(?s)<.*?>')} AS text FROM pages")
def raw_page_text(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", html.raw_text(F.col("html")).alias("text"))


# every line of a text stands for a title
_LINES = """l AS (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)"""


def _lines(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", "source", "lang", F.posexplode(
        F.split("text", "\n", -1)).alias("pos", "line")).withColumn(
        "pos", F.col("pos").cast("long"))


def _ucfirst(c: str) -> str:
    return f"(upper(substr({c}, 1, 1)) || substr({c}, 2))"


@query("normalize_title", rf"""
    WITH {_LINES}, t AS (SELECT doc_id, pos, regexp_replace(regexp_replace(
                 '  ' || source || '_x: ' || line || '_', '^[ _]+|[ _]+$', '', 'g'),
                 '[\s_]+', ' ', 'g') AS own,
                 regexp_replace(regexp_replace(
                 'category:  ' || line, '^[ _]+|[ _]+$', '', 'g'),
                 '[\s_]+', ' ', 'g') AS known,
                 regexp_replace(regexp_replace(line, '^[ _]+|[ _]+$', '', 'g'),
                 '[\s_]+', ' ', 'g') AS plain FROM l)
    SELECT doc_id, pos,
           {_ucfirst("split_part(own, ':', 1)")} || ': '
             || {_ucfirst("substr(own, strpos(own, ':') + 2)")} AS own,
           'Category:' || {_ucfirst("substr(known, 11)")} AS known,
           CASE WHEN regexp_matches(plain, '^[^:]*:\s*\S') THEN
               CASE WHEN {_ucfirst("split_part(plain, ':', 1)")} IN {_NS_SQL}
                    THEN {_ucfirst("split_part(plain, ':', 1)")} || ':'
                    ELSE {_ucfirst("split_part(plain, ':', 1)")} || ':'
                         || regexp_extract(plain, '^[^:]*:(\s?)', 1) END
               || {_ucfirst("regexp_extract(plain, '^[^:]*:\\s*(\\S.*)$', 1)")}
           ELSE {_ucfirst('plain')} END AS plain
    FROM t""")
def normalize_title(spark, sf_dir):
    line = F.col("line")
    return _lines(spark, sf_dir).select(
        "doc_id", "pos",
        text.normalize_title(F.concat(F.lit("  "), "source", F.lit("_x: "), line, F.lit("_")),
                             NAMESPACES).alias("own"),
        text.normalize_title(F.concat(F.lit("category:  "), line), NAMESPACES).alias("known"),
        text.normalize_title(line, NAMESPACES).alias("plain"))


@query("first_letter_case", f"""
    SELECT doc_id, {_ucfirst('text')} AS upper_first,
           lower(substr(text, 1, 1)) || substr(text, 2) AS lower_first FROM documents""")
def first_letter_case(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", text.upper_first(F.col("text")).alias("upper_first"),
        text.lower_first(F.col("text")).alias("lower_first"))


@query("template_titles", rf"""
    WITH {_LINES}
    SELECT doc_id, pos, 'Template:' || {_ucfirst('source')} AS plain,
           'Category:' || source AS known, {_ucfirst('source')} AS main,
           'Template:' || {_ucfirst("(source || ':' || lang)")} AS unknown,
           CASE WHEN line = '' THEN ''
                WHEN starts_with(line, ':') THEN {_ucfirst('substr(line, 2)')}
                WHEN contains(line, ':') AND {_ucfirst("split_part(line, ':', 1)")} IN {_NS_SQL}
                THEN {_ucfirst("split_part(line, ':', 1)")} || substr(line, strpos(line, ':'))
                ELSE 'Template:' || {_ucfirst('line')} END AS free
    FROM l""")
def template_titles(spark, sf_dir):
    def qualified(column):
        return text.qualify_template_title(column, NAMESPACES)

    return _lines(spark, sf_dir).select(
        "doc_id", "pos", qualified(F.col("source")).alias("plain"),
        qualified(F.concat(F.lit("category:"), "source")).alias("known"),
        qualified(F.concat(F.lit(":"), "source")).alias("main"),
        qualified(F.concat_ws(":", "source", "lang")).alias("unknown"),
        qualified(F.col("line")).alias("free"))


@query("escape_markup", """
    SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')
           AS html FROM pages""")
def escape_markup(spark, sf_dir):
    return pages(spark, sf_dir).select(
        "page_id", text.escape_markup(F.col("html")).alias("html"))


@query("page_urls", """
    SELECT doc_id, 'http://enc.example.org/wiki?curid=' || doc_id AS url FROM documents""")
def page_urls(spark, sf_dir):
    base = F.lit("http://enc.example.org/wiki")
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.page_url(base, F.col("doc_id")).alias("url"))


@query("percent_quote", """
    SELECT page_id, replace(url_encode(url), '%2F', '/') AS quoted FROM pages""")
def percent_quote(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", text.percent_quote(F.col("url")).alias("quoted"))
