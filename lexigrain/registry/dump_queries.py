"""Encyclopedia dumps: all documents land as one XML dump and are read back.

English and German documents are articles (the German ones appear twice, English
ones of one source carry no namespace), Spanish ones template pages, French ones
template redirects, each after a page that is not closed. Comments of English revisions
hold a closing tag in CDATA, a page whose opening tag is torn stands before German ones,
and one inside a comment after Spanish ones.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrain.functions.text import escape_markup, upper_first
from lexigrain.operators import pages as P
from lexigrain.plans.ingest import extract_articles
from lexigrain.registry import sql as S
from lexigrain.registry.core import documents, query, table
from lexigrain.session import shared_path
from lexigrain.sinks.files import write_templates
from lexigrain.sources.xml import read_dump, read_dump_rejects, read_site_info

NAMESPACES = ["Template", "Category", "Module"]

def _header(spark, sf_dir):
    """The header as one file: fixed namespaces, and one more for each nation."""
    own = table(spark, sf_dir, "nation").select(
        (F.col("n_nationkey") + 1000).alias("key"), F.initcap("n_name").alias("name"))
    fixed = spark.createDataFrame(
        [(0, ""), (10, "Template"), (14, "Category"), (828, "Module")], "key long, name string")
    space = F.concat(F.lit('<namespace key="'), "key", F.when(F.col("name") == "", '" />').otherwise(
        F.concat(F.lit('" case="first-letter">'), "name", F.lit("</namespace>"))))
    spaces = fixed.unionByName(own).agg(F.array_join(F.array_sort(F.collect_list(space)), "\n"))
    return spaces.select(F.concat(
        F.lit("<mediawiki><siteinfo>\n<base>http://enc.example.org/wiki/Main_Page</base>\n"
              "<namespaces>\n"), spaces.columns[0],
        F.lit("\n</namespaces></siteinfo>")).alias("value"))


def _ucfirst_sql(c: str) -> str:
    return f"(upper(substr({c}, 1, 1)) || substr({c}, 2))"


def land_dump(spark, sf_dir):
    """Write the dump; the folder of its parts."""
    article = F.concat(
        F.lit("{{"), "source", F.lit("|x={{R-"), "source", F.lit("}}}} {{#if:a|b}} {{{1}}}\n"
              "{{category:"), "lang", F.lit("}} {{missing}} == "), "text")
    template = F.concat(
        F.lit("<!-- c --><noinclude>doc</noinclude><includeonly>"), "text",
        F.lit("</includeonly>"), F.when(F.col("n_chars") < 500, F.concat(
            F.lit("<onlyinclude>a"), "source", F.lit("</onlyinclude>b<onlyinclude>c</onlyinclude>")))
        .otherwise(""))
    title = (F.when(F.col("lang") == "es", F.concat(F.lit("Template:"), upper_first(F.col("source"))))
             .when(F.col("lang") == "fr", F.concat(F.lit("Template:R-"), "source"))
             .otherwise(F.concat_ws(" ", "source", "doc_id")))
    ns = (F.when(F.col("lang").isin("es", "fr"), "<ns>10</ns>")
          .when(F.col("source") == "src1", "").otherwise("<ns>0</ns>"))
    redirect = F.when(F.col("lang") == "fr", F.concat(
        F.lit('<redirect title="Template:'), upper_first(F.col("source")), F.lit('" />'))).otherwise("")
    text = F.when(F.col("lang") == "es", template).otherwise(article)
    page = F.concat(
        F.lit("  <page>\n    <title>"), title, F.lit("</title>\n    "), ns, F.lit("\n    <id>"),
        F.col("doc_id").cast("string"), F.lit("</id>\n    "), redirect,
        F.lit("<revision><id>7</id>\n<text xml:space=\"preserve\">"), escape_markup(text),
        F.lit("</text>"), F.when(F.col("lang") == "en", "<comment><![CDATA[ </page> ]]></comment>")
        .otherwise(""), F.lit("</revision>\n  </page>"))
    unclosed = F.lit("  <page>\n    <title>Torn</title><id>1</id>")
    torn = F.lit("age>\n    <title>Torn</title><id>1</id></page>")
    comment = F.lit("<!-- <page><title>Old</title><id>2</id></page> -->")
    copies = (F.when(F.col("lang") == "de", F.array(torn, page, page))
              .when(F.col("lang") == "fr", F.array(unclosed, page))
              .when(F.col("lang") == "es", F.array(page, comment)).otherwise(F.array(page)))
    # one range of pages per file, in order, as a dump is
    lines = documents(spark, sf_dir).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    path = shared_path(spark, "dump")
    lines.select(F.explode(copies).alias("value")).write.text(f"{path}/pages")
    _header(spark, sf_dir).write.text(f"{path}/header")
    return path


_ARTICLE = ("'{{' || source || '|x={{R-' || source || '}}}} {{#if:a|b}} {{{1}}}' || chr(10) "
            "|| '{{category:' || lang || '}} {{missing}} == ' || text")


@query("dump_pages", f"""
    SELECT doc_id AS id, source || ' ' || doc_id AS title, 0 AS ns, {_ARTICLE} AS text
    FROM documents WHERE lang IN ('en', 'de')""")
def dump_pages(spark, sf_dir):
    pages = P.content_pages(read_dump(spark, land_dump(spark, sf_dir) + "/pages", land=True))
    return P.split_templates(pages)[0].select("id", "title", "ns", "text")


@query("dump_page_kinds", """
    SELECT CASE WHEN lang IN ('es', 'fr') THEN 10 ELSE 0 END AS ns, lang = 'fr' AS is_redirect,
           sum(CASE lang WHEN 'de' THEN 2 ELSE 1 END)::BIGINT AS n_pages FROM documents
    GROUP BY ALL""")
def dump_page_kinds(spark, sf_dir):
    pages = read_dump(spark, land_dump(spark, sf_dir) + "/pages")
    return pages.groupBy("ns", "is_redirect").agg(F.count("*").alias("n_pages"))


@query("dump_site_info", """
    SELECT 'http://enc.example.org/wiki' AS url_base, k AS ns_key, n AS ns_name
    FROM (VALUES (0, ''), (10, 'Template'), (14, 'Category'), (828, 'Module')) t(k, n)
    UNION ALL SELECT 'http://enc.example.org/wiki', n_nationkey + 1000, array_to_string(
        list_transform(string_split(n_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')
    FROM nation""")
def dump_site_info(spark, sf_dir):
    return read_site_info(spark, land_dump(spark, sf_dir) + "/header")


@query("dump_rejects", """
    SELECT CASE lang WHEN 'fr' THEN 'malformed record' ELSE 'no opening tag' END AS reason,
        count(*) AS n_pages FROM documents WHERE lang IN ('fr', 'de') GROUP BY 1""")
def dump_rejects(spark, sf_dir):
    return read_dump_rejects(spark, land_dump(spark, sf_dir) + "/pages").groupBy("reason").agg(
        F.count("*").alias("n_pages"))


_BODIES = f"""b AS (SELECT 'Template:' || {_ucfirst_sql('source')} AS title, arg_max(CASE
    WHEN n_chars < 500 THEN 'a' || source || 'c' ELSE text END, doc_id) AS body
    FROM documents WHERE lang = 'es' GROUP BY 1)"""
_REDIRECTS = f"""d AS (SELECT DISTINCT 'Template:R-' || source AS title,
    'Template:' || {_ucfirst_sql('source')} AS target FROM documents WHERE lang = 'fr')"""
_CALLS = f"""c AS (SELECT doc_id AS id, unnest(['Template:' || {_ucfirst_sql('source')},
    'Template:R-' || source, 'Category:' || lang, 'Template:Missing']) AS title
    FROM documents WHERE lang IN ('en', 'de'))"""


@query("template_bodies", f"WITH {_BODIES} SELECT title, body FROM b")
def template_bodies(spark, sf_dir):
    pages = read_dump(spark, land_dump(spark, sf_dir) + "/pages")
    return P.template_inventory(pages)[0]


@query("template_redirects", f"WITH {_REDIRECTS} SELECT title, target FROM d")
def template_redirects(spark, sf_dir):
    pages = read_dump(spark, land_dump(spark, sf_dir) + "/pages")
    return P.template_inventory(pages)[1]


def _inventory_and_calls(spark, sf_dir):
    pages = read_dump(spark, land_dump(spark, sf_dir) + "/pages", land=True)
    bodies, redirects = P.template_inventory(pages)
    articles, _ = P.split_templates(P.content_pages(pages))
    return bodies, redirects, P.template_calls(articles, NAMESPACES)


@query("template_calls", f"WITH {_CALLS} SELECT id, title FROM c")
def template_calls(spark, sf_dir):
    return _inventory_and_calls(spark, sf_dir)[2]


@query("template_usage", f"""
    WITH {_BODIES}, {_REDIRECTS}, {_CALLS},
    r AS (SELECT coalesce(target, c.title) AS title FROM c LEFT JOIN d ON d.title = c.title)
    SELECT title, count(*) AS calls, title IN (SELECT title FROM b) AS found FROM r GROUP BY title""")
def template_usage(spark, sf_dir):
    bodies, redirects, calls = _inventory_and_calls(spark, sf_dir)
    return P.template_usage(calls, bodies, redirects)


@query("resolved_template_calls", f"""
    WITH {_BODIES}, {_REDIRECTS}, {_CALLS},
    r AS (SELECT id, coalesce(target, c.title) AS title FROM c LEFT JOIN d ON d.title = c.title)
    SELECT id, r.title, coalesce(body, '') AS body FROM r LEFT JOIN b ON b.title = r.title""")
def resolved_template_calls(spark, sf_dir):
    bodies, redirects, calls = _inventory_and_calls(spark, sf_dir)
    return P.resolve_calls(calls, bodies, redirects)


@query("saved_templates", f"""
    SELECT doc_id AS id, 10 AS ns, 'Template:' || {_ucfirst_sql('source')} AS title,
           length(text) > 0 AS has_text FROM documents WHERE lang = 'es'""")
def saved_templates(spark, sf_dir):
    pages = P.content_pages(read_dump(spark, land_dump(spark, sf_dir) + "/pages", land=True))
    path = shared_path(spark, "templates")
    write_templates(P.split_templates(pages)[1], path)
    return spark.read.parquet(path).select(
        "id", "ns", "title", (F.length("text") > 0).alias("has_text"))


@query("known_namespace_titles", """
    SELECT doc_id AS id FROM documents WHERE lang IN ('es', 'fr')""")
def known_namespace_titles(spark, sf_dir):
    path = land_dump(spark, sf_dir)
    names = read_site_info(spark, path + "/header")
    return P.known_namespaces(read_dump(spark, path + "/pages"), names).select("id")


@query("extracted_articles", rf"""
    WITH l AS (SELECT doc_id, source, unnest(string_split(t, chr(10))) AS line,
        generate_subscripts(string_split(t, chr(10)), 1) AS pos
        FROM (SELECT *, {S.chain("'} ' || chr(10) || '  == ' || text", (" {2,}", " "),
                                 (r"\.{4,}", "..."), (r"\n[^\p{L}\p{N}_]+?\n", "\n"))} AS t
              FROM documents WHERE lang IN ('en', 'de')))
    SELECT doc_id AS id, 'http://enc.example.org/wiki?curid=' || doc_id AS url,
        source || ' ' || doc_id AS title, coalesce(string_agg(line, chr(10) ORDER BY pos)
        FILTER (pos > 1 AND (NOT starts_with(line, ' ')) AND line <> ''
                AND NOT regexp_matches(line, '^[{{|:*#;]|\}}$|^\(.*\)$|^[.-]*$')), '') AS text
    FROM l GROUP BY ALL""")
def extracted_articles(spark, sf_dir):
    pages = read_dump(spark, land_dump(spark, sf_dir) + "/pages", land=True)
    return extract_articles(pages, "http://enc.example.org/wiki")
