"""Readers and writers: tables are landed in each raw format, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrain.functions.text import escape_markup
from lexigrain.functions.tokens import document_words
from lexigrain.operators.codes import (
    describe_codes,
    hierarchy_closure,
    is_below,
    roll_up,
    tree_intervals,
)
from lexigrain.operators.joins import lookup
from lexigrain.operators.measure import measured_write
from lexigrain.operators.ordering import sort_for_output
from lexigrain.plans import ingest
from lexigrain.plans.ingest import run_feeds, tokenize_documents, tokenize_encyclopedia
from lexigrain.registry import sql as S
from lexigrain.registry.core import documents, pages, query, table
from lexigrain.session import shared_path
from lexigrain.sinks import files as K
from lexigrain.sinks import rolled as R
from lexigrain.sources import lines as L
from lexigrain.sources import tabular as B
from lexigrain.sources import xml as X


def land(df, label, compression="none", column="value"):
    """Write one string column as text lines; the path."""
    path = shared_path(df.sparkSession, label)
    df.select(F.col(column).alias("value")).write.option("compression", compression).text(path)
    return path


_ONE_LINE = r"regexp_replace(text, '[\n\t<>]', ' ', 'g')"


def _one_line():
    return F.regexp_replace("text", r"[\n\t<>]", " ")


def _news_lines(spark, sf_dir):
    record = F.to_json(F.struct(
        F.concat(F.lit("n"), "doc_id").alias("id"), F.col("lang").alias("media-type"), "source",
        F.lit("2015-09-01T00:00:00Z").alias("published"), F.col("text").alias("content")))
    # a German record is followed by a line that is no object and one that is broken
    noise = F.when(F.col("lang") == "de", F.array(
        F.lit("[1, 2]"), F.lit(""), F.lit('{"id": broken}'))).otherwise(
        F.array().cast("array<string>"))
    return documents(spark, sf_dir).select(
        F.explode(F.concat(F.array(record), noise)).alias("value"))


@query("news_json", """
    SELECT 'n' || doc_id AS id, 'signal' AS dataset, lang AS cat, source, '' AS url,
           '2015-09-01T00:00:00Z' AS published, text AS content FROM documents""")
def news_json(spark, sf_dir):
    return L.parse_news_json(L.read_lines(spark, land(_news_lines(spark, sf_dir), "news")))


@query("news_json_rejects", """
    SELECT reason, record, count(*) AS n_lines FROM documents, (VALUES ('no object', '[1, 2]'),
        ('no object', ''), ('no known field', '{"id": broken}')) t(reason, record)
    WHERE lang = 'de' GROUP BY ALL""")
def news_json_rejects(spark, sf_dir):
    lines = L.read_lines(spark, land(_news_lines(spark, sf_dir), "news"))
    return L.reject_news_json(lines).groupBy("reason", "record").agg(
        F.count("*").alias("n_lines"))


@query("tagged_records", f"""
    SELECT 't' || doc_id AS id, 'ag' AS dataset, lang AS cat, source, 'http://x.org/' || doc_id
           AS url, '2016-01-01' AS published, source || ' ' || {_ONE_LINE} AS content
    FROM documents WHERE lang <> 'de'""")
def tagged_records(spark, sf_dir):
    return L.parse_tagged(_tagged_lines(spark, sf_dir))


@query("tagged_rejects", f"""
    SELECT 'fewer than 9 fields' AS reason, '<a> ' || array_to_string(['t' || doc_id, source,
        'http://x.org/' || doc_id, source, '', lang, {_ONE_LINE}, '5'], '</a><b>')
        || '</a></doc>' AS record FROM documents WHERE lang = 'de'""")
def tagged_rejects(spark, sf_dir):
    return L.reject_tagged(_tagged_lines(spark, sf_dir))


def _tagged_lines(spark, sf_dir):
    fields = (F.concat(F.lit("t"), "doc_id"), F.col("source"),
              F.concat(F.lit("http://x.org/"), "doc_id"), F.col("source"), F.lit(""),
              F.col("lang"), _one_line(), F.lit("5"), F.lit("2016-01-01"))
    whole = F.concat(F.lit("<a> "), F.concat_ws("</a><b>", *fields), F.lit("</a></doc>"))
    torn = F.concat(F.lit("<a> "), F.concat_ws("</a><b>", *fields[:8]), F.lit("</a></doc>"))
    # German records lack the last field
    docs = documents(spark, sf_dir).select(
        F.when(F.col("lang") == "de", torn).otherwise(whole).alias("value"))
    return L.read_lines(spark, land(docs, "tagged"))


@query("crawl_articles", rf"""
    SELECT 'http://x.org/' || doc_id AS id, 'crawl' AS dataset, '' AS cat, source,
           'http://x.org/' || doc_id AS url,
           strftime(make_timestamp((1476523800 + doc_id) * 1000000), '%Y-%m-%d %H:%M:%S')
           AS published, {_ONE_LINE} AS content FROM documents WHERE lang <> 'es'""")
def crawl_articles(spark, sf_dir):
    return L.parse_crawl(_crawl_lines(spark, sf_dir))


@query("crawl_rejects", """
    SELECT 'fewer than 7 fields' AS reason, '1476523800.0' || chr(9) || source || chr(9)
        || 'http://f' AS record FROM documents WHERE lang = 'es'""")
def crawl_rejects(spark, sf_dir):
    return L.reject_crawl(_crawl_lines(spark, sf_dir))


@query("crawl_round_trip", r"""
    SELECT 'http://x.org/' || doc_id AS id, 'crawl' AS dataset, '' AS cat,
           ' "' || source || '" ' AS source, 'http://x.org/' || doc_id AS url,
           strftime(make_timestamp((1476523800 + doc_id) * 1000000), '%Y-%m-%d %H:%M:%S')
           AS published, CASE WHEN lang = 'de' THEN '' ELSE ' "' ||
           regexp_replace(text, '[\n\t\r]', ' ', 'g') || '" ' END AS content FROM documents""")
def crawl_round_trip(spark, sf_dir):
    """Articles appended to a log and read back, with quotes, blanks and empty fields."""
    link = F.concat(F.lit("http://x.org/"), "doc_id")
    content = F.when(F.col("lang") == "de", "").otherwise(
        F.concat(F.lit(' "'), "text", F.lit('" ')))
    rows = documents(spark, sf_dir).select(
        F.lit("1476523800.0"), F.concat(F.lit(' "'), "source", F.lit('" ')), F.lit("http://f"),
        F.lit("a"), link, F.col("doc_id") + 1476523800, content).toDF(*"abcdefg")
    path = shared_path(spark, "crawl-log")
    K.append_tsv(rows, path)
    return L.parse_crawl(L.read_lines(spark, path))


def _crawl_lines(spark, sf_dir):
    # commas become tabs, so the text itself spans fields; Spanish rows are cut short
    text = F.replace(_one_line(), F.lit(" "), F.lit("\t"))
    link = F.concat(F.lit("http://x.org/"), "doc_id")
    row = F.concat_ws("\t", F.lit("1476523800.0"), "source", F.lit("http://f"), F.lit("a"), link,
                      (F.col("doc_id") + 1476523800).cast("string"), text)
    cut = F.concat_ws("\t", F.lit("1476523800.0"), "source", F.lit("http://f"))
    docs = documents(spark, sf_dir).select(
        F.when(F.col("lang") == "es", cut).otherwise(row).alias("value"))
    return L.read_lines(spark, land(docs, "crawl"))


@query("common_document_table", f"""
    WITH u AS (SELECT 'n' || doc_id AS id, 'signal' AS dataset,
        make_timestamp(1441065600000000) AS published, text AS content FROM documents
        UNION ALL SELECT 'http://x.org/' || doc_id, 'crawl',
        make_timestamp((1476523800 + doc_id) * 1000000), {_ONE_LINE} FROM documents
        WHERE lang <> 'es')
    SELECT id, dataset, strftime(published, '%Y-%m-%d %H:%M:%S') AS published,
           array_to_string({S.words('content')}, ' ') AS words FROM u""")
def common_document_table(spark, sf_dir):
    union = news_json(spark, sf_dir).unionByName(crawl_articles(spark, sf_dir))
    docs = tokenize_documents(union)
    return docs.select("id", "dataset", F.date_format("published", "yyyy-MM-dd HH:mm:ss")
                       .alias("published"), F.array_join("words", " ").alias("words"))


def _news_items(spark, sf_dir):
    """XML items over several lines. German ones are malformed; before Spanish ones stands an
    unclosed one, before French ones one whose opening tag is torn. French texts are CDATA
    with an item in it, and after English items stands one inside a comment."""
    tagged = "<newsitem><title>no</title></newsitem>"
    text = F.when(F.col("lang") == "fr", F.concat(
        F.lit("<![CDATA["), "text", F.lit(f"<!-- {tagged}]]>"))).otherwise(
        escape_markup(F.col("text")))
    good = F.concat(F.lit('<newsitem itemid="'), "doc_id", F.lit('">\n<title>'), "source",
                    F.lit("</title>\n<text>"), text, F.lit("</text>\n</newsitem>"))
    bad = F.concat(F.lit("<newsitem><title>"), "source", F.lit("</newsitem>"))
    unclosed = F.concat(F.lit("<newsitem><title>"), "source", F.lit("</title>\n<text>lost</text>"))
    torn = F.concat(F.lit("ewsitem><title>"), "source", F.lit("</title></newsitem>"))
    comment = F.concat(F.lit("<!-- <![CDATA[ "), F.lit(tagged), F.lit(tagged), F.lit(" -->"))
    # one file ends with a record that is whole, so that no unclosed one stands last
    end = (F.when(F.col("lang") == "es", F.array(unclosed, good))
           .when(F.col("lang") == "fr", F.array(torn, good))
           .when(F.col("lang") == "de", F.array(bad)).otherwise(F.array(good, comment)))
    return documents(spark, sf_dir).select(F.explode(end).alias("value"))


_NEWS_ITEM = "_itemid long, title string, text string"


def _read_items(spark, path):
    schema = spark.createDataFrame([], _NEWS_ITEM).schema
    return X.read_xml_records(spark, path, "newsitem", schema)


@query("xml_records", """
    SELECT doc_id, source AS title, trim(text, E' \\t\\n\\r') || CASE lang WHEN 'fr' THEN
        '<!-- <newsitem><title>no</title></newsitem>' ELSE '' END AS text
    FROM documents WHERE lang <> 'de'""")
def xml_records(spark, sf_dir):
    records = _read_items(spark, land(_news_items(spark, sf_dir), "newsitems"))
    good = X.good_records(records)
    return good.select(F.col("_itemid").alias("doc_id"), "title", F.regexp_replace(
        "text", r"^[ \t\n\r]+|[ \t\n\r]+$", "").alias("text"))


@query("xml_record_counts", """
    SELECT count(*) FILTER (lang <> 'de') AS good,
           count(*) FILTER (lang IN ('de', 'es', 'fr')) AS corrupt FROM documents""")
def xml_record_counts(spark, sf_dir):
    return X.record_counts(_read_items(spark, land(_news_items(spark, sf_dir), "newsitems")))


@query("xml_rejects", """
    SELECT CASE lang WHEN 'fr' THEN 'no opening tag' ELSE 'malformed record' END AS reason,
        CASE lang WHEN 'de' THEN '<newsitem><title>' || source || '</newsitem>'
        WHEN 'fr' THEN 'ewsitem><title>' || source || '</title></newsitem>'
        ELSE '<newsitem><title>' || source || '</title> <text>lost</text>' END
        AS record, count(*) AS n_records FROM documents WHERE lang IN ('de', 'es', 'fr')
    GROUP BY ALL""")
def xml_rejects(spark, sf_dir):
    bad = X.rejected_records(_read_items(spark, land(_news_items(spark, sf_dir), "newsitems")))
    return bad.groupBy("reason", F.trim(F.regexp_replace("record", r"\s+", " ")).alias(
        "record")).agg(F.count("*").alias("n_records"))


@query("compressed_inputs", """
    SELECT doc_id, source FROM documents WHERE lang <> 'de'
    UNION ALL SELECT doc_id, source FROM documents WHERE lang <> 'de'""")
def compressed_inputs(spark, sf_dir):
    """The same items as gz and bz2 folders, read as one record set."""
    items = _news_items(spark, sf_dir)
    paths = [land(items, f"items-{codec}", codec) for codec in ("gzip", "bzip2")]
    good = X.good_records(_read_items(spark, paths))
    return good.select(F.col("_itemid").alias("doc_id"), F.col("title").alias("source"))


@query("whole_files", """
    SELECT sum(length(html))::BIGINT AS n_chars, count(*) AS n_lines FROM pages""")
def whole_files(spark, sf_dir):
    one_line = table(spark, sf_dir, "pages").select(
        F.translate("html", "\n\r", "  ").alias("html"))
    path = land(one_line, "html", column="html")
    files = L.read_lines(spark, path, whole=True)
    text = files.select(F.explode(F.split(F.rtrim("value", F.lit("\n")), "\n")).alias("line"))
    return text.agg(F.sum(F.length("line")).alias("n_chars"), F.count("*").alias("n_lines"))


@query("doc_records", rf"""
    SELECT 'http://enc/wiki?curid=' || doc_id AS url, doc_id::VARCHAR AS id, source AS title,
           1::BIGINT AS n_links, '[{{"href":"/' || lang || '","text":"' || lang || '"}}]' AS links,
           source || '  ' || trim(regexp_replace({_ONE_LINE},
           '[^\x00-\x7F\t]+', ' ', 'g')) || ' see ' || lang AS text FROM documents""")
def doc_records(spark, sf_dir):
    """``<doc>`` records written, read back and parsed."""
    docs = L.read_doc_records(spark, _land_docs(spark, sf_dir))
    return docs.select("url", "id", "title", F.size("links").cast("long").alias("n_links"),
                       F.to_json("links").alias("links"), "text")


@query("doc_record_rejects", """
    SELECT 'no opening tag' AS reason, count(*) AS n_records FROM documents WHERE lang = 'de'""")
def doc_record_rejects(spark, sf_dir):
    return L.read_doc_rejects(spark, _land_docs(spark, sf_dir)).groupBy("reason").agg(
        F.count("*").alias("n_records"))


def _land_docs(spark, sf_dir):
    """Records with a link each; after a German one stands a body without its tag."""
    body = F.concat(F.trim(F.regexp_replace(_one_line(), r"[^\x00-\x7F\t]+", " ")),
                    F.lit(' see <a href="/'), "lang", F.lit('">'), "lang", F.lit("</a>"))
    url = F.concat(F.lit("http://enc/wiki?curid="), F.col("doc_id").cast("string"))
    record = K.doc_record(F.col("doc_id"), url, F.col("source"), body)
    torn = F.when(F.col("lang") == "de", F.concat(
        record, F.lit("torn\n</doc>\n"))).otherwise(record)
    path = shared_path(spark, "docs")
    K.write_doc_records(documents(spark, sf_dir).select(torn.alias("record")), path)
    return path


@query("doc_record_text", """
    SELECT doc_id, '<doc id="' || doc_id || '" url="http://enc?curid=' || doc_id || '" title="'
        || source || '">' || chr(10) || source || chr(10) || chr(10) || text || chr(10) || chr(10)
        || '</doc>' || chr(10) AS record FROM documents""")
def doc_record_text(spark, sf_dir):
    url = F.concat(F.lit("http://enc?curid="), F.col("doc_id").cast("string"))
    return documents(spark, sf_dir).select("doc_id", K.doc_record(
        F.col("doc_id"), url, F.col("source"), F.col("text")).alias("record"))


@query("encyclopedia_token_rows", f"""
    SELECT doc_id::VARCHAR AS id, source AS title, array_to_string(
        {S.words(_ONE_LINE, tags=False, lower_first=False)}, ' ') AS words
    FROM documents WHERE lang <> 'fr'""")
def encyclopedia_token_rows(spark, sf_dir):
    rows = L.parse_wiki_rows(_wiki_lines(spark, sf_dir))
    return tokenize_encyclopedia(rows).select(
        "id", "title", F.array_join("words", " ").alias("words"))


@query("encyclopedia_row_rejects", """
    SELECT 'more than 5 fields' AS reason, count(*) AS n_lines FROM documents WHERE lang = 'fr'""")
def encyclopedia_row_rejects(spark, sf_dir):
    return L.reject_wiki_rows(_wiki_lines(spark, sf_dir)).groupBy("reason").agg(
        F.count("*").alias("n_lines"))


def _wiki_lines(spark, sf_dir):
    row = F.concat_ws("\t", F.lit("u"), F.col("doc_id").cast("string"), "source", F.lit("set()"),
                      _one_line())
    # French rows have one field too many
    docs = documents(spark, sf_dir).select(F.when(
        F.col("lang") == "fr", F.concat(row, F.lit("\tx"))).otherwise(row).alias("value"))
    return L.read_lines(spark, land(docs, "wiki-rows"))


@query("feed_catalogue", """
    SELECT event_type AS feed_name, 'http://f/' || user_id AS feed_link, count(*) AS listed
    FROM events GROUP BY ALL""")
def feed_catalogue(spark, sf_dir):
    """One line per event, some links with a stray quote; duplicates are kept."""
    link = F.concat(F.lit("http://f/"), "user_id", F.when(
        F.col("event_type") == "view", "'").otherwise(""))
    lines = table(spark, sf_dir, "events").select(
        F.concat_ws(",", "event_type", link).alias("value"))
    feeds = B.read_feed_catalogue(spark, land(lines, "feeds"))
    return feeds.groupBy("feed_name", "feed_link").agg(F.count("*").alias("listed"))


@query("feed_catalogue_distinct", """
    SELECT DISTINCT event_type AS feed_name, 'http://f/' || user_id AS feed_link FROM events""")
def feed_catalogue_distinct(spark, sf_dir):
    lines = table(spark, sf_dir, "events").select(F.concat_ws(
        ",", "event_type", F.concat(F.lit("http://f/"), "user_id", F.lit("'"))).alias("value"))
    return B.read_feed_catalogue(spark, land(lines, "feeds"), dedupe=True)


@query("run_log", """
    SELECT event_id AS run_id, event_type AS feed_name, value AS feed_time,
           user_id AS article_count, 0.5::DOUBLE AS article_avg FROM events""")
def run_log(spark, sf_dir):
    path = shared_path(spark, "run-log")
    K.append_tsv(table(spark, sf_dir, "events").select(
        "event_id", "event_type", "value", "user_id", F.lit(0.5)), path)
    return B.read_run_log(spark, path).withColumn(
        "article_count", F.col("article_count").cast("long"))


@query("error_log", """
    SELECT event_type = 'click' AS torn, count(*) AS n_rows FROM events GROUP BY 1""")
def error_log(spark, sf_dir):
    row = F.concat_ws("\t", "event_type", "event_id", F.lit("http://x"), F.lit("<type 'E'>"))
    lines = table(spark, sf_dir, "events").select(F.when(
        F.col("event_type") == "click", F.concat(row, F.lit("\tmore"))).otherwise(row)
        .alias("value"))
    log = B.read_error_log(spark, land(lines, "errors"))
    torn = log.select("feed_name", F.col("_corrupt_record").isNotNull().alias("torn"))
    return torn.groupBy("torn").agg(F.count("*").alias("n_rows"))


@query("code_dictionary", """
    SELECT 'C' || c_custkey AS code, upper(c_name) AS description FROM customer
    WHERE c_mktsegment <> 'BUILDING'""")
def code_dictionary(spark, sf_dir):
    """Comment and blank lines, a trailing tab and CRLF line ends."""
    code = F.concat(F.lit("C"), "c_custkey", F.lit("\t"), F.upper("c_name"), F.lit("\t\r"))
    lines = table(spark, sf_dir, "customer").select(F.when(
        F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("; "), "c_name"))
        .otherwise(code).alias("value")).unionByName(
        table(spark, sf_dir, "region").select(F.lit("").alias("value")))
    return B.read_code_dictionary(spark, land(lines, "codes"))


def _tree_lines(spark, sf_dir):
    """Customers below nations below regions below Root."""
    edge = lambda p, c, d: F.concat(
        F.lit("parent: "), p, F.lit("    child: "), c, F.lit("   child-description: "), d)
    regions = table(spark, sf_dir, "region").select(edge(
        F.lit("Root"), F.concat(F.lit("R"), "r_regionkey"), F.col("r_name")).alias("value"))
    root = spark.range(1).select(edge(
        F.lit("None"), F.lit("Root"), F.lit("No Description")).alias("value"))
    nations = table(spark, sf_dir, "nation").select(edge(
        F.concat(F.lit("R"), "n_regionkey"), F.concat(F.lit("N"), "n_nationkey"),
        F.col("n_name")).alias("value"))
    customers = table(spark, sf_dir, "customer").select(edge(
        F.concat(F.lit("N"), "c_nationkey"), F.concat(F.lit("C"), "c_custkey"),
        F.col("c_name")).alias("value"))
    return root.unionByName(regions).unionByName(nations).unionByName(customers)


_EDGES = """x AS (SELECT 'None' AS parent, 'Root' AS child, 'No Description' AS description
    UNION ALL SELECT 'Root', 'R' || r_regionkey, r_name FROM region
    UNION ALL SELECT 'R' || n_regionkey, 'N' || n_nationkey, n_name FROM nation
    UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey, c_name FROM customer)"""


@query("hierarchy_edges", f"WITH {_EDGES} SELECT parent, child, description FROM x")
def hierarchy_edges(spark, sf_dir):
    return B.read_hierarchy(spark, land(_tree_lines(spark, sf_dir), "tree"))


@query("wide_hierarchy_edges", """
    SELECT 'R' || n_regionkey AS parent, 'r' AS parent_short, 'N' || n_nationkey AS child,
           'n' || n_nationkey AS child_short, n_name || ', THE' AS description FROM nation""")
def wide_hierarchy_edges(spark, sf_dir):
    lines = table(spark, sf_dir, "nation").select(F.concat(
        F.lit("pp: R"), "n_regionkey", F.lit("   pu: r   cp: N"), "n_nationkey",
        F.lit("   cu: n"), "n_nationkey", F.lit("    cd: "), "n_name", F.lit(", THE"))
        .alias("value"))
    return B.read_wide_hierarchy(spark, land(lines, "tree-wide"))


@query("hierarchy_closure", f"""
    WITH RECURSIVE {_EDGES},
    c AS (SELECT parent AS ancestor, child AS descendant, 1 AS distance FROM x
          WHERE parent <> 'None'
          UNION ALL SELECT x.parent, c.descendant, c.distance + 1 FROM c
          JOIN x ON x.child = c.ancestor WHERE x.parent <> 'None')
    SELECT ancestor, descendant, distance::BIGINT AS distance FROM c""")
def closure_of_hierarchy(spark, sf_dir):
    edges = B.read_hierarchy(spark, land(_tree_lines(spark, sf_dir), "tree"))
    return hierarchy_closure(edges).withColumn("distance", F.col("distance").cast("long"))


_PATHS = """c AS (SELECT child AS ancestor, child AS descendant, 0 AS distance FROM x
          UNION ALL SELECT x.parent, c.descendant, c.distance + 1 FROM c
          JOIN x ON x.child = c.ancestor WHERE x.parent <> 'None')"""


@query("tree_intervals", f"""
    WITH RECURSIVE {_EDGES}, {_PATHS},
    d AS (SELECT descendant AS code, max(distance) AS depth FROM c GROUP BY ALL),
    s AS (SELECT ancestor AS code, count(*) - 1 AS n FROM c GROUP BY ALL)
    SELECT code, depth::BIGINT AS depth, n AS n_descendants, code <> 'Root' AS inside
    FROM d JOIN s USING (code)""")
def intervals_of_tree(spark, sf_dir):
    """Every interval holds as many places as descendants and lies in that of the parent."""
    places = tree_intervals(B.read_hierarchy(spark, land(_tree_lines(spark, sf_dir), "tree")))
    upper = places.select(F.col("code").alias("parent"), F.col("first").alias("_first"),
                          F.col("last").alias("_last"))
    inside = is_below(F.col("first"), F.col("_first"), F.col("_last")) & (
        F.col("last") <= F.col("_last"))
    return lookup(places, upper, ["parent"], ["code"]).select(
        "code", "depth", (F.col("last") - F.col("first")).alias("n_descendants"),
        F.coalesce(inside, F.lit(False)).alias("inside"))


@query("tree_roll_up", f"""
    WITH RECURSIVE {_EDGES}, {_PATHS},
    o AS (SELECT 'C' || o_custkey AS code, count(*) AS n FROM orders GROUP BY ALL)
    SELECT ancestor AS code, coalesce(sum(n) FILTER (distance = 0), 0)::BIGINT AS n,
        coalesce(sum(n) FILTER (distance > 0), 0)::BIGINT AS n_below
    FROM c LEFT JOIN o ON o.code = descendant GROUP BY ancestor""")
def rolled_up_tree(spark, sf_dir):
    """Orders of each customer, and of all customers below a nation, a region and the root."""
    edges = B.read_hierarchy(spark, land(_tree_lines(spark, sf_dir), "tree"))
    orders = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("C"), "o_custkey").alias("customer"))
    return roll_up(orders, tree_intervals(edges), "customer")


@query("described_tree_codes", f"""
    WITH {_EDGES} SELECT o_orderkey, description FROM orders
    LEFT JOIN x ON child = 'C' || o_custkey""")
def described_tree_codes(spark, sf_dir):
    edges = B.read_hierarchy(spark, land(_tree_lines(spark, sf_dir), "tree"))
    codes = edges.select(F.col("child").alias("code"), "description")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.lit("C"), "o_custkey").alias("code"))
    return describe_codes(orders, codes, "code").select("o_orderkey", "description")


@query("parquet_round_trip", "SELECT doc_id, lang, text FROM documents")
def parquet_round_trip(spark, sf_dir):
    path = shared_path(spark, "documents")
    K.write_parquet(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), path,
                    partition_by=["lang"])
    return spark.read.schema("doc_id long, text string, lang string").parquet(path)


@query("saved_results", "SELECT c_custkey, c_name FROM customer")
def saved_results(spark, sf_dir):
    path = shared_path(spark, "saved")
    table(spark, sf_dir, "customer").select("c_custkey", "c_name").write.save(path)
    return B.read_saved(spark, path)


@query("report_file", """
    SELECT source, count(*) AS n_docs, 1::BIGINT AS n_files FROM documents GROUP BY source""")
def report_file(spark, sf_dir):
    path = shared_path(spark, "report")
    K.write_report(table(spark, sf_dir, "documents").groupBy("source").agg(
        F.count("*").alias("n_docs")), path)
    rows = spark.read.schema("source string, n_docs long").csv(path, sep="\t")
    files = rows.select(F.input_file_name()).distinct().agg(F.count("*")).scalar()
    return rows.withColumn("n_files", files)


@query("rolled_files", """
    SELECT doc_id, lang, replace(replace(replace(text, chr(9), ' '), chr(10), ' '), chr(13), ' ')
        AS text, true AS within_bound, true AS filled, true AS dense FROM documents""")
def rolled_files(spark, sf_dir):
    """Two runs append to one log, the first one twice; only the last file of a run was not
    full, and the second run went on in a new version of it."""
    folder, docs = shared_path(spark, "rolled-log"), documents(spark, sf_dir)
    runs = [docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")]
    bound = 8 * docs.agg(F.max(F.octet_length("text"))).head()[0]
    for number in (1, 1, 2):
        R.append_rolled(runs[number - 1].select("doc_id", "lang", "text"), folder, bound, number)
    runs = spark.read.schema(R.MANIFEST).parquet(f"{folder}/manifest")
    state = runs.agg(
        (F.max("bytes") <= bound).alias("within_bound"),
        (F.count_distinct(F.when(F.col("bytes") < bound * 6 / 8, F.col("name"))) <= 2).alias("filled"),
        (F.count_distinct("number") == F.max("number") + 1).alias("dense"))
    field = F.split("value", "\t", 3)
    lines = R.read_rolled(spark, folder).select(
        field[0].cast("long").alias("doc_id"), field[1].alias("lang"), field[2].alias("text"))
    return lines.join(F.broadcast(state))


@query("size_bounded_files", """
    WITH s AS (SELECT doc_id, strlen(doc_id || ' ' || regexp_replace(text, '[\\n\\t\\r]', ' ', 'g'))
        + 1 AS b FROM documents)
    SELECT count(*) AS n_rows, sum(doc_id)::BIGINT AS key_sum, sum(b)::BIGINT AS n_bytes,
        max(b) FILTER (b > 60000) AS above_bound, true AS within_bound FROM s""")
def size_bounded_files(spark, sf_dir):
    """Files of at most 60,000 bytes; only a row that is larger alone exceeds this."""
    path = shared_path(spark, "bounded")
    K.write_bounded(documents(spark, sf_dir).select("doc_id", "text"), path, max_bytes=60_000)
    lines = spark.read.text(path).select(
        F.input_file_name().alias("file"), (F.octet_length("value") + 1).cast("long").alias("b"),
        F.split("value", "\t")[0].cast("long").alias("doc_id"))
    files = lines.groupBy("file").agg(F.count("*").alias("n"), F.sum("doc_id").alias("k"),
                                      F.sum("b").alias("b"))
    large = F.col("b") > 60_000
    return files.agg(
        F.sum("n").alias("n_rows"), F.sum("k").alias("key_sum"), F.sum("b").alias("n_bytes"),
        F.max(F.when(large, F.col("b"))).alias("above_bound"),
        F.bool_and(~large | (F.col("n") == 1)).alias("within_bound"))


@query("ordered_output", "SELECT doc_id, n_chars FROM documents")
def ordered_output(spark, sf_dir):
    path = shared_path(spark, "ordered")
    K.write_parquet(sort_for_output(
        table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id"), path)
    return spark.read.parquet(path)


# events as feed items: a click has no id, a view no date
_ITEM_DATE = "strftime(ts, '%Y-%m-%d %H:%M:%S')"


@query("feed_items", f"""
    SELECT CASE WHEN event_type <> 'click' THEN 'e' || event_id END AS entry_id,
           'http://x.org/' || event_id AS link,
           CASE event_type WHEN 'view' THEN 't</item><item>' ELSE 't' END AS title,
           CASE WHEN event_type <> 'view' THEN {_ITEM_DATE} END AS published FROM events""")
def feed_items(spark, sf_dir):
    return X.read_feed_entries(spark, _land_items(spark, sf_dir)).select(
        "entry_id", "link", "title", F.date_format("published", "yyyy-MM-dd HH:mm:ss").alias("published"))


@query("feed_item_rejects", """
    SELECT CASE event_type WHEN 'click' THEN 'malformed record' ELSE 'no opening tag' END AS reason,
        count(*) AS n_records FROM events WHERE event_type IN ('click', 'view') GROUP BY 1""")
def feed_item_rejects(spark, sf_dir):
    return X.read_feed_rejects(spark, _land_items(spark, sf_dir)).groupBy("reason").agg(
        F.count("*").alias("n_records"))


def _land_items(spark, sf_dir):
    """One item per event. An unclosed one stands before that of a click, one with a torn
    opening before that of a view, whose title is CDATA that closes an item; after the
    others stands an item inside a comment."""
    guid = F.when(F.col("event_type") != "click", F.concat(
        F.lit("<guid>e"), "event_id", F.lit("</guid>"))).otherwise("")
    date = F.when(F.col("event_type") != "view", F.concat(
        F.lit("<pubDate>"), F.date_format("ts", "E, dd MMM yyyy HH:mm:ss"),
        F.lit(" GMT</pubDate>"))).otherwise("")
    before = (F.when(F.col("event_type") == "click", "<item><title>u</title>")
              .when(F.col("event_type") == "view", "item><title>u</title></item>").otherwise(""))
    title = F.when(F.col("event_type") == "view", "<![CDATA[t</item><item>]]>").otherwise("t")
    after = F.when(F.col("event_type").isin("click", "view"), "").otherwise(
        "<!-- <item><title>u</title></item> -->")
    items = table(spark, sf_dir, "events").select(F.concat(
        before, F.lit("<item>"), guid, F.lit("<link>http://x.org/"), "event_id",
        F.lit("</link><title>"), title, F.lit("</title>"), date, F.lit("</item>"), after).alias(
        "value"))
    return land(items, "items")


@query("feed_run_articles", f"""
    WITH p AS (SELECT page_id, url, {S.visible('html', ('head', 'header', 'title', 'footer', 'a'))}
               AS v FROM pages),
    w AS (SELECT page_id, url, array_to_string({S.words('v')}, ' ') AS words FROM p)
    SELECT 1704068100::BIGINT AS run_id, 'feed' AS feed_name, 'a' || page_id AS article_id,
           url AS article_link, words AS text FROM w WHERE words <> ''""")
def feed_run_articles(spark, sf_dir):
    articles, _ = _feed_run(spark, sf_dir)
    return articles.select("run_id", "feed_name", "article_id", "article_link", "text")


@query("feed_run_log", f"""
    WITH p AS (SELECT {S.visible('html', ('head', 'header', 'title', 'footer', 'a'))} AS v
               FROM pages),
    w AS (SELECT array_to_string({S.words('v')}, ' ') AS words FROM p)
    SELECT 1704068100::BIGINT AS run_id, 'feed' AS feed_name, count(*) AS article_count,
           300.0::DOUBLE AS article_avg, count(*) FILTER (words = '') AS failed_count FROM w
    UNION ALL SELECT 1704068100, 'silent', 0, 0.0, 0""")
def feed_run_log(spark, sf_dir):
    feeds = spark.createDataFrame([("feed",), ("silent",)], "feed_name string")
    return ingest.feed_run_log(*_feed_run(spark, sf_dir), feeds, 1704068100)


def _feed_run(spark, sf_dir):
    landed = pages(spark, sf_dir).select("page_id", "url", "html")
    entries = landed.select(
        F.lit("feed").alias("feed_name"), F.lit("http://feed").alias("feed_link"),
        F.concat(F.lit("a"), "page_id").alias("article_id"),
        F.col("url").alias("article_link"),
        F.lit("2024-01-01 00:10:00").cast("timestamp").alias("published"))
    return run_feeds(entries, landed, 1704068100)


@query("throughput_report", """
    SELECT 'tokenize' AS job, count(*) AS rows, true AS timed FROM documents""")
def throughput_report(spark, sf_dir):
    words = documents(spark, sf_dir).select(
        "doc_id", document_words(F.col("text")).alias("words"))
    report = measured_write(words, shared_path(spark, "measured"), "tokenize")
    return report.select("job", "rows", ((F.col("seconds") > 0) & (F.abs(
        F.col("rows_per_second") * F.col("seconds") - F.col("rows")) < 0.01)).alias("timed"))
