import datetime as dt

import pytest
from pyspark.sql import functions as F

from lexigrain.operators import pages as P
from lexigrain.operators.codes import describe_codes, hierarchy_closure
from lexigrain.operators.rows import route_rows
from lexigrain.plans.ingest import (extract_articles, run_feeds, tokenize_documents,
                                    tokenize_encyclopedia, union_sources)
from lexigrain.sources import lines as L
from lexigrain.sources import tabular as B
from lexigrain.sources import xml as X


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_news(spark, fixtures):
    parsed = L.parse_news_json(L.read_lines(spark, f"{fixtures}/news.jsonl"))
    good, bad = route_rows(parsed, {"no content": F.col("content").isNull()})
    assert sorted(r["id"] for r in good.collect()) == ["a1", "true"]
    assert bad.count() == 1
    assert good.filter("id = 'a1'").head()["dataset"] == "signal"


def test_every_line_is_parsed_or_rejected(spark, fixtures):
    lines = L.read_lines(spark, f"{fixtures}/news.jsonl")
    assert sorted((r.record, r.reason) for r in L.reject_news_json(lines).collect()) == [
        ("", "no object"), ("plain words", "no object"),
        ('{"id": "a3", "media-type": "News"', "no object"), ("{broken}", "no known field")]
    for good, bad, least in ((L.parse_tagged, L.reject_tagged, 9), (L.parse_crawl, L.reject_crawl, 7),
                             (L.parse_wiki_rows, L.reject_wiki_rows, 5)):
        assert good(lines).count() + bad(lines).count() == lines.count()
        assert {r.reason for r in bad(lines).collect()} <= {
            f"fewer than {least} fields", f"more than {least} fields"}


def test_unclosed_records_spoil_only_themselves(spark, tmp_path):
    text = ("<r><i n='1'><t>a</t></i><i n='2'><t>lost</t><i n='3'><t>b</t></i>"
            "<i n='4'><t><![CDATA[x</i>y]]></t></i> <i n='5'><t>c</t></i></r>")
    (tmp_path / "a.xml").write_text(text)
    schema = spark.createDataFrame([], "_n long, t string").schema
    records = X.read_xml_records(spark, str(tmp_path), "i", schema)
    assert sorted(tuple(r) for r in X.good_records(records).collect()) == [
        (1, "a"), (3, "b"), (4, "x</i>y"), (5, "c")]
    bad = [r.record for r in X.rejected_records(records).collect()]
    assert len(bad) == 1 and "lost" in bad[0]


def test_deep_and_cyclic_hierarchies(spark):
    deep = spark.range(150).selectExpr(
        "IF(id = 0, 'None', string(id - 1)) AS parent", "string(id) AS child")
    found = hierarchy_closure(deep)
    assert found.count() == 150 * 149 // 2
    assert found.filter("ancestor = '0' AND descendant = '149'").head().distance == 149
    cycle = spark.createDataFrame([("None", "r"), ("r", "x"), ("c", "a"), ("a", "b"), ("b", "c")],
                                  "parent string, child string")
    with pytest.raises(ValueError, match="cycle"):
        hierarchy_closure(cycle)


def test_a_code_with_two_descriptions(spark):
    codes = spark.createDataFrame([("a", "y"), ("a", "x")], "code string, description string")
    rows_ = spark.createDataFrame([("a",), ("b",)], "code string")
    assert sorted((r.code, r.description) for r in describe_codes(rows_, codes, "code").collect()) == [
        ("a", "x"), ("b", None)]


def test_crawl_log_round_trip(spark, tmp_path):
    from lexigrain.sinks.files import append_tsv

    values = [("1.0", ' "s" ', "f", "a", f"http://x/{i}", "1476523800", t)
              for i, t in enumerate(["", ' f "q" ', "plain", "a\tb\nc", None])]
    append_tsv(spark.createDataFrame(values, ", ".join(f"c{i} string" for i in range(7))),
               str(tmp_path / "log"))
    got = {r.url[-1]: (r.source, r.content) for r in L.parse_crawl(
        L.read_lines(spark, str(tmp_path / "log"))).collect()}
    assert got == {"0": (' "s" ', ""), "1": (' "s" ', ' f "q" '), "2": (' "s" ', "plain"),
                   "3": (' "s" ', "a b c"), "4": (' "s" ', "")}


def test_tagged(spark, fixtures):
    got = rows(L.parse_tagged(L.read_lines(spark, f"{fixtures}/tagged.txt")))
    assert got == [
        ("1", "ag", "World", "Wire", "http://w/1", "2004-08-01", "Storm nears Heavy rain is due"),
        ("2", "ag", "Local", "Wire", "http://w/2", "2004-08-02", "Quiet day ")]


def test_crawl(spark, fixtures):
    got = rows(L.parse_crawl(L.read_lines(spark, f"{fixtures}/crawl.tsv"), "mine"))
    assert [r[0] for r in got] == ["http://d/1", "http://d/2"]
    assert got[1] == ("http://d/2", "mine", "", "Daily", "http://d/2", "2016-10-15 09:28:21",
                      "split by tab")


def test_union_reaches_the_common_table(spark, fixtures):
    union = union_sources(
        L.parse_news_json(L.read_lines(spark, f"{fixtures}/news.jsonl")),
        L.parse_tagged(L.read_lines(spark, f"{fixtures}/tagged.txt")),
        L.parse_crawl(L.read_lines(spark, f"{fixtures}/crawl.tsv")))
    docs = tokenize_documents(union)
    assert docs.columns == ["id", "dataset", "cat", "source", "url", "published", "words"]
    assert docs.filter("id = 'a1'").head()["words"] == ["rain", "wind", "today"]


def test_logs_and_catalogue(spark, fixtures):
    assert B.read_feed_catalogue(spark, f"{fixtures}/feeds.csv").count() == 3
    assert sorted(rows(B.read_feed_catalogue(spark, f"{fixtures}/feeds.csv", dedupe=True))) == [
        ("Daily", "http://d/rss"), ("Hill", "http://h/rss")]
    assert B.read_run_log(spark, f"{fixtures}/runlog.tsv").agg(
        F.sum("article_count"), F.sum("feed_time")).head() == (4, 24.0)
    log = B.read_error_log(spark, f"{fixtures}/errorlog.tsv")
    assert log.filter("_corrupt_record is null").count() == 1
    assert sorted(r["article_id"] for r in log.filter("_corrupt_record is not null").collect()) == [
        "g2", "g3"]


def test_codes_and_trees(spark, fixtures):
    codes = B.read_code_dictionary(spark, f"{fixtures}/codes.txt")
    assert sorted(rows(codes), key=str) == [
        ("AAA", "ALPHA LAND"), ("BBB", "BETA; LAND"), ("CCC", None)]
    used = spark.createDataFrame([("AAA",), ("ZZZ",)], "region string")
    assert sorted(rows(describe_codes(used, codes, "region")), key=str) == [
        ("AAA", "ALPHA LAND"), ("ZZZ", None)]
    tree = B.read_hierarchy(spark, f"{fixtures}/tree.txt")
    assert ("A1", "A11", "ALPHA ONE ONE") in rows(tree)
    assert sorted(rows(hierarchy_closure(tree))) == [
        ("A", "A1", 1), ("A", "A11", 2), ("A1", "A11", 1),
        ("Root", "A", 1), ("Root", "A1", 2), ("Root", "A11", 3)]
    assert rows(B.read_wide_hierarchy(spark, f"{fixtures}/tree_wide.txt"))[1] == (
        "Root", "Root", "I0", "I0", "FARMS, FORESTS AND FISH")


def test_xml_records(spark, fixtures):
    schema = spark.createDataFrame([], "_itemid long, title string, text string").schema
    records = X.read_xml_records(spark, [f"{fixtures}/news_items.xml"], "newsitem", schema)
    assert rows(X.record_counts(records)) == [(2, 1)]
    assert sorted(rows(X.good_records(records))) == [
        (1, "One", "\nseveral\nlines"), (3, "Three & more", "t")]


def test_dump(spark, fixtures):
    pages = X.read_dump(spark, f"{fixtures}/dump.xml")
    assert pages.count() == 8
    kept = P.content_pages(pages)
    assert sorted(r["id"] for r in kept.collect()) == [1, 3, 4, 6, 7]
    assert kept.filter("id = 1").head()["text"].startswith("A '''river'''")
    assert kept.filter("id = 7").select("ns", "text").head() == (0, "")
    info = rows(X.read_site_info(spark, f"{fixtures}/dump.xml"))
    assert sorted(info) == [("http://enc.example.org/wiki", 0, ""),
                            ("http://enc.example.org/wiki", 10, "Template"),
                            ("http://enc.example.org/wiki", 828, "Module")]


def test_templates(spark, fixtures):
    pages = X.read_dump(spark, f"{fixtures}/dump.xml")
    bodies, redirects = P.template_inventory(pages)
    assert sorted(rows(bodies)) == [("Module:Math", "return {}"), ("Template:Convert", "{{{1}}} km"),
                                    ("Template:Only", "bd")]
    assert rows(redirects) == [("Template:Nested", "Template:Only")]
    calls = P.template_calls(P.split_templates(P.content_pages(pages))[0], ["Template"])
    assert sorted(rows(P.resolve_calls(calls, bodies, redirects))) == [
        (1, "Template:Convert", "{{{1}}} km"), (1, "Template:Only", "bd")]
    assert sorted(rows(P.template_usage(calls, bodies, redirects))) == [
        ("Template:Convert", 1, True), ("Template:Only", 1, True)]


def test_extracted_article(spark, fixtures):
    pages = X.read_dump(spark, f"{fixtures}/dump.xml")
    got = extract_articles(pages, "http://enc.example.org/wiki").filter("id = 1").head()
    assert got["url"] == "http://enc.example.org/wiki?curid=1"
    assert got["text"].split("\n") == [
        'A river is "a stream".', "Course.", "Upper.",
        "It flows to the open seas and formula_1 or formula_2."]


def test_doc_records(spark, fixtures):
    docs = {r["id"]: r for r in L.read_doc_records(spark, f"{fixtures}/docs_0.txt").collect()}
    assert [tuple(x) for x in docs["11"]["links"]] == [("/l", "lakes"), ("/r", "rivers")]
    assert docs["11"]["text"].split() == "Caf ber rivers and rivers, also lakes.".split()
    assert docs["12"]["title"] == "Plain" and docs["12"]["links"] == []


def test_wiki_rows(spark, fixtures):
    got = tokenize_encyclopedia(L.parse_wiki_rows(L.read_lines(spark, f"{fixtures}/wiki.tsv")))
    assert [(r["id"], r["words"]) for r in got.collect()] == [("1", ["some", "words", "here"])]


def test_feed_files_and_run(spark, fixtures):
    entries = X.read_feed_entries(spark, [f"{fixtures}/feed_a.xml", f"{fixtures}/feed_b.xml"])
    by_link = {r["link"]: r for r in entries.collect()}
    assert len(by_link) == 6
    assert by_link["http://h/1"]["published"] == dt.datetime(2016, 10, 15, 9, 45)
    assert by_link["http://d/4"]["published"] is None
    due = entries.select(
        F.lit("Daily").alias("feed_name"), F.lit("http://f").alias("feed_link"),
        F.col("entry_id").alias("article_id"), F.col("link").alias("article_link"), "published")
    pages = spark.createDataFrame([("http://d/1", "<p>Some visible text</p>"),
                                   ("http://h/1", "<p>1 2</p>")], "url string, html string")
    articles, errors = run_feeds(due, pages, 1476523800)  # 2016-10-15 09:30:00
    assert [(r["article_id"], r["text"]) for r in articles.collect()] == [
        ("a1", "some visible text")]
    assert sorted((r["article_id"], r["error"]) for r in errors.collect()) == [
        ("b1", "no text"), ("b2", "page missing")]
