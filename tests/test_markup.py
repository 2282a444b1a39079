import random

from pyspark.sql import functions as F

from lexigrain.functions import lines, markup, text


def test_nested_templates_of_any_depth(one):
    deep = "a" + "{{x|" * 40 + "y" + "}}" * 40 + "b"
    assert one(deep, markup.drop_templates) == "ab"
    assert one("no braces", markup.drop_templates) == "no braces"
    assert one(None, markup.drop_templates) is None


def test_unclosed_template(one):
    assert one("a {{b {{c}} d", markup.drop_templates) == "a  d"
    assert one("a {{b {{c}} d", lambda c: markup.drop_templates(c, "cut")) == "a "
    assert one("a {{b", markup.drop_templates) == "a {{b"


def cut_by_counting(text):
    """Templates dropped by a loop over characters that counts braces."""
    out, at = "", 0
    while at < len(text):
        if text.startswith("{{", at):
            depth, end = 0, at
            while end < len(text):
                depth += {"{": 1, "}": -1}.get(text[end], 0)
                end += 1
                if depth == 0:
                    break
            if depth:
                return out
            at = end
        else:
            out += text[at]
            at += 1
    return out


def drop_by_tokens(text, opening, closing):
    """Closed spans dropped by a loop over tokens; None if an opening is left over."""
    out, depth, at = "", 0, 0
    while at < len(text):
        token = text[at:at + 2]
        if token == opening:
            depth, at = depth + 1, at + 2
        elif token == closing and depth:
            depth, at = depth - 1, at + 2
        else:
            out += text[at] if not depth else ""
            at += 1
    return None if depth else out


def test_brackets_equal_a_loop_over_the_text(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["{", "}", "{{", "}}", "|", "{|", "|}", "a", "\n"])
                     for _ in range(rng.randint(0, 16))) for _ in range(3000)]
    texts += ["x {{a|{b}}} y", "{{" * 60 + "a" + "}}" * 60 + "b", "{" * 90 + "}" * 90 + "{a}",
              "{{x|" * 500 + "y" + "}}" * 500 + "z", "q" + "{{a}} {b} " * 5000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", markup.drop_brace_templates(F.col("t")).alias("braces"),
                       markup.drop_templates(F.col("t")).alias("templates"),
                       markup.drop_tables(F.col("t")).alias("tables")).collect():
        assert r.braces == cut_by_counting(r.t), r.t
        for got, pair in ((r.templates, "{{ }}"), (r.tables, "{| |}")):
            expected = drop_by_tokens(r.t, *pair.split())
            assert expected is None or got == expected, r.t


def test_single_braces_in_a_template(one):
    assert one("x {{a|{b}}} y", markup.light_clean) == "x  y"
    assert one("{b} {{c", markup.light_clean) == "{b} "


def test_tables(one):
    assert one("x{| a\n{| b |}\n|}y", markup.drop_tables) == "xy"


def test_links(one):
    page = "[[Lake]]s [[sea|open sea]] [[Category:X]] [[:fr:Y]] [[File:q|thumb|the [[bend]]]] [[w:Z|z]]"
    assert one(page, markup.replace_internal_links) == "Lakes open sea    z"
    assert one("[http://x.y see [[this]]] [mailto:a@b.c] [ftp://q http://i/p.PNG] [1]",
               markup.replace_external_links) == "see [[this]]   [1]"
    assert one("[[a b|c]] [http://x/y z]", lambda c: markup.replace_internal_links(
        markup.replace_external_links(c, True), True)) == \
        '<a href="a%20b">c</a> <a href="http%3A//x/y">z</a>'


def test_elements_and_tags(one):
    assert one("<div>a<div>b</div>c</div>d<REF name=x>q</ref>e", markup.drop_elements) == "de"
    assert one("<ref>a<ref/>b", markup.drop_tags) == "<ref>ab"
    assert one("<p class=q>x</p><br /><!-- <b> -->y<a href=z>l</a>", markup.drop_tags) == "xyl"


def test_emphasis_and_whitespace(one):
    assert one("'''''a''''' '''b''' ''c'' ''\"d\"'' '''e", markup.unquote_emphasis) == \
        'a b "c" "d" e'
    assert one("a\t  b.....c\n--\nd ,, e,. <<q>>", markup.tidy_whitespace) == \
        "a b...c\nd , e. «q»"


def test_placeholders_share_the_number_of_an_equal_block(one):
    assert one("<math>a</math><math>b</math><math>a</math> <code>c</code>",
               markup.name_placeholders) == "formula_1formula_2formula_1 codice_1"


def test_code_blocks_stay_undecoded(one):
    page = "&lt;syntaxhighlight lang=c&gt;a &amp;lt; b&lt;/syntaxhighlight&gt; &lt;i&gt;"
    assert one(page, text.decode_outside_code) == "a &amp;lt; b <i>"


def test_code_keeps_its_tags(one):
    page = "<b>x</b> <syntaxhighlight lang=c>if (a<b) <i>y</i> &lt;</syntaxhighlight> <i>z</i>"
    assert one(page, markup.clean_markup) == "x if (a<b) <i>y</i> &lt; z"


def test_light_clean(one):
    page = "A [[b|c]] {{t}}<ref>r</ref> [http://x.y label] [[Category:Z]]\n{| x\n|-\n| cell || two\n|}\nend"
    assert one(page, markup.light_clean).split() == "A c label cell two end".split()


def test_compact(one):
    page = ("intro\n== A ==\n== B ==\nbody\n pre\n=== C ===\n* item\nafter\nplain\n"
            "== D ==\n(aside)\n== E! ==\n pre first\nmore\n== F ==\n...\n}\n{| x")
    assert one(page, lines.compact_lines) == [
        "intro", "B.", "body", "after", "C.", "plain", "E!", " pre first", "more"]
    assert one(page, lambda c: lines.compact_lines(c, keep_sections=False)) == [
        "intro", "body", "after", "plain", " pre first", "more"]
    assert "- item" in one(page, lambda c: lines.compact_lines(c, keep_lists=True))
    assert one("", lines.compact_lines) == []


def test_compact_carries_state_over_blocks(one):
    page = "== A ==\n" + ":x\n" * 1000 + "body\n" + "line\n" * 600
    out = one(page, lines.compact_lines)
    assert out[:2] == ["A.", "body"] and len(out) == 602


def test_long_content_does_not_overflow(one):
    page = "{{" + "x " * 400_000 + "}}t<div>" + "y " * 200_000 + "</div>[http://a.b " + "z " * 100_000 + "]"
    assert one(page, lambda c: F.length(markup.clean_markup(c))) > 100_000


def test_nothing_is_tried_where_no_mark_is_left(spark):
    texts = ["{{a|{{b}}}}x", "{{{{a}}", "}}{{", "{{a}}{{b", "<DIV>a<div>b</div></div >c<div>",
             "<ref>a</REF>b</ref>", "[[a|[[b]]]]c]]", "{{{a}}}b", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    marked = markup.until_stable(F.col("t"), F.lit(3), lambda x: F.concat(x, F.lit("+")),
                                 lambda x: F.lit(False))
    assert [r.m for r in df.select(marked.alias("m")).collect()] == [
        t if t is None else t + "+" for t in texts]
    found = df.select(
        markup.drop_templates(F.col("t")).alias("a"), markup.drop_elements(F.col("t")).alias("b"),
        markup.replace_internal_links(F.col("t")).alias("c")).collect()
    assert [r.a for r in found[:4]] == ["x", "", "}}{{", "{{b"]
    assert [r.b for r in found[4:6]] == ["c<div>", "b</ref>"]
    assert found[6].c == "bc]]" and tuple(found[-1]) == (None,) * 3
