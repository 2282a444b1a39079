import unicodedata

from pyspark.sql import functions as F

from lexigrain.functions import arrays, html, stopwords, text, tokens


def test_words_end_at_the_first_non_word_character(one):
    assert one("Don't stop_it x.yz,w9 abc", tokens.document_words) == ["don", "stopit", "abc"]
    assert one("ab-cdef ...ghi", tokens.document_words) == ["cdef", "ghi"]


def test_words_drop_digits_tags_and_odd_lengths(one):
    line = "<b>Bold</b> 3rd m² no " + "a" * 20 + " " + "b" * 21
    assert one(line, tokens.document_words) == ["bold", "a" * 20]
    assert one("ab²cd défi", tokens.document_words) == ["défi"]


def test_accented_letter_before_a_space_is_a_boundary_unless_asked(one):
    assert one("thé vert thé", tokens.document_words) == ["vert", "thé"]
    assert one("thé vert thé", lambda c: tokens.clean_words(c, unicode_boundary=True)) == [
        "thé", "vert", "thé"]


def test_no_break_space_separates(one):
    assert one("one two three", tokens.document_words) == ["one", "two", "three"]


def test_parameters_of_the_first_version(one):
    words = one("a1b2 tiny " + "z" * 30, lambda c: tokens.clean_words(
        c, max_len=None, keep_digits=True))
    assert words == ["a1b2", "tiny", "z" * 30]


def test_other_tokenisers(one):
    assert one("Don't go, été", lambda c: tokens.gap_words(c, 1)) == ["don", "t", "go", "t"]
    assert one("_x ab3cd Große a 12", tokens.alphabetic_words) == ["ab", "cd", "große"]
    assert one("THE Cat's", tokens.encyclopedia_words) == ["the", "cat"]


def test_stop_words_match_spark_default(one, spark):
    from pyspark.ml.feature import StopWordsRemover

    assert stopwords.ENGLISH == StopWordsRemover.loadDefaultStopWords("english")
    assert one("The cat and THE hat", lambda c: stopwords.remove_stop_words(
        F.split(c, " "))) == ["cat", "hat"]


def test_term_counts(one):
    counts = one("b a b c b", lambda c: arrays.term_counts(F.split(c, " ")))
    assert [tuple(r) for r in counts] == [("a", 1), ("b", 3), ("c", 1)]
    assert one("", lambda c: arrays.term_counts(F.filter(F.split(c, " "), lambda x: x != ""))) == []


def test_cosine(spark):
    row = spark.range(1).select(
        arrays.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))).alias("a"),
        arrays.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("b")).head()
    assert abs(row["a"] - 0.5 ** 0.5) < 1e-12 and row["b"] is None


def test_accents_bytes_entities(one):
    assert one("Žluťoučký kůň", text.remove_accents) == "Zlutoucky kun"
    assert one(b"caf\xc3\xa9", text.to_unicode) == "café"
    assert one(b"caf\xe9!", text.to_unicode) is None
    assert one(b"caf\xe9!", lambda c: text.to_unicode(c, "ignore")) == "caf!"
    assert one("caf&#233; &#xE9;&eacute; &lt; &nope; &amp;lt; &#xD800; & &#99999999999;",
               text.decode_entities) == "café éé < &nope; &lt; &#xD800; & &#99999999999;"


def test_titles(one):
    names = ["Template", "Category"]
    assert one(" category:  two__words ", lambda c: text.normalize_title(c, names)) == \
        "Category:Two words"
    assert one("book:   a tale", lambda c: text.normalize_title(c, names)) == "Book: A tale"
    assert one("plain", lambda c: text.normalize_title(c, names)) == "Plain"
    for title, full in ((":page", "Page"), ("category:x", "Category:x"), ("foo:x", "Template:Foo:x"),
                        ("cite", "Template:Cite"), ("", "")):
        assert one(title, lambda c: text.qualify_template_title(c, names)) == full


def test_literal_fixes_and_escapes(one):
    assert one("a<br>b < c & é", text.literal_fixes) == "ab lt c and  "
    assert one("<a & b>", text.escape_markup) == "&lt;a &amp; b&gt;"
    assert one("a b/ü*", text.percent_quote) == "a%20b/%C3%BC%2A"


PAGE = """<html><head><title>T</title></head><body><!-- <p>c</p> --><header>menu</header>
<p>Hello&nbsp;&amp; WORLD<br>x</p><script>if (a<b) "</p>"</script><a class=q href='/a?1&amp;2'>go <b>on</b></a>
<a href="/a?1&2">again</a><a name=x>anchor</a><img src=q></body></html>"""


def test_visible_text(one):
    assert one(PAGE, html.visible_text) == "hello & world x"
    shown = one(PAGE, lambda c: html.visible_text(c, html.HIDDEN_ELEMENTS_FIRST_VERSION, False))
    assert shown == "menu Hello & WORLD x go on again anchor"


def test_links(one):
    links = [tuple(x) for x in one(PAGE, html.all_links)]
    assert links == [("/a?1&2", "go on"), ("/a?1&2", "again")]
    assert one(PAGE, html.link_map) == {"/a?1&2": "again"}
    assert [tuple(x) for x in one(PAGE, html.distinct_links)] == [
        ("/a?1&2", "again"), ("/a?1&2", "go on")]


def test_accents_of_all_characters(spark):
    def bare(c):
        return unicodedata.normalize("NFC", "".join(
            x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn"))

    chars = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i <= 0xDFFF]
    words = ["x" + "|".join(chars[i:i + 2000]) for i in range(0, len(chars), 2000)]
    df = spark.createDataFrame(list(enumerate(words)), "id int, t string").repartition(8)
    out = df.select("id", text.remove_accents(F.col("t")).alias("t"))
    assert "Python" not in out._jdf.queryExecution().toString()
    for r in out.collect():
        assert r.t == "x" + "|".join(bare(c) for c in chars[r.id * 2000:(r.id + 1) * 2000])
