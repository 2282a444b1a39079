"""Records with closing tags in CDATA and comments, over small blocks and several files."""

import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrain.operators.pages import content_pages
from lexigrain.sources import xml as X
from lexigrain.sources import xml_sections

SCHEMA = T.StructType([T.StructField("_id", T.LongType()), T.StructField("t", T.StringType())])


@pytest.fixture()
def small_blocks(spark):
    settings = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


def read(spark, path):
    records = X.read_xml_records(spark, str(path), "i", SCHEMA).cache()
    good = sorted((r._id, r.t) for r in X.good_records(records).collect())
    bad = sorted((r.reason, r.record.strip()) for r in X.rejected_records(records).collect())
    assert tuple(X.record_counts(records).head()) == (len(good), len(bad))
    return good, bad


def test_the_three_faults(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        '<r><i id="1"><t>a</t></i>\n<i id="2"<t>torn</t></i>\n'
        '<i id="3"><t><![CDATA[x </i> <i> & y]]></t></i><i id="4"><t>b</t></i>\n'
        '<!-- <i id="9"><t>no</t></i> -->\n i id="5"><t>lost</t></i>\n<i id="6"><t>c</t></i></r>')
    good, bad = read(spark, tmp_path)
    assert good == [(1, "a"), (3, "x </i> <i> & y"), (4, "b"), (6, "c")]
    assert bad == [("malformed record", '<i id="2"<t>torn</t></i>'),
                   ("no opening tag", 'i id="5"><t>lost</t></i>')]


def test_a_section_that_is_never_closed_joins_nothing(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<r><i id="1"><t>a</t></i><i id="2"><t><![CDATA[b</t></i>'
                                    '<i id="3"><t>c</t></i></r>')
    (tmp_path / "b.xml").write_text('<i id="4"><t>d]]&gt;</t></i>')
    good, bad = read(spark, tmp_path)
    assert [i for i, _ in good] == [1, 3, 4] and [r for r, _ in bad] == ["malformed record"]


def test_sections_over_blocks(spark, tmp_path, small_blocks):
    rng, expected, torn = random.Random(6), [], 0
    for name in range(4):
        out = ["<r>"]
        for at in range(120):
            key = name * 1000 + at
            fill = "".join(rng.choice(["<i>", "</i>", "]]", "<!--", "&", "x ", "<i id='7'>"])
                           for _ in range(rng.choice([1, 5, 5, 400])))
            kind = rng.randrange(5)
            if kind == 0:
                out.append(f'<i id="{key}"><t><![CDATA[{fill}-->]]></t></i>\n')
                expected.append((key, fill + "-->"))
            elif kind == 1:
                out.append(f"<!-- <![CDATA[ {fill} -->")
            elif kind == 2:
                out.append(f'\n{key}"><t>torn</t></i>')
                torn += 1
            elif kind == 3:
                out.append(f'<i id="{key}"><!--{fill}--><t>a<![CDATA[{fill}]]><!----></t></i>')
                expected.append((key, "a" + fill))
            else:
                out.append(f'<i id="{key}"><t>plain</t></i>')
                expected.append((key, "plain"))
        (tmp_path / f"{name}.xml").write_text("".join([*out, "</r>"]))
    chunks = spark.read.text(str(tmp_path), lineSep="</i>").select(
        "value", xml_sections.place().alias("pos"))
    assert chunks.select("pos.file", "pos.block").distinct().count() > 40
    good, bad = read(spark, tmp_path)
    assert good == sorted(expected)
    assert {r for r, _ in bad} == {"no opening tag"} and len(bad) == torn


def test_transitions_equal_a_character_scan(spark):
    def after(text, state):
        marks = {0: {"<![CDATA[": 1, "<!--": 2}, 1: {"]]>": 0}, 2: {"-->": 0}}
        at = 0
        while at < len(text):
            mark = next((m for m in marks[state] if text.startswith(m, at)), None)
            state, at = (marks[state][mark], at + len(mark)) if mark else (state, at + 1)
        return state

    rng = random.Random(1)
    texts = ["".join(rng.choice(["<![CDATA[", "<!--", "]]>", "-->", "x", "\n", "-", "]", "<!"])
                     for _ in range(rng.randint(0, 9))) for _ in range(800)]
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    for r in df.select("value", xml_sections.transition(F.col("value")).alias("a"),
                       xml_sections.plain_sections(F.col("value")).alias("plain")).collect():
        assert (r.a or [0, 1, 2]) == [after(r.value, s) for s in range(3)], r.value
        if after(r.value, 0) == 0:
            gone = re.sub(r"(?s)<!\[CDATA\[(.*?)\]\]>|<!--.*?-->", lambda m: (m[1] or "").replace(
                "<", "&lt;").replace(">", "&gt;"), r.value)
            assert r.plain == gone


def test_no_files_with_records(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<r>\n</r>")
    assert read(spark, tmp_path) == ([], [])


def _glued_file(tmp_path):
    out = [f'<i id="{at}"><t><![CDATA[{at}</i>]]></t></i><i id="{at + 1}"><t>p</t></i>'
           for at in range(0, 2000, 2)]
    (tmp_path / "a.xml").write_text("".join(out))
    return [(at, "p" if at % 2 else f"{at}</i>") for at in range(2000)]


@pytest.mark.parametrize("small", [True, False])
def test_glued_chunks_by_broadcast_and_by_shuffle(spark, tmp_path, monkeypatch, small):
    monkeypatch.setattr(xml_sections, "fits_broadcast", lambda table: small)
    expected = _glued_file(tmp_path)
    good, bad = read(spark, tmp_path)
    assert (good, bad) == (expected, [])


def test_a_chunk_finds_its_section_without_trying_all_of_its_block(spark, tmp_path):
    _glued_file(tmp_path)
    chunks = spark.read.text(str(tmp_path), lineSep="</i>").select(
        "value", xml_sections.place().alias("pos"))
    plan = xml_sections.glue_sections(chunks, "</i>")._jdf.queryExecution().optimizedPlan().toString()
    assert "array_position" in plan and "lambda" not in plan


def test_a_landed_dump_is_not_parsed_again(spark, tmp_path):
    (tmp_path / "d.xml").write_text("<m>" + "".join(
        f"<page><title>T{i}</title><id>{i % 3}</id><revision><text>x {i}</text></revision></page>"
        for i in range(6)) + "</m>")
    once = X.read_dump(spark, str(tmp_path))
    landed = X.read_dump(spark, str(tmp_path), land=True)
    assert landed.columns == once.columns
    assert sorted(r.title for r in landed.collect()) == sorted(r.title for r in once.collect())
    kept = content_pages(landed)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" not in plan and "from_xml" not in plan
    assert sorted(r.title for r in kept.collect()) == ["T0", "T1", "T2"]


@pytest.mark.parametrize("bits", [16, 8])
def test_marks_are_carried_by_part_not_by_chunk(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(xml_sections, "PART", bits)
    expected = _glued_file(tmp_path)
    chunks = spark.read.text(str(tmp_path), lineSep="</i>").select(
        "value", xml_sections.place().alias("pos"))
    rows = chunks.count()
    assert rows > 2900 and xml_sections._parts(chunks).count() == -(-rows // (1 << bits))
    assert read(spark, tmp_path) == (expected, [])
