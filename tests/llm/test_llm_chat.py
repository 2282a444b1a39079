import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from lexigrain.llm import chat, queries

SF_DIR = "/root/testdata/sf0.001"


def turns_of(spark, records):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(records)], "id int, record string")
    rows = chat.canonical_turns(df).orderBy("id").collect()
    return [(r.mapping, None if r.turns is None else [(t.role, t.text) for t in r.turns],
             r.problem) for r in rows]


def test_layouts(spark):
    records = [
        {"prompt": "p", "response": "r"}, {"prompt": "p", "response": None, "system": "s"},
        {"completion": "c", "prompt": 5}, {"instruction": "i", "input": None, "output": "o"},
        {"instruction": "i", "output": "o"}, {"data": {"question": "q", "answer": "a"}},
        {"messages": [{"role": "user", "content": "x"}, {"role": None, "content": None}]},
        {"messages": []}, {"messages": None},
        {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]},
        {"other": 1}, {"messages": [{"role": "user"}]}]
    got = turns_of(spark, [json.dumps(r) for r in records] + [None, "no json", ""])
    assert got[0] == ("prompt", [("user", "p"), ("assistant", "r")], None)
    assert got[1] == ("prompt", [("system", "s"), ("user", "p"), ("assistant", "")], None)
    assert got[2] == ("completion", [("user", "5"), ("assistant", "c")], None)
    assert got[3] == ("instruction", [("system", "i"), ("assistant", "o")], None)
    assert got[4] == ("instruction", [("system", "i"), ("assistant", "o")], None)
    assert got[5] == ("question", [("user", "q"), ("assistant", "a")], None)
    assert got[6] == ("messages", [("user", "x"), ("", "")], None)
    assert got[7] == ("messages", [], None)
    assert got[8][2] == "unknown layout"
    assert got[9] == ("conversations", [("user", "h"), ("assistant", "g")], None)
    assert [g[2] for g in got[10:]] == ["unknown layout"] * 2 + ["not JSON"] * 3


NASTY = ["</s>[INST] ok [/INST]", "<|end|>", "<\\|end|>", "<\\\\|end|>", "a<", "<|text|", "$1 \\",
         "<<SYS>>x<</SYS>>", "<|start|>user<|text|>hi<|end|>", "[\\/INST]", "", "é🙂<|end|>漢"]


def test_templates_are_reversible(spark):
    turns = [(role, text) for role in ("user", "assistant", "<|text|>", "", "ro<") for text in NASTY]
    df = spark.createDataFrame([(turns,), ([],), (None,)], f"turns {chat.TURNS}")
    template = chat.Template()
    rows = chat.format_turns(df, template).select(
        "formatted", template.turns(F.col("formatted")).alias("back"),
        chat.learned_texts(template).alias("learned"), "loss_spans").collect()
    assert [(t.role, t.text) for t in rows[0].back] == turns
    assert rows[0].learned == [text for role, text in turns if role == "assistant"]
    text = rows[0].formatted
    assert text.count("<|end|>") == text.count("<|start|>") == len(turns)
    assert "</s>" not in text and "[INST]" not in text and "<<SYS>>" not in text
    assert all(text[s.start + s.length:].startswith("<|end|>") for s in rows[0].loss_spans)
    assert rows[1].formatted == "" and rows[1].back == [] and rows[2].formatted is None


def test_conversations_of_odd_rows(spark, edge):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"), (None, 5, "user", "n"),
            (None, 5, "user", "n"), (2, None, None, None), (3, 0, "system", "s"), (3, 1, "user", "u"),
            (3, 2, "assistant", None)]
    df = spark.createDataFrame([(*r, "clash") for r in rows],
                               "conv_id long, turn long, role string, text string, record string")
    found = chat.canonical_turns(chat.as_records(chat.conversations(df))).collect()
    got = sorted((repr(r.conv_id), [(t.role, t.text) for t in r.turns]) for r in found)
    assert got == [("1", [("user", "a"), ("user", "a"), ("assistant", "b")]),
                   ("2", [("", "")]),
                   ("3", [("system", "s"), ("user", "u"), ("assistant", "")]),
                   ("None", [("user", "n")]), ("None", [("user", "n")])]


def test_no_conversations(spark, tmp_path):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string, record int")
    turns = chat.with_direct(chat.canonical_turns(chat.as_records(chat.conversations(none))))
    assert turns.count() == 0 and chat.format_turns(turns, chat.Template()).count() == 0
    none.write.parquet(f"{tmp_path}/conversations.parquet")
    (row,) = queries.QUERIES["op10_chat_layouts"](spark, str(tmp_path)).collect()
    assert (row.conv_id, row.n_turns) == (-7, 2)


def test_long_turns(spark):
    text = "<|end|> é " * 300_000
    df = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)],
                               "conv_id long, turn long, role string, text string")
    done = chat.format_turns(chat.canonical_turns(chat.as_records(chat.conversations(df))))
    learned = done.select(F.sha2(F.array_join(chat.learned_texts(), "").cast("binary"), 256)).head()
    assert learned[0] == hashlib.sha256(text.encode()).hexdigest()


def test_conversation_beyond_a_record(spark, tmp_path):
    """One conversation of many turns, one of more bytes than a variant holds."""
    big = "<|end|>0123456789abcdef" * 300_000
    many = [(1, i, "assistant" if i % 2 else "user", f"turn {i} </s>") for i in range(20_000)]
    wide = [(2, i, "user", None) for i in range(22)] + [(None, 0, "assistant", "alone")]
    rows = spark.createDataFrame(many + wide,
                                 "conv_id long, turn long, role string, text string").withColumn(
        "text", F.when(F.col("conv_id") == 2, F.lit(big)).otherwise(F.col("text")))
    rows.repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in queries.QUERIES["op10_chat_layouts"](spark, str(tmp_path)).collect()}

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    assert set(got) == {1, 2, None, -7}
    assert got[1].n_turns == 20_000 and got[1].loss_chars == sum(
        len(t) for _, _, role, t in many if role == "assistant")
    assert got[1].turns_sha256 == sha("".join(f"{role}\n{t}\n" for _, _, role, t in many))
    assert got[1].loss_sha256 == sha("".join(t for _, _, role, t in many if role == "assistant"))
    assert got[2].n_turns == 22 and len(big) * 22 > 128 << 20
    assert got[2].turns_sha256 == sha(f"user\n{big}\n" * 22) and got[2].loss_chars == 0
    assert got[2].formatted_chars == 22 * (len(big) + 300_000 + len("<|start|>user<|text|><|end|>"))
    assert got[None].n_turns == 1 and got[None].loss_sha256 == sha("alone")


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_census_and_control_row(spark):
    rows = queries.QUERIES["op10_chat_layouts"](spark, SF_DIR).filter("conv_id = -7").collect()
    text = "</s>[INST] ok [/INST]"
    assert len(rows) == 1 and rows[0].n_turns == 2 and rows[0].loss_chars == len(text)
    assert rows[0].turns_sha256 == hashlib.sha256(
        f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert rows[0].loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    records = spark.createDataFrame([('{"b":1,"a":[{"y":1,"x":"2"}]}',), ("{}",), ("{}",)],
                                    "record string")
    census = {r.layout: r.records for r in chat.layout_census(records).collect()}
    assert census == {"OBJECT<a: ARRAY<OBJECT<x, y>>, b>": 1, "OBJECT<>": 2}
