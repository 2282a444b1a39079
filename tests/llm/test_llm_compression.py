import re
from collections import Counter

import zstandard

from lexigrain.llm import compression as C
from llm_samples import sample_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i:i + 3])] > 1:
            inside |= {i, i + 1, i + 2}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(inside))


def test_base_counts_equal_brute_force(spark):
    texts = sample_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in C.judge(df).collect()}
    for i, text in enumerate(texts):
        r, (n, chars, symbols, dup, rep) = got[i], brute(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n)
        data = (text or "").encode()
        ratio = len(zstandard.ZstdCompressor(level=3).compress(data)) / len(data) if data else None
        assert r.ratio == ratio


def test_bands(spark):
    import base64
    import random

    rng = random.Random(3)
    noise = base64.b64encode(rng.randbytes(9000)).decode()
    texts = {"list": "the same phrase again and " * 400, "noise": " ".join(
        noise[i:i + 7] for i in range(0, len(noise), 7))}
    from llm_samples import prose

    texts["prose"] = prose(5, 800)
    texts["spoiled"] = prose(6, 1500) + " " + "ab " * 4000
    df = spark.createDataFrame(list(texts.items()), "name string, text string")
    got = {r.name: r.compression for r in C.judge(df).collect()}
    assert got == {"list": "repetitive", "noise": "incompressible", "prose": None,
                   "spoiled": "repetitive"}


def test_edges(spark, edge, empty):
    rows = C.judge(edge).collect()
    assert len(rows) == edge.count()
    by_text = {r.text: r for r in rows}
    for text in (None, "", " \n\t "):
        assert (by_text[text].n_words, by_text[text].base_failed, by_text[text].kept) == (
            0, True, False)
    assert by_text[None].ratio is None and by_text[""].ratio is None
    assert C.judge(empty).count() == 0
