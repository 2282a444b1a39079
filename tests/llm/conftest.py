import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_samples import prose  # noqa: E402

TOKENIZERS = pytest.importorskip("public_tokenizers")

EDGE_SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
               "n_words string, kept string, shard string, sig string, key string, row string, "
               "p string, root string, ids string, turns string, score string, block string")


def edge_rows() -> list[tuple]:
    """Nulls in any column, empty and long texts, repeated rows, ids that repeat."""
    long_text = " ".join(prose(i, 2000) for i in range(100, 160))
    base = prose(1)
    rows = [(1, base, "en", "a"), (1, base, "en", "a"), (2, base, "en", "a"),
            (3, base + " ending", None, None), (None, base, "en", "a"), (None, base, "en", "a"),
            (None, None, None, None), (4, None, "de", "b"), (5, "", "de", "b"),
            (6, " \n\t ", "de", None), (7, long_text, "en", "a"), (8, long_text + " x", "en", "b"),
            (9, "one two", "en", "b"), (10, "One TWO", "en", "b"), (11, prose(2), "de", "b"),
            (11, prose(3), "de", "b"), (12, "é" * 5000, "fr", "b"), (13, "漢字 🙂 \x00 x", "fr", "b")]
    return [(i, t, lang, src, len(t) if t else None, *["clash"] * 12)
            for i, t, lang, src in rows]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(edge_rows(), EDGE_SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], EDGE_SCHEMA)


@pytest.fixture(scope="session")
def bpe():
    return TOKENIZERS.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def pieces():
    return TOKENIZERS.path("piece_bpe_32k.model")
