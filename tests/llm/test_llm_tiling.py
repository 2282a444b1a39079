import random

import numpy as np
import pyarrow as pa

from lexigrain.llm import common
from lexigrain.llm import string_tiling as T
from llm_samples import prose


def brute_tiles(text, item, shortest):
    """Greedy tiling by comparing every pair of places."""
    used_text, used_item, found = set(), set(), []
    while True:
        best = None
        for i in range(len(item)):
            for t in range(len(text)):
                n = 0
                while (t + n < len(text) and i + n < len(item) and text[t + n] == item[i + n] != 0
                       and t + n not in used_text and i + n not in used_item):
                    n += 1
                if n >= shortest and (best is None or n > best[2]):
                    best = (t, i, n)
        if best is None:
            return found
        found.append(best)
        used_text |= set(range(best[0], best[0] + best[2]))
        used_item |= set(range(best[1], best[1] + best[2]))


def test_tiles_equal_brute_force():
    rng = random.Random(4)
    for _ in range(150):
        letters = rng.choice([2, 4, 9])
        text = np.array([rng.randint(0, letters) for _ in range(rng.randint(0, 60))], np.uint64)
        item = np.array([rng.randint(1, letters) for _ in range(rng.randint(0, 40))], np.uint64)
        shortest = rng.choice([2, 3, 5])
        assert T.tiles(text, item, shortest) == brute_tiles(text.tolist(), item.tolist(), shortest)


def test_leaks(spark):
    items = [prose(i, 40) for i in range(6)]
    words = items[2].split()
    reordered = " ".join(words[24:] + prose(50, 8).split() + words[12:24] + ["and"] + words[:12])
    half = " ".join(words[:18])
    docs = [
        (0, prose(60, 300)), (1, prose(61, 50) + " " + items[1] + " " + prose(62, 50)),
        (2, prose(63, 80) + " " + reordered), (3, prose(64, 90) + " " + half),
        (4, items[3].upper().replace(" ", ", ") + "!"), (5, " ".join(items)),
        (6, None), (7, ""), (8, prose(60, 300)), (None, items[0]), (1, items[1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(
        [*enumerate(items), (1, items[1]), (9, "too short"), (10, None), (None, items[5])],
        "item_id long, text string")
    got = sorted((repr(r.doc_id), r.contaminated, r.n_items, r.item_id, round(r.coverage, 2))
                 for r in T.decontaminated(df, bench).collect())
    assert got == sorted([
        ("0", False, 0, None, 0.0), ("1", True, 1, 1, 1.0), ("1", True, 1, 1, 1.0),
        ("2", True, 1, 2, 1.0), ("3", False, 0, None, 0.0), ("4", True, 1, 3, 1.0),
        ("5", True, 7, 0, 1.0), ("6", False, 0, None, 0.0), ("7", False, 0, None, 0.0),
        ("8", False, 0, None, 0.0), ("None", True, 1, 0, 1.0)])


def test_edges(spark, edge, empty):
    bench = edge.selectExpr("doc_id AS item_id", "text", "kept", "row")
    rows = T.decontaminated(edge, bench).collect()
    assert len(rows) == edge.count()
    assert {r.doc_id for r in rows if r.contaminated} == {1, 2, 3, 7, 8, 11, None}
    assert T.decontaminated(empty, bench).count() == 0
    assert T.decontaminated(edge, empty.selectExpr("doc_id AS item_id", "text")).filter(
        "contaminated").count() == 0


def test_a_task_gives_its_free_memory_back_once(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "freed", lambda: calls.append(1))
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 100, None, "b"]})
    cut = list(common.small_batches(iter([batch, batch]), limit=50))
    assert sum(b.num_rows for b in cut) == 6 and len(cut) > 2 and calls == [1]
