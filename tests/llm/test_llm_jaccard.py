import random
import re
from itertools import combinations

from lexigrain.llm import jaccard_join as J
from lexigrain.llm.components import components
from llm_samples import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def brute(texts):
    """Component by index, comparing every pair."""
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        common = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * common >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def fixture_texts():
    rng = random.Random(2)
    texts = [None, "", "  ", "a b", "A  b", "a b c d e", "a b c d e", "é É", "É é"]
    passage = prose(900, 60)
    for seed in range(12):
        base = prose(seed, rng.choice([20, 60, 150])).split()
        texts.append(" ".join(base))
        for _ in range(6):  # near copies of growing distance, chains among them
            base = list(base)
            for _ in range(rng.randint(1, 4)):
                base[rng.randrange(len(base))] = rng.choice(["new", "other", "word"])
            texts.append(" ".join(base).upper() if rng.random() < 0.3 else " ".join(base))
        texts.append(passage + " " + " ".join(base[:rng.choice([5, 12, 200])]))
    texts += [texts[20]] * 5
    return texts


def test_components_equal_brute_force(spark):
    texts = fixture_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    sizes, roots = brute(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.join_components(df).collect()}
    assert got == {i: (sizes[i], roots[i]) for i in range(len(texts))}
    assert len(set(roots)) < len(texts) - 30


def test_hot_shingles_dealt_into_parts(spark, monkeypatch):
    """Everything counts as hot here, so every group is split and joined again."""
    monkeypatch.setattr(J, "frequency_classes", lambda counters: (
        (counters > 3).astype("uint8"), (counters > 0).astype("uint8") * 2))
    texts = fixture_texts()[:60]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sizes, roots = brute(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.join_components(df).collect()}
    assert got == {i: (sizes[i], roots[i]) for i in range(len(texts))}


def test_edges(spark, edge, empty):
    rows = J.join_components(edge).collect()
    assert len(rows) == edge.count()
    by_id = {r.doc_id: r.component_id for r in rows if r.doc_id is not None}
    assert by_id[2] == by_id[3] == 1 and by_id[8] == 7 and by_id[10] == 9
    assert [by_id[i] for i in (4, 5, 6)] == [4, 5, 6]
    assert sorted(repr(r.component_id) for r in rows if r.doc_id is None) == ["1", "1", "None"]
    assert J.join_components(empty).count() == 0


def test_one_of_each(spark, edge, empty):
    kept = J.one_of_each(edge).collect()
    assert kept[0].__fields__ == edge.columns
    assert sorted(repr(r.doc_id) for r in kept) == sorted(
        ["1", "4", "5", "6", "7", "9", "11", "11", "12", "13", "None"])
    assert J.one_of_each(empty).count() == 0


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)],
                                  "u long, v long")
    found = {r.node: r.root for r in components(links).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_sets_to_verify_are_not_landed(spark, monkeypatch):
    labels, landed = [], J.landed
    monkeypatch.setattr(J, "landed", lambda df, label: (labels.append(label), landed(df, label))[1])
    texts = fixture_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = J.join_components(docs).orderBy("doc_id").collect()
    assert [r.component_id for r in found] == brute(texts)[1]
    assert "verified" in labels and "values" not in labels
