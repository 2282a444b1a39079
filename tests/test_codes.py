"""Intervals and roll-ups of code trees against plain walks."""

import random

import pytest

from lexigrain.operators.codes import roll_up, tree_intervals


def _edges(spark, pairs):
    return spark.createDataFrame(pairs, "parent string, child string").repartition(5)


def _walks(pairs):
    """Code to its ancestors, itself first."""
    up = {c: p for p, c in pairs if c is not None}
    up |= {p: None for p, _ in pairs if p not in up and p not in ("None", None)}
    walks = {}
    for code in up:
        walk, at = [], code
        while at not in (None, "None"):
            walk.append(at)
            at = up.get(at)
        walks[code] = walk
    return walks


def _random_tree(seed, hot=0.0):
    rng = random.Random(seed)
    return [("None" if i == 0 else "n0" if rng.random() < hot else f"n{rng.randrange(i)}", f"n{i}")
            for i in range(120)]


@pytest.mark.parametrize("pairs", [
    _random_tree(1), _random_tree(2, hot=0.8),
    [("None" if i == 0 else f"n{i - 1}", f"n{i}") for i in range(70)],  # one path
    [("a", "b"), ("a", "b"), ("None", "z"), ("b", "c"), ("a", "d"), ("x", None)],  # a forest
], ids=["random", "hot", "path", "forest"])
def test_intervals_and_roll_up(spark, pairs):
    walks = _walks([p for p in pairs if p[1] is not None])
    places = tree_intervals(_edges(spark, pairs)).persist()
    found = {r.code: r for r in places.collect()}
    assert set(found) == set(walks)
    assert sorted(r.first for r in found.values()) == list(range(len(walks)))
    for code, r in found.items():
        assert r.depth == len(walks[code]) - 1
        above = {c for c, u in found.items() if u.first <= r.first <= u.last}
        assert above == set(walks[code])
    rng = random.Random(3)
    used = [rng.choice([*walks, "unknown", None]) for _ in range(400)] + [pairs[0][1]] * 200
    rows = spark.createDataFrame([(u,) for u in used], "c string")
    for r in roll_up(rows, places, "c").collect():
        assert r.n == used.count(r.code)
        assert r.n_below == sum(r.code in walks[u][1:] for u in used if u in walks)


def test_wrong_and_empty_trees(spark):
    with pytest.raises(ValueError, match="cycle"):
        tree_intervals(_edges(spark, [("None", "r"), ("a", "b"), ("b", "a")]))
    with pytest.raises(ValueError, match="several parents"):
        tree_intervals(_edges(spark, [("a", "c"), ("b", "c")]))
    nothing = tree_intervals(_edges(spark, [("a", "b")]).limit(0))
    assert nothing.count() == 0 and roll_up(
        spark.createDataFrame([("a",)], "c string"), nothing, "c").count() == 0
