import math
import struct
import zlib

import xxhash

from lexigrain.llm.hash_tree import Tree, shard_rows

TREE = Tree.regular(4, 2, 5)


def brute_place(doc_id, tree):
    """Descend with plain Python arithmetic; Spark chains the hash from column to column."""
    def hashed(level, node):
        seed = 42 if doc_id is None else xxhash.xxh64_intdigest(struct.pack("<q", doc_id), 42)
        for number in (level, node):
            seed = xxhash.xxh64_intdigest(struct.pack("<i", number), seed)
        return seed

    at = 0
    for level, parents in enumerate(tree.levels()):
        at = min((-math.log((hashed(level, node) >> 11) * 2.0 ** -53 + 2.0 ** -54) / weight, node)
                 for node, weight in parents[at])[1]
    return at


def test_places_equal_brute_force(spark):
    df = spark.range(-500, 1500).selectExpr("id AS doc_id", "string(id) AS text")
    for r in shard_rows(df, TREE).collect():
        assert r.shard == brute_place(r.doc_id, TREE)
        assert r.grown_shard == brute_place(r.doc_id, TREE.grown())
        assert r.size == len(str(r.doc_id)) + 16
        assert r.text_crc32 == zlib.crc32(str(r.doc_id).encode())


def moved(spark, before, after, count=4000):
    df = spark.range(count).selectExpr("id AS doc_id", "'' AS text")
    a = {r.doc_id: r.shard for r in shard_rows(df, before).collect()}
    b = {r.doc_id: r.shard for r in shard_rows(df, after).collect()}
    return a, b


def test_one_more_shard_takes_rows_only_into_itself(spark):
    tree = TREE
    for shard in (40, 41, 42):
        a, b = moved(spark, tree, tree.grown())
        changed = [i for i in a if a[i] != b[i]]
        assert changed and {b[i] for i in changed} == {shard}
        tree = tree.grown()


def test_a_weight_moves_only_in_its_subtrees(spark):
    a, b = moved(spark, TREE, TREE.weighted(7, 4.0))
    inside = range(5, 10)  # the rack of shard 7
    for i in a:
        if a[i] != b[i]:  # into the region of the shard, never between others
            assert b[i] in range(0, 10)
            assert not (a[i] in inside and b[i] not in (*inside,))
    emptied = moved(spark, TREE, TREE.weighted(7, 0.0))[1]
    assert 7 not in emptied.values()
    shares = [list(b.values()).count(s) for s in (7, 30)]
    assert shares[0] > 2 * shares[1]


def test_edges(spark, edge, empty):
    rows = shard_rows(edge, TREE, splits=2).collect()
    assert len(rows) == edge.count()
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.law == "key" and 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r.size for r in rows if r.doc_id in (4, 5)} == {16}
    assert shard_rows(empty, TREE).count() == 0


def test_equal_rows_in_great_number(spark):
    df = spark.range(150_000).selectExpr("bigint(1) AS doc_id", "'same' AS text")
    found = shard_rows(df, TREE).selectExpr("count(*)", "count(DISTINCT slot)", "max(slot)").head()
    assert tuple(found) == (150_000, 150_000, 149_999)
