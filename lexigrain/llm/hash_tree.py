"""Sharding by a hierarchical weighted hash tree.

Regions hold racks and racks hold shards. A key descends from the root: at each node
every child draws -ln(u) / weight from a hash of key and child, and the smallest
draw wins, so a child gets its share by weight. A child's draw depends on itself
alone: if a weight changes, the only keys that move at that level are those that
enter or leave this child's subtree.

The n-th further shard is a subtree of its own below the root. It takes its share from
everywhere, and no key moves between the shards that were there before.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrain.llm.folders import landed

SPLITS = 256  # parts of one shard that are numbered apart
STEP = 65_536  # slots of one run of equal rows that are listed at a time


@dataclass(frozen=True)
class Tree:
    """Shards as (region, rack, shard number, weight)."""

    shards: tuple[tuple[int, int, int, float], ...]

    @staticmethod
    def regular(regions: int, racks: int, shards: int) -> Tree:
        """Equal weights, shards numbered from 0."""
        return Tree(tuple((n // (racks * shards), n // shards, n, 1.0)
                          for n in range(regions * racks * shards)))

    def grown(self, weight: float = 1.0) -> Tree:
        """With one more shard, in a region and rack of its own."""
        region, rack, shard = (1 + max(s[i] for s in self.shards) for i in range(3))
        return Tree((*self.shards, (region, rack, shard, weight)))

    def weighted(self, shard: int, weight: float) -> Tree:
        """With another weight for a shard; 0 empties it."""
        return replace(self, shards=tuple((*s[:3], weight) if s[2] == shard else s
                                          for s in self.shards))

    def levels(self) -> list[dict[int, list[tuple[int, float]]]]:
        """For each level the children (node, weight) of every parent; the root is 0."""
        found: list[dict[int, dict[int, float]]] = [{}, {}, {}]
        for region, rack, shard, weight in self.shards:
            if weight > 0:
                for level, parent, node in ((0, 0, region), (1, region, rack), (2, rack, shard)):
                    children = found[level].setdefault(parent, {})
                    children[node] = children.get(node, 0.0) + weight
        return [{p: sorted(c.items()) for p, c in level.items()} for level in found]


def draw(key: Column, level: int, node: Column, weight: Column) -> Column:
    """-ln(u) / weight with u in (0, 1) from a hash of key, level and node."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(level), node), 11)
    return -F.ln(bits.cast("double") * F.lit(2.0 ** -53) + F.lit(2.0 ** -54)) / weight


def drawn(key: Column, level: int):
    return lambda child: F.struct(
        draw(key, level, child["node"], child["weight"]).alias("draw"),
        child["node"].alias("node"))


def place(key: Column, tree: Tree) -> Column:
    """The shard of a key: one weighted draw among the children of each node on the way."""
    at = F.lit(0)
    for level, parents in enumerate(tree.levels()):
        children = F.create_map(*[
            x for parent, nodes in parents.items() for x in (
                F.lit(parent),
                F.array(*[F.struct(F.lit(n).alias("node"), F.lit(float(w)).alias("weight"))
                          for n, w in nodes]))])
        at = F.array_min(F.transform(F.element_at(children, at), drawn(key, level)))["node"]
    return at


def shard_rows(docs: DataFrame, tree: Tree, text: str = "text", doc_id: str = "doc_id",
               splits: int = SPLITS) -> DataFrame:
    """One row per document: size, checksum of the text, shard, slot, shard when grown.

    The shard depends on doc_id and the tree alone, so repeated and null ids share a shard.
    Slots run from 0 without a gap in each shard, ordered by a hash and then by
    doc_id, checksum and size; equal rows take neighbouring slots. Only these narrow
    columns are shuffled. A shard is numbered in ``splits`` parts, so no task holds
    a whole shard, and equal rows are counted before the shuffle.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"))
    runs = landed(rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("_n")).select(
        "*", place(F.col("doc_id"), tree).alias("shard"),
        place(F.col("doc_id"), tree.grown()).alias("grown_shard"),
        F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(splits)).cast("int").alias(
            "_part")), "shards")
    parts = Window.partitionBy("shard").orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = (  # at most shards x splits rows
        runs.groupBy("shard", "_part").agg(F.sum("_n").alias("_rows"))
        .select("shard", "_part", F.coalesce(F.sum("_rows").over(parts), F.lit(0)).alias("_from")))
    inside = Window.partitionBy("shard", "_part").orderBy(
        "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = runs.join(F.broadcast(offsets), ["shard", "_part"]).withColumn(
        "_first", F.col("_from") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    last = F.col("_first") + F.col("_n") - 1
    steps = F.explode(F.sequence(F.col("_first"), last, F.lit(STEP).cast("long"))).alias("_step")
    listed = placed.select("doc_id", "size", "text_crc32", "shard", "grown_shard",
                           last.alias("_last"), steps)
    return listed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "grown_shard",
        F.explode(F.sequence("_step", F.least(F.col("_last"), F.col("_step") + STEP - 1))).alias(
            "slot"))
