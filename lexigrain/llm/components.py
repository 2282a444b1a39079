"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrain.llm.folders import landed


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of each node on its smallest neighbour or itself.

    Large: those above the node. Small: those below it, and the node itself.
    """
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if large:
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        hung = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"),
                                                            F.col("m").alias("v"))
    else:
        down = both.filter("v < u")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        hung = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            least.select("u", F.col("m").alias("v")))
    return hung.filter("u != v").distinct()


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
                                              F.lit(0))).head()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (u, v): the root is the smallest node.

    Stars are written to the shared folder after each round; the number of rounds
    grows with the logarithm of the longest path.
    """
    edges = landed(links.select("u", "v").filter("u != v").distinct(), "links")
    state = _state(edges)
    while state[0]:
        edges = landed(_star(_star(edges, True), False), "stars")
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
