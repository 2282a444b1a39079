"""Code dictionaries and hierarchies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrain.operators.joins import lookup
from lexigrain.session import ensure_checkpoint_dir

PARTS = 256  # of the children of one code
BLOCK = 65_536  # positions that are summed up by one window


def describe_codes(rows: DataFrame, codes: DataFrame, code: str) -> DataFrame:
    """Add the description of a code, the first in order of text if it has several;
    unknown codes get null."""
    dims = codes.groupBy(F.col("code").alias(code)).agg(F.min("description").alias("description"))
    return lookup(rows, dims, [code], rows.columns)


def hierarchy_closure(edges: DataFrame, parent: str = "parent", child: str = "child",
                      root: str = "None") -> DataFrame:
    """(ancestor, descendant, distance) for every pair on a path of a code tree.

    Paths double: those of the length reached so far are joined with all that are known,
    so a tree of any depth takes as many rounds as its depth has binary digits. A code
    has one parent; one that turns up among its own ancestors is an error.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    closure = edges.filter(F.col(parent) != root).select(
        F.col(parent).alias("ancestor"), F.col(child).alias("descendant"),
        F.lit(1).alias("distance")).checkpoint()
    reached = 1
    while True:
        longest = closure.filter(F.col("distance") == reached).select(
            F.col("ancestor").alias("_middle"), F.col("descendant").alias("_end"))
        grown = closure.join(longest, F.col("descendant") == F.col("_middle")).select(
            "ancestor", F.col("_end").alias("descendant"),
            (F.col("distance") + reached).alias("distance")).checkpoint()
        found = grown.agg(F.count("*"), F.min(F.when(
            F.col("ancestor") == F.col("descendant"), F.col("descendant")))).head()
        if found[1] is not None:
            raise ValueError(f"the hierarchy has a cycle through {found[1]}")
        if not found[0]:
            return closure
        closure, reached = closure.unionByName(grown), 2 * reached


def tree_intervals(edges: DataFrame, parent: str = "parent", child: str = "child",
                   root: str = "None") -> DataFrame:
    """(code, parent, depth, first, last): places in a walk down the tree.

    ``first`` is a code's place, ``last`` that of its last descendant, so a code is below
    another if its place lies in the other's interval (:func:`is_below`). Places run
    from 0 without a gap. Top codes have depth 0 and parent null; several are a forest, one
    that is only named as a parent is a top code too. Repeated edges count once; a code
    with two parents, or among its own ancestors, is an error. Codes of null are left out.

    A table of one row per code, never of pairs: sums over ancestors and descendants
    double their reach in each round.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    listed = edges.filter(F.col(child).isNotNull()).select(
        F.col(child).alias("code"), F.nullif(parent, F.lit(root)).alias("parent")).distinct()
    tops = listed.filter("parent IS NOT NULL").select(F.col("parent").alias("code")).distinct()
    nodes = listed.unionByName(tops.join(listed, "code", "left_anti").withColumn(
        "parent", F.lit(None).cast("string"))).checkpoint()
    twice = nodes.groupBy("code").count().filter("count > 1").agg(F.min("code")).head()[0]
    if twice is not None:
        raise ValueError(f"{twice} has several parents")
    sized = _doubled(nodes.withColumn("depth", F.col("parent").isNotNull().cast("long")).withColumn(
        "size", F.lit(1).cast("long")), above=["depth"], below=["size"])
    # places before a code below its parent: children of one code are dealt into parts
    dealt = sized.withColumn("_part", F.pmod(F.xxhash64("code"), F.lit(PARTS)))
    ahead = Window.partitionBy("parent").orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    parts = dealt.groupBy("parent", "_part").agg(F.sum("size").alias("_sum")).select(
        F.col("parent").alias("_parent"), F.col("_part").alias("_of"),
        F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    within = Window.partitionBy("parent", "_part").orderBy("code").rowsBetween(
        Window.unboundedPreceding, -1)
    step = (F.col("_ahead") + F.coalesce(F.sum("size").over(within), F.lit(0))
            + F.col("parent").isNotNull().cast("long"))
    stepped = dealt.join(parts, F.col("parent").eqNullSafe(F.col("_parent"))
                         & (F.col("_part") == F.col("_of"))).withColumn("first", step)
    placed = _doubled(stepped.select("code", "parent", "depth", "size", "first"), above=["first"])
    return placed.withColumn("last", F.col("first") + F.col("size") - 1).drop("size")


def _doubled(nodes: DataFrame, above: list[str], below: tuple | list[str] = ()) -> DataFrame:
    """Sum columns up over a code and its ancestors (``above``) or descendants (``below``).

    After k rounds a row knows its ancestor 2^k steps up and the sums within that reach.
    """
    rounds = nodes.count().bit_length() + 1
    reached = nodes.withColumn("_up", F.col("parent"))
    for _ in range(rounds):
        if not reached.agg(F.count("_up")).head()[0]:
            return reached.drop("_up")
        higher = reached.select(F.col("code").alias("_up"), F.col("_up").alias("_next"),
                                *[F.col(c).alias(f"_{c}") for c in above])
        grown = lookup(reached, higher, ["_up"], ["code"])
        if below:
            sums = reached.filter("_up IS NOT NULL").groupBy(F.col("_up").alias("code")).agg(
                *[F.sum(c).alias(f"_{c}") for c in below])
            grown = grown.join(sums, "code", "left")
        total = {c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in [*above, *below]}
        reached = grown.select(*[total.get(c, F.col(c)).alias(c) for c in nodes.columns],
                               F.col("_next").alias("_up")).checkpoint()
    open_code = reached.filter("_up IS NOT NULL").agg(F.min("code")).head()[0]
    raise ValueError(f"the hierarchy has a cycle that {open_code} is in or below")


def is_below(first: Column, upper_first: Column, upper_last: Column) -> Column:
    """Whether the code at place ``first`` is a descendant of the one with that interval."""
    return (first > upper_first) & (first <= upper_last)


def roll_up(rows: DataFrame, intervals: DataFrame, code: str) -> DataFrame:
    """(code, n, n_below): rows of each code, and of all its descendants besides.

    Running sums over places: what lies in an interval is a difference of two of them.
    Every code of the tree gets a row; rows of other codes, or of null, count nowhere.
    """
    own = rows.groupBy(F.col(code).alias("code")).agg(F.count("*").alias("n"))
    counted = intervals.join(own, "code", "left").select(
        "code", "first", "last", F.coalesce("n", F.lit(0)).alias("n"),
        F.floor(F.col("first") / BLOCK).alias("_block"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.groupBy("_block").agg(F.sum("n").alias("_sum")).select(  # one row a block
        "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_ahead"))
    within = Window.partitionBy("_block").orderBy("first")
    running = counted.join(offsets, "_block").select(
        "code", "first", "last", "n",
        (F.col("_ahead") + F.sum("n").over(within)).alias("_through"))
    ends = running.select(F.col("first").alias("last"), F.col("_through").alias("_end"))
    return lookup(running, ends, ["last"], ["code"]).select(
        "code", "n", (F.col("_end") - F.col("_through")).alias("n_below"))
