"""Benchmark decontamination by greedy string tiling.

A document shares seeds (short runs of words) with a test item before it can share
a passage. Documents with seeds meet the items they share them with; the longest
common runs of both are marked, longest first, until none of the shortest length is
left. Runs never overlap, and their order does not matter, so reordered passages count.
An item is leaked if the marked runs cover enough of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrain.llm.bitmaps import bit_set, in_bit_set
from lexigrain.llm.common import WordHashes, column_like, small_batches, texts_of, window_hashes
from lexigrain.llm.folders import landed
from lexigrain.llm.keep import row_key

SEED = 5  # words of a seed, and the shortest run
COVERAGE = 0.5  # share of an item's words that makes it leaked
SET_BITS = 24  # bits of the set of seeds of all items
MARKS = bytes.maketrans(bytes(b for b in range(128) if not chr(b).isalnum()),
                        b" " * sum(not chr(b).isalnum() for b in range(128)))
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def normal_words(text: str, words: WordHashes) -> np.ndarray:
    """Hashes of the words of a text: lower case, ASCII marks taken for white space."""
    return words(text.lower().encode().translate(MARKS))


class Running:
    """Karp-Rabin hashes of all windows of any length, from one running sum."""

    def __init__(self, tokens: np.ndarray):
        steps = np.full(len(tokens) + 1, INVERSE, np.uint64)
        steps[0] = 1
        weights = np.multiply.accumulate(steps)[:len(tokens)]
        self.sums = np.r_[np.uint64(0), np.cumsum(tokens * weights, dtype=np.uint64)]
        steps = np.full(len(tokens) + 1, BASE, np.uint64)
        steps[0] = 1
        self.powers = np.multiply.accumulate(steps)

    def windows(self, length: int) -> np.ndarray:
        count = len(self.sums) - length
        return (self.sums[length:] - self.sums[:-length]) * self.powers[:count]


def tiles(text: np.ndarray, item: np.ndarray, shortest: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: (start in the text, start in the item, length), longest first.

    Zeros stand for gaps and match nothing. Among equal lengths the first place in
    the item, then in the text, is taken.
    """
    sides = [(a, Running(a), a == 0) for a in (text, item)]
    found: list[tuple[int, int, int]] = []

    def free(side: int, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the unmarked windows."""
        tokens, running, marked = sides[side]
        if len(tokens) < length:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        before = np.r_[0, np.cumsum(marked)]
        starts = np.flatnonzero(before[length:] == before[:-length])
        return starts, running.windows(length)[starts]

    def common(length: int) -> bool:
        return np.isin(free(1, length)[1], free(0, length)[1]).any()

    high = min(len(text), len(item))
    while high >= shortest:
        low = shortest - 1  # the longest length that is known to match
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if common(middle) else (low, middle - 1)
        if low < shortest:
            break
        before, places = len(found), {}
        for start, value in zip(*(x.tolist() for x in free(0, low)), strict=True):
            places.setdefault(value, []).append(start)
        for at, value in zip(*(x.tolist() for x in free(1, low)), strict=True):
            for start in places.get(value, ()):
                if (not sides[1][2][at:at + low].any() and not sides[0][2][start:start + low].any()
                        and np.array_equal(text[start:start + low], item[at:at + low])):
                    sides[0][2][start:start + low] = True
                    sides[1][2][at:at + low] = True
                    found.append((start, at, low))
                    break
        # more runs of this length may be left, unless nothing but hashes were equal
        high = low if len(found) > before and common(low) else low - 1
    return found


def item_table(items: DataFrame, seed: int) -> DataFrame:
    """(item_id, words, seeds): the hashes of each item; items without a seed go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in small_batches(batches):
            rows = []
            for key, text in zip(column_like(batch, "item_id").to_pylist(), texts_of(batch),
                                 strict=True):
                tokens = normal_words(text, words)
                if len(tokens) >= seed:
                    rows.append((key, tokens.tobytes(),
                                 window_hashes(tokens, seed).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()),
                 pa.array([r[1] for r in rows], pa.binary()),
                 pa.array([r[2] for r in rows], pa.list_(pa.int64()))],
                names=["item_id", "words", "seeds"])

    return items.mapInArrow(run, "item_id long, words binary, seeds array<long>")


def seeded(docs: DataFrame, chosen, seed: int) -> DataFrame:
    """One row per document; those with seeds of any item bring the words around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in small_batches(batches):
            kept, hits = [], []
            for text in texts_of(batch):
                tokens = normal_words(text, words)
                grams = window_hashes(tokens, seed)
                at = np.flatnonzero(in_bit_set(chosen.value, grams, SET_BITS))
                if not len(at):
                    kept.append(None)
                    hits.append(None)
                    continue
                near = np.zeros(len(tokens) + 1, bool)  # one gap between regions
                for shift in range(seed):
                    near[at + shift] = True
                edge = near.copy()
                edge[1:] |= near[:-1]
                region = np.where(near, np.r_[tokens, np.uint64(0)], np.uint64(0))[edge]
                kept.append(region.tobytes())
                hits.append(np.unique(grams[at]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [column_like(batch, "doc_id"), column_like(batch, "key"),
                 pa.array(kept, pa.binary()), pa.array(hits, pa.list_(pa.int64()))],
                names=["doc_id", "key", "region", "hits"])

    rows = docs.mapInArrow(
        run, "doc_id long, key struct<a:long,b:long>, region binary, hits array<long>")
    return landed(rows.withColumn("row", F.monotonically_increasing_id()), "seeded")


def leaks(docs: DataFrame, items: DataFrame, seed: int = SEED, coverage: float = COVERAGE,
          text: str = "text", doc_id: str = "doc_id", item_text: str = "text",
          item_id: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """Documents (row, doc_id, key) and their leaked items (row, item_id, coverage, n_tiles).

    ``key`` tells texts apart, whatever their ids are.

    Null and empty texts share no seed. Items shorter than a seed leak nowhere; repeated
    items count once per item_id and text. Repeated rows of documents stay rows. Only
    documents that share seeds with an item are joined with it.
    """
    spark = docs.sparkSession
    items = landed(item_table(items.select(F.col(item_id).cast("long").alias("item_id"),
                                           F.col(item_text).alias("text")).distinct(), seed),
                   "items").withColumn("item", F.xxhash64("item_id", "words"))
    seeds = items.select("item", F.explode("seeds").alias("h"))
    chosen = spark.sparkContext.broadcast(bit_set(seeds.select("h"), SET_BITS))
    rows = seeded(docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                              F.col(text).alias("text"), row_key(text).alias("key")),
                  chosen, seed)
    hits = rows.select("row", F.explode("hits").alias("h"))
    sized = items.select("item", (F.octet_length("words") / 8).alias("n"))
    # a shared seed covers at most `seed` words of the item, so few seeds cannot reach it
    pairs = (hits.join(seeds.groupBy("item", "h").agg(F.count("*").alias("places")), "h")
             .groupBy("row", "item").agg(F.sum("places").alias("places")).join(sized, "item")
             .filter(seed * F.col("places") >= coverage * F.col("n")).select("row", "item"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            covered, count = [], []
            for region, words in zip(column_like(batch, "region"), column_like(batch, "words"),
                                     strict=True):
                item = np.frombuffer(words.as_buffer(), np.uint64)
                found = tiles(np.frombuffer(region.as_buffer(), np.uint64), item, seed)
                covered.append(sum(f[2] for f in found) / len(item))
                count.append(len(found))
            yield pa.RecordBatch.from_arrays(
                [column_like(batch, "row"), column_like(batch, "item_id"),
                 pa.array(covered, pa.float64()), pa.array(count, pa.int64())],
                names=["row", "item_id", "coverage", "n_tiles"])

    met = (pairs.join(items.select("item", "item_id", "words"), "item")
           .join(rows.select("row", "region"), "row"))
    tiled = met.mapInArrow(run, "row long, item_id long, coverage double, n_tiles long")
    return rows.select("row", "doc_id", "key"), tiled.filter(F.col("coverage") >= coverage)


def decontaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, contaminated, n_items, and the item covered most
    (the smallest item_id among ties) with its coverage and number of runs."""
    rows, found = leaks(docs, items, **options)
    best = found.groupBy("row").agg(
        F.count("*").alias("n_items"),
        F.max_by(F.struct("item_id", "coverage", "n_tiles"),
                 F.struct("coverage", -F.col("item_id"))).alias("best"))
    return rows.join(best, "row", "left").select(
        "doc_id", F.col("best").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"), F.col("best.item_id").alias("item_id"),
        F.coalesce("best.coverage", F.lit(0.0)).alias("coverage"),
        F.coalesce("best.n_tiles", F.lit(0)).alias("n_tiles"))
