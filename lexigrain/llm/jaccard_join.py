"""N-gram Jaccard join: rare-first prefix filtering.

The shingles of a document are ordered from rare to frequent, by counts over all
documents. Two sets that are similar enough share a shingle among the first of both
(their prefixes), so only prefix shingles are shuffled. Candidates pass a length, a
positional and a suffix filter, and each pair is verified once on whole sets.

Equal sets are one node from the start. Documents that share a prefix shingle are
first compared with one of them, the pivot: the set whose shingles are the most
frequent, as the original of near copies is. What this connects needs no more
comparisons, so a large group of near copies is not expanded into its pairs. All
pairs between different components that remain are then verified, so no link is lost.

Shingles and sets are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrain.llm.bitmaps import bit_set, blocks_of, in_bit_set, merged, whole
from lexigrain.llm.common import (
    WordHashes,
    column_like,
    mixed,
    small_batches,
    texts_of,
    window_hashes,
)
from lexigrain.llm.components import components
from lexigrain.llm.folders import landed
from lexigrain.llm.keep import row_key, without
from lexigrain.operators.joins import first_per_key, lookup

WIDTH = 5
PERCENT = 75
COUNTER_BITS = 20  # cells of the frequency table, 4 MB that every task lands
SET_BITS = 24  # bits of the set of candidates that tells which documents to read again
BINS = 64  # ranges of shingles whose counts the suffix filter compares
SEEN = 200_000  # sets a task remembers to send copies once
SALTED = 4096  # documents of one shingle that one group may hold
# one number holds, from the low bits: the place of a shingle in its prefix, the size of the
# set, the part of a hot shingle (1 to 32; 0 for others), how frequent its shingles are
PLACE_BITS, SIZE_BITS, PART_BITS, SCORE_BITS = 23, 25, 6, 9
HUGE = (1 << SIZE_BITS) - 1  # sets of this many shingles or more pass the filters
SMALL = 32  # rows of a group that are all compared in place
UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(data: bytes, words: WordHashes, width: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    hashes = words(data.translate(UPPER))
    if len(hashes) == 0:
        return hashes
    if len(hashes) < width:
        whole_text = np.full(1, len(hashes), np.uint64)
        for value in hashes:
            whole_text = mixed(whole_text + value)
        return whole_text
    return np.unique(window_hashes(hashes, width))


def signature(values: np.ndarray) -> int:
    """A 64-bit hash of a set of shingles, as a signed number."""
    from xxhash import xxh3_64_intdigest

    number = xxh3_64_intdigest(values.tobytes())
    return number - (1 << 64) if number >= 1 << 63 else number


def prefix_length(count: int, percent: int) -> int:
    return count - -(-percent * count // 100) + 1


class Seen:
    """Remembers the latest sets of a task, up to a limit."""

    def __init__(self) -> None:
        self.known: set[int] = set()

    def __call__(self, key: int) -> bool:
        if key in self.known:
            return True
        if len(self.known) >= SEEN:
            self.known.clear()
        self.known.add(key)
        return False


def text_key(data: bytes) -> int:
    """A 64-bit hash of a text, as a signed number."""
    from xxhash import xxh3_64_intdigest

    number = xxh3_64_intdigest(data)
    return number - (1 << 64) if number >= 1 << 63 else number


def _sets(batches, width: int, wanted=None) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Batches and the (text key, signature, shingles) of their documents.

    ``wanted`` is a bit set of text keys: other texts, and texts met before, have none.
    """
    words, seen = WordHashes(), Seen()
    nothing = np.empty(0, np.uint64)
    for batch in small_batches(batches):
        texts = [text.encode() for text in texts_of(batch)]
        keys = [text_key(data) for data in texts]
        hits = [True] * len(keys) if wanted is None else in_bit_set(
            wanted, np.asarray(keys, np.int64), SET_BITS)
        found = []
        for data, key, hit in zip(texts, keys, hits, strict=True):
            if not hit or (wanted is not None and seen(key)):
                found.append((key, None, nothing))
                continue
            values = shingles(data, words, width)
            found.append((key, signature(values) if len(values) else None, values))
        yield batch, found


def set_table(docs: DataFrame, width: int, bits: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """First pass: per document its set's signature, size and bins; counters of shingles."""
    columns = {n: pa.int64() for n in carry}
    shift = np.uint64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()),
                            ("sig", pa.int64()), ("n", pa.int64()),
                            ("bins", pa.binary()), ("block", pa.int32()), ("cells", pa.binary()),
                            *((n, columns[n]) for n in carry)])
        counters, waiting, size, seen = np.zeros(1 << bits, np.uint32), [], 0, Seen()
        for batch, found in _sets(batches, width):
            bins = []
            for _, sig, values in found:
                bins.append(None if sig is None or len(values) > 65_535 else np.bincount(
                    (values >> np.uint64(58)).astype(np.int64), minlength=BINS).astype(
                        "<u2").tobytes())
                if sig is not None and not seen(sig):
                    waiting.append(values >> shift)
                    size += len(values)
            if size > 1 << 21:
                counters += np.bincount(np.concatenate(waiting).astype(np.int64),
                                        minlength=1 << bits).astype(np.uint32)
                waiting, size = [], 0
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [column_like(batch, "doc_id"), pa.array([f[0] for f in found], pa.int64()),
                 pa.array([f[1] for f in found], pa.int64()),
                 pa.array([len(f[2]) for f in found], pa.int64()), pa.array(bins, pa.binary()),
                 pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary()),
                 *(column_like(batch, n) for n in carry)], schema=schema)
        if waiting:
            counters += np.bincount(np.concatenate(waiting).astype(np.int64),
                                    minlength=1 << bits).astype(np.uint32)
        blocks, cells = blocks_of(counters)
        rows = len(blocks)
        yield pa.RecordBatch.from_arrays(
            [*(pa.nulls(rows, pa.int64()) for _ in range(4)), pa.nulls(rows, pa.binary()), pa.array(blocks, pa.int32()),
             pa.array(cells, pa.binary()), *(pa.nulls(rows, pa.int64()) for _ in carry)],
            schema=schema)

    return landed(docs.mapInArrow(
        run, ", ".join(["doc_id long, text_key long, sig long, n long, bins binary, block int, "
                        "cells binary",
                        *(f"{n} long" for n in carry)])), "sets")


def frequency_classes(counters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per cell: how frequent its shingles are (quarters of a power of two), and into
    how many parts the documents of such a shingle are dealt (0: one group)."""
    counts = counters.astype(np.float64)
    classes = np.minimum(np.floor(4 * np.log2(counts + 1)), 255).astype(np.uint8)
    above = counts - 4 * counts.mean()
    salts = np.where(above > SALTED, np.ceil(np.log2(np.maximum(above, 1) / SALTED * 4)), 0)
    return classes, np.minimum(salts, 5).astype(np.uint8)


def postings(docs: DataFrame, width: int, percent: int, bits: int, table) -> DataFrame:
    """Second pass: prefix shingles that at least two sets have, with a pivot for each row.

    ``pivot`` is the most central set of the row's group, or null if it is this one or the
    filters exclude the pair.
    """
    shift = np.uint64(64 - bits)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, salts = table.value
        seen = Seen()
        for _, found in _sets(batches, width):
            parts: list[list[np.ndarray]] = [[], [], []]
            for _, sig, values in found:
                if sig is None or seen(sig):
                    continue
                cells = values >> shift
                found_classes = classes[cells]
                order = np.argsort(found_classes, kind="stable")[
                    :prefix_length(len(values), percent)]
                score = min(int(3 * found_classes.mean()), (1 << SCORE_BITS) - 1)
                parts[0].append(values[order].view(np.int64))
                parts[1].append(np.full(len(order), sig, np.int64))
                dealt = salts[cells[order]].astype(np.uint64)
                part = np.uint64(sig & 0xFFFF) & ((np.uint64(1) << dealt) - np.uint64(1))
                part = np.where(dealt > 0, part + np.uint64(1), np.uint64(0)).astype(np.int64)
                size = min(len(values), HUGE)
                parts[2].append(((score << PART_BITS | part) << SIZE_BITS | size) << PLACE_BITS
                                | np.minimum(np.arange(len(order)), (1 << PLACE_BITS) - 1))
            if parts[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(p)) for p in parts], names=["h", "sig", "at"])

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        h, sig, at = (rows.column(c).to_numpy() for c in range(3))
        del held, rows
        part = at >> PLACE_BITS + SIZE_BITS & (1 << PART_BITS) - 1
        score = at >> PLACE_BITS + SIZE_BITS + PART_BITS
        order = np.lexsort((sig, -score, part, h))
        h, part, sig, at = h[order], part[order], sig[order], at[order]
        first = np.r_[True, (h[1:] != h[:-1]) | (part[1:] != part[:-1])]
        fresh = first | np.r_[True, sig[1:] != sig[:-1]]  # copies sent by several tasks
        h, part, sig, at, first = (x[fresh] for x in (h, part, sig, at, first))
        sizes = np.bincount(np.cumsum(first) - 1)
        starts = np.repeat(np.flatnonzero(first), sizes)
        keep = (np.repeat(sizes, sizes) > 1) | (part > 0)
        n = (at >> PLACE_BITS & (1 << SIZE_BITS) - 1).astype(np.int32)
        pos = (at & (1 << PLACE_BITS) - 1).astype(np.int32)
        passed = ~first & within(n, n[starts], pos, pos[starts], percent)
        keep &= partnered(starts, np.repeat(sizes, sizes), part, n, pos, percent)
        pivot = pa.array(sig[starts][keep], pa.int64(), mask=~passed[keep])
        columns = [h[keep], sig[keep], n[keep], pos[keep]]
        for low in range(0, len(pivot), 100_000):
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c[low:low + 100_000]) for c in columns), pivot[low:low + 100_000]],
                names=["h", "sig", "n", "pos", "pivot"])

    rows = docs.mapInArrow(emit, "h long, sig long, at long")
    part = F.shiftright("at", PLACE_BITS + SIZE_BITS).bitwiseAND((1 << PART_BITS) - 1)
    return landed(rows.repartition(F.col("h"), part).mapInArrow(
        group, "h long, sig long, n int, pos int, pivot long"), "postings")


def partnered(starts: np.ndarray, sizes: np.ndarray, part: np.ndarray, n: np.ndarray,
              pos: np.ndarray, percent: int) -> np.ndarray:
    """Rows that may have a similar one in their group (all rows of a large or dealt group).

    Rows of a group stand together; ``starts`` is the place of the first and ``sizes``
    how many there are.
    """
    out = (sizes > SMALL) | (part > 0)
    left = np.flatnonzero(~out & (sizes > 1))
    for apart in range(1, SMALL):
        left = left[starts[left] + sizes[left] > left + apart]
        if not len(left):
            break
        met = left[within(n[left], n[left + apart], pos[left], pos[left + apart], percent)]
        out[met] = out[met + apart] = True
    return out


def within(n_a, n_b, pos_a, pos_b, percent: int):
    """Length and positional filter: can the pair be similar if this is its first match?

    The size of a huge set is not known exactly; it passes.
    """
    short, long = np.minimum(n_a, n_b).astype(np.int64), np.maximum(n_a, n_b).astype(np.int64)
    most = 1 + np.minimum(n_a - pos_a, n_b - pos_b).astype(np.int64) - 1
    return (long >= HUGE) | (
        (100 * short >= percent * long) & ((100 + percent) * most >= percent * (short + long)))


def within_columns(percent: int) -> Column:
    a = {c: F.col(f"a.{c}") for c in ("n", "pos")}
    b = {c: F.col(f"b.{c}") for c in ("n", "pos")}
    total = (a["n"] + b["n"]).cast("long")
    most = F.least(a["n"] - a["pos"], b["n"] - b["pos"])
    similar = ((100 * F.least(a["n"], b["n"]).cast("long")
                >= percent * F.greatest(a["n"], b["n"]).cast("long"))
               & ((100 + percent) * most.cast("long") >= percent * total))
    return (F.greatest(a["n"], b["n"]) >= HUGE) | similar


def among(sets: DataFrame, chosen, *columns: str) -> DataFrame:
    """Columns of the documents whose sets are in a bit set; the sig comes first."""
    schema = ", ".join(f"{c} {'binary' if c == 'bins' else 'long'}" for c in ("sig", *columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(in_bit_set(chosen.value, keys, SET_BITS)))

    return sets.filter("sig is not null").select("sig", *columns).mapInArrow(run, schema)


def suffix_filter(pairs: DataFrame, sets: DataFrame, chosen, percent: int) -> DataFrame:
    """Keep pairs whose counts per range of shingles allow the needed overlap.

    Only sets of candidates (those in ``chosen``) are shuffled.
    """
    bins = among(sets, chosen, "n", "bins").groupBy("sig").agg(
        F.first("n").alias("n"), F.first("bins").alias("bins"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n_u, n_v, bins_u, bins_v in zip(
                    *(column_like(batch, c).to_pylist() for c in ("n_u", "n_v", "bins_u", "bins_v")),
                    strict=True):
                most = n_u if bins_u is None or bins_v is None else int(np.minimum(
                    np.frombuffer(bins_u, "<u2"), np.frombuffer(bins_v, "<u2")).sum(dtype=np.int64))
                keep.append((100 + percent) * most >= percent * (n_u + n_v))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    def side(name: str) -> DataFrame:
        return bins.select(F.col("sig").alias(name), F.col("n").alias(f"n_{name}"),
                           F.col("bins").alias(f"bins_{name}"))

    return pairs.join(side("u"), "u").join(side("v"), "v").mapInArrow(run, "u long, v long")


def members(pairs: DataFrame):
    """The broadcast bit set of all sets in pairs; it has the same size for any input."""
    wanted = pairs.select("u").unionAll(pairs.select("v")).distinct()
    return pairs.sparkSession.sparkContext.broadcast(bit_set(wanted, SET_BITS))


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, width: int,
             percent: int) -> DataFrame:
    """Third pass: fetch the sets of candidate pairs (u, v) and keep the similar ones.

    One text stands for each set. Texts are told by a hash, so only these are cut into
    shingles again.
    """
    texts = among(sets, members(pairs), "text_key").groupBy("sig").agg(
        F.min("text_key").alias("text_key"))
    chosen = docs.sparkSession.sparkContext.broadcast(
        bit_set(texts.select("text_key"), SET_BITS))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in _sets(batches, width, chosen.value):
            rows = [(sig, values.tobytes()) for _, sig, values in found if sig is not None]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s for s, _ in rows], pa.int64()),
                     pa.array([v for _, v in rows], pa.binary())], names=["sig", "values"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(column_like(batch, "values_u"), column_like(batch, "values_v"),
                            strict=True):
                a = np.frombuffer(x.as_buffer(), np.uint64)
                b = np.frombuffer(y.as_buffer(), np.uint64)
                a, b = (a, b) if len(a) <= len(b) else (b, a)
                at = np.searchsorted(b, a)
                at[at == len(b)] = 0
                common = int((b[at] == a).sum())
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    # copies sent by several tasks come together here, before they meet the pairs; both sides
    # read this one shuffle, so the sets are not written as a table as well
    sets = docs.mapInArrow(fetch, "sig long, values binary").groupBy("sig").agg(
        F.first("values").alias("values"))

    def side(name: str) -> DataFrame:
        return sets.select(F.col("sig").alias(name), F.col("values").alias(f"values_{name}"))

    return landed(pairs.join(side("v").hint("merge"), "v").join(side("u").hint("merge"), "u")
                  .mapInArrow(check, "u long, v long"), "verified")


def similar_links(docs: DataFrame, sets: DataFrame, width: int, percent: int,
                  bits: int) -> DataFrame:
    """(node, root) of the sets that links connect."""
    spark = docs.sparkSession
    counters = whole(merged(sets.filter("block is not null").select("block", "cells"), "<u4"),
                     bits, "<u8")
    table = spark.sparkContext.broadcast(frequency_classes(counters))
    posted = postings(docs, width, percent, bits, table)

    stars = landed(posted.filter("pivot is not null").select(
        F.col("pivot").alias("u"), F.col("sig").alias("v")).distinct(), "stars")
    tried = landed(suffix_filter(stars, sets, members(stars), percent), "pairs")
    links = verified(tried, sets, docs, width, percent)
    roots = landed(components(links), "roots")

    labelled = lookup(posted.drop("pivot"), roots.withColumnRenamed("node", "sig"), ["sig"],
                      ["h"]).withColumn("root", F.coalesce("root", "sig"))
    split = labelled.groupBy("h").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).filter(
        "_a != _b").select("h")
    open_rows = landed(labelled.join(split, "h", "left_semi"), "open")
    a, b = open_rows.alias("a"), open_rows.alias("b")
    rest = a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.sig") < F.col("b.sig"))
                  & (F.col("a.root") != F.col("b.root")) & within_columns(percent)).select(
        F.col("a.sig").alias("u"), F.col("b.sig").alias("v")).distinct()
    tested = stars.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    untried = landed(rest.join(tested, ["u", "v"], "left_anti"), "rest")
    left = landed(suffix_filter(untried, sets, members(untried), percent), "pairs")
    more = verified(left, sets, docs, width, percent)
    return landed(components(links.unionAll(more)), "roots")


def join_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                    width: int = WIDTH, percent: int = PERCENT, bits: int = COUNTER_BITS,
                    carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id (smallest doc_id reached).

    Documents without words (null, empty, blank) have no shingles and are their own
    component. Repeated rows are equal sets and so linked; a component whose ids are
    all null has a null id, and ``root`` tells it from others (null without words).
    ``carry`` names columns of 64-bit numbers to keep; others are not read. Reads the
    texts four times and shuffles prefix shingles and the sets of candidates only.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                         F.col(text).alias("text"), *carry)
    table = set_table(source, width, bits, carry)
    sets = table.filter("block is null")
    roots = similar_links(source.select("text"), table, width, percent, bits)

    least = sets.filter("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("least"))
    rooted = least.join(roots.withColumnRenamed("node", "sig"), "sig", "left").select(
        "sig", "least", F.coalesce("root", "sig").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_set = rooted.join(named, "root").select("sig", "component_id", "root")
    shown = ["doc_id", "n_shingles", "component_id", "root", *carry]
    words = sets.filter("sig is not null").withColumnRenamed("n", "n_shingles")
    none = sets.filter("sig is null").withColumnRenamed("n", "n_shingles").withColumn(
        "component_id", F.col("doc_id")).withColumn("root", F.col("sig"))
    return words.join(by_set, "sig").select(*shown).unionAll(none.select(*shown))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents without near copies: of each component the row with the smallest
    doc_id stays (ids before null, then by a hash of the text); of equal rows one.

    Documents without words all stay.
    """
    a, b = (row_key("doc_id", "text")[part] for part in ("a", "b"))
    found = landed(join_components(docs.select("doc_id", "text", a.alias("_a"), b.alias("_b")),
                                   carry=("_a", "_b"), **options).filter("root is not null"),
                   "components")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("_a"),
                     F.col("_b"))
    best = found.groupBy("root").agg(F.min(order).alias("best"))
    key = F.struct(F.col("_a").alias("a"), F.col("_b").alias("b"))
    marked = found.join(best, "root").select(
        key.alias("key"), ((F.col("best._a") == F.col("_a")) & (F.col("best._b") == F.col("_b")))
        .alias("stays"))
    kept = without(docs, row_key("doc_id", "text"), marked.filter("not stays").select("key"))
    again = landed(marked.filter("stays").groupBy("key").count().filter("count > 1").select("key"),
                   "repeated")
    if again.isEmpty():
        return kept
    marked_docs = kept.withColumn("_key", row_key("doc_id", "text"))
    repeated = marked_docs.join(again.withColumnRenamed("key", "_key"), "_key", "left_semi")
    singles = without(kept, row_key("doc_id", "text"), again)
    return singles.unionByName(first_per_key(repeated, ["_key"], F.col("doc_id")).drop("_key"))
