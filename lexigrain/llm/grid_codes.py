"""Vector codes by product quantisation, the nearest entry found by memoised grid cells.

Components become integers, a vector is cut into equal parts, and every part position
has a codebook. The space of a part is laid out in boxes of a grid. The entries that can
be nearest to any point of a box are those whose least distance to the box is not above
the smallest of all greatest distances; they are found once for a box, kept under the
hash of its cell, and only they are measured exactly for the vectors inside. All
arithmetic is in integers, so codes do not depend on how the rows are dealt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrain.llm.common import column_like, mixed
from lexigrain.llm.folders import landed
from lexigrain.operators.joins import lookup

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LIMIT = 1 << 24  # greatest size of a component: squares and their sums stay exact
CELLS = 1 << 15  # cells that a part position remembers
BLOCK = 1 << 21  # integers of a block of distances


def usable(vector: str | Column) -> Column:
    """Whether a vector is there and has only finite components."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~odd


def grid_integers(batch: pa.RecordBatch, vector: str, dims: int) -> np.ndarray:
    """The vectors of a batch as integers, one row each."""
    column = column_like(batch, vector)
    lengths = np.diff(column.offsets.to_numpy())
    if (lengths != dims).any():
        raise ValueError(f"vectors of other lengths than {dims}")
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    scaled = np.floor(values * SCALE)
    if (np.abs(scaled) > LIMIT).any():
        raise ValueError(f"components beyond {LIMIT // SCALE} have no exact distances")
    return scaled.astype(np.int64).reshape(len(lengths), dims)


class Cells:
    """The nearest entries of one part position, by cells met so far."""

    def __init__(self, book: np.ndarray, limit: int = CELLS):
        self.book, self.limit = book, limit
        spread = int(np.abs(book - book.mean(axis=0)).mean()) if book.size else 0
        self.width = max(1, spread)
        self._restart()

    def _restart(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.corners = np.empty((0, self.book.shape[1]), np.int64)
        self.masks = np.empty((0, -(-len(self.book) // 8)), np.uint8)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each point (ties: the lower) and squared distance."""
        step = max(1, BLOCK // max(1, self.book.size))
        found = [self._block(points[at:at + step]) for at in range(0, len(points), step)]
        return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) \
            if found else (np.empty(0, np.int64), np.empty(0, np.int64))

    def _block(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        corners = points // self.width
        hashes = np.full(len(points), 1, np.uint64)
        for at in range(corners.shape[1]):
            hashes = mixed(hashes + corners[:, at].astype(np.uint64))
        keys, first, cell = np.unique(hashes, return_index=True, return_inverse=True)
        masks = self._masks(keys, corners[first])
        # two cells under one hash: the second is not the one the mask is for
        strange = (corners != corners[first][cell]).any(axis=1)
        allowed = np.unpackbits(masks, axis=1, count=len(self.book)).astype(bool)
        if strange.any():
            allowed = np.vstack([allowed, np.ones((1, len(self.book)), bool)])
            cell = np.where(strange, len(allowed) - 1, cell)
        _, entries = np.nonzero(allowed)
        sizes = allowed.sum(axis=1)
        starts = np.cumsum(sizes) - sizes
        counts = sizes[cell]
        ends = np.cumsum(counts)
        begins = ends - counts
        row = np.repeat(np.arange(len(points)), counts)
        entry = entries[np.repeat(starts[cell] - begins, counts) + np.arange(ends[-1])]
        apart = points[row] - self.book[entry]
        squared = np.einsum("ij,ij->i", apart, apart)
        best = np.minimum.reduceat(squared * len(self.book) + entry, begins)
        return best % len(self.book), best // len(self.book)

    def _masks(self, keys: np.ndarray, corners: np.ndarray) -> np.ndarray:
        """The candidates of cells as bits, from memory or computed and remembered."""
        at = np.searchsorted(self.keys, keys)
        inside = at < len(self.keys)
        known = np.zeros(len(keys), bool)
        known[inside] = (self.keys[at[inside]] == keys[inside]) & (
            self.corners[at[inside]] == corners[inside]).all(axis=1)
        masks = np.empty((len(keys), self.masks.shape[1]), np.uint8)
        masks[known] = self.masks[at[known]]
        if not known.all():
            fresh = ~known
            masks[fresh] = self._candidates(corners[fresh])
            if len(self.keys) + fresh.sum() > self.limit:
                self._restart()
            merged = np.concatenate([self.keys, keys[fresh]])
            order = np.argsort(merged, kind="stable")
            self.keys = merged[order]
            self.corners = np.concatenate([self.corners, corners[fresh]])[order]
            self.masks = np.concatenate([self.masks, masks[fresh]])[order]
        return masks

    def _candidates(self, corners: np.ndarray) -> np.ndarray:
        low = (corners * self.width)[:, None, :]
        high = low + (self.width - 1)
        book = self.book[None, :, :]
        below, above = low - book, book - high
        least = (np.maximum(np.maximum(below, above), 0) ** 2).sum(axis=2)
        most = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(axis=2)
        return np.packbits(least <= most.min(axis=1, keepdims=True), axis=1)


def _cut(rows: np.ndarray, parts: int) -> np.ndarray:
    """(part, row, component): vectors cut into equal parts."""
    return rows.reshape(len(rows), parts, -1).transpose(1, 0, 2)


def _sums(kept: DataFrame, books: np.ndarray, vector: str, dims: int) -> DataFrame:
    """(part, entry, at, n, total): one row for each place of a codebook and task."""
    parts, size, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(book) for book in books]
        totals, counts = np.zeros(books.shape, np.int64), np.zeros((parts, size), np.int64)
        for batch in batches:
            cut = _cut(grid_integers(batch, vector, dims), parts)
            for part in range(parts):
                entry, _ = cells[part].nearest(cut[part])
                np.add.at(totals[part], entry, cut[part])
                counts[part] += np.bincount(entry, minlength=size)
        part, entry, at = np.nonzero(np.repeat(counts[:, :, None], width, axis=2))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in (part, entry, at, counts[part, entry],
                                               totals[part, entry, at])],
            names=["part", "entry", "at", "n", "total"])

    return kept.select(vector).mapInArrow(
        run, "part long, entry long, at long, n long, total long")


def learn_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES,
                    rounds: int = ROUNDS, vec_id: str = "vec_id",
                    vector: str = "embedding") -> np.ndarray:
    """Codebooks (part, entry, component) after some rounds, from all usable vectors.

    They start from the vectors of the smallest ids (null ids come last, equal ids in the
    order of their vectors). An entry that no part is nearest to stays. Fewer vectors than
    ``entries`` give as many entries as there are vectors, none give an empty array.
    The driver gets sums for each place of the codebooks, never rows.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be from 1 to 256")
    kept = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v")).filter(
        usable("v"))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    if not first:
        return np.empty((parts, 0, 0), np.int64)
    dims = len(first[0].v)
    if dims % parts or not dims:
        raise ValueError(f"vectors of {dims} components cannot be cut into {parts} equal parts")
    seeds = pa.RecordBatch.from_pydict({"v": pa.array([r.v for r in first], pa.list_(pa.float64()))})
    books = _cut(grid_integers(seeds, "v", dims), parts).copy()
    for _ in range(rounds):
        found = _sums(kept, books, "v", dims).groupBy("part", "entry", "at").agg(
            F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
        for r in found:
            books[r.part, r.entry, r.at] = r.total // r.n
    return books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, books: np.ndarray, vec_id: str = "vec_id",
           vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, codes, error): the entry of every part, as bytes, and what it loses.

    Vectors that are null or hold null or infinite components go; no other row does, and
    repeated rows and ids stay. Vectors of different lengths, and components whose squares
    would not be exact, stop the job. Other columns are not read. No shuffle.
    """
    parts, size, width = books.shape
    kept = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"),
                          F.col(vector).alias("v")).filter(usable("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(book) for book in books]
        for batch in batches:
            if not batch.num_rows:
                continue
            cut = _cut(grid_integers(batch, "v", parts * width), parts)
            codes = np.empty((batch.num_rows, parts), np.uint8)
            error = np.zeros(batch.num_rows, np.int64)
            for part in range(parts):
                codes[:, part], lost = cells[part].nearest(cut[part])
                error += lost
            packed = pa.Array.from_buffers(
                pa.binary(parts), batch.num_rows, [None, pa.py_buffer(codes.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [column_like(batch, "vec_id"), column_like(batch, "label"),
                 packed.cast(pa.binary()), pa.array(error, pa.int64())],
                names=["vec_id", "label", "codes", "error"])

    schema = kept.select("vec_id", "label", F.lit(b"").alias("codes"),
                         F.lit(0).cast("long").alias("error")).schema
    return kept.mapInArrow(run, schema)


def decode(codes: DataFrame, books: np.ndarray, column: str = "codes") -> DataFrame:
    """Adds ``vector``: the entries that codes stand for, as integers."""
    table = [[[int(x) for x in entry] for entry in book] for book in books]

    @F.udf("array<long>")
    def entries(code):
        return None if code is None else [x for part, at in enumerate(code)
                                          for x in table[part][at]]

    return codes.withColumn("vector", entries(column))


def label_errors(coded: DataFrame) -> DataFrame:
    """Adds ``label_error``: the error summed over equal labels, nulls together.

    Sums are combined in every task before the shuffle and looked up again by a join that
    is broadcast when measured small, else salted, so a frequent label is no hot key.
    """
    blank = F.col("label").isNull()
    marked = coded.withColumn("_none", blank).withColumn("_label", F.coalesce(
        F.col("label").cast("string"), F.lit("")))
    sums = marked.groupBy("_none", "_label").agg(F.sum("error").alias("label_error"))
    return lookup(marked, sums, ["_none", "_label"], ["vec_id", "codes"]).drop("_none", "_label")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES,
             rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Codes of all usable vectors with their errors, and the codebooks they refer to."""
    books = learn_codebooks(vectors, parts, entries, rounds)
    return label_errors(landed(encode(vectors, books), "codes")), books
