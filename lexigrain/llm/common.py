"""What several operators share: Arrow batches and words."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lexigrain.session import spread

WHITE = b"\t\n\x0b\x0c\r "  # what separates words
BLOCK = 1 << 20  # bytes of a long text that are turned into words at a time


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; one that is a single small file is dealt to all cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def small_batches(batches: Iterator[pa.RecordBatch], column: str = "text",
                  limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that one holds about ``limit`` bytes of a text column, or one row.

    After the last one the worker's free memory goes back to the system (:func:`freed`).
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column(column).nbytes
        step = max(1, int(batch.num_rows * limit / max(sizes, 1)))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)
    freed()


def freed() -> None:
    """Give memory that is not in use back to the system.

    Python workers outlive their tasks; what the allocators keep counts against the
    executor in every later stage.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null becomes the empty text."""
    return [value or "" for value in batch.column(column).to_pylist()]


def cut_blocks(data: bytes, block: int = BLOCK) -> Iterator[bytes]:
    """A long text in blocks cut at white space, so that no word is cut."""
    start = 0
    while len(data) - start > block:
        window = data[start:start + block]
        end = max(window.rfind(mark) for mark in (b" ", b"\n", b"\t", b"\r"))
        if end <= 0:  # a word longer than the block: up to its end
            ends = [p for p in (data.find(mark, start + block) for mark in
                                (b" ", b"\n", b"\t", b"\r")) if p >= 0]
            end = min(ends, default=len(data)) - start
        yield data[start:start + end]
        start += end
    yield data[start:]


def words_of(data: bytes) -> Iterator[list[bytes]]:
    """Words between ASCII white space, as lists of one block each."""
    if len(data) <= BLOCK:
        yield data.split()
        return
    for block in cut_blocks(data):
        yield block.split()


class WordHashes:
    """64-bit hashes of words, remembered for words seen before (up to a limit)."""

    def __init__(self, limit: int = 400_000):
        self.limit = limit
        self.known: dict[bytes, int] = {}

    def __call__(self, data: bytes) -> np.ndarray:
        """The hashes of the words of a text, in order."""
        parts = [self._hash(words) for words in words_of(data)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def _hash(self, words: list[bytes]) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        known = self.known
        new = set(words).difference(known)
        if len(known) + len(new) > self.limit:
            known.clear()
            new = set(words)
        for word in new:
            known[word] = xxh3_64_intdigest(word)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a finaliser of multiplications and shifts)."""
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(0x7FB5D329728EA185)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x81DADEF4BC2DD44D)
    return values ^ (values >> np.uint64(33))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each window of ``width`` words; none if there are fewer words."""
    count = len(hashes) - width + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.full(count, width, np.uint64)
    for at in range(width):
        out = mixed(out + hashes[at:at + count])
    return out


def column_like(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
