"""Tables of fixed size (counters, bit sets) that tasks fill and one merge adds up.

A table has 2^bits cells in 256 blocks. Every task sends its own blocks; blocks are
merged one by one as they arrive, so neither a task nor the driver ever holds more
than one table, however large the input is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCKS = 256


def blocks_of(cells: np.ndarray) -> tuple[list[int], list[bytes]]:
    """The non-empty blocks of a table and their bytes."""
    parts = cells.reshape(BLOCKS, -1)
    filled = np.flatnonzero(parts.any(axis=1))
    return filled.tolist(), [parts[i].tobytes() for i in filled]


def merged(blocks: DataFrame, kind: str, adding: bool = True) -> dict[int, bytes]:
    """Merge rows (block, cells) by sum or by bitwise or; at most 256 rows reach the driver.

    Sums are 64 bits wide, whatever ``kind`` (the type of the cells) is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, cells in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(cells.as_buffer(), kind)
                part = part.astype(np.uint64) if adding else part
                if block not in tables:
                    tables[block] = part.copy()
                elif adding:
                    tables[block] += part
                else:
                    tables[block] |= part
        if tables:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(tables), pa.int32()),
                 pa.array([t.tobytes() for t in tables.values()], pa.binary())],
                names=["block", "cells"])

    rows = blocks.repartition("block").mapInArrow(run, "block int, cells binary").collect()
    return {row.block: bytes(row.cells) for row in rows}


def whole(parts: dict[int, bytes], bits: int, kind: str) -> np.ndarray:
    """The table of merged blocks, zero where no task sent one."""
    table = np.zeros((BLOCKS, (1 << bits) // BLOCKS), kind)
    for block, cells in parts.items():
        table[block] = np.frombuffer(cells, kind)
    return table.reshape(-1)


def bit_set(keys: DataFrame, bits: int) -> np.ndarray:
    """Bytes of a set of 64-bit keys by their leading bits (a superset test)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << (bits - 3), np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(
                64 - bits)
            np.bitwise_or.at(cells, at >> np.uint64(3),
                             (1 << (at & np.uint64(7))).astype(np.uint8))
        blocks, parts = blocks_of(cells)
        yield pa.RecordBatch.from_arrays(
            [pa.array(blocks, pa.int32()), pa.array(parts, pa.binary())], names=["block", "cells"])

    return whole(merged(keys.mapInArrow(run, "block int, cells binary"), "uint8", False),
                 bits - 3, "uint8")


def in_bit_set(cells: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    at = keys.view(np.uint64) >> np.uint64(64 - bits)
    return (cells[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
