"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are the powers of two of n
(as many of the longest allowed as fit, then the binary digits of the rest). Each
piece is a sequence of its own: pieces of equal length fill a bucket from which
batches are drawn, no sequence crosses documents, and nothing is padded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrain.llm.bpe import encoder
from lexigrain.llm.common import column_like, small_batches

MAX_LENGTH = 2048
END_ID = 1
OUT = 1 << 24  # ids that go out in one batch

PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


def decompose(count: int, longest: int = MAX_LENGTH) -> list[int]:
    """Lengths of the pieces of ``count`` tokens, longest first."""
    lengths = [longest] * (count // longest)
    rest = count % longest
    lengths += [1 << bit for bit in range(rest.bit_length() - 1, -1, -1) if rest >> bit & 1]
    return lengths


def piece_lengths(counts: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """``decompose`` for many counts: per piece the place of its document and its length."""
    bits = longest.bit_length() - 1
    lengths = longest >> np.arange(bits + 1)
    times = np.column_stack([counts // longest, (counts % longest)[:, None] >> np.arange(
        bits - 1, -1, -1) & 1])
    owner = np.repeat(np.arange(len(counts)), times.sum(axis=1))
    return owner, np.repeat(np.tile(lengths, len(counts)), times.ravel())


def pack(docs: DataFrame, tokenizer: str, max_length: int = MAX_LENGTH, end_id: int = END_ID,
         text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per piece: its document, place, ids (little-endian, 32 bits) and sequence.

    ``tokenizer`` is the path of a byte-level BPE file of the tokenizers library.
    Null and empty texts hold the end id alone. A repeated row or a repeated or null
    doc_id is a document of its own. Other columns are not read. There is no shuffle;
    ``sequence_id`` is unique, and stable as long as the input files and their splits are.
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                        ("doc_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in small_batches(batches, "text"):
            ids, counts = encode(column_like(batch, "text"))
            ids, counts = np.insert(ids, np.cumsum(counts), end_id), counts + 1
            owner, lengths = piece_lengths(counts, max_length)
            ends = np.cumsum(lengths)
            starts = ends - lengths - (np.cumsum(counts) - counts)[owner]
            keys = column_like(batch, "doc_id")
            low = 0
            while low < len(lengths):  # a huge document goes out in several batches
                first = ends[low] - lengths[low]
                high = max(low + 1, int(np.searchsorted(ends, first + OUT, side="right")))
                places = (np.append(first, ends[low:high]) - first).astype(np.int32) * 4
                data = pa.Array.from_buffers(pa.binary(), high - low, [
                    None, pa.py_buffer(places), pa.py_buffer(ids[first:ends[high - 1]])])
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(owner[low:high])), pa.array(starts[low:high]),
                     pa.array(lengths[low:high]), pa.array(counts[owner[low:high]]), data],
                    schema=schema)
                low = high

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                         F.col(text).alias("text"))
    return (source.mapInArrow(run, PIECES)
            .withColumn("sequence_id", F.monotonically_increasing_id())
            .withColumn("offset", F.lit(0).cast("long")))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write pieces into one folder per length, from which batches of one length are read."""
    pieces.write.partitionBy("length").option("compression", "zstd").parquet(path)
