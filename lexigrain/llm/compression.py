"""Quality rules: compression bands.

Text that repeats itself compresses too well, and text without structure hardly at
all. Both are seen in the zstandard ratio (compressed bytes over bytes). A ratio
depends on the length, so the limits belong to bands of lengths; fixed chunks
show a spoiled part inside a long document that its whole ratio would hide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from lexigrain.llm.common import BLOCK, WHITE, small_batches, texts_of, words_of

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Band:
    """Limits for texts of at least ``from_bytes``: a ratio outside low..high rejects."""

    from_bytes: int
    low: float
    high: float


#: Whole documents. Prose falls from about 0.7 at 300 bytes to 0.4 at 16,000; encoded data
#: stays above 0.76 and lists of one phrase fall below 0.2. Below 256 bytes the frame of
#: the format outweighs the text, so nothing is judged there.
DOCUMENT_BANDS = (Band(0, 0.0, 99.0), Band(256, 0.35, 0.88), Band(512, 0.32, 0.80),
                  Band(1024, 0.30, 0.72), Band(2048, 0.28, 0.66), Band(4096, 0.26, 0.62),
                  Band(16384, 0.25, 0.60))
#: Fixed chunks; a last piece of less than half a chunk belongs to the chunk before.
CHUNK_BAND = Band(0, 0.22, 0.66)
CHUNK_BYTES = 4096
MAX_BAD_CHUNKS = 0.25
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
LEVEL = 3

MEASURES = ["n_bytes", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "ratio", "n_chunks", "n_low_chunks", "n_high_chunks"]


def repeated_words(ids: np.ndarray) -> int:
    """Words that lie in a 3-word window which the text has at least twice."""
    count = len(ids) - 2
    if count < 2:
        return 0
    pairs = ids[:-1].astype(np.int64) << 32 | ids[1:]
    pair_ids = np.unique(pairs, return_inverse=True)[1]
    triples = pair_ids[:-1].astype(np.int64) << 32 | ids[2:]
    _, inverse, counts = np.unique(triples, return_inverse=True, return_counts=True)
    starts = counts[inverse] > 1
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift:shift + count] |= starts
    return int(covered.sum())


def word_ids(data: bytes) -> np.ndarray:
    """Words numbered by first appearance, exactly (no hashing)."""
    number: dict[bytes, int] = {}
    parts = []
    for words in words_of(data):
        parts.append(np.fromiter((number.setdefault(w, len(number)) for w in words),
                                 np.int64, len(words)))
    return np.concatenate(parts)


def repeated_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in data.split(b"\n") if line.strip(WHITE)]
    return len(lines) - len(set(lines))


def chunks_of(data: bytes, size: int) -> Iterator[bytes]:
    start = 0
    while len(data) - start >= size * 3 // 2:
        yield data[start:start + size]
        start += size
    if start < len(data):
        yield data[start:]


def _measure(text: str, squeeze, chunk_bytes: int, chunk: Band) -> tuple:
    data = text.encode()
    ids = word_ids(data)
    white = len(data) - len(data.translate(None, WHITE))
    low = high = chunks = 0
    ratio = None
    if data:
        ratio = squeeze(data) / len(data)
        for piece in chunks_of(data, chunk_bytes):
            value = squeeze(piece) / len(piece) if len(piece) < len(data) else ratio
            chunks += 1
            full = len(piece) >= chunk_bytes // 2
            low += full and value < chunk.low
            high += full and value > chunk.high
    return (len(data), len(ids), len(text) - white,
            len(data) - len(data.translate(None, SYMBOLS)), repeated_lines(data),
            repeated_words(ids), ratio, chunks, low, high)


def measure_texts(docs: DataFrame, text: str = "text", chunk_bytes: int = CHUNK_BYTES,
                  chunk: Band = CHUNK_BAND, level: int = LEVEL) -> DataFrame:
    """Add word statistics and compression ratios; no shuffle.

    Null counts as the empty text: all counts 0, ``ratio`` null. Columns of the
    input that have the name of a measure are replaced. Each row is measured by
    itself, so copies and ties need no rule.
    """
    names = MEASURES
    kept = docs.drop(*names)
    wide = StructType(list(kept.schema.fields))
    for name in names:
        wide = wide.add(name, DoubleType() if name == "ratio" else LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compressor = zstandard.ZstdCompressor(level=level)

        def squeeze(data: bytes) -> int:
            if len(data) <= BLOCK:
                return len(compressor.compress(data))
            size = 0
            stream = compressor.compressobj(size=len(data))
            for start in range(0, len(data), BLOCK):
                size += len(stream.compress(data[start:start + BLOCK]))
            return size + len(stream.flush())

        for batch in small_batches(batches, text):
            rows = [_measure(value, squeeze, chunk_bytes, chunk) for value in texts_of(batch, text)]
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array(c, pa.float64() if n == "ratio" else pa.int64())
                      for n, c in zip(names, columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays],
                                             [*batch.schema.names, *names])

    return kept.mapInArrow(run, wide)


def in_bands(bands: tuple[Band, ...] = DOCUMENT_BANDS, max_bad: float = MAX_BAD_CHUNKS):
    """The verdict on measured texts: 'repetitive', 'incompressible', or null if within."""
    ordered = sorted(bands, key=lambda b: b.from_bytes)
    low = high = F.lit(None).cast("double")
    for band in ordered:
        reached = F.col("n_bytes") >= band.from_bytes
        low = F.when(reached, F.lit(band.low)).otherwise(low)
        high = F.when(reached, F.lit(band.high)).otherwise(high)
    return (F.when(F.col("ratio") < low, "repetitive")
            .when(F.col("ratio") > high, "incompressible")
            .when(F.col("n_low_chunks") > max_bad * F.col("n_chunks"), "repetitive")
            .when(F.col("n_high_chunks") > max_bad * F.col("n_chunks"), "incompressible"))


def judge(docs: DataFrame, text: str = "text", bands: tuple[Band, ...] = DOCUMENT_BANDS,
          chunk_bytes: int = CHUNK_BYTES, chunk: Band = CHUNK_BAND,
          max_bad: float = MAX_BAD_CHUNKS, min_words: int = MIN_WORDS,
          max_repeated_percent: int = MAX_REPEATED_PERCENT) -> DataFrame:
    """Measure texts and judge them.

    Adds ``base_failed`` (too few words, or too many in repeated windows),
    ``compression`` (the verdict of the bands) and ``kept``. Empty and null texts
    have no words, so they fail.
    """
    measured = measure_texts(docs, text, chunk_bytes, chunk)
    failed = ((F.col("n_words") < min_words)
              | (100 * F.col("n_repeat_words") > max_repeated_percent * F.col("n_words")))
    return (measured.withColumn("base_failed", failed)
            .withColumn("compression", in_bands(bands, max_bad))
            .withColumn("kept", ~F.col("base_failed") & F.col("compression").isNull()))
