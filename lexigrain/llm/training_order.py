"""Token ids on disk in training order.

Every sequence of fixed length gets a number, and a keyed Feistel permutation with
cycle-walking turns the number into its global slot: a bijection that needs no table
and no sort by random keys. Slots are range-partitioned into shards. A shard is a file of
equal records, so slot s stands at byte (s mod rows) * stride of shard s div rows, and
a run resumes at any slot by reading on from there.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrain.llm.bpe import rank_encoder
from lexigrain.llm.common import column_like, mixed, small_batches
from lexigrain.llm.folders import landed

LENGTH = 512  # tokens of a sequence
SHARD_ROWS = 16_384  # sequences of a shard; 2^20 (1 GB) for 100 TB
ROUNDS = 4
TASK = 33  # bits that count rows within a task in Spark's increasing ids


def _round(half: np.ndarray, key: int, turn: int, mask: np.uint64) -> np.ndarray:
    return mixed(half + np.uint64((key * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03)
                                  % (1 << 64))) & mask


def _walk(values: np.ndarray, count: int, step) -> np.ndarray:
    """Apply a permutation of a larger range until every value is below ``count``."""
    out = step(values.astype(np.uint64))
    while True:
        outside = out >= np.uint64(count)
        if not outside.any():
            return out.astype(np.int64)
        out[outside] = step(out[outside])


def permuted(values: np.ndarray, count: int, key: int) -> np.ndarray:
    """The slots of numbers below ``count``."""
    bits = np.uint64(max(1, (max(count - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << bits) - np.uint64(1)

    def step(x: np.ndarray) -> np.ndarray:
        left, right = x >> bits, x & mask
        for turn in range(ROUNDS):
            left, right = right, left ^ _round(right, key, turn, mask)
        return left << bits | right

    return _walk(values, count, step)


def unpermuted(slots: np.ndarray, count: int, key: int) -> np.ndarray:
    """The numbers of slots: the inverse of ``permuted``."""
    bits = np.uint64(max(1, (max(count - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << bits) - np.uint64(1)

    def step(x: np.ndarray) -> np.ndarray:
        left, right = x >> bits, x & mask
        for turn in reversed(range(ROUNDS)):
            left, right = right ^ _round(left, key, turn, mask), left
        return left << bits | right

    return _walk(slots, count, step)


def sequences(docs: DataFrame, ranks: str, pattern: str, length: int = LENGTH,
              end_id: int = 50256, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, piece, n_tokens, body): documents cut into sequences, each ended by ``end_id``.

    ``ranks`` is the path of a rank file. ``body`` holds the ids as compressed unsigned
    16-bit numbers, without the padding that the shards have. Null and empty texts hold
    the end id alone. Repeated rows stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encode = rank_encoder(ranks, pattern).encode
        squeeze = zstandard.ZstdCompressor(level=1, write_content_size=True).compress
        for batch in small_batches(batches):
            ids, counts = encode(column_like(batch, "text"))
            ids, counts = np.insert(ids, np.cumsum(counts), end_id), counts + 1
            pieces = -(-counts // length)
            owner = np.repeat(np.arange(len(counts)), pieces)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sizes = np.minimum(counts[owner] - place * length, length)
            ends = np.cumsum(sizes)
            bodies = [squeeze(ids[start:end]) for start, end in zip(
                (ends - sizes).tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [column_like(batch, "doc_id").take(pa.array(owner)), pa.array(place),
                 pa.array(sizes), pa.array(bodies, pa.binary())],
                names=["doc_id", "piece", "n_tokens", "body"])

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                         F.col(text).alias("text"))
    return source.mapInArrow(run, "doc_id long, piece long, n_tokens long, body binary")


def sequence_counts(docs: DataFrame, ranks: str, pattern: str, length: int = LENGTH,
                    text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(task, n): how many sequences each task of ``sequences`` makes of the same documents.

    A pass of its own: to count takes a fraction of what it takes to keep all ids on disk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, count = rank_encoder(ranks, pattern).counts, 0
        for batch in small_batches(batches):
            count += int((counts(column_like(batch, "text")) // length + 1).sum())
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], names=["n"])

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                         F.col(text).alias("text"))
    return source.mapInArrow(run, "n long").select(F.spark_partition_id().alias("task"), "n")


def numbered(rows: DataFrame, counts: DataFrame) -> tuple[DataFrame, int]:
    """Rows with a number from 0 without a gap, and how many there are.

    Numbers follow the tasks that make the rows, by a window over one row per task.
    A scan is cut into the same tasks each time; a row beyond its task's count, which
    would mean that the input has changed, stops the job.
    """
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = landed(counts.groupBy("task").agg(F.sum("n").alias("n")).select(
        F.col("task").alias("_task"), "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias(
            "_from")), "offsets")
    count = offsets.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    inside = F.monotonically_increasing_id().bitwiseAND((1 << TASK) - 1)
    marked = rows.withColumn("_task", F.spark_partition_id()).withColumn("_inside", inside)
    found = marked.join(F.broadcast(offsets), "_task")  # one row per task
    number = F.when(F.col("_inside") < F.col("n"), F.col("_from") + F.col("_inside")).otherwise(
        F.raise_error(F.lit("the documents changed between counting and writing")))
    return found.withColumn("number", number).drop("_task", "_from", "_inside", "n"), count


def materialise(rows: DataFrame, counts: DataFrame, folder: str, key: int = 1, length: int = LENGTH,
                pad_id: int = 50256, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Write the shards and return their index (slot, shard, doc_id, piece, n_tokens,
    record_crc32, the checksum of the whole stored record).

    ``rows`` and ``counts`` come from ``sequences`` and ``sequence_counts`` of the same
    documents; more or fewer rows than counted stop the job.

    One task writes one shard, under a name of its own that is then moved into place,
    so a repeated or doubled task leaves the same whole file. No rows write nothing.
    """
    placed, count = numbered(rows, counts)

    @F.pandas_udf("long")
    def slot_of(numbers):
        import pandas as pd

        return pd.Series(permuted(numbers.to_numpy(), count, key))

    schema = pa.schema([("slot", pa.int64()), ("shard", pa.int32()), ("doc_id", pa.int64()),
                        ("piece", pa.int64()), ("n_tokens", pa.int64()),
                        ("record_crc32", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        import zstandard
        from pyarrow import fs

        expand = zstandard.ZstdDecompressor()
        padding = np.full(length, pad_id, "<u2").tobytes()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        open_shard, stream, name = None, None, ""

        def close() -> None:
            if stream is not None:
                stream.close()
                store.move(name, f"{root}/{shard_name(open_shard)}")

        for batch in batches:
            sums = []
            for shard, body in zip(column_like(batch, "shard").to_pylist(),
                                   column_like(batch, "body"), strict=True):
                if shard != open_shard:
                    close()
                    open_shard, name = shard, f"{root}/_{uuid.uuid4().hex}"
                    stream = store.open_output_stream(name)
                data = expand.decompress(body.as_buffer())
                record = data + padding[len(data):]
                stream.write(record)
                sums.append(zlib.crc32(record))
            yield pa.RecordBatch.from_arrays(
                [*(column_like(batch, n) for n in schema.names[:-1]), pa.array(sums, pa.int64())],
                schema=schema)
        close()

    shards = -(-count // shard_rows)
    dealt = placed.withColumn("slot", slot_of("number")).withColumn(
        "shard", (F.col("slot") / shard_rows).cast("int"))
    ranged = dealt.repartitionById(max(shards, 1), F.col("shard")).sortWithinPartitions("slot")
    index = landed(ranged.select("slot", "shard", "doc_id", "piece", "n_tokens", "body").mapInArrow(
        write, "slot long, shard int, doc_id long, piece long, n_tokens long, record_crc32 long"),
        "index")
    written = index.count()  # no task has more rows than counted, so equal sums are equal counts
    if written != count:
        raise RuntimeError(f"{written} sequences were written, {count} were counted")
    return index


def shard_name(shard: int) -> str:
    return f"shard-{shard:06d}.bin"


def read_slots(spark: SparkSession, folder: str, index: DataFrame, length: int = LENGTH,
               first: int = 0, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(slot, ids) from a slot on, read in order from each shard: one task per shard."""
    stride = 2 * length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                slot = max(first, shard * shard_rows)
                with store.open_input_file(f"{root}/{shard_name(shard)}") as file:
                    file.seek((slot - shard * shard_rows) * stride)
                    while data := file.read(stride * 1024):
                        rows = [data[i:i + stride] for i in range(0, len(data), stride)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(range(slot, slot + len(rows)), pa.int64()),
                             pa.array(rows, pa.binary())], names=["slot", "ids"])
                        slot += len(rows)

    shards = index.filter(F.col("slot") >= first).select("shard").distinct()
    return shards.repartition("shard").mapInArrow(run, "slot long, ids binary")
