"""Records whose closing tag stands inside CDATA or a comment: chunks glued together.

The text reader cuts at every closing tag, also at those that are only text. Each chunk
is a small state transition: given whether it begins in text, in CDATA or in a comment, it
tells where it ends. Transitions compose, so every part of a file block is scanned for
itself for all three beginnings, one row a part is carried through a file, and then each part
knows the state it begins in and which of its chunks belong together. Only chunks that hold a
section mark take part, and only chunks that are glued are shuffled with their text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrain.functions.arrays import let
from lexigrain.operators.joins import fits_broadcast
from lexigrain.operators.once import with_once
from lexigrain.session import landed

TEXT, CDATA, COMMENT = range(3)
PART = 16  # bits of a chunk's row within a part of a block
NEXT = [(code // 9, code // 3 % 3, code % 3) for code in range(27)]  # states by code
BUCKET = 8  # bits of a chunk's row within one entry of the table of glued chunks
_SECTION = r"(?s)<!\[CDATA\[.*?(?:\]\]>|\z)|<!--.*?(?:-->|\z)"
_PIECE = (r"(?s)(<!\[CDATA\[.*?\]\]>|<!--.*?-->"
          r"|(?:[^<]++|<(?!!(?:\[CDATA\[|--)))++|<)")


def place() -> Column:
    """Where a chunk stands: file, start of its block, and row, in the order of the reader."""
    return F.struct(F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("row"))


def state_after(text: Column) -> Column:
    """Where a text that begins outside of sections ends: in its last section, if unclosed."""
    last = F.try_element_at(F.regexp_extract_all(text, F.lit(_SECTION), F.lit(0)), F.lit(-1))
    return let(last, lambda s: (
        F.when(s.startswith("<![CDATA[") & ~s.rlike(r"(?s)^<!\[CDATA\[.*\]\]>\z"), CDATA)
        .when(s.startswith("<!--") & ~s.rlike(r"(?s)^<!--.*-->\z"), COMMENT).otherwise(TEXT)))


def transition(text: Column) -> Column:
    """The states a text ends in when it begins in text, CDATA or a comment; null if in the same."""

    def after(mark: str, state: int) -> Column:
        at = F.instr(text, mark)
        return F.when(at > 0, state_after(F.substr(text, at + len(mark)))).otherwise(state)

    marked = (text.contains("<![CDATA[") | text.contains("<!--") | text.contains("]]>")
              | text.contains("-->"))
    return F.when(marked, F.array(state_after(text), after("]]>", CDATA), after("-->", COMMENT)))


def plain_sections(text: Column) -> Column:
    """A text without comments, and with CDATA as escaped text."""

    def plain(piece: Column) -> Column:
        body = F.substr(piece, F.lit(10), F.length(piece) - 12)
        for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            body = F.replace(body, F.lit(char), F.lit(entity))
        return F.when(piece.startswith("<![CDATA[") & piece.endswith("]]>"), body).when(
            piece.startswith("<!--"), "").otherwise(piece)

    pieces = F.regexp_extract_all(text, F.lit(_PIECE), F.lit(1))
    return F.when(text.contains("<![CDATA[") | text.contains("<!--"),
                  F.array_join(F.transform(pieces, plain), "")).otherwise(text)


def _transition_code(text: Column) -> Column:
    """The three states of ``transition`` as one number of base 3; null stays null."""
    return F.aggregate(transition(text), F.lit(0), lambda code, state: code * 3 + state)


def _parts(chunks: DataFrame) -> DataFrame:
    """(file, block, part, first, last, at, codes, states, opened): the chunks of a block in
    parts of ``PART`` bits of their row.

    ``at`` and ``codes`` hold the chunks with section marks (place in the part, transition),
    ``states`` is the transition of the whole part. ``opened`` is the row whose section is
    open at its end, null if that began before. One pass over the files.
    """
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("part", pa.int64()),
                        ("first", pa.int64()), ("last", pa.int64()), ("at", pa.binary()),
                        ("codes", pa.binary()), ("states", pa.list_(pa.int32())),
                        ("opened", pa.list_(pa.int64()))])

    def ended(key: tuple, first: int, last: int, at: list, codes: list) -> tuple:
        at, codes = np.concatenate(at).astype(np.int32), np.concatenate(codes).astype(np.int8)
        found = [_end_state(at, codes, start) for start in range(3)]
        return (*key, first, last, at.tobytes(), codes.tobytes(), [s for s, _ in found],
                [None if o is None else first + o for _, o in found])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            file, block, row, code = batch.columns
            block, row = block.to_numpy(), row.to_numpy()
            code = code.fill_null(-1).to_numpy()
            part = row >> PART
            other = (block[1:] != block[:-1]) | (part[1:] != part[:-1]) | pc.not_equal(
                file.slice(1), file.slice(0, len(file) - 1)).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(other) + 1).tolist(), len(row)]
            done = []
            for start, stop in zip(cuts, cuts[1:], strict=False):
                key = (file[start].as_py(), int(block[start]), int(part[start]))
                if held is None or held[0] != key:
                    done += [ended(*held)] if held else []
                    held = [key, int(row[start]), 0, [], []]
                marked = start + np.flatnonzero(code[start:stop] >= 0)
                held[2] = int(row[stop - 1])
                held[3].append(row[marked] - held[1])
                held[4].append(code[marked])
            if done:
                yield _batch(done, schema)
        if held:
            yield _batch([ended(*held)], schema)

    rows = with_once(chunks, "_code", _transition_code(F.col("value"))).select(
        F.col("pos.file").alias("file"), F.col("pos.block").alias("block"),
        F.col("pos.row").alias("row"), "_code")
    return landed(rows.mapInArrow(
        run, "file string, block long, part long, first long, last long, at binary, "
             "codes binary, states array<int>, opened array<long>"), "xml-marks")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)],
        names=schema.names)


def _end_state(at: np.ndarray, codes: np.ndarray, state: int) -> tuple[int, int | None]:
    """The state after some transitions, and the place that opened its section."""
    opened = None
    for place_, code in zip(at.tolist(), codes.tolist(), strict=True):
        now = NEXT[code][state]
        if now == TEXT:
            opened = None
        elif state == TEXT:
            opened = place_
        state = now
    return state, opened


def _part_starts(parts: DataFrame) -> DataFrame:
    """(file, block, part, state, key_block, key_row, lost_block, lost_row, tail): how each
    part begins, which section of its file is never closed, and the last row of the file."""

    def run(frame):
        frame = frame.sort_values(["block", "part"])
        state, key, starts = TEXT, (-1, -1), []
        for block, states, opened in zip(frame["block"], frame["states"], frame["opened"],
                                         strict=True):
            starts.append((state, *key))
            row, state = opened[state], int(states[state])
            if state == TEXT:
                key = (-1, -1)
            elif row is not None and row == row:
                key = (int(block), int(row))
        last = int(frame["last"].iloc[-1])
        out = frame[["file", "block", "part"]].copy()
        for at, name in enumerate(("state", "key_block", "key_row")):
            out[name] = [s[at] for s in starts]
        out["lost_block"], out["lost_row"] = key
        out["tail"] = [None] * (len(out) - 1) + [last]
        return out

    return parts.select("file", "block", "part", "last", "states", "opened").groupBy(
        "file").applyInPandas(
        run, "file string, block long, part long, state int, key_block long, key_row long, "
             "lost_block long, lost_row long, tail long")


def _glued_rows(parts: DataFrame, starts: DataFrame) -> DataFrame:
    """(file, block, bucket, _at, _back, _tail): for each bucket of a block the chunks that are
    glued, in two arrays: place in the bucket, and how far behind the first chunk of the whole
    is. ``_tail`` is the last row of the file, if it is here. A bucket lies in one part."""
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("bucket", pa.int64()),
                        ("_at", pa.list_(pa.int32())), ("_back", pa.list_(pa.int64())),
                        ("_tail", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                spans = np.array(_spans(part), np.int64).reshape(-1, 3)
                sizes = spans[:, 1] - spans[:, 0] + 1
                before = np.cumsum(sizes) - sizes
                rows = np.arange(sizes.sum()) + np.repeat(spans[:, 0] - before, sizes)
                back = rows - np.repeat(spans[:, 2], sizes)
                tail = part["tail"]
                buckets, first = np.unique(rows >> BUCKET, return_index=True)
                if tail is not None and tail >> BUCKET not in buckets:
                    place_ = np.searchsorted(buckets, tail >> BUCKET)
                    first = np.insert(first, place_, first[place_] if place_ < len(first)
                                      else len(rows))
                    buckets = np.insert(buckets, place_, tail >> BUCKET)
                if not len(buckets):
                    continue
                offsets = pa.array(np.append(first, len(rows)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part["file"]] * len(buckets)),
                     pa.array([part["block"]] * len(buckets), pa.int64()), pa.array(buckets),
                     pa.ListArray.from_arrays(
                         offsets, pa.array((rows & ((1 << BUCKET) - 1)).astype(np.int32))),
                     pa.ListArray.from_arrays(offsets, pa.array(back)),
                     pa.array([None if tail is None or tail >> BUCKET != b else tail
                               for b in buckets.tolist()], pa.int64())], schema=schema)

    entered = parts.drop("states", "opened").join(starts, ["file", "block", "part"])
    return entered.mapInArrow(run, "file string, block long, bucket long, _at array<int>, "
                                   "_back array<long>, _tail long")


def _spans(part: dict) -> list[tuple[int, int, int]]:
    """(first, last, key row) of the chunks of a part that one section joins."""
    base, state, out = part["first"], part["state"], []
    lost = (part["lost_block"], part["lost_row"])
    first, key = base, (part["key_block"], part["key_row"])
    at = np.frombuffer(part["at"], np.int32).tolist()
    for place_, code in zip(at, np.frombuffer(part["codes"], np.int8).tolist(), strict=True):
        now = NEXT[code][state]
        if state == TEXT and now != TEXT:
            first = base + place_
            key = (part["block"], first)
        elif state != TEXT and now == TEXT and key != lost:
            out.append((first, base + place_, key[1]))
        state = now
    if state != TEXT and key != lost:
        out.append((first, part["last"], key[1]))
    return out


def _bucket(row: Column) -> Column:
    return F.shiftright(row, BUCKET)


def _in_bucket(row: Column) -> Column:
    return row.bitwiseAND(F.lit((1 << BUCKET) - 1)).cast("int")


def glue_sections(chunks: DataFrame, closing: str) -> DataFrame:
    """(value, pos, tail): chunks joined where a section goes over a closing tag.

    ``chunks`` has ``value`` and ``pos`` (:func:`place`) as the reader gives them. A joined
    chunk stands where its first one stood; ``tail`` tells the last chunk of a file. A
    section that is never closed joins nothing. Reads the files once at once, to find the
    marks, and once or, if chunks are to be joined, twice for the result.
    """
    parts = _parts(chunks)
    table = landed(_glued_rows(parts, _part_starts(parts)), "xml-glued")

    row = F.col("pos.row")
    keyed = chunks.select("value", "pos", F.col("pos.file").alias("file"), F.col("pos.block").alias(
        "block"), _bucket(row).alias("bucket"))
    # a key holds the chunks of one bucket at most, so a join by shuffle needs no salt
    found = keyed.join(F.broadcast(table) if fits_broadcast(table) else table,
                       ["file", "block", "bucket"], "left")
    place_of = F.array_position("_at", _in_bucket(row)).cast("int")
    found = found.withColumn("_key", row - F.get("_back", place_of - 1))
    tail = F.coalesce(row == F.col("_tail"), F.lit(False)).alias("tail")
    alone = found.filter("_key is null").select("value", "pos", tail)
    if table.filter(F.size("_at") > 0).isEmpty():
        return alone
    joined = found.filter("_key is not null").groupBy("file", "_key").agg(
        F.sort_array(F.collect_list(F.struct("pos.block", "pos.row", "value", tail))).alias("_parts"))
    return alone.unionByName(joined.select(
        F.array_join("_parts.value", closing).alias("value"),
        F.struct("file", F.get("_parts.block", F.lit(0)).alias("block"), F.col("_key").alias("row")).alias(
            "pos"), F.element_at("_parts.tail", -1).alias("tail")))
