"""Token ids of a byte-level BPE from public libraries.

No pre-token of such a tokenizer spans the place between a character and the white
space after it, so a text may be encoded run by run (white space with the word after
it). The runs of many texts are found and told apart in whole Arrow columns; the
libraries get the distinct ones only, and the ids of all runs are put together again by
their places. Added tokens contain no white space, so a library still sees them whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lexigrain.llm.token_table import token_bytes

#: The characters with the Unicode property White_Space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"
BYTES = 8 << 20  # bytes of texts whose runs are told apart at a time
JOINED = 4096  # distinct runs that a library gets as one text
SPLICED = 1 << 17  # runs whose ids are put together at a time
WHITE = np.zeros(256, bool)  # ASCII white space: runs are cut before it
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: The last two bytes of the other characters of white space.
WHITE_ENDS = np.asarray([int.from_bytes(c.encode()[-2:], "big") for c in map(chr, range(128, 0x3001))
                         if re.fullmatch(f"[{SPACES}]", c)], np.uint16)


def bytes_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The offsets and the bytes of a string or binary array without nulls."""
    _, offsets, data = values.buffers()
    if not len(values):
        return np.zeros(1, np.int32), np.empty(0, np.uint8)
    offsets = np.frombuffer(offsets, np.int32)[values.offset:values.offset + len(values) + 1]
    data = np.empty(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return offsets - offsets[0], data[offsets[0]:offsets[-1]]


def after_white(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Does white space (maybe outside ASCII) end at these places?"""
    last = data[places - 1]
    out = WHITE[last]
    high = np.flatnonzero(last >= 128)
    pairs = data[places[high] - 2].astype(np.uint16) << np.uint16(8) | last[high]
    out[high] = np.isin(pairs, WHITE_ENDS)
    return out


def runs_of(texts: pa.Array, block: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The runs of texts and the place of the text of each, about ``block`` bytes at a time."""
    offsets, data = bytes_of(texts)
    low, size = 0, block
    while low < len(data):
        high = min(low + size, len(data))
        part = data[low:high]
        white = WHITE[part]
        starts = np.flatnonzero(white[1:] & ~white[:-1]) + 1
        begins = np.zeros(len(part), bool)
        begins[starts[~after_white(part, starts)]] = True
        begins[offsets[np.searchsorted(offsets, low):np.searchsorted(offsets, high)] - low] = True
        begins[0] = True
        starts = np.flatnonzero(begins)
        if high < len(data):  # what follows the last start may go on beyond the part
            if len(starts) == 1:
                size *= 2
                continue
            high, starts = low + int(starts[-1]), starts[:-1]
        ends = np.append(starts, high - low).astype(np.int32)
        yield pa.Array.from_buffers(
            pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data[low:high])]
        ), np.searchsorted(offsets, starts + low, side="right") - 1
        low, size = high, block


def joinable(runs: pa.Array) -> tuple[np.ndarray, int]:
    """An order that puts runs of ASCII white space and a word first, and how many these are."""
    offsets, data = bytes_of(runs)
    joined = WHITE[data[offsets[:-1]]] & ~after_white(data, offsets[1:])
    return np.argsort(~joined, kind="stable"), int(joined.sum())


def spliced(flat: np.ndarray, ends: np.ndarray, index: np.ndarray,
            sizes: np.ndarray) -> np.ndarray:
    """The values of runs in a row; those of run i begin at ``ends[i]``."""
    stops = np.cumsum(sizes)
    out = np.empty(stops[-1] if len(stops) else 0, flat.dtype)
    for low in range(0, len(index), SPLICED):
        size, stop = sizes[low:low + SPLICED], stops[low:low + SPLICED]
        first, last = stop[0] - size[0], stop[-1]
        shift = ends[index[low:low + SPLICED]] - (stop - size)
        out[first:last] = flat[np.repeat(shift, size) + np.arange(first, last)]
    return out


class Encoder:
    """Encode texts by their distinct runs.

    The ids of runs are remembered from block to block until they and the runs take more
    than ``limit`` bytes; then all are forgotten.
    """

    def __init__(self, sizes: np.ndarray, dtype: str, limit: int, block: int):
        self.sizes, self.dtype, self.limit, self.block = sizes, dtype, limit, block
        self._forget()

    def _forget(self) -> None:
        self.runs = pa.array([], pa.binary())
        self.flat, self.ends = np.empty(0, self.dtype), np.zeros(1, np.int64)

    def library(self, texts: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has (null: none)."""
        parts, counts = [np.empty(0, self.dtype)], np.zeros(len(texts), np.int64)
        for index, owner in self._blocks(texts):
            sizes = np.diff(self.ends)[index]
            counts += np.bincount(owner, sizes, len(counts)).astype(np.int64)
            parts.append(spliced(self.flat, self.ends, index, sizes))
        return np.concatenate(parts), counts

    def counts(self, texts: pa.Array) -> np.ndarray:
        """How many ids each text has."""
        counts = np.zeros(len(texts), np.int64)
        for index, owner in self._blocks(texts):
            counts += np.bincount(owner, np.diff(self.ends)[index], len(counts)).astype(np.int64)
        return counts

    def _blocks(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per run its place among the known runs and that of its text, by blocks."""
        for runs, owner in runs_of(pc.fill_null(texts.cast(pa.string()), ""), self.block):
            coded = runs.dictionary_encode()
            yield self._places(coded.dictionary)[coded.indices.to_numpy()], owner

    def _places(self, distinct: pa.Array) -> np.ndarray:
        """Places of runs among the known ones; unknown ones are encoded."""
        if self.runs.nbytes + self.flat.nbytes + self.ends.nbytes > self.limit:
            self._forget()
        found = pc.index_in(self.runs, value_set=distinct)  # the table of the few takes less
        known = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
        places = np.full(len(distinct), -1)
        places[found.drop_null().to_numpy()] = known
        fresh = np.flatnonzero(places < 0)
        if len(fresh):
            order, ids, counts = self._encode(distinct.take(pa.array(fresh)))
            fresh = fresh[order]
            places[fresh] = len(self.runs) + np.arange(len(fresh))
            self.runs = pa.concat_arrays([self.runs, distinct.take(pa.array(fresh))])
            self.flat = np.concatenate([self.flat, *ids])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])
        return places

    def _encode(self, runs: pa.Array) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Encode distinct runs: the order they come in, their ids, how many each has."""
        order, joined = joinable(runs)
        runs = runs.take(pa.array(order))
        offsets, data = bytes_of(runs)
        ids, counts = [], []
        for low in range(0, joined, JOINED):
            ends = offsets[low:min(low + JOINED, joined) + 1]
            found = self._encode_joined(data[ends[0]:ends[-1]].tobytes().decode(), ends[1:] - ends[0])
            for part, sizes in found or self._encode_single(runs[low:low + len(ends) - 1]):
                ids.append(part)
                counts.append(sizes)
        for part, sizes in self._encode_single(runs[joined:]):
            ids.append(part)
            counts.append(sizes)
        return order, ids, np.concatenate(counts)

    def _encode_single(self, runs: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for low in range(0, len(runs), JOINED):
            found = self.library(runs[low:low + JOINED].cast(pa.string()).to_pylist())
            yield (np.concatenate([np.asarray(ids, self.dtype) for ids in found]),
                   np.asarray([len(ids) for ids in found]))

    def _encode_joined(self, text: str, run_ends: np.ndarray):
        """Encode runs of white space and a word as one text, cut where their bytes end.

        None if a token goes over the end of a run.
        """
        (found,) = self.library([text])
        ids = np.asarray(found, self.dtype)
        ends = np.cumsum(self.sizes[ids])
        cuts = np.searchsorted(ends, run_ends)
        if ends[-1] != run_ends[-1] or (ends[cuts] != run_ends).any():
            return None
        return [(ids, np.diff(cuts + 1, prepend=0))]


class RunEncoder(Encoder):
    """Unsigned 32-bit ids of a file of the tokenizers library, without special tokens added."""

    def __init__(self, path: str, limit: int = 40 << 20, block: int = BYTES):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        super().__init__(np.asarray([len(token) for token in token_bytes(path)]), "<u4", limit,
                         block)

    def library(self, texts: list[str]) -> list[list[int]]:
        return [found.ids for found in self.tokenizer.encode_batch_fast(
            texts, add_special_tokens=False)]

    def ids(self, text: str) -> np.ndarray:
        return self.encode(pa.array([text], pa.string()))[0]


_encoders: dict[str, RunEncoder] = {}


def encoder(path: str) -> RunEncoder:
    """The encoder of this worker process for a file; it outlives a task."""
    if path not in _encoders:
        _encoders[path] = RunEncoder(path)
    return _encoders[path]


class RankEncoder(Encoder):
    """Unsigned 16-bit ids under a rank file.

    ``pattern`` splits text before the merges. Strings of special tokens are plain text.
    Nothing is remembered between blocks: to look runs up takes as long as to encode them.
    """

    def __init__(self, path: str, pattern: str, block: int = BYTES):
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        if max(ranks.values()) >= 1 << 16:
            raise ValueError("ids do not fit into 16 bits")
        self.merge = tiktoken.Encoding(
            "ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        super().__init__(sizes, "<u2", 0, block)

    def library(self, texts: list[str]) -> list[list[int]]:
        return list(map(self.merge, texts))

    def ids(self, text: str) -> bytes:
        return self.encode(pa.array([text], pa.string()))[0].tobytes()

    def count(self, text: str) -> int:
        return int(self.counts(pa.array([text], pa.string()))[0])


_rank_encoders: dict[tuple[str, str], RankEncoder] = {}


def rank_encoder(path: str, pattern: str) -> RankEncoder:
    """The encoder of this worker process for a rank file; it outlives a task."""
    if (path, pattern) not in _rank_encoders:
        _rank_encoders[path, pattern] = RankEncoder(path, pattern)
    return _rank_encoders[path, pattern]
