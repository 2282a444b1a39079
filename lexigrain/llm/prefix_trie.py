"""Byte-pair encoding by walking a trie of distinct words.

A sequence of tokens is the encoding of its text exactly when each token encodes to
itself and no merge would cross the border of two neighbours before both are complete.
So the encoding of a prefix is that of a shorter one and a last token, and only one last
token fits. The distinct words of a block of texts form a trie; a depth-first walk gives
every node its last token from those of the nodes above it, so a prefix that words share
is encoded once, and a word is read off by stepping back over its last tokens.

The trie is laid out by its depth-first order: sorted words, each of which leaves the path
of the word before it at the depth of their common prefix. It takes the memory of the
words and, for the path, of the longest one.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lexigrain.llm.bpe import BYTES, JOINED, Encoder, bytes_of, joinable, spliced
from lexigrain.llm.common import column_like, small_batches
from lexigrain.llm.token_table import byte_letters, token_bytes

NEVER = 1 << 30  # the rank of a merge that does not happen
IDS = 1 << 20  # ids of a long text that are decoded at a time


def common_prefix(a: str, b: str) -> int:
    """Length of the common prefix, by halving: one comparison a step, whatever the length."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Merges:
    """The tokens and merges of a byte-level BPE file, and which tokens may be neighbours."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model, before = data["model"], data.get("pre_tokenizer") or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix",
                           "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if odd or data.get("normalizer") or before.get("type") != "ByteLevel" or before.get(
                "add_prefix_space"):
            raise ValueError(f"not a plain byte-level file: {odd or before}")
        added = data.get("added_tokens") or []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("added tokens with conditions are not supported")
        self.vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in added}
        size = max([*self.vocab.values(), *self.added.values()]) + 1
        self.size = size
        self.parents = [(-1, -1)] * size
        self.rank = [NEVER] * size
        self.pair_rank: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            token, a, b = self.vocab[left + right], self.vocab[left], self.vocab[right]
            ordered = all(self.rank[t] < rank or self.parents[t] == (-1, -1) for t in (a, b))
            if self.rank[token] != NEVER or not ordered:
                raise ValueError("a token with two merges, or a merge before its parts")
            self.parents[token], self.rank[token] = (a, b), rank
            self.pair_rank[a * size + b] = rank
        self.right_spines: dict[int, list] = {}
        self.left_spines: dict[int, list] = {}
        self.allowed: dict[int, bool] = {}
        letters = byte_letters()
        self.bytes = [b""] * size
        whole = set()
        for text, token in self.vocab.items():
            if text in self.added:
                continue
            self.bytes[token] = bytes(map(letters.__getitem__, text))
            if len(text) == 1:
                whole.add(token)
        for token in sorted((t for t in self.vocab.values() if self.rank[t] != NEVER),
                            key=self.rank.__getitem__):
            a, b = self.parents[token]
            if a in whole and b in whole and self._crossing(a, b) == self.rank[token]:
                whole.add(token)
        for text, token in self.added.items():
            self.bytes[token] = text.encode()
        #: Every ending of a token that encodes to itself, and that token or -1.
        self.endings: dict[str, int] = {}
        for text, token in self.vocab.items():
            if token in whole:
                for at in range(1, len(text)):
                    self.endings.setdefault(text[at:], -1)
                self.endings[text] = token

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """Parts of a token along one edge, smallest first, with the rank that merges each on."""
        spines = self.right_spines if side else self.left_spines
        if token not in spines:
            spine, at, consumed = [], token, NEVER
            while at >= 0:
                spine.append((at, consumed))
                at, consumed = self.parents[at][side], self.rank[at]
            spines[token] = spine[::-1]
        return spines[token]

    def _crossing(self, a: int, b: int) -> int:
        """The rank of the first merge over the border of two tokens, or ``NEVER``.

        Merges happen in the order of their ranks, equal ones from left to right: a part
        at the border is there until the merge that consumes it.
        """
        ends, starts = self._spine(a, 1), self._spine(b, 0)
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = ends[i], starts[j]
            rank = self.pair_rank.get(x * self.size + y, NEVER)
            if rank < x_until and rank <= y_until and rank != NEVER:
                return rank
            if x_until <= y_until:
                if x_until == NEVER:
                    return NEVER
                i += 1
            else:
                j += 1

    def neighbours(self, a: int, b: int) -> bool:
        """Whether token ``b`` may follow token ``a`` in an encoding."""
        key = a * self.size + b
        known = self.allowed.get(key)
        if known is None:
            if len(self.allowed) > 1 << 20:
                self.allowed.clear()
            known = self.allowed[key] = self._crossing(a, b) == NEVER
        return known


class TrieEncoder(Encoder):
    """Ids of texts; runs of white space and letters are remembered, new words go to a trie."""

    def __init__(self, path: str, limit: int = 48 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.merges = Merges(path)
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.lengths = list(map(len, self.merges.bytes))
        super().__init__(np.asarray(self.lengths), "<u4", limit, BYTES)

    def words_of(self, run: str) -> list[str | int]:
        """The words of a run, in letters that stand for bytes, and ids of added tokens."""
        for text, token in self.merges.added.items():
            if text in run:
                parts = run.split(text)
                words = self.words_of(parts[0])
                for part in parts[1:]:
                    words += [token, *self.words_of(part)]
                return words
        return [word for word, _ in self.split(run)] if run else []

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of sorted distinct words, and how many each has, by a depth-first walk."""
        endings, merges, lengths = self.merges.endings, self.merges, self.lengths
        allowed, across = merges.allowed, merges.size
        last, before, found, counts = array("i", [-1]), "", array("I"), array("i")
        for word in words:
            depth = common_prefix(before, word)
            del last[depth + 1:]
            for end in range(depth + 1, len(word) + 1):
                fits, start = [], end - 1
                while start >= 0 and (token := endings.get(word[start:end])) is not None:
                    if token >= 0:
                        fits.append((start, token))
                    start -= 1
                for start, token in reversed(fits):
                    if start == 0:
                        break
                    known = allowed.get(last[start] * across + token)
                    if merges.neighbours(last[start], token) if known is None else known:
                        break
                else:
                    raise ValueError(f"no token ends {word[max(0, end - 20):end]!r}")
                last.append(token)
            ids, end = [], len(word)
            while end:
                token = last[end]
                ids.append(token)
                end -= lengths[token]
            counts.append(len(ids))
            found.extend(ids[::-1])
            before = word
        return np.frombuffer(found, "<u4"), np.frombuffer(counts, np.int32)

    def _encode(self, runs: pa.Array) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Encode distinct runs: all their distinct words share a trie."""
        order, joined = joinable(runs)
        runs = runs.take(pa.array(order))
        offsets, data = bytes_of(runs)
        numbers: dict[str | int, int] = {}
        parts, counts = [], []
        for low in range(0, len(runs), JOINED):
            high = min(low + JOINED, len(runs))
            words = None
            if high <= joined:
                text = data[offsets[low]:offsets[high]].tobytes().decode()
                words, sizes = self._split_joined(text, offsets[low + 1:high + 1] - offsets[low])
            if words is None:
                found = [self.words_of(run) for run in
                         runs[low:high].cast(pa.string()).to_pylist()]
                words = [word for run in found for word in run]
                sizes = np.fromiter(map(len, found), np.int64, len(found))
            parts.append(np.fromiter((numbers.setdefault(word, len(numbers)) for word in words),
                                     np.int64, len(words)))
            counts.append(sizes)
        words = sorted(word for word in numbers if isinstance(word, str))
        flat, sizes = self.encode_words(words)
        tokens = [word for word in numbers if not isinstance(word, str)]  # added ones
        flat = np.concatenate([flat, np.asarray(tokens, "<u4")])
        sizes = np.concatenate([sizes, np.ones(len(tokens), np.int32)])
        places = np.empty(len(numbers), np.int64)
        places[np.fromiter(map(numbers.__getitem__, [*words, *tokens]), np.int64,
                           len(numbers))] = np.arange(len(numbers))
        index = places[np.concatenate(parts)]
        found = spliced(flat, np.append(0, np.cumsum(sizes)), index, sizes[index])
        counts = np.concatenate(counts)
        return order, [found], np.add.reduceat(sizes[index], np.cumsum(counts) - counts)

    def _split_joined(self, text: str, run_ends: np.ndarray):
        """The words of runs that were joined to one text, and how many each run has.

        None if an added token is in the text or a word goes over the end of a run.
        """
        if any(added in text for added in self.merges.added):
            return None, None
        words = [word for word, _ in self.split(text)]
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        cuts = np.searchsorted(ends, run_ends)
        if ends[-1] != run_ends[-1] or (ends[cuts] != run_ends).any():
            return None, None
        return words, np.diff(cuts + 1, prepend=0)

    encode_column = Encoder.encode

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        ids, counts = self.encode_column(pa.array(texts, pa.string()))
        ends = np.cumsum(counts)
        return [ids[end - size:end].tobytes() for end, size in zip(ends, counts, strict=True)]


_encoders: dict[str, TrieEncoder] = {}


def trie_encoder(path: str) -> TrieEncoder:
    """The encoder of this worker process for a file; it outlives a task."""
    if path not in _encoders:
        _encoders[path] = TrieEncoder(path)
    return _encoders[path]


def encode(docs: DataFrame, tokenizer: str, text: str = "text",
           doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids): the token ids of every whole text, without shuffle.

    ``tokenizer`` is the path of a byte-level BPE file of the tokenizers library. Added
    tokens inside a text get their own ids, as the library's default is; nothing is added,
    cut or padded. Null and empty texts have no ids. Repeated rows and ids stay; other
    columns are not read. A long text is worked on a block at a time, its ids are one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = trie_encoder(tokenizer)
        for batch in small_batches(batches):
            ids, sizes = encoder.encode_column(column_like(batch, "text"))
            offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
            values = pa.Array.from_buffers(pa.int32(), len(ids), [None, pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays(
                [column_like(batch, "doc_id"), pa.array(sizes),
                 pa.ListArray.from_arrays(pa.array(offsets), values)],
                names=["doc_id", "n_tokens", "ids"])

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str, ids: str = "ids") -> DataFrame:
    """Replaces the ids by ``decoded``, the text they stand for; other columns pass.

    Added tokens give their own text. Bytes that are no UTF-8 become U+FFFD. Null ids
    give a null text, an id that the file does not have stops the job. No shuffle.
    """
    kept = [f for f in encoded.schema.fields if f.name not in (ids, "decoded")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(tokenizer)
        for batch in batches:
            column = column_like(batch, "_ids")
            values = column.values.to_numpy(zero_copy_only=False)
            offsets, texts = column.offsets.to_pylist(), []
            for row, known in enumerate(column.is_valid().to_pylist()):
                data = bytearray()
                for start in range(offsets[row], offsets[row + 1], IDS):
                    part = values[start:min(start + IDS, offsets[row + 1])].tolist()
                    data += b"".join(map(table.__getitem__, part))
                texts.append(data.decode("utf-8", "replace") if known else None)
            yield pa.RecordBatch.from_arrays(
                [*(column_like(batch, f.name) for f in kept), pa.array(texts, pa.string())],
                names=[*(f.name for f in kept), "decoded"])

    source = encoded.select(*(f.name for f in kept), F.col(ids).alias("_ids"))
    return source.mapInArrow(run, StructType([*kept, StructField("decoded", StringType())]))
