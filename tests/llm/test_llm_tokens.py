import os
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as TOKENIZERS
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lexigrain.llm import packing, token_counts, training_order
from lexigrain.llm.bpe import RankEncoder, RunEncoder
from lexigrain.session import shared_path
from llm_samples import prose, sample_texts


def odd_texts(seed=5, count=120):
    rng = random.Random(seed)
    letters = [" ", " ", "\n", "\t", "a", "b", "é", "漢", "🙂", "</s>", "▁", "<|endoftext|>", "!",
               "'s", "\xa0", "\x1c", "\x85", "　", "12"]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 1500)))
            for _ in range(count)]


def test_runs_give_the_ids_of_whole_texts(bpe):
    encoder, whole = RunEncoder(bpe, limit=5000), Tokenizer.from_file(bpe)
    for text in [t or "" for t in sample_texts()] + odd_texts():
        assert encoder.ids(text).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_ranks_give_the_ids_of_whole_texts(bpe):
    ranks = TOKENIZERS.path("byte_bpe_50k.tiktoken"), TOKENIZERS.PATTERN
    encoders = [RankEncoder(*ranks), RankEncoder(*ranks, block=40)]
    whole = Tokenizer.from_file(bpe)
    whole.encode_special_tokens = True
    for text in [t or "" for t in sample_texts()] + odd_texts(7):
        ids = whole.encode(text, add_special_tokens=False).ids
        for encoder in encoders:
            assert np.frombuffer(encoder.ids(text), "<u2").tolist() == ids
            assert encoder.count(text) == len(ids)


@pytest.mark.parametrize("chunk,overlap", [(64, 8), (300, 16), (500, 200)])
def test_spliced_chunks_count_as_whole_texts(pieces, chunk, overlap):
    counter = token_counts.Pieces(pieces, chunk, overlap)
    whole = sentencepiece.SentencePieceProcessor(model_file=pieces)
    texts = [t or "" for t in sample_texts()] + odd_texts(6) + [
        "x" * 3000, " " * 900, "a " * 900, "▁a" * 900, "a" * 299 + " " + "b" * 900]
    assert counter.proven
    assert counter.counts(texts) == [len(ids) for ids in whole.encode(texts)]


def test_token_counts_of_a_table(spark, edge, empty, pieces):
    whole = sentencepiece.SentencePieceProcessor(model_file=pieces)
    rows = token_counts.count_tokens(edge, pieces, chunk=4096).collect()
    assert len(rows) == edge.count()
    for r in rows:
        ids = whole.encode(r.text or "")
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (
            len((r.text or "").encode()), len(ids), len(ids) > 4096)
    assert token_counts.count_tokens(empty, pieces).count() == 0


def test_lengths_of_pieces():
    for count in (1, 2, 3, 2047, 2048, 2049, 5000):
        lengths = packing.decompose(count)
        assert sum(lengths) == count and max(lengths) <= 2048
        assert all(n & (n - 1) == 0 for n in lengths)
        assert lengths == sorted(lengths, reverse=True)


def test_pieces_rebuild_their_documents(spark, edge, empty, bpe):
    whole = Tokenizer.from_file(bpe)
    rows = packing.pack(edge, bpe).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert all(r.offset == 0 and len(r.ids) == 4 * r.length for r in rows)
    got, parts = [], []
    for r in sorted(rows, key=lambda r: r.sequence_id):  # pieces of a document stand together
        assert r.start == sum(len(p) for p in parts) // 4
        parts.append(r.ids)
        if r.start + r.length == r.doc_tokens:
            got.append((str(r.doc_id), zlib.crc32(b"".join(parts))))
            parts = []
    expected = []
    for r in edge.select("doc_id", "text").collect():
        ids = whole.encode(r.text or "", add_special_tokens=False).ids + [1]
        expected.append((str(r.doc_id), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
    assert sorted(got) == sorted(expected)
    assert packing.pack(empty, bpe).count() == 0
    with pytest.raises(ValueError):
        packing.pack(edge, bpe, max_length=1000)


def test_buckets_hold_pieces_of_one_length(spark, edge, bpe, tmp_path):
    pieces = packing.pack(edge, bpe, max_length=256)
    packing.write_buckets(pieces, f"{tmp_path}/buckets")
    wanted = Counter((r.length, bytes(r.ids)) for r in pieces.collect())
    found = Counter()
    for name in (n for n in os.listdir(f"{tmp_path}/buckets") if n.startswith("length=")):
        length = int(name.removeprefix("length="))
        assert length & (length - 1) == 0 and length <= 256
        found.update((length, bytes(r.ids)) for r in spark.read.parquet(
            f"{tmp_path}/buckets/{name}").collect())
    assert found == wanted


def test_permutation_is_a_bijection():
    for count in (1, 2, 3, 7, 100, 4097, 70_000):
        numbers = np.arange(count)
        slots = training_order.permuted(numbers, count, 9)
        assert np.array_equal(np.sort(slots), numbers)
        assert np.array_equal(training_order.unpermuted(slots, count, 9), numbers)
    first = training_order.permuted(np.arange(4097), 4097, 1)
    assert not np.array_equal(first, training_order.permuted(np.arange(4097), 4097, 2))


def test_shards_hold_every_sequence_at_its_slot(spark, edge, empty, bpe):
    folder = f"file://{shared_path(spark, 'test-shards')}"
    ranks = TOKENIZERS.path("byte_bpe_50k.tiktoken"), TOKENIZERS.PATTERN
    rows = training_order.sequences(edge, *ranks, length=64)
    counts = training_order.sequence_counts(edge, *ranks, length=64)
    index = training_order.materialise(rows, counts, folder, key=3, length=64, shard_rows=100)
    placed = {r.slot: r for r in index.collect()}
    assert sorted(placed) == list(range(len(placed)))
    assert all(r.shard == r.slot // 100 for r in placed.values())
    stored = {r.slot: np.frombuffer(r.ids, "<u2") for r in training_order.read_slots(
        spark, folder, index, 64, 0, 100).collect()}
    assert sorted(stored) == sorted(placed) and all(len(v) == 64 for v in stored.values())
    assert all(r.record_crc32 == zlib.crc32(stored[r.slot].tobytes()) for r in placed.values())
    whole = Tokenizer.from_file(bpe)
    for doc in (7, 8, 12, 13):
        text = edge.filter(f"doc_id = {doc}").head().text
        own = sorted((r for r in placed.values() if r.doc_id == doc), key=lambda r: r.piece)
        ids = np.concatenate([stored[r.slot][:r.n_tokens] for r in own])
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids + [50256]
    tail = {r.slot for r in training_order.read_slots(spark, folder, index, 64, 150, 100).collect()}
    assert tail == set(range(150, len(placed)))
    nothing = training_order.materialise(
        training_order.sequences(empty, *ranks), training_order.sequence_counts(empty, *ranks),
        folder + "-none")
    assert nothing.count() == 0


def test_fewer_or_more_sequences_than_counted_stop_the_job(spark, edge):
    ranks = TOKENIZERS.path("byte_bpe_50k.tiktoken"), TOKENIZERS.PATTERN
    some = edge.filter("doc_id > 5")
    for counted, written in ((edge, some), (some, edge)):
        rows = training_order.sequences(written, *ranks, length=64)
        counts = training_order.sequence_counts(counted, *ranks, length=64)
        with pytest.raises(Exception, match="were counted|between counting and writing"):
            training_order.materialise(rows, counts, f"file://{shared_path(spark, 'torn')}",
                                       length=64, shard_rows=100)


class Spy:
    """Hands texts on to a library and keeps them."""

    def __init__(self, encoder):
        self.texts, self.library = [], encoder.library
        encoder.library = self

    def __call__(self, texts):
        self.texts += texts
        return self.library(texts)


@pytest.mark.parametrize("block", [30, 1 << 20])
def test_columns_give_the_ids_of_whole_texts(bpe, block):
    whole = Tokenizer.from_file(bpe)
    spaces = ["\x85", " ", " ", " ", " ", "　", " ", "\n", "\r\n", "\t "]
    rng = random.Random(3)
    texts = ["".join(rng.choice([*spaces, "a", "-x", "é", "ok.", "Рах", "漢", "🙂",
                                 "<|endoftext|>", "\x1c", "'s"]) for _ in range(rng.randint(0, 60)))
             for _ in range(200)] + [None, "", "y" * 500] + sample_texts()
    ids = [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    column = pa.array(["cut", *texts], pa.string())[1:]
    found, counts = RunEncoder(bpe, limit=2000, block=block).encode(column)
    assert counts.tolist() == list(map(len, ids))
    assert found.tolist() == [i for text in ids for i in text]
    ranks = RankEncoder(TOKENIZERS.path("byte_bpe_50k.tiktoken"), TOKENIZERS.PATTERN,
                        block=block)
    plain = [None if t is None else t.replace("<|endoftext|>", "") for t in texts]
    ids = [whole.encode(t or "", add_special_tokens=False).ids for t in plain]
    found, counts = ranks.encode(pa.array(plain))
    assert found.tolist() == [i for text in ids for i in text]
    assert counts.tolist() == ranks.counts(pa.array(plain)).tolist() == list(map(len, ids))


def test_libraries_get_the_distinct_runs_only(bpe):
    column = pa.array([prose(1), prose(2)] * 50)
    for encoder in (RunEncoder(bpe, limit=0), RankEncoder(
            TOKENIZERS.path("byte_bpe_50k.tiktoken"), TOKENIZERS.PATTERN)):
        spy = Spy(encoder)
        encoder.encode(column)
        assert sum(map(len, spy.texts)) <= len(prose(1)) + len(prose(2))


def test_pieces_of_many_counts():
    counts = np.asarray([1, 2, 3, 255, 256, 257, 700, 1024])
    owner, lengths = packing.piece_lengths(counts, 256)
    for at, count in enumerate(counts):
        assert lengths[owner == at].tolist() == packing.decompose(int(count), 256)
    assert packing.piece_lengths(np.asarray([3]), 1)[1].tolist() == [1, 1, 1]
