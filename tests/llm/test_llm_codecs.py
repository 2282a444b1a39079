"""Token ids from the trie against the library, and vector codes against plain loops."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from lexigrain.llm import grid_codes, prefix_trie
from lexigrain.llm.memory import Generations
from llm_samples import sample_texts
from test_llm_tokens import odd_texts


@pytest.fixture(scope="module")
def trie(bpe):
    return prefix_trie.TrieEncoder(bpe, limit=1 << 16)


def ids_of(trie, text):
    return np.frombuffer(trie.encode([text])[0], "<u4").tolist()


def test_trie_gives_the_ids_of_the_library(bpe, trie):
    whole, rng = Tokenizer.from_file(bpe), random.Random(8)
    vocab = sorted(whole.get_vocab())
    texts = [t or "" for t in sample_texts()] + odd_texts(9, 60)
    texts += ["".join(chr(rng.randrange(1, 0xD800)) for _ in range(9)) for _ in range(300)]
    texts += ["".join(rng.choice("abce") for _ in range(40)) for _ in range(200)]
    texts += ["".join(rng.choice(vocab).replace("Ġ", " ") for _ in range(4)) for _ in range(400)]
    texts += [c * n for c in " a=-\n0é" for n in (1, 2, 3, 63, 64, 65, 3000)]
    texts += ["<|endoftext|>", " <|endoftext|><|endoftext|> a", "a  <|endoftext|>\n b<|endoftext"]
    for text, found in zip(texts, trie.encode(texts), strict=True):
        ids = whole.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(found, "<u4").tolist() == ids, text
        table = prefix_trie.token_bytes(bpe)
        assert b"".join(table[i] for i in ids).decode() == whole.decode(
            ids, skip_special_tokens=False)


def test_long_texts_are_encoded_by_blocks(bpe, trie):
    whole = Tokenizer.from_file(bpe)
    for text in ("lorem ipsum, dolor\n" * 200_000, "z" * 2_500_000):
        assert ids_of(trie, text) == whole.encode(text, add_special_tokens=False).ids


def test_new_words_of_a_block_share_a_trie(bpe):
    """Words come from few calls of the library, and a run that is known is not walked again."""
    trie, whole = prefix_trie.TrieEncoder(bpe), Tokenizer.from_file(bpe)
    split, walk, calls, walked = trie.split, trie.encode_words, [], []
    trie.split = lambda text: calls.append(1) or split(text)
    trie.encode_words = lambda words: walked.append(len(words)) or walk(words)
    rng = random.Random(4)
    texts = [" ".join(f"{rng.choice('abc')}{i}-{j}" for j in range(40)) + "\u2003 x" for i in range(500)]
    for _ in range(2):
        for text, found in zip(texts, trie.encode(texts), strict=True):
            assert np.frombuffer(found, "<u4").tolist() == whole.encode(
                text, add_special_tokens=False).ids
    assert sum(1 for n in walked if n) == 1 and len(calls) < 5000
    mixed = [text.replace("-7 ", "<|endoftext|>\n") for text in texts]
    for text, found in zip(mixed, trie.encode(mixed), strict=True):
        assert np.frombuffer(found, "<u4").tolist() == whole.encode(
            text, add_special_tokens=False).ids


def test_neighbours_are_those_that_plain_merging_leaves(bpe, trie):
    merges, rng = trie.merges, random.Random(3)
    names = {i: t for t, i in merges.vocab.items()}
    ranks = {names[a] + " " + names[b]: r for key, r in merges.pair_rank.items()
             for a, b in [divmod(key, merges.size)]}

    def merged(text):
        parts = list(text)
        while len(parts) > 1:
            best = min((ranks.get(f"{a} {b}", 1 << 30), i)
                       for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] == 1 << 30:
                break
            parts[best[1]:best[1] + 2] = ["".join(parts[best[1]:best[1] + 2])]
        return parts

    tokens = [t for t in merges.endings if merges.endings[t] >= 0]
    for _ in range(3000):
        a, b = rng.choice(tokens[:3000]), rng.choice(tokens[:3000])
        assert merges.neighbours(merges.vocab[a], merges.vocab[b]) == (merged(a + b) == [a, b])
    assert all(merged(t) == [t] for t in rng.sample(tokens, 500))


def test_codec_of_a_table(spark, edge, empty, bpe):
    whole = Tokenizer.from_file(bpe)
    coded = prefix_trie.encode(edge, bpe)
    rows = prefix_trie.decode(coded.withColumn("same", coded.ids), bpe).collect()
    expected = []
    for r in edge.collect():
        ids = whole.encode(r.text or "", add_special_tokens=False).ids
        expected.append((str(r.doc_id), len(ids), ids,
                         whole.decode(ids, skip_special_tokens=False)))
    assert sorted((str(r.doc_id), r.n_tokens, r.same, r.decoded) for r in rows) == sorted(expected)
    assert prefix_trie.decode(prefix_trie.encode(empty, bpe), bpe).count() == 0
    torn = spark.createDataFrame([(1, [50256, 152]), (2, None), (3, [])], "k int, ids array<int>")
    assert {r.k: r.decoded for r in prefix_trie.decode(torn, bpe).collect()} == {
        1: "<|endoftext|>" + whole.decode([152]), 2: None, 3: ""}


def test_other_files_are_refused(tmp_path):
    path = tmp_path / "other.json"
    path.write_text('{"model": {"vocab": {}, "merges": []}, "normalizer": null, '
                    '"pre_tokenizer": {"type": "Whitespace"}}')
    with pytest.raises(ValueError):
        prefix_trie.Merges(str(path))


def test_memory_stays_below_its_bound():
    memory = Generations(limit=20_000)
    for i in range(5000):
        assert ("key 0" in memory.missing({"key 0", "none"})) == (i == 0)
        memory.put(f"key {i}", b"value")
        assert (len(memory.young) + len(memory.old)) * 165 < 21_000
    memory.put("x" * 100_000, b"")
    assert memory.missing({"x" * 100_000}) and not memory.old


def plain_codes(rows, parts, entries, rounds):
    """Codes by loops over all entries, in Python integers."""
    kept = [r for r in rows if r[1] is not None and all(
        x is not None and np.isfinite(x) for x in r[1])]
    grid = [[int(np.floor(256 * float(np.float32(x)))) for x in r[1]] for r in kept]
    width = len(grid[0]) // parts
    cut = [[tuple(g[p * width:(p + 1) * width]) for p in range(parts)] for g in grid]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0,
                                                    kept[i][1]))
    books = [[cut[i][p] for i in order[:entries]] for p in range(parts)]

    def nearest(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), i)
                   for i, e in enumerate(books[p]))

    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(parts):
            own = {}
            for c in cut:
                own.setdefault(nearest(p, c[p])[1], []).append(c[p])
            for e, members in own.items():
                new[p][e] = tuple(sum(x) // len(members) for x in zip(*members, strict=True))
        books = new
    out, errors = [], {}
    for r, c in zip(kept, cut, strict=True):
        found = [nearest(p, c[p]) for p in range(parts)]
        out.append((r[0], bytes(i for _, i in found), sum(d for d, _ in found), r[2]))
        errors[r[2]] = errors.get(r[2], 0) + out[-1][2]
    flat = ",".join(str(x) for b in books for e in b for x in e)
    return (sorted(((str(i), c, e, errors[label]) for i, c, e, label in out)),
            hashlib.sha256(flat.encode()).hexdigest())


SCHEMA = "vec_id long, embedding array<float>, label int, codes int, error string, part string"


@pytest.mark.parametrize("dims,parts,entries", [(32, 16, 64), (8, 4, 5), (48, 2, 200)])
def test_codes_equal_plain_loops(spark, dims, parts, entries):
    rng = random.Random(dims)
    rows = [(rng.choice([None, *range(400)]), [float(np.float32(rng.gauss(0, .3)))
                                               for _ in range(dims)],
             rng.choice([None, 1, 2, 3])) for _ in range(300)]
    rows += [(1000 + i, rows[0][1], 2) for i in range(150)] + rows[:20]  # copies of one vector
    rows += [(5, None, 1), (6, [None] * dims, 1), (7, [float("nan")] * dims, None),
             (-1, [float("inf")] + [0.0] * (dims - 1), 2), (-2, [-300.5] * dims, None)]
    df = spark.createDataFrame([(*r, 1, "clash", "clash") for r in rows], SCHEMA).repartition(5)
    coded, books = grid_codes.compress(df, parts, entries, 2)
    got = sorted((str(r.vec_id), bytes(r.codes), r.error, r.label_error) for r in coded.collect())
    assert (got, grid_codes.books_digest(books)) == plain_codes(rows, parts, entries, 2)


def test_few_or_no_vectors_and_wrong_ones(spark):
    few = spark.createDataFrame([(2, [0.5] * 16, None, 1, "", ""), (1, [0.1] * 16, 3, 1, "", "")],
                                SCHEMA)
    coded, books = grid_codes.compress(few)
    assert books.shape == (16, 2, 1) and {r.vec_id: (bytes(r.codes), r.error)
                                          for r in coded.collect()} == {
        1: (bytes(16), 0), 2: (b"\x01" * 16, 0)}
    decoded = grid_codes.decode(coded, books).collect()
    assert {r.vec_id: r.vector for r in decoded} == {1: [25] * 16, 2: [128] * 16}
    coded, books = grid_codes.compress(few.limit(0))
    assert coded.count() == 0 and books.size == 0
    for vectors in ([[0.0] * 16, [0.0] * 32], [[0.0] * 17], [[1e9] * 16]):
        df = spark.createDataFrame([(i, v, 1, 1, "", "") for i, v in enumerate(vectors)], SCHEMA)
        with pytest.raises(Exception, match="vectors of|components beyond"):
            grid_codes.compress(df)[0].count()


def test_cells_hold_every_nearest_entry():
    rng = np.random.default_rng(1)
    for width in (1, 3, 6):
        book = rng.integers(-40, 40, (64, width))
        points = rng.integers(-60, 60, (5000, width))
        cells = grid_codes.Cells(book, limit=50)  # forgets often
        far = ((points[:, None] - book[None]) ** 2).sum(axis=2)
        for start in (0, 2500):
            entry, lost = cells.nearest(points[start:start + 2500])
            assert (entry == far[start:start + 2500].argmin(axis=1)).all()
            assert (lost == far[start:start + 2500].min(axis=1)).all()
