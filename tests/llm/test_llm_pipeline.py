import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from llm_samples import prose
from test_llm_compression import brute as brute_counts
from test_llm_jaccard import brute as brute_groups


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    items = [prose(500 + i, 40) for i in range(3)]
    base = prose(1, 150)
    rows = [(1, base), (2, base), (3, base + " more"), (4, prose(2, 150) + " " + items[1]),
            (5, prose(3, 20)), (6, "again and again and " * 60), (7, None), (8, prose(4, 300)),
            (8, prose(4, 300)), (None, prose(5, 90)), (9, " ".join(prose(9, 400).split()[::-1]))]
    docs = spark.createDataFrame([(i, t, "en", None if i == 8 else "s", 0, "clash") for i, t in rows],
                                 "doc_id long, text string, lang string, source string, "
                                 "n_chars long, kept string")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(
        f"{path}/benchmark.parquet")
    return path, rows, items


def test_run_equals_brute_force(spark, folder, bpe):
    path, rows, items = folder
    good = []
    for i, text in rows:
        n, *_, repeated = brute_counts(text)
        if n >= 50 and 100 * repeated <= 50 * n:
            good.append((i, text))
    good = list(dict.fromkeys(good))  # of equal rows one
    groups = brute_groups([t for _, t in good])[1]
    alone = [good[i] for i in range(len(good)) if groups[i] == i]
    clean = [(i, t) for i, t in alone if not any(item in t for item in items)]
    encode = Tokenizer.from_file(bpe).encode
    expected = sorted((repr(i), len(encode(t, add_special_tokens=False).ids) + 1) for i, t in clean)
    pieces = corpus_pipeline.run(spark, path).collect()
    got = sorted({(repr(r.doc_id), r.doc_tokens) for r in pieces})
    assert got == expected and len(expected) == 4
    assert sum(r.length for r in pieces) == sum(n for _, n in expected)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(np.frombuffer(r.ids, "<u4")) == r.length
               for r in pieces)


def test_stages_keep_the_columns_of_documents(spark, folder):
    path, *_ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == corpus_pipeline.DOCUMENT_COLUMNS
        assert stage(spark, docs.limit(0), path).count() == 0
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "language", "near_duplicates", "decontamination", "packing"]
    assert os.path.basename(path)


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_hand_texts_out_in_small_batches(spark, folder, name):
    path, *_ = folder

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    dict(corpus_pipeline.STAGES)[name](spark, spark.read.parquet(f"{path}/documents.parquet"), path)
    texts = spark.range(3000, numPartitions=1).selectExpr("repeat(string(id), 1000) AS text")
    found = [r.n for r in texts.mapInArrow(sizes, "n long").collect()]
    assert sum(found) > 10 << 20 and max(found) < 3 << 20
