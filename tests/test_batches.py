"""Logs that go on from run to run, and streams that are written batch by batch."""

import datetime as dt
import random

from pyspark.sql import functions as F

from lexigrain.sinks import rolled
from lexigrain.streaming import batches


def test_a_log_goes_on_from_run_to_run(spark, tmp_path):
    rng, folder, bound, lines = random.Random(2), f"file://{tmp_path}/log", 2000, []
    for run, count in ((1, 120), (2, 0), (3, 1), (4, 300)):
        rows = [(run * 1000 + i, "é" * rng.randint(0, 40)) for i in range(count)]
        df = spark.createDataFrame(rows, "id long, text string").repartition(3)
        before = {r.name: r.bytes for r in rolled.manifest(spark, folder).collect()}
        for _ in range(2):  # the second is a repetition
            rolled.append_rolled(df, folder, bound, run)
        lines += [f"{i}\t{t}" for i, t in rows]
        files = sorted(rolled.manifest(spark, folder).collect(), key=lambda r: r.number)
        assert [f.number for f in files] == list(range(len(files)))
        assert sum(f.bytes for f in files) == sum(len(x.encode()) + 1 for x in lines)
        assert all(f.bytes <= bound for f in files)
        assert all(f.bytes > bound - 2 * 90 for f in files[:-1])
        gone = [b for n, b in before.items() if n not in {f.name for f in files}]
        assert len(gone) == (count > 0 and run > 1)  # only the open file has a new version
        assert sorted(r.value for r in rolled.read_rolled(spark, folder).collect()) == sorted(lines)


def test_a_long_line_and_an_empty_log(spark, tmp_path):
    folder = f"file://{tmp_path}/log"
    rolled.append_rolled(spark.createDataFrame([], "t string"), folder, 100, 1)
    assert rolled.manifest(spark, folder).count() == 0
    df = spark.createDataFrame([("x" * 500,), ("a",), (None,)], "t string").coalesce(1)
    rolled.append_rolled(df, folder, 100, 2)
    assert sorted(r.value for r in rolled.read_rolled(spark, folder).collect()) == [
        "", "a", "x" * 500]


def rows(spark, path, schema):
    return sorted((tuple(r) for r in batches.left(spark, path, schema).select(
        *[c.split()[0] for c in schema.split(", ")], "batch_id").collect()), key=str)


def test_repeats_of_any_age_are_dropped_and_batches_can_be_replayed(spark, tmp_path):
    path, seen = f"{tmp_path}/rows", f"{tmp_path}/seen"
    write = batches.unseen_only("k", F.col("at"), path, seen)
    parts = [[("a", 2), ("a", 1), ("b", 1), (None, 1), (None, 1)], [("b", 0), ("c", 5)],
             [("a", 0), ("d", 1)]]
    frames = [spark.createDataFrame(p, "k string, at int") for p in parts]
    counts = [write(f, "r", i) for i, f in enumerate(frames)]
    assert counts == [{"n_written": 4, "n_repeated": 1}, {"n_written": 1, "n_repeated": 1},
                      {"n_written": 1, "n_repeated": 1}]
    expected = rows(spark, path, "k string, at int")
    assert expected == sorted([("a", 1, 0), ("b", 1, 0), (None, 1, 0), (None, 1, 0), ("c", 5, 1),
                               ("d", 1, 2)], key=str)
    assert write(frames[1], "r", 1) == counts[1]
    assert rows(spark, path, "k string, at int") == expected
    assert write(frames[1], "again", 0)["n_written"] == 0


def test_late_rows_are_kept_apart(spark, tmp_path):
    paths = [f"{tmp_path}/{name}" for name in ("rows", "late", "marks")]
    write = batches.late_apart("at", "10 minutes", *paths)
    noon = dt.datetime(2024, 1, 1, 12)
    parts = [[0, 30, -500], [20, 19, None], [100], [89, 90]]
    frames = [spark.createDataFrame([(i, None if m is None else noon + dt.timedelta(minutes=m))
                                     for i, m in enumerate(p)], "i int, at timestamp")
              for p in parts]
    assert [write(f, "r", i)["n_late"] for i, f in enumerate(frames)] == [0, 1, 0, 1]
    assert write(frames[1], "r", 1) == {"n_written": 2, "n_late": 1}
    late = batches.left(spark, paths[1], "i int, reason string, watermark timestamp").collect()
    assert sorted((r.batch_id, r.i, r.reason, r.watermark) for r in late) == [
        (1, 1, batches.LATE, noon + dt.timedelta(minutes=20)),
        (3, 0, batches.LATE, noon + dt.timedelta(minutes=90))]
