"""Increments of run statistics: order, repeats and what a late delivery touches."""

import os
import random

import pytest

from lexigrain.operators import run_ledger as L

SCHEMA = "run_id long, feed_name string, latency double"


def _deliveries(seed=4):
    rng = random.Random(seed)
    return [[(900 * rng.randrange(300), rng.choice(["a", "a", "b", None]),
              rng.choice([None, rng.random() * 100])) for _ in range(80)]
            + [(None, "a", 1.0)] for _ in range(4)]


def _expected(rows):
    groups = {}
    for run, feed, latency in rows:
        if run is not None:
            groups.setdefault((run, feed), []).append(latency)
    return {k: (len(v), sum(x for x in v if x is not None) / n if (n := sum(
        x is not None for x in v)) else None) for k, v in groups.items()}


def _found(spark, path):
    return {(r.run_id, r.feed_name): (r.article_count, r.article_avg)
            for r in L.read_statistics(spark, path).collect()}


def test_increments_equal_one_pass(spark, tmp_path):
    ledger, table = f"{tmp_path}/ledger", f"{tmp_path}/statistics"
    parts = _deliveries()
    for number in (2, 0, 0, 3, 1):
        L.deliver(spark.createDataFrame(parts[number], SCHEMA), f"d{number}", ledger, table)
    got, want = _found(spark, table), _expected([r for part in parts for r in part])
    assert set(got) == set(want)
    for key, (n, mean) in want.items():
        assert got[key][0] == n and got[key][1] == (None if mean is None else pytest.approx(mean))


def test_a_late_delivery_rewrites_its_own_day(spark, tmp_path):
    ledger, table = f"{tmp_path}/ledger", f"{tmp_path}/statistics"
    L.deliver(spark.createDataFrame(
        [(900, "a", 1.0), (L.DAY + 900, "a", 2.0)], SCHEMA), "first", ledger, table)
    before = {d: sorted(os.listdir(f"{table}/{d}")) for d in ("day=0", "day=1")}
    L.deliver(spark.createDataFrame([(900, "a", 3.0)], SCHEMA), "late", ledger, table)
    after = {d: sorted(os.listdir(f"{table}/{d}")) for d in ("day=0", "day=1")}
    assert before["day=1"] == after["day=1"] and before["day=0"] != after["day=0"]
    assert _found(spark, table) == {(900, "a"): (2, 2.0), (L.DAY + 900, "a"): (1, 2.0)}
    L.deliver(spark.createDataFrame([], SCHEMA), "none", ledger, table)
    with pytest.raises(ValueError, match="no longer has entries"):
        L.deliver(spark.createDataFrame([(900, "a", 1.0)], SCHEMA), "first", ledger, table)
    assert _found(spark, table) == {(900, "a"): (2, 2.0), (L.DAY + 900, "a"): (1, 2.0)}
