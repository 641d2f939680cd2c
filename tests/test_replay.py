"""G2 by carry between slices of time, and the introductions of W7 in one pass."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from claimlake.operators import updates as U
from test_plans import plan_text


def _rows(spark, n, hot):
    rng = random.Random(n)
    start = dt.datetime(2024, 1, 1)
    data = []
    for i in range(n):
        ts = None if i % 41 == 0 else start + dt.timedelta(minutes=rng.choice([0, 5, rng.randint(0, 10_000)]))
        data.append((i, ts, 1 if hot and i % 3 else rng.randint(1, 30), None if i % 7 == 0 else f"s{rng.randint(1, 5)}"))
    rng.shuffle(data)
    return spark.createDataFrame(data, "seq long, ts timestamp_ntz, cid int, new string")


@pytest.mark.parametrize("n, hot", [(0, False), (1, False), (50, False), (2000, True)])
def test_previous_value_equals_lag(spark, n, hot):
    df = _rows(spark, n, hot)
    w = Window.partitionBy("cid").orderBy("ts", "seq")
    want = df.withColumn("prev", F.lag("new").over(w)).withColumn("first", F.row_number().over(w) == 1)
    got = U.previous_value(df, "cid", "ts", "seq", "new", "prev", "first")
    columns = ["seq", "cid", "prev", "first"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))


def test_rows_are_dealt_once_and_a_hot_key_by_slices(spark):
    df = _rows(spark, 2000, True)
    text = plan_text(U.previous_value(df, "cid", "ts", "seq", "new", "prev", "first"))
    assert "rangepartitioning" not in text and "hashpartitioning(cid" in text
    windows = [line for line in text.splitlines() if "windowspecdefinition(cid" in line]
    assert windows and all("_slice" in line for line in windows)   # no window holds all rows of a key


def test_both_ways_to_settle_late_ids_agree(tables_small, monkeypatch):
    t = tables_small
    args = (t["status_updates"], t["claims"], t["statuses"], t["history"])

    def rows():
        res = U.apply_status_updates(*args)
        return [sorted((tuple(r) for r in df.collect()), key=str) for df in (res.outcomes, res.new_statuses, res.replay)]

    one = rows()
    monkeypatch.setattr(U, "CANDIDATES_MAX", 0)
    assert rows() == one


def test_introductions_one_at_a_time():
    class C:
        def __init__(self, ts, seq, k, nid, key):
            self.ts, self.seq, self.k, self.nid, self.key = ts, seq, k, nid, key

    found = U.introduction_times([
        C(1, 1, 0, None, "a"),       # id 11
        C(2, 2, 1, 12, "b"),         # refused: 12 is not there yet
        C(3, 3, 1, 11, "c"),         # id 12 by way of 11
        C(4, 4, 1, 12, "b"),         # id 13 by way of 12
        C(5, 5, 1, None, "b"),       # known by now
        C(5, 5, 0, None, "d"),       # id 14
        C(None, 9, 1, 11, "e"),      # a missing time is before all: refused
        C(6, 6, 1, 14, None),        # id 15, the status NULL
    ], 10)
    assert [(i, ts, seq) for i, ts, seq in found] == [(11, 1, 1), (12, 3, 3), (13, 4, 4), (14, 5, 5), (15, 6, 6)]
