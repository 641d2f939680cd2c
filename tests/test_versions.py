"""Stores of several tables: one commit for all, newest row of each key, compaction."""

from __future__ import annotations

import os

import pytest

from claimlake.sources import versions as V

KEYS = {"claims": "id", "log": None}


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def _claims(spark, rows):
    return spark.createDataFrame(rows, "id long, status string")


def _log(spark, rows):
    return spark.createDataFrame(rows, "log_id long, id long")


@pytest.fixture
def store(spark, tmp_path):
    root = str(tmp_path / "store")
    V.publish_changes(spark, root, {"claims": _claims(spark, [(1, "a"), (2, "b"), (3, None)]), "log": _log(spark, [(1, 1)])}, KEYS)
    return root


def test_newest_row_of_each_key(spark, store):
    V.publish_changes(spark, store, {"claims": _claims(spark, [(2, "c"), (4, "d")]), "log": _log(spark, [(2, 2)])}, KEYS, {"log_id": 2})
    V.publish_changes(spark, store, {"claims": _claims(spark, [(2, None), (1, "z")])}, KEYS)
    want = [(1, "z"), (2, None), (3, None), (4, "d")]
    assert _rows(V.read_current(spark, store, "claims")) == want
    assert _rows(V.read_current(spark, store, "log")) == [(1, 1), (2, 2)]
    assert V.read_commit(spark, store).marks == {"log_id": 2}
    # an older commit still reads as it was
    old = V.read_commit(spark, store, 1)
    assert {r.id for r in V.read_current(spark, store, "claims", old).collect()} == {1, 2, 3}
    # compaction changes no row, and later changes go on top of it
    version = V.compact(spark, store, least=2)
    state = V.read_commit(spark, store).tables
    assert version == 4 and state["claims"].changes == [] and state["log"].changes == []
    assert _rows(V.read_current(spark, store, "claims")) == want
    V.publish_changes(spark, store, {"claims": _claims(spark, [(3, "y"), (5, "x")])}, KEYS)
    assert _rows(V.read_current(spark, store, "claims")) == [(1, "z"), (2, None), (3, "y"), (4, "d"), (5, "x")]
    assert V.compact(spark, store, least=2) == 5   # nothing has piled up


def test_readers_never_see_half_a_batch(spark, store, monkeypatch):
    """A writer that dies before its commit leaves folders that no reader lists, and the batch can be repeated."""
    def dies(*_):
        raise RuntimeError("lost")

    change = {"claims": _claims(spark, [(1, "new")]), "log": _log(spark, [(9, 9)])}
    with monkeypatch.context() as m:
        m.setattr(V, "_commit", dies)
        with pytest.raises(RuntimeError):
            V.publish_changes(spark, store, change, KEYS, batch=0)
    assert len(os.listdir(os.path.join(store, "log"))) == 2
    assert _rows(V.read_current(spark, store, "log")) == [(1, 1)]
    assert V.publish_changes(spark, store, change, KEYS, batch=0) == 2
    assert V.publish_changes(spark, store, change, KEYS, batch=0) == 2   # repeated: nothing happens
    assert _rows(V.read_current(spark, store, "log")) == [(1, 1), (9, 9)]


def test_of_two_writers_of_one_version_the_second_fails(spark, store):
    late = V.read_commit(spark, store)
    V.publish_changes(spark, store, {"log": _log(spark, [(2, 2)])}, KEYS)
    late.version += 1
    with pytest.raises(FileExistsError):
        V._commit(spark, store, late)


def test_only_changed_rows_are_written(spark, store):
    V.publish_changes(spark, store, {"claims": _claims(spark, [(2, "c")])}, KEYS)
    state = V.read_commit(spark, store).tables["claims"]
    assert spark.read.parquet(os.path.join(store, state.changes[-1])).count() == 1


def test_few_changes_do_not_shuffle_the_base(spark, store):
    V.compact(spark, store)
    V.publish_changes(spark, store, {"claims": _claims(spark, [(2, "c")])}, KEYS)
    plan = V.read_current(spark, store, "claims")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan and "SortMergeJoin" not in plan


def test_empty_changes_and_missing_tables(spark, store):
    V.publish_changes(spark, store, {"claims": _claims(spark, [])}, KEYS)
    assert len(_rows(V.read_current(spark, store, "claims").na.fill("-"))) == 3
    with pytest.raises(FileNotFoundError):
        V.read_current(spark, store, "nothing")
