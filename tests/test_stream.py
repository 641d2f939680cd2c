"""Stream = batch, and a restart from the checkpoint changes nothing."""

from __future__ import annotations

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from claimlake.operators import submissions as W
from claimlake.operators import updates as UP
from claimlake.sources import versions as V
from claimlake.streaming import jobs as T
from helpers import claim, employee, table


def _rows(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_stream_submissions_equal_batch_and_restart_is_idempotent(spark, tables_small):
    t = tables_small
    root = tempfile.mkdtemp(prefix="claimlake-t1-")
    feed, state, ckpt = (os.path.join(root, x) for x in ("feed", "state", "ckpt"))
    T.write_feed(t["submissions"], feed, "seq", chunks=3)
    T.stream_submissions(spark, feed, state, ckpt, t["claims"], t["employees"], t["history"])
    got = _rows(T.read_state(spark, state, "outcomes"), ["seq", "outcome", "claim_id"])
    want = _rows(W.ingest_submissions(t["submissions"], t["claims"], t["employees"]),
                 ["seq", "outcome", "claim_id"])
    assert got == want
    batches = T.read_state(spark, state, "outcomes").select("batch_id").distinct().count()
    assert batches == 3
    # restart with the same checkpoint: no file is processed twice, state unchanged
    T.stream_submissions(spark, feed, state, ckpt, t["claims"], t["employees"], t["history"])
    assert _rows(T.read_state(spark, state, "outcomes"), ["seq", "outcome", "claim_id"]) == got
    batch = W.ingest_submissions(t["submissions"], t["claims"], t["employees"])
    for name, want in (("claims", W.new_claims(batch)), ("history", W.submission_history(batch, t["history"]))):
        rows = T.read_state(spark, state, name)
        assert _rows(rows, want.columns) == _rows(want, want.columns), name


def _file_source(spark, rows, folder, number):
    """One more file of the feed, newer than the ones before."""
    path = os.path.join(folder, f"file-{number}")
    spark.createDataFrame(rows, T.SUBMISSION_SCHEMA).coalesce(1).write.json(path)
    (name,) = [n for n in os.listdir(path) if n.startswith("part-")]
    os.utime(os.path.join(path, name), (1_700_000_000 + number,) * 2)


def _submission(seq, reference, **kw):
    base = {"seq": seq, "submitted_at": dt.datetime(2024, 5, 1, 8), "reference": reference, "computer_number": "1", "nic": "9V",
            "opd_date": "2024-04-30", "amount_requested": "10", "claim_type": "opd", "claim_for": "CHILD", "patient_name": "P"}
    return tuple({**base, **kw}.values())


def test_references_stay_taken_without_reading_earlier_output(spark):
    """The state store alone knows what the stream has taken; a replayed batch changes nothing."""
    root = tempfile.mkdtemp(prefix="claimlake-t1s-")
    feed, ckpt = os.path.join(root, "feed"), os.path.join(root, "ckpt")
    claims = table(spark, "claims", [claim(7, reference="OLD")])
    employees = table(spark, "employees", [employee(1, "1", "9V")])
    history = table(spark, "history", [])

    def run(state):
        T.stream_submissions(spark, feed + "/*", state, ckpt, claims, employees, history)
        return {r.seq: (r.outcome, r.claim_id) for r in T.read_state(spark, state, "outcomes").collect()}

    _file_source(spark, [_submission(1, "A"), _submission(2, "a "), _submission(3, "B", nic="?"), _submission(4, "old")], feed, 1)
    _file_source(spark, [_submission(5, "b"), _submission(6, "A"), _submission(7, "C", amount_requested="0")], feed, 2)
    one = run(os.path.join(root, "state"))
    assert one == {1: ("accepted", 8), 2: ("duplicate_reference", None), 3: ("bad_employee", None), 4: ("duplicate_reference", None),
                   5: ("accepted", 9), 6: ("duplicate_reference", None), 7: ("bad_amount", None)}
    # the same checkpoint goes on with a store that has none of the earlier outputs
    _file_source(spark, [_submission(8, "a"), _submission(9, "c"), _submission(10, "B"), _submission(11, "C")], feed, 3)
    two = run(os.path.join(root, "other-state"))
    assert {k: v[0] for k, v in two.items()} == {8: "duplicate_reference", 9: "accepted", 10: "duplicate_reference", 11: "duplicate_reference"}
    # replay: the last batch is forgotten by the checkpoint, not by the store
    commits = sorted(int(n) for n in os.listdir(os.path.join(ckpt, "commits")) if n.isdigit())
    for name in (str(commits[-1]), f".{commits[-1]}.crc"):
        os.remove(os.path.join(ckpt, "commits", name))
    version = V.current_version(spark, os.path.join(root, "other-state"))
    assert run(os.path.join(root, "other-state")) == two
    assert V.current_version(spark, os.path.join(root, "other-state")) == version
    # and the state store went on from it
    _file_source(spark, [_submission(12, "c"), _submission(13, "D")], feed, 4)
    three = run(os.path.join(root, "other-state"))
    assert {k: v[0] for k, v in three.items() if k > 11} == {12: "duplicate_reference", 13: "accepted"}


@pytest.mark.parametrize("chunks", [1, 3])
def test_stream_status_updates_equal_batch(spark, tables_small, chunks):
    t = tables_small
    root = tempfile.mkdtemp(prefix="claimlake-t2-")
    feed, state, ckpt = (os.path.join(root, x) for x in ("feed", "state", "ckpt"))
    T.write_feed(t["status_updates"], feed, "seq", chunks=chunks)
    T.stream_status_updates(spark, feed, state, ckpt, t["claims"], t["statuses"], t["history"], compact_after=2)
    got = T.read_state(spark, state, "outcomes")
    batch = UP.apply_status_updates(t["status_updates"], t["claims"], t["statuses"], t["history"])
    assert _rows(got, ["seq", "outcome"]) == _rows(batch.outcomes, ["seq", "outcome"])
    # log ids continue the table's without gaps or repeats
    hist = T.read_state(spark, state, "history")
    base = t["history"].agg(F.max("log_id")).first()[0]
    ids = sorted(r.log_id for r in hist.select("log_id").collect())
    assert ids == list(range(base + 1, base + 1 + len(ids)))
    columns = ["log_id", "claim_requests_id", "updated_by", "old_status_id", "new_status_id", "remarks"]
    assert _rows(hist, columns) == _rows(batch.history, columns)
    # the state holds, per changed claim, the status of its newest log row
    snap = {r.claim_id: r.status for r in T.read_state(spark, state, "claim_state").collect()}
    changes = {r.claim_id: r.status for r in batch.changes.collect()}
    assert snap == changes
    names = t["statuses"].unionByName(T.read_state(spark, state, "status_state").drop("batch_id"))
    newest = (hist.groupBy("claim_requests_id").agg(F.max_by("new_status_id", "log_id").alias("sid"))
              .join(names, F.col("sid") == F.col("s_id")).select("claim_requests_id", "status_name").collect())
    assert snap == {r.claim_requests_id: r.status_name for r in newest}
