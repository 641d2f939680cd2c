"""The log stored by claim: buckets pruned, no exchange and no sort of the log, same rows."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from claimlake.operators import details as X
from claimlake.sources.claim_log import write_claim_log
from test_plans import plan_text


@pytest.fixture(scope="module")
def log(spark, tables_small, tmp_path_factory):
    name = f"claim_log_{uuid.uuid4().hex}"
    yield write_claim_log(tables_small["history"], name, str(tmp_path_factory.mktemp("log") / name), 16)
    spark.sql(f"DROP TABLE {name}")


def _requests(spark, ids):
    return spark.createDataFrame(list(enumerate(ids)), "request_id long, claim_id int")


def _want(spark, t, ids):
    rows = X.claim_history_admin(t["history"], t["statuses"], t["users"])
    asked = _requests(spark, ids)
    return sorted((tuple(r) for r in asked.join(rows, "claim_id").select("request_id", *rows.columns).collect()), key=str)


def test_few_claims_open_only_their_buckets(spark, tables_small, log):
    t = tables_small
    ids = [1, 5, 5, 9, 0, -3, None, 10_000_000]
    got = X.claim_history_of(_requests(spark, ids), log, t["statuses"], t["users"])
    text = plan_text(got)
    assert "SelectedBucketsCount: " in text and "SelectedBucketsCount: 16 out of 16" not in text
    assert sorted((tuple(r) for r in got.collect()), key=str) == _want(spark, t, ids)


def test_many_claims_join_the_log_in_place(spark, tables_small, log, monkeypatch):
    t = tables_small
    monkeypatch.setattr(X, "LITERAL_IDS", 3)
    ids = list(range(1, 400, 3))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = X.rows_of_claims(log, _requests(spark, ids), "claim_id", small=False)
        text = plan_text(rows)
        scan = text[:text.index("Scan parquet")]
        assert "Bucketed: true" in text and scan.count("Exchange") <= 2   # the ids are made distinct and dealt; the log stays
        assert "claim_requests_id" not in [line for line in text.splitlines() if "hashpartitioning" in line]
        got = sorted(r.log_id for r in rows.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    want = sorted(r.log_id for r in t["history"].where(F.col("claim_requests_id").isin(ids)).collect())
    assert got == want and got


def test_no_request_reads_nothing(spark, tables_small, log):
    t = tables_small
    assert X.claim_history_of(_requests(spark, []), log, t["statuses"], t["users"]).count() == 0


def test_latest_remark_does_not_move_the_stored_log(spark, tables_small, log):
    t = tables_small
    last = X.latest_remark(log, t["claims"])
    # only the claims are dealt: one exchange, for them or their broadcast
    text = plan_text(last)
    moved = [line for line in text.splitlines() if "hashpartitioning(claim_requests_id" in line.replace("hashpartitioning(_cid", "hashpartitioning(claim_requests_id")]
    assert not moved
    want = sorted(tuple(r) for r in X.latest_remark(t["history"], t["claims"]).collect())
    assert sorted(tuple(r) for r in last.collect()) == want
