"""W10 within five digits: free numbers in order, across gaps, until none is left."""

from __future__ import annotations

import datetime as dt

import pytest

from claimlake.operators import submissions as W
from helpers import claim, table


def _run(spark, rows, references, monkeypatch, last=None):
    if last is not None:
        monkeypatch.setattr(W, "LAST_NUMBER", last)
    monkeypatch.setattr(W, "PLACES", 3)     # gaps span several stretches
    df = spark.createDataFrame([(i, r, None if y is None else dt.datetime(y, 5, 1)) for i, (r, y) in enumerate(rows)], "seq long, reference string, submitted_at timestamp_ntz")
    claims = table(spark, "claims", [claim(i + 1, reference=r) for i, r in enumerate(references)])
    out = W.assign_free_references(df, claims).orderBy("seq").collect()
    return [(r.reference, r.outcome) for r in out]


def test_free_numbers_are_taken_in_order(spark, monkeypatch):
    references = ["MC-2024-10000", "mc-2024-10002 ", "MC-2024-10003", "MC-2024-10009", "MC-2023-10000", "MC-2024-010001", "MC-2024-99", None, "X"]
    rows = [("", 2024), (" ", 2024), ("MC-2024-10004", 2024), (None, 2023), ("own", 2024)] + [("", 2024)] * 9
    got = _run(spark, rows, references, monkeypatch)
    assert got[:5] == [("MC-2024-10001", "assigned"), ("MC-2024-10005", "assigned"), ("MC-2024-10004", "given"), ("MC-2023-10001", "assigned"), ("own", "given")]
    assert [r for r, _ in got[5:]] == [f"MC-2024-{n}" for n in (10006, 10007, 10008, *range(10010, 10016))]


@pytest.mark.parametrize("used", [[], [10000], [10005], [10001, 10003, 10004]])
def test_when_a_year_is_full(spark, monkeypatch, used):
    free = [n for n in range(10000, 10006) if n not in used]
    got = _run(spark, [("", 2024)] * 8, [f"MC-2024-{n}" for n in used], monkeypatch, last=10005)
    assert got == [(f"MC-2024-{n}", "assigned") for n in free] + [(None, "none_free")] * (8 - len(free))


def test_without_a_year_or_requests(spark, monkeypatch):
    assert _run(spark, [("", None)], [], monkeypatch) == [(None, "none_free")]
    assert _run(spark, [("MC-1", 2024)], [], monkeypatch) == [("MC-1", "given")]
