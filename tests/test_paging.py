"""Deep pages: sought by day, second and id range; equal to the sorted list at every offset."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from claimlake.operators import enrich as E
from claimlake.operators import paging
from claimlake.operators import search as S
from helpers import STATUSES, claim, employee, table


@pytest.fixture(scope="module")
def tables(spark):
    """Missing times, equal times, many claims in one second, shared computer numbers, a status stored twice."""
    rng = random.Random(2)
    day = dt.datetime(2024, 3, 1)
    claims = []
    for i in range(1, 161):
        made = None if i % 9 == 0 else day if i % 3 == 0 else day + dt.timedelta(days=rng.randint(-3, 3), seconds=rng.choice([0, 0, 1, 86399]))
        touched = None if i % 18 == 0 else dt.datetime(2024, 3, 2, 5)
        claims.append(claim(i * 1000, emp_computer_number=f"{i % 6:06d}", created_at=made, updated_at=touched,
                            status=rng.choice(["Submitted", "paid ", "Odd", None]), claim_type=rng.choice(["opd", "specs"])))
    staff = [employee(k, f"{k % 4:06d}", division_code=k % 3) for k in range(1, 8)]
    divisions = spark.createDataFrame([(0, "A"), (1, "B"), (1, "B2")], "div_code int, division_name string")
    statuses = table(spark, "statuses", [*STATUSES, {"s_id": 9, "status_name": "PAID", "status_order": 81}])
    return table(spark, "claims", claims), table(spark, "employees", staff), divisions, statuses


@pytest.mark.parametrize("filters", [S.SearchFilters(), S.SearchFilters(claim_type="opd", status="paid"), S.SearchFilters(search="000")])
def test_every_page_equals_the_sorted_list(tables, filters, monkeypatch):
    rows = S.search_projection(S.search_claims(E.enrich_claims(*tables), filters))
    full = [tuple(r) for r in rows.orderBy(*S.newest_first(rows)).select(*S.SEARCH_COLUMNS).collect()]
    for module in (paging, S):
        monkeypatch.setattr(module, "SHALLOW", 12)   # every page but the first is deep
    monkeypatch.setattr(paging, "ID_RANGE", 4000)
    limit = 17
    pages = range(1, len(full) // limit + 3)
    chosen = pages if len(full) < 150 else [1, 2, 5, len(full) // limit // 2, *list(pages)[-4:]]
    for page in chosen:
        got = [tuple(r) for r in S.search_page_of(*tables, filters, page, limit).collect()]
        assert got == full[(page - 1) * limit:page * limit], page


def test_offsets_beyond_any_list(tables):
    assert S.search_page_of(*tables, S.SearchFilters(), page=10 ** 12, limit=100).count() == 0
    assert S.search_page(E.enrich_claims(*tables), S.SearchFilters(), page=10 ** 12, limit=100).count() == 0


def test_newest_claim(tables):
    rows = S.search_projection(E.enrich_claims(*tables))
    want = rows.orderBy(*S.newest_first(rows)).select(*S.SEARCH_COLUMNS).first()
    assert S.newest_claim(*tables).collect() == [want]
