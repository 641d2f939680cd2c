"""Every registered query against its DuckDB oracle on the smallest fixture."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from claimlake.plans import registry
from conftest import SF_SMALL
from oracle_check import compare, duck_connection

QUERIES = entry.queries()
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return duck_connection(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF_SMALL).toPandas()
    want = duck.execute(ORACLE[name]).fetchdf()
    ok, msg = compare(got, want)
    assert ok, f"{name}: {msg}"


def test_every_query_has_oracle_or_is_documented():
    # the training-data queries have their own tests
    registry.load_all()
    assert set(registry.QUERIES) - set(registry.ORACLE) == set()


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1
    assert df.columns == ["status_id", "status_name", "status_order", "total"]
