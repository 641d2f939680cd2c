"""Physical-plan properties: no Python in the hot path, no products, pushdown, partial top-k."""

from __future__ import annotations

import contextlib
import io

import pytest

import __spark_entry__ as entry
from claimlake.operators import dashboard as D
from claimlake.operators import facets as U
from conftest import SF_SMALL

QUERIES = entry.queries()
FORBIDDEN = ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin",
             "PythonUDF")
# these run a job (stream / sink) when built; their result is a plain file scan
SIDE_EFFECT = {"stream_submissions", "stream_status_updates", "publish_claims", "publish_claim_partitions",
               "export_json"}


def plan_text(df, mode: str = "formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SIDE_EFFECT))
def test_no_python_and_no_products(spark, name):
    text = plan_text(QUERIES[name](spark, SF_SMALL))
    for word in FORBIDDEN:
        assert word not in text, f"{name}: {word} in plan"


def test_date_range_reaches_parquet_scan(spark):
    text = plan_text(QUERIES["filter_date_range"](spark, SF_SMALL))
    assert "GreaterThanOrEqual(o_orderdate" in text and "LessThan(o_orderdate" in text
    assert "o_orderpriority" not in text  # unused columns are pruned from the scan


def test_top_k_pages_do_not_sort_everything(spark):
    text = plan_text(QUERIES["search_page"](spark, SF_SMALL))
    assert "TakeOrderedAndProject" in text


def test_per_employee_pages_limit_before_shuffle(spark):
    text = plan_text(QUERIES["paged_per_employee"](spark, SF_SMALL))
    assert "WindowGroupLimit" in text


def test_dimensions_are_broadcast(spark):
    text = plan_text(QUERIES["enrich_claims"](spark, SF_SMALL))
    assert text.count("BroadcastHashJoin") >= 2


@pytest.mark.parametrize("name", ["document_update_outcomes", "reference_exists", "claim_detail",
                                  "employee_claim_counts"])
def test_batches_cut_claims_down_before_shuffling(spark, name):
    # a request batch's keys are broadcast into a semi join on the claims scan
    text = plan_text(QUERIES[name](spark, SF_SMALL))
    assert "BroadcastHashJoin LeftSemi" in text, name


@pytest.mark.parametrize("name,partial", [("latest_remark", "partial_max_by"),
                                          ("apply_document_updates", "partial_max_by"),
                                          ("employee_claim_counts", "partial_count")])
def test_hot_keys_fold_on_the_map_side(spark, name, partial):
    # per-claim / per-employee reductions are partial aggregates before the shuffle
    text = plan_text(QUERIES[name](spark, SF_SMALL))
    assert partial in text, name


def test_status_facets_reduce_claims_by_hash(spark, tables_small):
    """Claims are grouped by their spelling; only the final few rows meet a least string."""
    plan = plan_text(U.status_facets(tables_small["statuses"], tables_small["claims"]), "simple")
    below_union = plan[plan.index("Union"):]
    assert "HashAggregate" in below_union and "SortAggregate" not in below_union


def test_dashboard_lists_take_their_claims_before_the_join(spark, tables_small):
    for make in (D.recent_claims, D.claims_needing_action):
        plan = plan_text(make(tables_small["claims"], tables_small["employees"]), "simple")
        assert "TakeOrderedAndProject" in plan[plan.index("Join"):]
