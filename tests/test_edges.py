"""Edge cases of the source application's rules on tiny hand-made tables."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from claimlake.functions import labels
from claimlake.functions.text import like_contains_pattern, php_trim
from claimlake.operators import dashboard as D
from claimlake.operators import details as X
from claimlake.operators import employee as M
from claimlake.operators import enrich as E
from claimlake.operators import facets as U
from claimlake.operators import search as S
from claimlake.operators import submissions as W
from claimlake.operators import updates as UP
from helpers import STATUSES, claim, employee, table


@pytest.fixture()
def dims(spark):
    divisions = table(spark, "divisions", [{"div_code": 1, "division_name": "Ops"},
                                           {"div_code": 2, "division_name": "  "}])
    statuses = table(spark, "statuses", STATUSES)
    return divisions, statuses


def test_case_and_trailing_blank_insensitive_keys(spark, dims):
    divisions, statuses = dims
    claims = table(spark, "claims", [claim(1, emp_computer_number="00000a ", status="PAID "),
                                     claim(2, status="paid")])
    emps = table(spark, "employees", [employee(1, "00000A")])
    counts = {r.status_name: r.total for r in D.status_counts(statuses, claims).collect()}
    assert counts["Paid"] == 2
    enriched = E.enrich_claims(claims, emps, divisions, statuses).where("r_id = 1").first()
    assert enriched.e_id == 1 and enriched.s_id == 8


def test_fan_out_is_counted(spark, dims):
    divisions, statuses = dims
    claims = table(spark, "claims", [claim(1, emp_computer_number="000009")])
    emps = table(spark, "employees", [employee(1, "000009"), employee(2, "000009")])
    enriched = E.enrich_claims(claims, emps, divisions, statuses)
    assert S.search_count(enriched, S.SearchFilters()).first().total_records == 2
    # the detail view picks one employee (smallest e_id)
    req = spark.createDataFrame([(1, 1)], "request_id long, claim_id int")
    detail = X.claim_detail(req, claims, emps, divisions).collect()
    assert len(detail) == 1 and detail[0].outcome == "ok"


def test_like_keeps_user_wildcards():
    assert like_contains_pattern("00_1") == "%00_1%"
    assert like_contains_pattern("A\\%") == "%a\\%%"
    assert like_contains_pattern("a\\b") == "%ab%"


def test_text_filter_matches_name_case_insensitively(spark, dims):
    divisions, statuses = dims
    claims = table(spark, "claims", [claim(1), claim(2, emp_computer_number="777")])
    emps = table(spark, "employees", [employee(1, "000001", surname="Building")])
    enriched = E.enrich_claims(claims, emps, divisions, statuses)
    hits = S.search_claims(enriched, S.SearchFilters(search="  BUILD ")).select("r_id").collect()
    assert [r.r_id for r in hits] == [1]


def test_impossible_date_filter_raises():
    with pytest.raises(ValueError):
        S.date_range_predicate("2024-02-30", "")
    assert S.date_range_predicate("2024-2-3", "") is None  # wrong shape: ignored


def test_concat_forms(spark):
    df = spark.createDataFrame([(None, "SMITH", "Pat")], "i string, s string, p string")
    row = df.select(labels.employee_name("i", "s", "p").alias("a"),
                    labels.employee_name_plain("i", "s").alias("b"),
                    labels.employee_name_strict("i", "s").alias("c"),
                    labels.full_name("i", "s").alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == ("SMITH", "SMITH", None, "SMITH")
    df = spark.createDataFrame([(None, None, None)], "i string, s string, p string")
    assert df.select(labels.employee_name("i", "s", "p")).first()[0] == "Unknown Employee"


def test_php_trim_strips_control_whitespace(spark):
    df = spark.createDataFrame([("\t\n x \x0b\x00",)], "v string")
    assert df.select(php_trim("v")).first()[0] == "x"
    assert df.select(F.trim("v")).first()[0] != "x"  # SQL TRIM strips blanks only


def test_labels(spark):
    df = spark.createDataFrame(
        [("SPECS", "Self", 1234.5, None), ("", "", None, None), (" specs", "MYSELF", -3.0, None)],
        "t string, f string, a double, d date")
    rows = df.select(labels.claim_type_label("t").alias("l"), labels.claim_type_capitalized("t").alias("c"),
                     labels.claim_for_label("f").alias("f"), labels.amount_lkr("a").alias("m")).collect()
    assert [(r.l, r.c, r.f, r.m) for r in rows] == [
        ("Spectacles", "Specs", "Myself", "LKR 1,234.50"),
        ("OPD", "—", "Myself", "LKR 0.00"),
        (" SPECS", " specs", "MYSELF", "LKR -3.00")]


def test_facets_take_smallest_real_id(spark):
    statuses = table(spark, "statuses", [{"s_id": 5, "status_name": "Paid", "status_order": 80},
                                         {"s_id": 3, "status_name": "PAID", "status_order": 85}])
    claims = table(spark, "claims", [claim(1, status="paid"), claim(2, status="Legacy"), claim(3, status=" ")])
    rows = {r.status_name: (r.status_id, r.status_order) for r in U.status_facets(statuses, claims).collect()}
    assert rows == {"PAID": (3, 80), "Legacy": (0, 999)}


def test_null_type_group_and_type_share(spark):
    claims = table(spark, "claims", [claim(1, claim_type=None), claim(2), claim(3, claim_type="specs")])
    counts = {r.claim_type: r.total for r in D.claim_type_counts(claims).collect()}
    assert counts == {None: 1, "opd": 1, "specs": 1}
    share = D.type_share(claims).first()
    assert (share.opd, share.specs, share.total, share.opd_pct) == (1, 1, 2, 50.0)


def test_progress_timeline_case_sensitive(spark):
    claims = table(spark, "claims", [claim(1, status=""), claim(2, status="Rejected by Doctor"),
                                     claim(3, status="paid"), claim(4, status="Paid")])
    done = {}
    for r in X.progress_timeline(claims).collect():
        done.setdefault(r.claim_id, []).append((r.is_done, r.is_current))
    assert done[1][0] == (True, True) and sum(d for d, _ in done[1]) == 1
    assert not any(d for d, _ in done[2]) and not any(d for d, _ in done[3])
    assert all(d for d, _ in done[4]) and done[4][-1] == (True, True)


def test_admin_paging_clamps(spark, dims):
    divisions, statuses = dims
    claims = table(spark, "claims", [claim(i) for i in range(1, 6)])
    emps = table(spark, "employees", [employee(1, "000001")])
    enriched = E.enrich_claims(claims, emps, divisions, statuses)
    assert S.clamp_admin_paging(0, 0) == (1, 1)
    assert S.clamp_admin_paging("2", 101) == (2, 100)
    assert S.clamp_admin_paging(1, "abc") == (1, 1)
    assert S.search_page(enriched, S.SearchFilters(), page=1000, limit=10).count() == 0
    page = [r.claim_id for r in S.search_page(enriched, S.SearchFilters(), page=2, limit=2).collect()]
    assert page == [3, 2]


def test_employee_paging_clamps(spark):
    p, n = M.clamp_employee_paging(F.col("p"), F.col("n"))
    df = spark.createDataFrame([(0, 0), (2, 51), (None, None), (3, 7)], "p int, n int")
    assert [(r[0], r[1]) for r in df.select(p, n).collect()] == [(1, 10), (2, 50), (1, 10), (3, 7)]


def _submission(seq, **kw):
    base = {"seq": seq, "submitted_at": dt.datetime(2024, 3, 1, 10), "reference": f"R{seq}",
            "computer_number": "000001", "nic": "1V", "opd_date": "2024-02-01", "amount_requested": "10",
            "claim_type": "opd", "claim_for": "MYSELF", "patient_name": "Pat"}
    base.update(kw)
    return base


def _submissions(spark, rows):
    cols = ["seq", "submitted_at", "reference", "computer_number", "nic", "opd_date", "amount_requested",
            "claim_type", "claim_for", "patient_name"]
    return spark.createDataFrame(
        [tuple(r[c] for c in cols) for r in rows],
        "seq long, submitted_at timestamp_ntz, reference string, computer_number string, nic string, "
        "opd_date string, amount_requested string, claim_type string, claim_for string, patient_name string")


def test_submission_rule_order(spark):
    emps = table(spark, "employees", [employee(1, "000001", nic="1V", initials="A.", surname="SMITH")])
    subs = _submissions(spark, [
        _submission(1, patient_name=" ", opd_date="bad"),      # missing beats bad date
        _submission(2, opd_date="2024-02-30", claim_type="x"),  # bad date beats bad type
        _submission(3, claim_type=" SPECS ", claim_for="cousin"),
        _submission(4, amount_requested="1e3"),
        _submission(5, amount_requested="0"),
        _submission(6, amount_requested="NaN"),
        _submission(7, nic="2V"),
        _submission(8, nic=" 1v "),
    ])
    got = {r.seq: r.outcome for r in W.validate_submissions(subs, emps).collect()}
    assert got == {1: "missing_field", 2: "bad_date", 3: "bad_for", 4: "ok", 5: "bad_amount",
                   6: "bad_amount", 7: "bad_employee", 8: "ok"}


def test_client_rules_fill_patient_and_reject_future(spark):
    emps = table(spark, "employees", [employee(1, "000001", initials="A.", surname="SMITH")])
    subs = _submissions(spark, [_submission(1, patient_name="", claim_for="MYSELF"),
                                _submission(2, opd_date="2024-03-02")])
    got = {r.seq: (r.outcome, r.v_patient_name)
           for r in W.validate_submissions(subs, emps, client_rules=True).collect()}
    assert got[1] == ("ok", "A. SMITH")
    assert got[2][0] == "future_date"


def test_duplicates_within_batch_and_table(spark):
    emps = table(spark, "employees", [employee(1, "000001")])
    claims = table(spark, "claims", [claim(10, reference="MC-OLD")])
    subs = _submissions(spark, [
        _submission(1, reference="new-1", amount_requested="x"),   # rejected: does not reserve
        _submission(2, reference="NEW-1 "),
        _submission(3, reference="new-1"),
        _submission(4, reference="mc-old"),
        _submission(5, reference="other"),
    ])
    res = {r.seq: (r.outcome, r.claim_id) for r in W.ingest_submissions(subs, claims, emps).collect()}
    assert res == {1: ("bad_amount", None), 2: ("accepted", 11), 3: ("duplicate_reference", None),
                   4: ("duplicate_reference", None), 5: ("accepted", 12)}


def test_assign_references_continue_per_year(spark):
    claims = table(spark, "claims", [claim(1, reference="MC-2024-00193")])
    subs = _submissions(spark, [_submission(1, reference=" "), _submission(2, reference="MC-2024-00200"),
                                _submission(3, reference=""),
                                _submission(4, reference=None, submitted_at=dt.datetime(2025, 1, 1))])
    got = {r.seq: r.reference for r in W.assign_references(subs, claims).collect()}
    assert got == {1: "MC-2024-00201", 2: "MC-2024-00200", 3: "MC-2024-00202", 4: "MC-2025-00001"}


def _updates(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_document_updates_rules_and_blank_overwrite(spark):
    claims = table(spark, "claims", [claim(1, invoice_number="INV", is_document_received=0)])
    schema = ("seq long, ts timestamp_ntz, claim_id int, is_document_received string, "
              "physical_document_received string, document_received_date string, invoice_number string")
    t = dt.datetime(2024, 5, 1)
    ups = _updates(spark, [(1, t, 1, "Yes", None, "", "X"),
                           (2, t, 1, None, "yes", "2024-05-01 10:30:00", " "),
                           (3, t, 99, "1", None, "", ""),
                           (4, t, 1, "1", None, "garbage", "")], schema)
    batch = UP.apply_document_updates(ups, claims)
    got = {r.seq: r.outcome for r in batch.outcomes.collect()}
    assert got == {1: "invalid_input", 2: "accepted", 3: "not_found", 4: "invalid_date"}
    row = batch.claims.first()
    assert row.is_document_received == 1 and row.invoice_number is None
    assert row.document_received_date == dt.datetime(2024, 5, 1, 10, 30) and row.updated_at == t


def test_payment_zero_allowed_negative_rejected(spark):
    claims = table(spark, "claims", [claim(1, status="Paid")])
    schema = "seq long, ts timestamp_ntz, claim_id int, approved_amount string, payment_approved_date string, paid_date string"
    t = dt.datetime(2024, 5, 1)
    ups = _updates(spark, [(1, t, 1, "-1", "", ""), (2, t, 1, " 0 ", "2024-05-01", "")], schema)
    batch = UP.apply_payment_updates(ups, claims)
    assert {r.seq: r.outcome for r in batch.outcomes.collect()} == {1: "invalid_input", 2: "accepted"}
    row = batch.claims.first()
    assert row.approved_amount == 0.0 and row.status == "Paid" and row.paid_date is None


def test_status_updates_resolve_insert_and_replay(spark):
    claims = table(spark, "claims", [claim(1, status="Legacy"), claim(2, status="paid")])
    statuses = table(spark, "statuses", STATUSES)
    history = table(spark, "history", [{"log_id": 100, "claim_requests_id": 1, "updated_by": 1,
                                        "old_status_id": 1, "new_status_id": 1}])
    schema = ("seq long, ts timestamp_ntz, claim_id int, new_status_id int, new_status_name string, "
              "remarks string, updated_by int")
    t = dt.datetime(2024, 5, 1)
    ups = _updates(spark, [
        (1, t, 1, 0, "received document", "r1", 5),     # stored spelling, old 'Legacy' inserted
        (2, t, 1, 0, "Rejected by Doctor", "r2", 5),     # new canonical spelling → order 60
        (3, t, 2, 0, "rejected BY doctor", "r3", 5),     # found (inserted by seq 2)
        (4, t, 2, 9, "", "r4", 5),                       # id of 'Legacy', inserted by seq 1
        (5, t, 1, 8, "", " ", 5),                        # blank remark
        (6, t, 7, 8, "", "r6", 5),                       # no such claim
        (7, t, 2, 11, "", "r7", 5),                      # id never introduced
    ], schema)
    res = UP.apply_status_updates(ups, claims, statuses, history)
    assert {r.seq: r.outcome for r in res.outcomes.collect()} == {
        1: "accepted", 2: "accepted", 3: "accepted", 4: "accepted", 5: "missing_input", 6: "not_found", 7: "invalid_status"}
    new = {r.status_name: (r.s_id, r.status_order) for r in res.new_statuses.collect()}
    assert new == {"Legacy": (9, 999), "Rejected by Doctor": (10, 60)}
    replay = {r.seq: (r.old_status, r.new_status) for r in res.replay.collect()}
    assert replay == {1: ("Legacy", "Received Document"), 2: ("Received Document", "Rejected by Doctor"),
                      3: ("paid", "Rejected by Doctor"), 4: ("Rejected by Doctor", "Legacy")}
    hist = {r.log_id: (r.claim_requests_id, r.old_status_id, r.new_status_id) for r in res.history.collect()}
    assert hist == {101: (1, 9, 2), 102: (1, 2, 10), 103: (2, 8, 10), 104: (2, 10, 9)}
    final = {r.r_id: r.status for r in res.claims.collect()}
    assert final == {1: "Rejected by Doctor", 2: "Legacy"}


def test_status_ids_are_valid_from_their_introduction_on(spark):
    """An id counts from the update after its introduction; an accepted late id may introduce the next one."""
    claims = table(spark, "claims", [claim(1, status="Old A"), claim(2, status="Old B"), claim(3, status="paid"),
                                     claim(4, status=None)])
    statuses = table(spark, "statuses", STATUSES)
    history = table(spark, "history", [])
    t = dt.datetime(2024, 5, 1)
    ups = _updates(spark, [
        (1, t, 3, 9, "", "r", 5),        # nothing has id 9 yet
        (2, t, 1, 0, "paid", "r", 5),    # introduces 'Old A' as 9
        (3, t, 2, 9, "", "r", 5),        # valid now; introduces 'Old B' as 10
        (4, t, 3, 10, "", "r", 5),       # valid through seq 3
        (5, t, 4, 10, "", "r", 5),       # introduces NULL as 11
        (6, t, 3, 12, "", "r", 5),       # never introduced
    ], "seq long, ts timestamp_ntz, claim_id int, new_status_id int, new_status_name string, remarks string, updated_by int")
    res = UP.apply_status_updates(ups, claims, statuses, history)
    assert [r.outcome for r in res.outcomes.orderBy("seq").collect()] == [
        "invalid_status", "accepted", "accepted", "accepted", "accepted", "invalid_status"]
    assert {r.s_id: r.status_name for r in res.new_statuses.collect()} == {9: "Old A", 10: "Old B", 11: None}
    assert {r.r_id: r.status for r in res.claims.collect()} == {1: "Paid", 2: "Old A", 3: "Old B", 4: "Old B"}
    assert [(r.old_status_id, r.new_status_id) for r in res.history.orderBy("log_id").collect()] == [
        (9, 8), (10, 9), (8, 10), (11, 10)]


def test_latest_remark_fallbacks(spark):
    claims = table(spark, "claims", [claim(1, medical_remark="med"), claim(2, medical_remark=""),
                                     claim(3, medical_remark="m3")])
    history = table(spark, "history", [
        {"log_id": 1, "remarks": " keep ", "updated_at": dt.datetime(2024, 1, 1), "claim_requests_id": 1},
        {"log_id": 2, "remarks": "  ", "updated_at": dt.datetime(2024, 1, 2), "claim_requests_id": 1},
        {"log_id": 3, "remarks": None, "updated_at": dt.datetime(2024, 1, 3), "claim_requests_id": 3}])
    got = {r.claim_id: r.latest_remark for r in X.latest_remark(history, claims).collect()}
    assert got == {1: " keep ", 2: "No remarks yet.", 3: "m3"}


def test_bad_rows_do_not_abort_a_batch(spark):
    """Ids read by their leading integer, dates must be whole, amounts beyond the money type keep their row."""
    from claimlake.functions.text import like_contains_pattern, money
    from claimlake.operators.common import leading_int
    from claimlake.operators.updates import whole_date

    df = spark.createDataFrame([("2x",), ("3.7",), ("abc",), (None,), ("-4",), ("99999999999",), ("true",)], "v string")
    assert [r[0] for r in df.select(leading_int("v")).collect()] == [2, 3, 0, 0, -4, 0, 0]
    dates = spark.createDataFrame([("2024",), ("2024-01",), ("2024-1-5T99",), ("2024-01-05",), ("2024-01-05 10:00:00",)], "v string")
    assert [r[0] is not None for r in dates.select(whole_date(F.col("v"))).collect()] == [False, False, False, True, True]
    amounts = spark.createDataFrame([(1e300,), (12.345,)], "v double")
    assert [r[0] is not None for r in amounts.select(money("v")).collect()] == [False, True]
    assert like_contains_pattern("a\\\\b") == "%a\\\\b%" and like_contains_pattern("a\\b") == "%ab%"


def test_shared_folder_is_required_off_local_masters(spark, monkeypatch):
    from types import SimpleNamespace

    from claimlake import session

    sc = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    other = SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda key, default=None: default))
    with pytest.raises(ValueError):
        session.checkpoint_dir(other)
