"""Claim detail queries (J2, J3, J5, G1, E1) and their SQL oracles."""

from __future__ import annotations

import uuid

from ..operators import details as X
from ..session import scratch_path
from ..sources.claim_log import write_claim_log
from .registry import query
from .sqltext import EMP_BY_CREDENTIALS, PEOPLE, SHOWN_DIVISION, SHOWN_NAME, ci, lookup, select_list, text_or_empty

DETAIL_SOURCES = {
    "claim_id": "r_id", "reference_no": "reference", "computer_no": "emp_computer_number",
    "current_status_name": "status", "employee_name": SHOWN_NAME, "division": SHOWN_DIVISION,
    **{c: f"person.{c}" for c in ("nic", "initials", "surname")},
}
DETAIL_SQL = f"""
WITH {PEOPLE},
asked AS (SELECT request_id, COALESCE(claim_id, 0) AS requested_id FROM fx_access_requests),
known AS (SELECT fx_claims.*, found[1] AS person
  FROM fx_claims LEFT JOIN people ON person_key = {ci('emp_computer_number')}),
found_rows AS (SELECT request_id, requested_id, 'ok' AS outcome, {select_list(X.DETAIL_COLUMNS, DETAIL_SOURCES)}
  FROM asked JOIN known ON r_id = requested_id WHERE requested_id > 0)
SELECT * FROM found_rows
UNION ALL BY NAME
SELECT request_id, requested_id, CASE WHEN requested_id > 0 THEN 'not_found' ELSE 'invalid_id' END AS outcome
FROM asked WHERE request_id NOT IN (SELECT request_id FROM found_rows)"""


@query("claim_detail", "J2", DETAIL_SQL, ("access_requests", "claims", "employees", "divisions"))
def _claim_detail(t):
    return X.claim_detail(t["access_requests"], t["claims"], t["employees"], t["divisions"])


HISTORY_FX = ("history", "statuses", "users")
ADMIN_HISTORY_COLUMNS = ["claim_id", "history_id", "old_status", "new_status", "remarks", "updated_by", "updated_at"]
OLD_STATUS, NEW_STATUS = (lookup("fx_statuses", "s_id", "status_name", f"fx_history.{c}")
                          for c in ("old_status_id", "new_status_id"))
ADMIN_HISTORY_SOURCES = {
    "claim_id": "claim_requests_id", "history_id": "log_id", "old_status": OLD_STATUS, "new_status": NEW_STATUS,
    "updated_by": lookup("fx_users", "u_id", "username", "fx_history.updated_by"),
}
EMPLOYEE_HISTORY_SOURCES = {
    "old_status_name": OLD_STATUS, "new_status_name": NEW_STATUS,
    "updated_by_name": lookup("fx_users", "u_id", "fullname", "fx_history.updated_by"),
}


@query("claim_history_admin", "J3",
       f"SELECT {select_list(ADMIN_HISTORY_COLUMNS, ADMIN_HISTORY_SOURCES)} FROM fx_history", HISTORY_FX)
def _claim_history_admin(t):
    return X.claim_history_admin(t["history"], t["statuses"], t["users"])


def _stored_log(t):
    """The log stored by claim id, in as many buckets as joins have partitions."""
    name = f"claim_log_{uuid.uuid4().hex}"
    buckets = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    return write_claim_log(t["history"], name, scratch_path(t.spark, "claimlake", name), buckets)


@query("claim_history_for_requests", "J3", f"""
SELECT request_id, {select_list(ADMIN_HISTORY_COLUMNS, ADMIN_HISTORY_SOURCES)}
FROM fx_access_requests JOIN fx_history ON claim_requests_id = claim_id WHERE claim_id > 0""", ("access_requests",) + HISTORY_FX)
def _claim_history_for_requests(t):
    """J3 for the claims of the requests, from a log stored by claim id."""
    return X.claim_history_of(t["access_requests"], _stored_log(t), t["statuses"], t["users"])


EMPLOYEE_HISTORY = select_list(X.EMPLOYEE_HISTORY_COLUMNS, EMPLOYEE_HISTORY_SOURCES)


@query("claim_history_employee", "J3", f"SELECT {EMPLOYEE_HISTORY} FROM fx_history", HISTORY_FX)
def _claim_history_employee(t):
    return X.claim_history_employee(t["history"], t["statuses"], t["users"])


AUTH_CTES = f"""
WITH {EMP_BY_CREDENTIALS},
q AS (SELECT request_id, claim_id, {text_or_empty('computer_number')} AS cn, {text_or_empty('nic')} AS nic_in
      FROM fx_access_requests),
v AS (SELECT q.*, e.e_id AS emp_e_id, e.computer_number AS emp_cn, e.nic AS emp_nic, e.initials AS emp_initials,
        e.surname AS emp_surname, d.division_name AS emp_division,
        (q.cn = '' OR q.nic_in = '' OR COALESCE(q.claim_id, 0) <= 0) AS missing
      FROM q LEFT JOIN emp2 e ON lower(rtrim(e.computer_number)) = lower(rtrim(q.cn))
                             AND lower(rtrim(e.nic)) = lower(rtrim(q.nic_in))
      LEFT JOIN fx_divisions d ON d.div_code = e.division_code),
j AS (SELECT v.*, r.r_id AS rid, r.reference, r.opd_date, r.amount_requested, r.claim_type, r.patient_name,
        r.emp_computer_number, r.claim_for, r.status, r.is_document_received, r.document_received_date,
        r.invoice_number, r.medical_recommendation, r.medical_remark, r.doctor_approved_date, r.approved_amount,
        r.payment_approved_date, r.paid_date, r.created_at, r.updated_at
      FROM v LEFT JOIN fx_claims r ON NOT v.missing AND v.emp_e_id IS NOT NULL AND r.r_id = v.claim_id
        AND lower(rtrim(r.emp_computer_number)) = lower(rtrim(v.cn)))"""
AUTHORIZED_SQL = AUTH_CTES + """
SELECT request_id,
  CASE WHEN missing THEN 'missing_input' WHEN emp_e_id IS NULL THEN 'invalid_employee'
       WHEN rid IS NULL THEN 'not_found' ELSE 'ok' END AS outcome,
  CASE WHEN rid IS NOT NULL THEN emp_e_id END AS employee_id,
  CASE WHEN rid IS NOT NULL THEN emp_cn END AS employee_computer_number,
  CASE WHEN rid IS NOT NULL THEN emp_nic END AS employee_nic,
  CASE WHEN rid IS NOT NULL THEN trim(COALESCE(emp_initials, '') || ' ' || COALESCE(emp_surname, ''),
       ' ' || chr(9) || chr(10) || chr(13) || chr(0) || chr(11)) END AS full_name,
  CASE WHEN rid IS NOT NULL THEN emp_division END AS division,
  rid AS claim_id, reference, opd_date, amount_requested, claim_type, patient_name, emp_computer_number,
  claim_for, status, is_document_received, document_received_date, invoice_number, medical_recommendation,
  medical_remark, doctor_approved_date, approved_amount, payment_approved_date, paid_date, created_at, updated_at
FROM j"""
AUTH_FX = ("access_requests", "employees", "divisions", "claims")


@query("authorized_claim", "J5", AUTHORIZED_SQL, AUTH_FX)
def _authorized_claim(t):
    return X.authorized_claim(t["access_requests"], t["employees"], t["divisions"], t["claims"])


@query("authorized_history", "J5", AUTH_CTES + f""",
ok AS (SELECT request_id, rid FROM j WHERE rid IS NOT NULL)
SELECT request_id, {EMPLOYEE_HISTORY} FROM ok JOIN fx_history ON claim_requests_id = rid""", AUTH_FX + HISTORY_FX)
def _authorized_history(t):
    return X.authorized_history(t["access_requests"], t["employees"], t["divisions"], t["claims"],
                                t["history"], t["statuses"], t["users"])


JS_TRIM = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160) || chr(65279)"


LATEST_REMARK_SQL = f"""
WITH last AS (
  SELECT claim_requests_id, remarks, row_number() OVER (
    PARTITION BY claim_requests_id ORDER BY updated_at DESC, log_id DESC) AS rn
  FROM fx_history WHERE trim(remarks, {JS_TRIM}) <> '')
SELECT r.r_id AS claim_id,
  COALESCE(l.remarks, CASE WHEN r.medical_remark <> '' THEN r.medical_remark END, 'No remarks yet.') AS latest_remark
FROM fx_claims r LEFT JOIN last l ON l.claim_requests_id = r.r_id AND l.rn = 1"""


@query("latest_remark", "G1", LATEST_REMARK_SQL, ("history", "claims"))
def _latest_remark(t):
    return X.latest_remark(t["history"], t["claims"])


@query("latest_remark_stored", "G1", LATEST_REMARK_SQL, ("history", "claims"))
def _latest_remark_stored(t):
    """G1 from a log stored by claim id."""
    return X.latest_remark(_stored_log(t), t["claims"])


def _steps_values() -> str:
    return ", ".join(f"({i + 1}, '{s}')" for i, s in enumerate(X.PROGRESS_STEPS))


@query("progress_timeline", "E1", f"""
WITH s(step_no, step) AS (VALUES {_steps_values()}),
c AS (SELECT r_id, CASE WHEN status IS NULL OR status = '' THEN 'Submitted' ELSE status END AS st FROM fx_claims),
cur AS (SELECT c.r_id, c.st, COALESCE((SELECT step_no FROM s WHERE s.step = c.st), 0) AS cur FROM c)
SELECT cur.r_id AS claim_id, CAST(s.step_no AS INTEGER) AS step_no, s.step,
  s.step_no <= cur.cur AS is_done, s.step = cur.st AS is_current
FROM cur CROSS JOIN s""", ("claims",))
def _progress_timeline(t):
    return X.progress_timeline(t["claims"])
