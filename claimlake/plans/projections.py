"""Scalar derivations (P1–P12) as queries over the claim tables, with SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as P
from ..functions.text import ci
from .registry import query
from .sqltext import PHP_TRIM_SET, SHOWN_NAME, STAFFED


def _claims_with_employee(t):
    emp = t["employees"].select(ci("computer_number").alias("_k"), "e_id", "initials", "surname")
    claims = t["claims"]
    return claims.join(emp, ci(claims["emp_computer_number"]) == emp["_k"], "left")


CLAIM_EMP_FROM = """
FROM fx_claims r LEFT JOIN fx_employees e ON lower(rtrim(e.computer_number)) = lower(rtrim(r.emp_computer_number))"""


@query("employee_name", "P1",
       f"WITH {STAFFED}\nSELECT r_id AS claim_id, person.e_id AS e_id, {SHOWN_NAME} AS employee_name FROM staffed",
       ("claims", "employees", "divisions"))
def _employee_name(t):
    return _claims_with_employee(t).select(
        F.col("r_id").alias("claim_id"), "e_id",
        P.employee_name("initials", "surname", "patient_name").alias("employee_name"))


@query("employee_name_plain", "P2",
       f"SELECT r.r_id AS claim_id, e.e_id, concat_ws(' ', e.initials, e.surname) AS employee_name{CLAIM_EMP_FROM}",
       ("claims", "employees"))
def _employee_name_plain(t):
    return _claims_with_employee(t).select(
        F.col("r_id").alias("claim_id"), "e_id",
        P.employee_name_plain("initials", "surname").alias("employee_name"))


@query("employee_name_strict", "P3",
       "SELECT e_id, initials || ' ' || surname AS employee_name FROM fx_employees", ("employees",))
def _employee_name_strict(t):
    return t["employees"].select("e_id", P.employee_name_strict("initials", "surname").alias("employee_name"))


@query("full_name", "P4",
       f"SELECT e_id, trim(COALESCE(initials, '') || ' ' || COALESCE(surname, ''), {PHP_TRIM_SET}) AS full_name "
       "FROM fx_employees", ("employees",))
def _full_name(t):
    return t["employees"].select("e_id", P.full_name("initials", "surname").alias("full_name"))


@query("division_label", "P5", f"""
SELECT e.e_id, CASE WHEN rtrim(d.division_name) <> '' THEN d.division_name ELSE 'Not Assigned' END AS division
FROM fx_employees e LEFT JOIN fx_divisions d ON d.div_code = e.division_code""", ("employees", "divisions"))
def _division_label(t):
    emp, div = t["employees"], t["divisions"]
    return (emp.join(div, emp["division_code"] == div["div_code"], "left")
            .select("e_id", P.division_label("division_name").alias("division")))


@query("payable_amount", "P6",
       "SELECT r_id AS claim_id, COALESCE(approved_amount, amount_requested, 0) AS payable_amount FROM fx_claims",
       ("claims",))
def _payable_amount(t):
    return t["claims"].select(F.col("r_id").alias("claim_id"),
                              P.payable_amount("approved_amount", "amount_requested").alias("payable_amount"))


@query("activity_ts", "P7", """
SELECT r_id AS claim_id, COALESCE(created_at, updated_at) AS recent_activity_at,
  COALESCE(updated_at, created_at) AS action_activity_at FROM fx_claims""", ("claims",))
def _activity_ts(t):
    return t["claims"].select(F.col("r_id").alias("claim_id"),
                              P.recent_activity_ts("created_at", "updated_at").alias("recent_activity_at"),
                              P.action_activity_ts("created_at", "updated_at").alias("action_activity_at"))


@query("claim_type_label", "P8", """
SELECT seq, CASE WHEN lower(COALESCE(claim_type, '')) = 'specs' THEN 'Spectacles'
  WHEN claim_type IS NULL OR claim_type = '' THEN 'OPD' ELSE upper(claim_type) END AS claim_type_label
FROM fx_submissions""", ("submissions",))
def _claim_type_label(t):
    return t["submissions"].select("seq", P.claim_type_label("claim_type").alias("claim_type_label"))


@query("claim_type_capitalized", "P9", """
SELECT seq, CASE WHEN claim_type IS NULL OR claim_type = '' THEN '—'
  ELSE upper(substr(claim_type, 1, 1)) || lower(substr(claim_type, 2)) END AS claim_type_display
FROM fx_submissions""", ("submissions",))
def _claim_type_capitalized(t):
    return t["submissions"].select("seq", P.claim_type_capitalized("claim_type").alias("claim_type_display"))


@query("amount_lkr", "P10", """
SELECT r_id AS claim_id,
  'LKR ' || format('{:,.2f}', CAST(COALESCE(amount_requested, 0) AS DECIMAL(18,2))) AS amount_requested_lkr,
  'LKR ' || format('{:,.2f}', CAST(COALESCE(approved_amount, 0) AS DECIMAL(18,2))) AS approved_amount_lkr
FROM fx_claims""", ("claims",))
def _amount_lkr(t):
    return t["claims"].select(F.col("r_id").alias("claim_id"),
                              P.amount_lkr("amount_requested").alias("amount_requested_lkr"),
                              P.amount_lkr("approved_amount").alias("approved_amount_lkr"))


@query("display_date", "P11", """
SELECT r_id AS claim_id,
  COALESCE(strftime(COALESCE(opd_date, CAST(created_at AS DATE)), '%Y-%m-%d'), '—') AS display_date
FROM fx_claims""", ("claims",))
def _display_date(t):
    return t["claims"].select(F.col("r_id").alias("claim_id"),
                              P.display_date("opd_date", "created_at").alias("display_date"))


@query("claim_for_label", "P12", """
SELECT seq, CASE WHEN claim_for IS NULL OR claim_for = '' OR claim_for = 'Self' THEN 'Myself' ELSE claim_for END
  AS claim_for_label FROM fx_submissions""", ("submissions",))
def _claim_for_label(t):
    return t["submissions"].select("seq", P.claim_for_label("claim_for").alias("claim_for_label"))
