"""Employee self-service queries (J4, A9, G3, L4) and their SQL oracles."""

from __future__ import annotations

from ..operators import employee as M
from .registry import query
from .sqltext import EMP_BY_CREDENTIALS, text_or_empty

REQUESTS = f"""q AS (SELECT request_id, {text_or_empty('computer_number')} AS cn, {text_or_empty('nic')} AS nic_in,
    CASE WHEN COALESCE(page, 1) < 1 THEN 1 ELSE COALESCE(page, 1) END AS pg,
    CASE WHEN COALESCE(page_limit, 10) < 1 THEN 10 WHEN COALESCE(page_limit, 10) > 50 THEN 50
         ELSE COALESCE(page_limit, 10) END AS lim
  FROM fx_access_requests)"""
VERIFIED = f"""{EMP_BY_CREDENTIALS},
{REQUESTS},
v AS (SELECT q.*, e.e_id AS emp_e_id,
        CASE WHEN q.cn = '' OR q.nic_in = '' THEN 'missing_input' WHEN e.e_id IS NULL THEN 'invalid_employee'
             ELSE 'ok' END AS outcome
      FROM q LEFT JOIN emp2 e ON lower(rtrim(e.computer_number)) = lower(rtrim(q.cn))
                             AND lower(rtrim(e.nic)) = lower(rtrim(q.nic_in)))"""


def _verify_sql() -> str:
    cols = []
    for name in M.VERIFY_COLUMNS:
        expr = "initials || ' ' || surname" if name == "employee_name" else name
        cols.append(f"CASE WHEN outcome = 'ok' THEN {expr} END AS {name}")
    return f"""
WITH {EMP_BY_CREDENTIALS},
{REQUESTS},
j AS (SELECT q.request_id,
        CASE WHEN q.cn = '' THEN 'missing_computer_number' WHEN q.nic_in = '' THEN 'missing_nic'
             WHEN e.e_id IS NULL THEN 'invalid_employee' ELSE 'ok' END AS outcome,
        e.*, d.division_name
      FROM q LEFT JOIN emp2 e ON lower(rtrim(e.computer_number)) = lower(rtrim(q.cn))
                             AND lower(rtrim(e.nic)) = lower(rtrim(q.nic_in))
      LEFT JOIN fx_divisions d ON d.div_code = e.division_code)
SELECT request_id, outcome, {', '.join(cols)}
FROM j"""


@query("verify_employees", "J4", _verify_sql(), ("access_requests", "employees", "divisions"))
def _verify_employees(t):
    return M.verify_employees(t["access_requests"], t["employees"], t["divisions"])


@query("employee_claim_counts", "A9", f"""
WITH {VERIFIED},
cnt AS (SELECT lower(rtrim(emp_computer_number)) AS k, COUNT(*) AS n FROM fx_claims GROUP BY 1)
SELECT v.request_id, v.outcome,
  CASE WHEN v.outcome = 'ok' THEN v.pg END AS page, CASE WHEN v.outcome = 'ok' THEN v.lim END AS page_limit,
  CAST(CASE WHEN v.outcome = 'ok' THEN COALESCE(cnt.n, 0) END AS BIGINT) AS total_claims,
  CAST(CASE WHEN v.outcome = 'ok' THEN CASE WHEN COALESCE(cnt.n, 0) > 0 THEN ceil(cnt.n / v.lim) ELSE 1 END END
       AS BIGINT) AS total_pages
FROM v LEFT JOIN cnt ON v.outcome = 'ok' AND cnt.k = lower(rtrim(v.cn))""", ("access_requests", "employees", "claims"))
def _employee_claim_counts(t):
    return M.employee_claim_counts(t["access_requests"], t["employees"], t["claims"])


RANKED = """r AS (SELECT c.*, lower(rtrim(emp_computer_number)) AS k, row_number() OVER (
    PARTITION BY lower(rtrim(emp_computer_number)) ORDER BY created_at DESC NULLS LAST, r_id DESC) AS row_no
  FROM fx_claims c)"""
PAGE_SELECT = """
SELECT p.request_id, CAST(r.row_no - (p.pg - 1) * p.lim AS INTEGER) AS position, r.r_id AS claim_id, r.reference,
  r.opd_date, r.claim_type, r.amount_requested, r.patient_name, r.claim_for, r.status, r.is_document_received,
  r.created_at
FROM p JOIN r ON r.k = lower(rtrim(p.cn)) AND r.row_no > (p.pg - 1) * p.lim AND r.row_no <= p.pg * p.lim"""


@query("paged_per_employee", "G3", f"""
WITH {REQUESTS},
p AS (SELECT * FROM q WHERE cn <> ''),
{RANKED}{PAGE_SELECT}""", ("access_requests", "claims"))
def _paged_per_employee(t):
    return M.paged_per_employee(t["access_requests"], t["claims"])


@query("employee_page", "L4", f"""
WITH {VERIFIED},
p AS (SELECT * FROM v WHERE outcome = 'ok'),
{RANKED}{PAGE_SELECT}""", ("access_requests", "employees", "claims"))
def _employee_page(t):
    return M.employee_page(t["access_requests"], t["employees"], t["claims"])
