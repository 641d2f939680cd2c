"""Dashboard queries (A1–A7, L1, L2) and their SQL oracles."""

from __future__ import annotations

from ..operators import dashboard as D
from .registry import query
from .sqltext import STAFFED, ci, lookup, select_list

PAYABLE_CENTS = "CAST(COALESCE(approved_amount, amount_requested, 0) AS DECIMAL(18,2))"


def _sum_sql(names: tuple[str, ...]) -> str:
    keys = ", ".join(f"'{n.lower()}'" for n in names)
    return (f"CAST(COALESCE(SUM(CASE WHEN lower(rtrim(status)) IN ({keys}) THEN {PAYABLE_CENTS} END), 0) AS DOUBLE)")


@query("total_claims", "A1", "SELECT COUNT(*) AS total_claims FROM fx_claims", ("claims",))
def _total_claims(t):
    return D.total_claims(t["claims"])


STATUS_COUNTS_SQL = f"""
WITH carried AS (SELECT {ci('status')} AS k, count(r_id) AS n FROM fx_claims GROUP BY k)
SELECT s_id AS status_id, status_name, status_order,
  COALESCE({lookup('carried', 'k', 'n', ci('status_name'))}, 0) AS total
FROM fx_statuses"""


@query("status_counts", "A2", STATUS_COUNTS_SQL, ("statuses", "claims"))
def _status_counts(t):
    return D.status_counts(t["statuses"], t["claims"])


@query("payment_summary", "A3", f"""
SELECT {_sum_sql(('Paid',))} AS total_paid_amount,
  {_sum_sql(('Payment Approved',))} AS pending_payment_amount,
  {_sum_sql(D.APPROVED_STATUSES)} AS total_approved_amount
FROM fx_claims""", ("claims",))
def _payment_summary(t):
    return D.payment_summary(t["claims"])


@query("claim_type_counts", "A4",
       "SELECT claim_type, COUNT(*) AS total FROM fx_claims GROUP BY claim_type", ("claims",))
def _claim_type_counts(t):
    return D.claim_type_counts(t["claims"])


def _kpi_sql() -> str:
    picks = ",\n  ".join(
        f"COALESCE((SELECT total FROM counted WHERE status_name = '{name}' "
        f"ORDER BY status_order DESC, s_id DESC LIMIT 1), 0) AS {D._kpi_name(name)}"
        for name in D.KPI_STATUSES)
    return f"""
WITH per AS (SELECT lower(rtrim(status)) AS k, COUNT(r_id) AS n FROM fx_claims GROUP BY 1),
counted AS (SELECT s.s_id, s.status_name, s.status_order, COALESCE(per.n, 0) AS total
            FROM fx_statuses s LEFT JOIN per ON per.k = lower(rtrim(s.status_name)))
SELECT (SELECT COUNT(*) FROM fx_claims) AS total_claims,
  (SELECT {_sum_sql(('Paid',))} FROM fx_claims) AS total_paid_amount,
  {picks}"""


@query("status_kpis", "A5", _kpi_sql(), ("statuses", "claims"))
def _status_kpis(t):
    return D.status_kpis(t["statuses"], t["claims"])


@query("status_bars", "A6", f"""
WITH c AS ({STATUS_COUNTS_SQL})
SELECT status_id, status_name, status_order, total,
  CAST(floor(total / greatest(max(total) OVER (), 1) * 100.0 + 0.5) AS BIGINT) AS bar_pct
FROM c""", ("statuses", "claims"))
def _status_bars(t):
    return D.status_bars(t["statuses"], t["claims"])


@query("type_share", "A7", """
WITH c AS (SELECT claim_type, COUNT(*) AS total FROM fx_claims GROUP BY claim_type),
v AS (SELECT COALESCE(SUM(CASE WHEN lower(claim_type) = 'opd' THEN total END), 0) AS opd,
             COALESCE(SUM(CASE WHEN lower(claim_type) = 'specs' THEN total END), 0) AS specs FROM c)
SELECT CAST(opd AS BIGINT) AS opd, CAST(specs AS BIGINT) AS specs, CAST(opd + specs AS BIGINT) AS total,
  CASE WHEN opd + specs > 0 THEN opd / (opd + specs) * 100.0 ELSE 0.0 END AS opd_pct
FROM v""", ("claims",))
def _type_share(t):
    return D.type_share(t["claims"])


LIST_SOURCES = {
    "claim_id": "r_id", "reference_no": "reference", "computer_no": "emp_computer_number", "status_name": "status",
    "employee_name": "COALESCE(person.plain_name, '')",
}
LIST_SQL = f"WITH {STAFFED}\nSELECT {select_list(D.LIST_COLUMNS, LIST_SOURCES)} FROM staffed"
LIST_FX = ("claims", "employees", "divisions")


@query("recent_claims", "L1", LIST_SQL + """
ORDER BY COALESCE(staffed.created_at, staffed.updated_at) DESC NULLS LAST, staffed.r_id DESC, person.e_id ASC NULLS FIRST
LIMIT 8""", LIST_FX)
def _recent_claims(t):
    return D.recent_claims(t["claims"], t["employees"])


@query("claims_needing_action", "L2", LIST_SQL + """
WHERE lower(rtrim(staffed.status)) IN ('submitted', 'document needed', 'payment approved')
ORDER BY COALESCE(staffed.updated_at, staffed.created_at) DESC NULLS LAST, staffed.r_id DESC, person.e_id ASC NULLS FIRST
LIMIT 8""", LIST_FX)
def _claims_needing_action(t):
    return D.claims_needing_action(t["claims"], t["employees"])
