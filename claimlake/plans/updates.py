"""Update queries (W4–W9, G2, U2 over the updated status table) and their SQL oracles."""

from __future__ import annotations

from ..operators import facets as U
from ..operators import updates as W
from ..sources.tables import CLAIM_COLUMNS
from .registry import query
from .sqltext import blank_to_null, text_or_empty

NUMERIC = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def _state_sql(fields: dict[str, str]) -> str:
    """Claims table after applying the last accepted row of ``c`` per claim."""
    cols = []
    for col in CLAIM_COLUMNS:
        if col in fields:
            cols.append(f"CASE WHEN l.cid IS NOT NULL THEN l.{fields[col]} ELSE r.{col} END AS {col}")
        elif col == "updated_at":
            cols.append("CASE WHEN l.cid IS NOT NULL THEN l.ts ELSE r.updated_at END AS updated_at")
        else:
            cols.append(f"r.{col}")
    return f""",
l AS (SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY cid ORDER BY ts DESC, seq DESC) AS rn
                     FROM c WHERE outcome = 'accepted') WHERE rn = 1)
SELECT {', '.join(cols)}
FROM fx_claims r LEFT JOIN l ON l.cid = r.r_id"""


EXISTS = "EXISTS (SELECT 1 FROM fx_claims r WHERE r.r_id = u.cid)"
_FLAGS = ", ".join(f"'{f}'" for f in W.DOCUMENT_FLAGS)
_TRUE = ", ".join(f"'{f}'" for f in W.DOCUMENT_FLAGS_TRUE)

DOCUMENT_C = f"""
WITH u AS (SELECT seq, ts, COALESCE(claim_id, 0) AS cid,
    COALESCE(is_document_received, physical_document_received) AS raw,
    {blank_to_null('document_received_date')} AS date_text, {blank_to_null('invoice_number')} AS invoice
  FROM fx_document_updates),
c AS (SELECT u.*, CASE WHEN upper(raw) IN ({_TRUE}) THEN 1 ELSE 0 END AS received,
    TRY_CAST(date_text AS TIMESTAMP) AS dt,
    CASE WHEN cid <= 0 OR raw IS NULL OR raw NOT IN ({_FLAGS}) THEN 'invalid_input'
         WHEN date_text IS NOT NULL AND TRY_CAST(date_text AS TIMESTAMP) IS NULL THEN 'invalid_date'
         WHEN NOT {EXISTS} THEN 'not_found' ELSE 'accepted' END AS outcome
  FROM u)"""


@query("document_update_outcomes", "W4", DOCUMENT_C + "\nSELECT seq, cid AS claim_id, outcome FROM c",
       ("document_updates", "claims"))
def _document_update_outcomes(t):
    return W.apply_document_updates(t["document_updates"], t["claims"]).outcomes


@query("apply_document_updates", "W4", DOCUMENT_C + _state_sql(
    {"is_document_received": "received", "document_received_date": "dt", "invoice_number": "invoice"}),
    ("document_updates", "claims"))
def _apply_document_updates(t):
    return W.apply_document_updates(t["document_updates"], t["claims"]).claims


_RECS = ", ".join(f"'{r}'" for r in W.RECOMMENDATIONS)
MEDICAL_C = f"""
WITH u AS (SELECT seq, ts, COALESCE(claim_id, 0) AS cid, upper({text_or_empty('medical_recommendation')}) AS rec,
    {blank_to_null('medical_remark')} AS remark, {blank_to_null('doctor_approved_date')} AS date_text
  FROM fx_medical_updates),
c AS (SELECT u.*, TRY_CAST(date_text AS DATE) AS dt,
    CASE WHEN cid <= 0 OR rec = '' THEN 'missing_input'
         WHEN rec NOT IN ({_RECS}) THEN 'invalid_recommendation'
         WHEN date_text IS NOT NULL AND TRY_CAST(date_text AS DATE) IS NULL THEN 'invalid_date'
         WHEN NOT {EXISTS} THEN 'not_found' ELSE 'accepted' END AS outcome
  FROM u)"""


@query("medical_update_outcomes", "W5", MEDICAL_C + "\nSELECT seq, cid AS claim_id, outcome FROM c",
       ("medical_updates", "claims"))
def _medical_update_outcomes(t):
    return W.apply_medical_updates(t["medical_updates"], t["claims"]).outcomes


@query("apply_medical_updates", "W5", MEDICAL_C + _state_sql(
    {"medical_recommendation": "rec", "medical_remark": "remark", "doctor_approved_date": "dt"}),
    ("medical_updates", "claims"))
def _apply_medical_updates(t):
    return W.apply_medical_updates(t["medical_updates"], t["claims"]).claims


PAYMENT_C = f"""
WITH u AS (SELECT seq, ts, COALESCE(claim_id, 0) AS cid,
    CASE WHEN regexp_matches(trim(approved_amount, ' ' || chr(9) || chr(10) || chr(13) || chr(0) || chr(11)), '{NUMERIC}')
         THEN CAST(trim(approved_amount, ' ' || chr(9) || chr(10) || chr(13) || chr(0) || chr(11)) AS DOUBLE) END AS amount,
    {blank_to_null('payment_approved_date')} AS pa_text, {blank_to_null('paid_date')} AS paid_text
  FROM fx_payment_updates),
c AS (SELECT u.*, TRY_CAST(pa_text AS DATE) AS pa, TRY_CAST(paid_text AS DATE) AS paid,
    CASE WHEN cid <= 0 OR amount IS NULL OR amount < 0 THEN 'invalid_input'
         WHEN (pa_text IS NOT NULL AND TRY_CAST(pa_text AS DATE) IS NULL)
           OR (paid_text IS NOT NULL AND TRY_CAST(paid_text AS DATE) IS NULL) THEN 'invalid_date'
         WHEN NOT {EXISTS} THEN 'not_found' ELSE 'accepted' END AS outcome
  FROM u)"""


@query("payment_update_outcomes", "W6", PAYMENT_C + "\nSELECT seq, cid AS claim_id, outcome FROM c",
       ("payment_updates", "claims"))
def _payment_update_outcomes(t):
    return W.apply_payment_updates(t["payment_updates"], t["claims"]).outcomes


@query("apply_payment_updates", "W6", PAYMENT_C + _state_sql(
    {"approved_amount": "amount", "payment_approved_date": "pa", "paid_date": "paid"}),
    ("payment_updates", "claims"))
def _apply_payment_updates(t):
    return W.apply_payment_updates(t["payment_updates"], t["claims"]).claims


# ---------------------------------------------------------------- status updates

def _canonical_case(x: str) -> str:
    whens = " ".join(f"WHEN '{n}' THEN {o}" for n, o in U.CANONICAL_STATUSES)
    return f"CASE {x} {whens} ELSE {U.UNLISTED_ORDER} END"


# The introductions are found one at a time: each step takes the earliest update after the
# last introduction that is valid by then and names a status that nobody named before.
STATUS_CTES = f"""
WITH RECURSIVE u AS (SELECT seq, ts, COALESCE(claim_id, 0) AS cid, COALESCE(new_status_id, 0) AS nid,
    {text_or_empty('new_status_name')} AS nname, {text_or_empty('remarks')} AS rem, updated_by,
    row_number() OVER (ORDER BY ts, seq) AS pos
  FROM fx_status_updates),
top AS (SELECT COALESCE(max(s_id), 0) AS m FROM fx_statuses),
byname AS (SELECT COALESCE(lower(rtrim(status_name)), chr(1)) AS k, arg_min(status_name, s_id) AS tname, min(s_id) AS tsid
  FROM fx_statuses GROUP BY 1),
w AS (SELECT u.*, r.r_id AS rid, r.status AS claim_status, s.s_id AS sid, s.status_name AS id_name, b.tname, b.tsid,
    u.cid <= 0 OR (u.nid <= 0 AND u.nname = '') OR u.rem = '' AS missing
  FROM u LEFT JOIN fx_claims r ON r.r_id = u.cid
  LEFT JOIN fx_statuses s ON u.nid > 0 AND s.s_id = u.nid
  LEFT JOIN byname b ON u.nid <= 0 AND b.k = lower(rtrim(u.nname))),
cand AS (
  SELECT pos, 0 AS k, 0 AS need, nname AS name, {_canonical_case('nname')} AS ord, lower(rtrim(nname)) AS nk
  FROM w WHERE NOT missing AND rid IS NOT NULL AND nid <= 0 AND tsid IS NULL
  UNION ALL
  SELECT pos, 1, CASE WHEN nid > 0 AND sid IS NULL THEN nid - m ELSE 0 END, claim_status, {U.UNLISTED_ORDER},
    COALESCE(lower(rtrim(claim_status)), chr(1))
  FROM w, top WHERE NOT missing AND rid IS NOT NULL AND (nid <= 0 OR sid IS NOT NULL OR nid > m)
    AND COALESCE(lower(rtrim(claim_status)), chr(1)) NOT IN (SELECT k FROM byname)),
chain(pos, k, name, ord, nk, named) AS (
  SELECT CAST(0 AS BIGINT), 0, CAST(NULL AS VARCHAR), 0, CAST(NULL AS VARCHAR), CAST([] AS VARCHAR[])
  UNION ALL
  SELECT * FROM (SELECT c.pos, c.k, c.name, c.ord, c.nk, list_append(chain.named, c.nk)
    FROM chain JOIN cand c ON (c.pos > chain.pos OR (c.pos = chain.pos AND c.k > chain.k))
      AND c.need <= len(chain.named) AND NOT list_contains(chain.named, c.nk)
    ORDER BY c.pos, c.k LIMIT 1)),
newst AS (SELECT CAST(m + len(named) AS INTEGER) AS s_id, name AS status_name, CAST(ord AS INTEGER) AS status_order,
    nk, pos AS since FROM chain, top WHERE pos > 0),
v AS (SELECT w.* REPLACE (COALESCE(w.sid, n.s_id) AS sid, CASE WHEN w.sid IS NULL THEN n.status_name ELSE w.id_name END AS id_name),
    CASE WHEN missing THEN 'missing_input' WHEN rid IS NULL THEN 'not_found'
         WHEN nid > 0 AND w.sid IS NULL AND n.s_id IS NULL THEN 'invalid_status' ELSE 'accepted' END AS outcome
  FROM w LEFT JOIN newst n ON n.s_id = w.nid AND n.since < w.pos),
a AS (SELECT * FROM v WHERE outcome = 'accepted'),
res AS (SELECT a.*,
    CASE WHEN a.nid > 0 THEN a.id_name WHEN a.tsid IS NOT NULL THEN a.tname ELSE n.status_name END AS new_status,
    CASE WHEN a.nid > 0 THEN a.nid WHEN a.tsid IS NOT NULL THEN a.tsid ELSE n.s_id END AS new_status_id
  FROM a LEFT JOIN newst n ON a.nid <= 0 AND a.tsid IS NULL AND n.nk = lower(rtrim(a.nname))),
rep AS (SELECT res.*, CASE WHEN row_number() OVER w = 1 THEN claim_status ELSE lag(new_status) OVER w END AS old_status
  FROM res WINDOW w AS (PARTITION BY cid ORDER BY ts, seq))"""
STATUS_FX = ("status_updates", "claims", "statuses")


def _status_batch(t):
    return W.apply_status_updates(t["status_updates"], t["claims"], t["statuses"], t["history"])


@query("status_update_outcomes", "W7", STATUS_CTES + "\nSELECT seq, cid AS claim_id, outcome FROM v", STATUS_FX)
def _status_update_outcomes(t):
    return _status_batch(t).outcomes


@query("apply_status_updates", "W7", STATUS_CTES
       + ",\nc AS (SELECT res.*, 'accepted' AS outcome FROM res)"
       + _state_sql({"status": "new_status"}), STATUS_FX)
def _apply_status_updates(t):
    return _status_batch(t).claims


@query("upsert_statuses", "W8", STATUS_CTES + """
SELECT s_id, status_name, status_order FROM fx_statuses
UNION ALL SELECT s_id, status_name, status_order FROM newst""", STATUS_FX)
def _upsert_statuses(t):
    return _status_batch(t).statuses


@query("status_replay", "G2", STATUS_CTES + "\nSELECT seq, cid AS claim_id, old_status, new_status FROM rep",
       STATUS_FX)
def _status_replay(t):
    return _status_batch(t).replay


@query("status_history", "W9", STATUS_CTES + """,
ob AS (SELECT k, tsid AS sid FROM byname)
SELECT CAST((SELECT max(log_id) FROM fx_history) + row_number() OVER (ORDER BY rep.ts, rep.seq) AS BIGINT) AS log_id,
  rep.rem AS remarks, rep.ts AS updated_at, rep.cid AS claim_requests_id, rep.updated_by,
  CAST(COALESCE(ob.sid, n.s_id) AS INTEGER) AS old_status_id, CAST(rep.new_status_id AS INTEGER) AS new_status_id
FROM rep LEFT JOIN ob ON ob.k = COALESCE(lower(rtrim(rep.old_status)), chr(1))
LEFT JOIN newst n ON n.nk = COALESCE(lower(rtrim(rep.old_status)), chr(1))""", STATUS_FX + ("history",))
def _status_history(t):
    return _status_batch(t).history


@query("status_choices", "U2", STATUS_CTES + f""",
st AS (SELECT s_id, status_name, status_order FROM fx_statuses UNION ALL SELECT s_id, status_name, status_order FROM newst),
uu AS (
  SELECT s_id AS status_id, status_name, status_order FROM st
  WHERE status_name IS NOT NULL AND rtrim(status_name) <> ''
  UNION ALL
  SELECT * FROM (VALUES {', '.join(f"(0, '{n}', {o})" for n, o in U.CANONICAL_STATUSES)})
    AS c(status_id, status_name, status_order))
SELECT COALESCE(min(CASE WHEN status_id <> 0 THEN status_id END), 0) AS status_id,
  min(status_name) AS status_name, min(status_order) AS status_order
FROM uu GROUP BY lower(rtrim(status_name))""", STATUS_FX)
def _status_choices(t):
    """U2 over the status table as the status-update batch leaves it."""
    return U.status_choices(_status_batch(t).statuses)
