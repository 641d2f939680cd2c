"""Intake queries (W1, W2, W3, W10, W11, J7) and their SQL oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import NUMERIC_PATTERN
from ..operators import submissions as W
from ..session import scratch_path
from ..sources.sinks import read_claims, write_claims
from ..sources.tables import SCHEMAS
from .registry import query
from .sqltext import EMP_BY_CREDENTIALS, text_or_empty

_FIELDS = ", ".join(f"{text_or_empty(f)} AS in_{f}" for f in W.TEXT_FIELDS)
_MISSING = " OR ".join(f"in_{f} = ''" for f in W.TEXT_FIELDS)
_TYPES = ", ".join(f"'{t}'" for t in W.CLAIM_TYPES)
_FORS = ", ".join(f"'{t}'" for t in W.CLAIM_FOR)


def _validated(client_rules: bool) -> str:
    patient = "in_patient_name"
    future = ""
    if client_rules:
        patient = ("CASE WHEN upper(in_claim_for) = 'MYSELF' AND in_patient_name = '' "
                   "THEN COALESCE(e.initials || ' ' || e.surname, '') ELSE in_patient_name END")
        future = ("WHEN CAST(try_strptime(in_opd_date, '%Y-%m-%d') AS DATE) > CAST(submitted_at AS DATE) "
                  "THEN 'future_date' ")
    return f"""{EMP_BY_CREDENTIALS},
s0 AS (SELECT seq, submitted_at, {_FIELDS} FROM fx_submissions),
s AS (SELECT s0.seq, s0.submitted_at, s0.in_reference, s0.in_computer_number, s0.in_nic, s0.in_opd_date,
        s0.in_amount_requested, lower(s0.in_claim_type) AS in_claim_type, upper(s0.in_claim_for) AS in_claim_for,
        {patient.replace('in_', 's0.in_')} AS in_patient_name, e.e_id
      FROM s0 LEFT JOIN emp2 e ON lower(rtrim(e.computer_number)) = lower(rtrim(s0.in_computer_number))
                              AND lower(rtrim(e.nic)) = lower(rtrim(s0.in_nic))),
c AS (SELECT s.*, CASE
    WHEN {_MISSING} THEN 'missing_field'
    WHEN NOT regexp_matches(in_opd_date, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$')
      OR try_strptime(in_opd_date, '%Y-%m-%d') IS NULL THEN 'bad_date'
    {future}WHEN in_claim_type NOT IN ({_TYPES}) THEN 'bad_type'
    WHEN in_claim_for NOT IN ({_FORS}) THEN 'bad_for'
    WHEN NOT regexp_matches(in_amount_requested, '{NUMERIC_PATTERN}')
      OR TRY_CAST(in_amount_requested AS DOUBLE) <= 0 THEN 'bad_amount'
    WHEN e_id IS NULL THEN 'bad_employee'
    ELSE 'ok' END AS outcome FROM s)"""


@query("validate_submissions", "W1", f"WITH {_validated(False)}\nSELECT seq, outcome FROM c",
       ("submissions", "employees"))
def _validate_submissions(t):
    return W.validate_submissions(t["submissions"], t["employees"]).select("seq", "outcome")


@query("client_rules", "W11", f"WITH {_validated(True)}\nSELECT seq, outcome, in_patient_name AS patient_name FROM c",
       ("submissions", "employees"))
def _client_rules(t):
    return (W.validate_submissions(t["submissions"], t["employees"], client_rules=True)
            .select("seq", "outcome", F.col("v_patient_name").alias("patient_name")))


def _ingested() -> str:
    return f"""{_validated(False)},
f AS (SELECT lower(rtrim(in_reference)) AS k, min(seq) AS first_seq FROM c WHERE outcome = 'ok' GROUP BY 1),
x AS (SELECT DISTINCT lower(rtrim(reference)) AS k FROM fx_claims WHERE reference IS NOT NULL),
o AS (SELECT c.*, CASE WHEN c.outcome <> 'ok' THEN c.outcome
                       WHEN x.k IS NOT NULL OR c.seq <> f.first_seq THEN 'duplicate_reference'
                       ELSE 'accepted' END AS final
      FROM c LEFT JOIN f ON f.k = lower(rtrim(c.in_reference)) LEFT JOIN x ON x.k = lower(rtrim(c.in_reference))),
a AS (SELECT o.*, row_number() OVER (ORDER BY seq) AS accept_no FROM o WHERE final = 'accepted')"""


INGEST_FX = ("submissions", "employees", "claims")


@query("ingest_submissions", "W2", f"""
WITH {_ingested()}
SELECT o.seq, o.final AS outcome, CAST((SELECT max(r_id) FROM fx_claims) + a.accept_no AS INTEGER) AS claim_id
FROM o LEFT JOIN a ON a.seq = o.seq""", INGEST_FX)
def _ingest_submissions(t):
    return (W.ingest_submissions(t["submissions"], t["claims"], t["employees"])
            .select("seq", "outcome", "claim_id"))


@query("new_claims", "W2", f"""
WITH {_ingested()}
SELECT CAST((SELECT max(r_id) FROM fx_claims) + accept_no AS INTEGER) AS r_id, in_reference AS reference,
  CAST(strptime(in_opd_date, '%Y-%m-%d') AS DATE) AS opd_date, CAST(in_amount_requested AS DOUBLE) AS amount_requested,
  in_claim_type AS claim_type, in_patient_name AS patient_name, in_computer_number AS emp_computer_number,
  0 AS is_document_received, CAST(NULL AS TIMESTAMP) AS document_received_date, CAST(NULL AS VARCHAR) AS invoice_number,
  CAST(NULL AS VARCHAR) AS medical_recommendation, CAST(NULL AS VARCHAR) AS medical_remark,
  CAST(NULL AS DATE) AS doctor_approved_date, CAST(NULL AS DOUBLE) AS approved_amount,
  CAST(NULL AS DATE) AS payment_approved_date, CAST(NULL AS DATE) AS paid_date,
  submitted_at AS created_at, submitted_at AS updated_at, in_claim_for AS claim_for, 'Submitted' AS status
FROM a""", INGEST_FX)
def _new_claims(t):
    return W.new_claims(W.ingest_submissions(t["submissions"], t["claims"], t["employees"]))


@query("submission_history", "W3", f"""
WITH {_ingested()}
SELECT CAST((SELECT max(log_id) FROM fx_history) + accept_no AS BIGINT) AS log_id,
  'Claim submitted by employee' AS remarks, submitted_at AS updated_at,
  CAST((SELECT max(r_id) FROM fx_claims) + accept_no AS INTEGER) AS claim_requests_id,
  1 AS updated_by, 1 AS old_status_id, 1 AS new_status_id
FROM a""", INGEST_FX + ("history",))
def _submission_history(t):
    ingested = W.ingest_submissions(t["submissions"], t["claims"], t["employees"])
    return W.submission_history(ingested, t["history"])


REFERENCE_EXISTS_SQL = """
WITH x AS (SELECT DISTINCT lower(rtrim(reference)) AS k FROM fx_claims WHERE reference IS NOT NULL)
SELECT s.seq, s.reference, x.k IS NOT NULL AS reference_exists
FROM fx_submissions s LEFT JOIN x ON x.k = lower(rtrim(s.reference))"""


@query("reference_exists", "J7", REFERENCE_EXISTS_SQL, ("submissions", "claims"))
def _reference_exists(t):
    return W.reference_exists(t["submissions"].select("seq", "reference"), t["claims"])


@query("reference_exists_stored", "J7", REFERENCE_EXISTS_SQL, ("submissions", "claims"))
def _reference_exists_stored(t):
    """J7 against claims stored with a Bloom filter of the reference."""
    path = scratch_path(t.spark, "claimlake", "claims-by-year", uuid.uuid4().hex)
    write_claims(t["claims"], path)
    stored = read_claims(t.spark, path, SCHEMAS["claims"], keep_key=True)
    return W.reference_exists(t["submissions"].select("seq", "reference"), stored)


_PAT = "^MC-([0-9]{4})-([0-9]{1,18})$"


@query("assign_references", "W10", f"""
WITH s AS (SELECT seq, submitted_at, {text_or_empty('reference')} AS ref FROM fx_submissions),
ex AS (SELECT upper(rtrim(reference)) AS r FROM fx_claims UNION ALL SELECT upper(rtrim(ref)) FROM s),
mx AS (SELECT CAST(regexp_extract(r, '{_PAT}', 1) AS INTEGER) AS y,
         max(CAST(regexp_extract(r, '{_PAT}', 2) AS BIGINT)) AS m
       FROM ex WHERE regexp_matches(r, '{_PAT}') GROUP BY 1),
b AS (SELECT seq, year(submitted_at) AS y, row_number() OVER (PARTITION BY year(submitted_at) ORDER BY seq) AS rn
      FROM s WHERE ref = '')
SELECT s.seq, CASE WHEN s.ref = '' THEN printf('MC-%d-%05d', b.y, COALESCE(mx.m, 0) + b.rn) ELSE s.ref END
  AS reference, s.ref = '' AS assigned
FROM s LEFT JOIN b ON b.seq = s.seq LEFT JOIN mx ON mx.y = b.y""", ("submissions", "claims"))
def _assign_references(t):
    return W.assign_references(t["submissions"], t["claims"])


# claims whose references use up most of two years' five-digit numbers here and there
_FIVE_DIGIT_CLAIMS = "'MC-' || CAST(2024 + r_id % 2 AS VARCHAR) || '-' || CAST(10000 + (r_id * 7) % 600 AS VARCHAR)"


@query("assign_free_references", "W10", f"""
WITH s AS (SELECT seq, year(submitted_at) AS y, {text_or_empty('reference')} AS ref FROM fx_submissions),
taken AS (SELECT upper(rtrim({_FIVE_DIGIT_CLAIMS})) AS r FROM fx_claims UNION SELECT upper(rtrim(ref)) FROM s),
free AS (SELECT y, n, row_number() OVER (PARTITION BY y ORDER BY n) AS k
  FROM (SELECT DISTINCT y FROM s WHERE ref = '') years, range(10000, 100000) numbers(n)
  WHERE 'MC-' || printf('%04d', y) || '-' || CAST(n AS VARCHAR) NOT IN (SELECT r FROM taken)),
b AS (SELECT seq, y, row_number() OVER (PARTITION BY y ORDER BY seq) AS k FROM s WHERE ref = '')
SELECT s.seq, CASE WHEN s.ref <> '' THEN s.ref WHEN n IS NOT NULL THEN 'MC-' || printf('%04d', s.y) || '-' || CAST(n AS VARCHAR) END AS reference,
  CASE WHEN s.ref <> '' THEN 'given' WHEN n IS NOT NULL THEN 'assigned' ELSE 'none_free' END AS outcome
FROM s LEFT JOIN b ON b.seq = s.seq LEFT JOIN free ON free.y = b.y AND free.k = b.k""", ("submissions", "claims"))
def _assign_free_references(t):
    claims = t["claims"].withColumn("reference", F.format_string(
        "MC-%d-%d", 2024 + F.col("r_id") % 2, (10000 + (F.col("r_id") * 7) % 600).cast("int")))
    return W.assign_free_references(t["submissions"], claims)
