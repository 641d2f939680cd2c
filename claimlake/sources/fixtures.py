"""Fixture views: the claim tables rebuilt over the driver's Parquet tables.

The SQL text is shared by Spark (temp views) and the DuckDB oracle (``WITH``
clauses), so both engines see exactly the same input rows.  The planted edge
cases (blank names, shared computer numbers, unknown statuses, bad request
values) are described in ``FIXTURES.md``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FIXTURE_SQL: dict[str, str] = {
    "fx_divisions": """
SELECT CAST(n_nationkey AS INT) AS div_code,
  CASE WHEN n_nationkey % 12 = 0 THEN '' WHEN n_nationkey % 12 = 1 THEN NULL ELSE n_name END AS division_name
FROM nation""",
    "fx_employees": """
SELECT CAST(c_custkey + 1 AS INT) AS e_id,
  substr('CGT', CAST(c_custkey % 3 + 1 AS INT), 1) AS port,
  lpad(CAST(CASE WHEN c_custkey % 500 = 499 THEN c_custkey - 1 ELSE c_custkey END AS STRING), 6, '0') AS computer_number,
  CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(c_custkey % 26 + 1 AS INT), 1) || '.' END AS initials,
  CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_mktsegment END AS surname,
  'PO' || CAST(c_custkey % 9 AS STRING) AS payoffice,
  'SN' || CAST(c_custkey AS STRING) AS service_number,
  lpad(CAST((c_custkey * 7919) % 1000000000 AS STRING), 9, '0') || 'V' AS nic,
  CASE WHEN c_custkey % 2 = 0 THEN DATE '1975-03-01' ELSE DATE '1988-11-15' END AS dob,
  CAST(c_nationkey AS INT) AS division_code,
  CAST(10000 AS DOUBLE) AS balance_opd_amount, CAST(10000 AS DOUBLE) AS balance_specs_amount
FROM customer""",
    "fx_statuses": """
SELECT * FROM (VALUES (1,'Submitted',10),(2,'Received Document',20),(3,'Document Needed',30),
  (4,'Submitted to Doctor',40),(5,'Approved by Doctor',50),(7,'Payment Approved',70),(8,'Paid',80)
) AS t(s_id, status_name, status_order)""",
    "fx_users": """
SELECT CAST(s_suppkey + 1 AS INT) AS u_id, s_name AS fullname, 'admin' || CAST(s_suppkey AS STRING) AS username,
  CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE 1 END AS status
FROM supplier""",
    "fx_claims": """
SELECT CAST(o_orderkey + 1 AS INT) AS r_id,
  'MC-' || CAST(year(o_orderdate) AS STRING) || '-' || lpad(CAST(o_orderkey AS STRING), 6, '0') AS reference,
  CAST(o_orderdate AS DATE) AS opd_date,
  o_totalprice AS amount_requested,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'specs' ELSE 'opd' END AS claim_type,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 'Patient ' || CAST(o_custkey AS STRING) END AS patient_name,
  lpad(CAST(o_custkey AS STRING), 6, '0') AS emp_computer_number,
  CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS is_document_received,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 1 DAY ELSE NULL END AS document_received_date,
  CASE WHEN o_orderkey % 2 = 0 THEN 'INV-' || CAST(o_orderkey AS STRING) ELSE NULL END AS invoice_number,
  CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'PENDING' WHEN 2 THEN 'RECOMMENDED' ELSE 'NOT_RECOMMENDED' END AS medical_recommendation,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 < 4 THEN 'sore throat' ELSE '' END AS medical_remark,
  CASE WHEN o_orderkey % 4 > 1 THEN CAST(o_orderdate + INTERVAL 3 DAY AS DATE) ELSE NULL END AS doctor_approved_date,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(round(o_totalprice * 0.5, 0) AS DOUBLE) END AS approved_amount,
  CASE WHEN o_orderkey % 10 IN (6, 7) THEN CAST(o_orderdate + INTERVAL 4 DAY AS DATE) ELSE NULL END AS payment_approved_date,
  CASE WHEN o_orderkey % 10 = 7 THEN CAST(o_orderdate + INTERVAL 5 DAY AS DATE) ELSE NULL END AS paid_date,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate + INTERVAL 9 HOUR END AS created_at,
  CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate + INTERVAL 2 DAY ELSE o_orderdate + INTERVAL 5 DAY END AS updated_at,
  CASE o_orderkey % 5 WHEN 0 THEN 'MYSELF' WHEN 1 THEN 'SPOUSE' WHEN 2 THEN 'CHILD' WHEN 3 THEN 'MOTHER' ELSE 'FATHER' END AS claim_for,
  CASE o_orderkey % 10 WHEN 0 THEN 'Submitted' WHEN 1 THEN 'Received Document' WHEN 2 THEN 'Document Needed'
    WHEN 3 THEN 'Submitted to Doctor' WHEN 4 THEN 'Approved by Doctor' WHEN 5 THEN 'Rejected by Doctor'
    WHEN 6 THEN 'Payment Approved' WHEN 7 THEN 'Paid' WHEN 8 THEN 'Legacy Hold' ELSE 'submitted' END AS status
FROM orders""",
    "fx_history": """
SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS log_id,
  CASE WHEN l_linenumber % 3 = 0 THEN '  ' WHEN l_linenumber % 5 = 0 THEN NULL ELSE 'step ' || CAST(l_linenumber AS STRING) END AS remarks,
  min(l_shipdate) AS updated_at,
  CAST(l_orderkey + 1 AS INT) AS claim_requests_id,
  CAST(min(l_suppkey) + 1 AS INT) AS updated_by,
  CASE WHEN l_linenumber = 1 THEN 1 ELSE l_linenumber - 1 END AS old_status_id,
  CAST(l_linenumber AS INT) AS new_status_id
FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "fx_access_requests": """
SELECT CAST(c_custkey AS BIGINT) AS request_id,
  CASE WHEN c_custkey % 50 = 7 THEN ' ' ELSE ' ' || lpad(CAST(c_custkey AS STRING), 6, '0') END AS computer_number,
  CASE WHEN c_custkey % 50 = 8 THEN '' WHEN c_custkey % 10 = 3 THEN '000000000X'
    ELSE lower(lpad(CAST((c_custkey * 7919) % 1000000000 AS STRING), 9, '0') || 'V') END AS nic,
  CAST(CASE WHEN c_custkey % 9 = 0 THEN 0 WHEN o.r IS NULL OR c_custkey % 4 = 0 THEN c_custkey + 1 ELSE o.r END AS INT) AS claim_id,
  CAST(c_custkey % 3 AS INT) AS page,
  CAST(CASE c_custkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 10 ELSE 80 END AS INT) AS page_limit
FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) + 1 AS r FROM orders GROUP BY o_custkey) o ON o.o_custkey = c_custkey""",
    "fx_submissions": """
SELECT ev.event_id AS seq, ev.ts AS submitted_at,
  CASE WHEN ev.event_id % 41 = 0 THEN ' ' WHEN ev.event_id % 37 = 0 THEN 'mc-sub-' || CAST(ev.event_id - 1 AS STRING)
    WHEN ev.event_id % 43 = 0 THEN 'MC-' || CAST(year(o.o_orderdate) AS STRING) || '-' || lpad(CAST(o.o_orderkey AS STRING), 6, '0')
    ELSE 'MC-SUB-' || CAST(ev.event_id AS STRING) END AS reference,
  lpad(CAST(ev.user_id AS STRING), 6, '0') AS computer_number,
  CASE WHEN ev.event_id % 31 = 0 THEN '000000000X' ELSE lpad(CAST((ev.user_id * 7919) % 1000000000 AS STRING), 9, '0') || 'V' END AS nic,
  CASE WHEN ev.event_id % 23 = 0 THEN '2024-02-30' WHEN ev.event_id % 23 = 1 THEN '2024-1-5' ELSE CAST(CAST(ev.ts AS DATE) AS STRING) END AS opd_date,
  CASE WHEN ev.event_id % 47 = 0 THEN 'abc' WHEN ev.event_id % 53 = 0 THEN '-5' WHEN ev.event_id % 59 = 0 THEN ' 1e3 ' ELSE CAST(ev.value AS STRING) END AS amount_requested,
  CASE ev.event_type WHEN 'view' THEN 'OPD' WHEN 'click' THEN ' specs ' WHEN 'error' THEN 'dental' ELSE 'opd' END AS claim_type,
  CASE ev.event_id % 6 WHEN 0 THEN 'myself' WHEN 1 THEN 'SPOUSE' WHEN 2 THEN 'CHILD' WHEN 3 THEN 'MOTHER' WHEN 4 THEN 'FATHER' ELSE 'COUSIN' END AS claim_for,
  CASE WHEN ev.event_id % 61 = 0 THEN NULL ELSE 'P' || CAST(ev.event_id AS STRING) END AS patient_name
FROM events ev JOIN orders o ON o.o_orderkey = ev.user_id""",
    "fx_status_updates": """
SELECT event_id AS seq, ts, CAST(user_id * 101 + 1 AS INT) AS claim_id,
  CAST(CASE WHEN event_id % 7 = 0 THEN event_id % 9 + 1 ELSE 0 END AS INT) AS new_status_id,
  CASE event_type WHEN 'signup' THEN 'Received Document' WHEN 'view' THEN 'Submitted to Doctor'
    WHEN 'click' THEN 'rejected by doctor' WHEN 'purchase' THEN 'Paid' ELSE 'Escalated' END AS new_status_name,
  CASE WHEN event_id % 29 = 0 THEN ' ' ELSE 'evt ' || CAST(event_id AS STRING) END AS remarks,
  CAST(event_id % 5 + 1 AS INT) AS updated_by
FROM events""",
    "fx_document_updates": """
SELECT event_id AS seq, ts, CAST(user_id * 101 + 1 AS INT) AS claim_id,
  CASE event_id % 7 WHEN 0 THEN '1' WHEN 1 THEN '0' WHEN 2 THEN 'YES' WHEN 3 THEN 'no' WHEN 4 THEN 'Yes' ELSE NULL END AS is_document_received,
  CASE event_id % 7 WHEN 5 THEN 'NO' ELSE NULL END AS physical_document_received,
  CASE WHEN event_id % 4 = 0 THEN ' ' ELSE CAST(CAST(ts AS DATE) AS STRING) || ' 10:30:00' END AS document_received_date,
  CASE WHEN event_id % 5 = 0 THEN '' ELSE ' F-' || CAST(event_id AS STRING) END AS invoice_number
FROM events WHERE event_type IN ('signup', 'view')""",
    "fx_medical_updates": """
SELECT event_id AS seq, ts, CAST(user_id * 101 + 1 AS INT) AS claim_id,
  CASE event_id % 5 WHEN 0 THEN 'recommended' WHEN 1 THEN ' PENDING ' WHEN 2 THEN 'NOT_RECOMMENDED' WHEN 3 THEN '' ELSE 'maybe' END AS medical_recommendation,
  CASE WHEN event_id % 4 = 0 THEN ' ' ELSE 'note ' || CAST(event_id AS STRING) END AS medical_remark,
  CASE WHEN event_id % 3 = 0 THEN '' ELSE CAST(CAST(ts AS DATE) AS STRING) END AS doctor_approved_date
FROM events WHERE event_type IN ('click', 'error')""",
    "fx_payment_updates": """
SELECT event_id AS seq, ts, CAST(user_id * 101 + 1 AS INT) AS claim_id,
  CASE event_id % 6 WHEN 0 THEN '0' WHEN 1 THEN '-1' WHEN 2 THEN 'x' WHEN 3 THEN NULL ELSE CAST(value AS STRING) END AS approved_amount,
  CASE WHEN event_id % 4 = 0 THEN '' ELSE CAST(CAST(ts AS DATE) AS STRING) END AS payment_approved_date,
  CASE WHEN event_id % 2 = 0 THEN '' ELSE CAST(CAST(ts AS DATE) AS STRING) END AS paid_date
FROM events WHERE event_type = 'purchase'""",
    # Not in FIXTURES.md: JSON request bodies for the document-update endpoint,
    # built from fx_document_updates with the alias keys and non-object bodies.
    "fx_document_bodies": """
SELECT seq, ts,
  CASE WHEN seq % 13 = 0 THEN '[1, 2]' WHEN seq % 17 = 0 THEN 'null' WHEN seq % 19 = 0 THEN 'not json'
    ELSE '{"claim_id": ' || CAST(claim_id AS STRING)
      || ', "physical_document_received": ' || COALESCE('"' || physical_document_received || '"', 'null')
      || ', "is_document_received": ' || COALESCE('"' || is_document_received || '"', 'null')
      || ', "document_received_date": "' || document_received_date || '"'
      || ', "physical_file_no": "' || invoice_number || '"}' END AS body
FROM fx_document_updates""",
}

# base tables each fixture view reads
FIXTURE_SOURCES: dict[str, tuple[str, ...]] = {
    "fx_divisions": ("nation",),
    "fx_employees": ("customer",),
    "fx_statuses": (),
    "fx_users": ("supplier",),
    "fx_claims": ("orders",),
    "fx_history": ("lineitem",),
    "fx_access_requests": ("customer", "orders"),
    "fx_submissions": ("events", "orders"),
    "fx_status_updates": ("events",),
    "fx_document_updates": ("events",),
    "fx_medical_updates": ("events",),
    "fx_payment_updates": ("events",),
    "fx_document_bodies": ("events",),
}

# fixture views read by other fixture views
FIXTURE_DEPENDS: dict[str, tuple[str, ...]] = {"fx_document_bodies": ("fx_document_updates",)}

# short names used by operators and the query registry
SHORT_NAMES = {
    "divisions": "fx_divisions", "employees": "fx_employees", "statuses": "fx_statuses",
    "users": "fx_users", "claims": "fx_claims", "history": "fx_history",
    "access_requests": "fx_access_requests", "submissions": "fx_submissions",
    "status_updates": "fx_status_updates", "document_updates": "fx_document_updates",
    "medical_updates": "fx_medical_updates", "payment_updates": "fx_payment_updates",
    "document_bodies": "fx_document_bodies",
}


class FixtureTables:
    """Lazily built fixture DataFrames for one ``sf`` directory.

    ``tables["claims"]`` (or ``tables["fx_claims"]``) returns the view as a
    DataFrame; the base Parquet tables are registered as temp views first so
    the shared SQL text resolves.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._registered: set[str] = set()
        self._frames: dict[str, DataFrame] = {}

    def base(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in self._registered:
            df.createOrReplaceTempView(name)
            self._registered.add(name)
        return df

    def __getitem__(self, name: str) -> DataFrame:
        view = SHORT_NAMES.get(name, name)
        if view not in self._frames:
            for src in FIXTURE_SOURCES[view]:
                self.base(src)
            for dep in FIXTURE_DEPENDS.get(view, ()):
                self[dep].createOrReplaceTempView(dep)
            self._frames[view] = self.spark.sql(FIXTURE_SQL[view])
        return self._frames[view]


def fixture_tables(spark: SparkSession, sf_dir: str) -> FixtureTables:
    return FixtureTables(spark, sf_dir)


def with_fixtures(body: str, *names: str) -> str:
    """Prefix ``body`` with the ``WITH fx_… AS (…)`` clauses it needs (for DuckDB)."""
    views = []
    for n in names:
        v = SHORT_NAMES.get(n, n)
        views += [d for d in FIXTURE_DEPENDS.get(v, ()) if d not in views and d not in names]
        if v not in views:
            views.append(v)
    ctes = ",\n".join(f"{v} AS ({FIXTURE_SQL[v].strip()})" for v in views)
    body = body.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":  # the body's own CTEs follow the fixtures
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
