"""Source, sink and streaming queries.

The sink and stream queries write under a fresh folder below the session's
checkpoint folder and return what they read back, so the written result is
what gets checked.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..operators import dashboard as D
from ..operators import submissions as W2
from ..operators import updates as W
from ..operators.common import checkpointed
from ..session import scratch_path
from ..sources import requests as R
from ..sources import sinks as K
from ..sources import versions as V
from ..sources.tables import SCHEMAS, read_tables
from ..streaming import jobs as T
from .dashboard import STATUS_COUNTS_SQL, _kpi_sql
from .registry import query
from .submissions import INGEST_FX, _ingested
from .updates import DOCUMENT_C, MEDICAL_C, PAYMENT_C, STATUS_CTES, STATUS_FX, _state_sql

DOCUMENT_FIELDS = ["claim_id", "is_document_received", "document_received_date", "invoice_number"]
DOCUMENT_ALIASES = {"is_document_received": ["physical_document_received"],
                    "invoice_number": ["physical_file_no"]}


def _scratch(t, kind: str) -> str:
    return scratch_path(t.spark, "claimlake", kind, uuid.uuid4().hex)


@query("parse_requests", "S2", """
SELECT seq,
  CASE WHEN json_valid(body) AND json_type(CASE WHEN json_valid(body) THEN body ELSE '0' END) IN ('OBJECT', 'ARRAY')
       THEN 'ok' ELSE 'invalid_body' END AS outcome,
  CASE WHEN json_valid(body) AND json_type(CASE WHEN json_valid(body) THEN body ELSE '0' END) = 'OBJECT' THEN
    json_extract_string(CASE WHEN json_valid(body) THEN body ELSE '{}' END, '$.claim_id') END AS claim_id,
  CASE WHEN json_valid(body) AND json_type(CASE WHEN json_valid(body) THEN body ELSE '0' END) = 'OBJECT' THEN
    COALESCE(json_extract_string(CASE WHEN json_valid(body) THEN body ELSE '{}' END, '$.is_document_received'),
             json_extract_string(CASE WHEN json_valid(body) THEN body ELSE '{}' END, '$.physical_document_received'))
    END AS is_document_received,
  CASE WHEN json_valid(body) AND json_type(CASE WHEN json_valid(body) THEN body ELSE '0' END) = 'OBJECT' THEN
    json_extract_string(CASE WHEN json_valid(body) THEN body ELSE '{}' END, '$.document_received_date')
    END AS document_received_date,
  CASE WHEN json_valid(body) AND json_type(CASE WHEN json_valid(body) THEN body ELSE '0' END) = 'OBJECT' THEN
    COALESCE(json_extract_string(CASE WHEN json_valid(body) THEN body ELSE '{}' END, '$.invoice_number'),
             json_extract_string(CASE WHEN json_valid(body) THEN body ELSE '{}' END, '$.physical_file_no'))
    END AS invoice_number
FROM fx_document_bodies""", ("document_bodies",))
def _parse_requests(t):
    return R.parse_requests(t["document_bodies"], "body", DOCUMENT_FIELDS, DOCUMENT_ALIASES, keep=["seq"])


# the field updates as JSON bodies, read back as VARIANT and applied: what came in decides as if it had come typed
@query("document_body_outcomes", "S2", DOCUMENT_C.replace("FROM fx_document_updates", "FROM fx_document_updates WHERE seq % 13 <> 0 AND seq % 17 <> 0 AND seq % 19 <> 0") + """
SELECT seq, cid AS claim_id, outcome FROM c
UNION ALL SELECT seq, CASE WHEN seq % 13 = 0 THEN 0 END, CASE WHEN seq % 13 = 0 THEN 'invalid_input' ELSE 'invalid_body' END
FROM fx_document_bodies WHERE seq % 13 = 0 OR seq % 17 = 0 OR seq % 19 = 0""", ("document_updates", "document_bodies", "claims"))
def _document_body_outcomes(t):
    """W4 from request bodies."""
    parsed = R.read_bodies(t["document_bodies"], "body", DOCUMENT_FIELDS, DOCUMENT_ALIASES, keep=["seq", "ts"])
    return R.body_outcomes(parsed, lambda u: W.apply_document_updates(u, t["claims"]).outcomes)


NUMBER_FIELDS = ("approved_amount", "claim_id", "new_status_id")


def _bodies(updates, fields):
    """JSON bodies of update rows: all values as text, or in every other row, where they can be read so, numbers as JSON numbers."""
    number = {f: F.col(f).try_cast("double") for f in fields if f in NUMBER_FIELDS}
    text = F.struct(*[F.col(f).cast("string").alias(f) for f in fields])
    typed = F.struct(*[number.get(f, F.col(f).cast("string")).alias(f) for f in fields])
    readable = F.col("seq") % 2 == 0
    for c in number.values():
        readable = readable & c.isNotNull()
    body = F.when(readable, F.to_json(typed, {"ignoreNullFields": "false"})).otherwise(F.to_json(text, {"ignoreNullFields": "false"}))
    return updates.withColumn("body", body)


def _register_bodies(name, op_id, sql, fixtures, source, fields, apply):
    @query(name, op_id, sql, fixtures)
    def _run(t):
        parsed = R.read_bodies(_bodies(t[source], fields), "body", fields, keep=["seq", "ts", *(["updated_by"] if source == "status_updates" else [])])
        return R.body_outcomes(parsed, lambda u: apply(u, t))
    _run.__doc__ = f"{op_id}: outcomes from request bodies."


_register_bodies("medical_body_outcomes", "S2", MEDICAL_C + "\nSELECT seq, cid AS claim_id, outcome FROM c", ("medical_updates", "claims"),
                 "medical_updates", ["claim_id", "medical_recommendation", "medical_remark", "doctor_approved_date"],
                 lambda u, t: W.apply_medical_updates(u, t["claims"]).outcomes)
_register_bodies("payment_body_outcomes", "S2", PAYMENT_C + "\nSELECT seq, cid AS claim_id, outcome FROM c", ("payment_updates", "claims"),
                 "payment_updates", ["claim_id", "approved_amount", "payment_approved_date", "paid_date"],
                 lambda u, t: W.apply_payment_updates(u, t["claims"]).outcomes)
_register_bodies("status_body_outcomes", "S2", STATUS_CTES + "\nSELECT seq, cid AS claim_id, outcome FROM v", STATUS_FX,
                 "status_updates", ["claim_id", "new_status_id", "new_status_name", "remarks"],
                 lambda u, t: W.apply_status_updates(u, t["claims"], t["statuses"], t["history"]).outcomes)


@query("publish_claims", "S3", DOCUMENT_C + _state_sql(
    {"is_document_received": "received", "document_received_date": "dt", "invoice_number": "invoice"}),
    ("document_updates", "claims"))
def _publish_claims(t):
    """W4's new claims table published as a version, then read back as the current version."""
    root = _scratch(t, "published")
    batch = W.apply_document_updates(t["document_updates"], t["claims"])
    K.publish(t.spark, {"claims": t["claims"]}, root, version=1)
    K.publish(t.spark, {"claims": batch.claims, "outcomes": batch.outcomes}, root, version=2)
    return K.read_published(t.spark, root, "claims")


@query("publish_claim_partitions", "S3", DOCUMENT_C + _state_sql(
    {"is_document_received": "received", "document_received_date": "dt", "invoice_number": "invoice"}),
    ("document_updates", "claims"))
def _publish_claim_partitions(t):
    """Claims stored by OPD year; W4's batch rewrites only the years it touched; read back."""
    path = _scratch(t, "claims-by-year")
    K.write_claims(t["claims"], path)
    stored = K.read_claims(t.spark, path, SCHEMAS["claims"])
    batch = W.apply_document_updates(t["document_updates"], stored)
    changed = batch.outcomes.where("outcome = 'accepted'")
    K.rewrite_changed_partitions(batch.claims, changed, path)
    return K.read_claims(t.spark, path, SCHEMAS["claims"])


@query("read_tables", "S1", STATUS_COUNTS_SQL, ("statuses", "claims"))
def _read_tables(t):
    """A2 over tables written as Parquet folders and read by the typed source."""
    root = _scratch(t, "tables")
    for name in ("claims", "statuses"):
        t[name].write.parquet(os.path.join(root, name))
    tables = read_tables(t.spark, root, ["claims", "statuses"])
    return D.status_counts(tables["statuses"], tables["claims"])


@query("export_json", "S4", STATUS_COUNTS_SQL, ("statuses", "claims"))
def _export_json(t):
    """A2 written as JSON lines and read back with its schema."""
    path = _scratch(t, "json")
    result = D.status_counts(t["statuses"], t["claims"])
    K.export_json(result, path)
    return t.spark.read.schema(result.schema).json(path)


def _submission_stream(t) -> str:
    """The submissions fed as four JSON files in ``seq`` order, one file per micro-batch; the store of the outputs."""
    root = _scratch(t, "stream-submissions")
    feed, state = os.path.join(root, "feed"), os.path.join(root, "state")
    T.write_feed(t["submissions"], feed, "seq", chunks=4)
    T.stream_submissions(t.spark, feed, state, os.path.join(root, "checkpoint"),
                         t["claims"], t["employees"], t["history"])
    return state


@query("stream_submissions", "T1", f"""
WITH {_ingested()}
SELECT o.seq, o.final AS outcome, CAST((SELECT max(r_id) FROM fx_claims) + a.accept_no AS INTEGER) AS claim_id
FROM o LEFT JOIN a ON a.seq = o.seq""", INGEST_FX)
def _stream_submissions(t):
    """Outcomes of all micro-batches."""
    return T.read_state(t.spark, _submission_stream(t), "outcomes").select("seq", "outcome", "claim_id")


# a new claim with its log row; the ids of both follow from the number of the accepted row
_ADDED_SQL = f"""
WITH {_ingested()}
SELECT CAST((SELECT max(r_id) FROM fx_claims) + accept_no AS INTEGER) AS r_id, in_reference AS reference,
  CAST(strptime(in_opd_date, '%Y-%m-%d') AS DATE) AS opd_date, CAST(in_amount_requested AS DOUBLE) AS amount_requested,
  in_claim_type AS claim_type, in_patient_name AS patient_name, submitted_at AS created_at, 'Submitted' AS status,
  CAST((SELECT max(log_id) FROM fx_history) + accept_no AS BIGINT) AS log_id,
  'Claim submitted by employee' AS remarks, 1 AS old_status_id, 1 AS new_status_id
FROM a"""


def _added(claims, history):
    """New claims with their log rows, matched by claim id."""
    log = history.select("log_id", "remarks", "old_status_id", "new_status_id", "claim_requests_id", F.col("updated_at").alias("_at"))
    return (claims.join(log, (claims["r_id"] == log["claim_requests_id"]) & (claims["created_at"] == log["_at"]), "left")
            .select("r_id", "reference", "opd_date", "amount_requested", "claim_type", "patient_name", "created_at", "status",
                    "log_id", "remarks", "old_status_id", "new_status_id"))


@query("stream_submission_rows", "T1", _ADDED_SQL, INGEST_FX + ("history",))
def _stream_submission_rows(t):
    """Claims and log rows that the stream wrote, from one commit of its store."""
    state = _submission_stream(t)
    last = V.read_commit(t.spark, state)
    return _added(V.read_current(t.spark, state, "claims", last), V.read_current(t.spark, state, "history", last))


@query("publish_submissions", "S3", _ADDED_SQL, INGEST_FX + ("history",))
def _publish_submissions(t):
    """W2 and W3 published together: claims and log are stored once, a batch commits only its new rows; read back."""
    root = _scratch(t, "store")
    V.publish_changes(t.spark, root, {"claims": t["claims"], "history": t["history"]}, {"claims": "r_id", "history": None})
    before = V.read_commit(t.spark, root)
    claims, history = V.read_current(t.spark, root, "claims"), V.read_current(t.spark, root, "history")
    ingested = checkpointed(W2.ingest_submissions(t["submissions"], claims, t["employees"]))
    V.publish_changes(t.spark, root, {"claims": W2.new_claims(ingested), "history": W2.submission_history(ingested, history)}, {}, batch=1)
    now = V.read_commit(t.spark, root)
    top = V.read_current(t.spark, root, "claims", before).agg(F.max("r_id")).first()[0] or 0
    added = V.read_current(t.spark, root, "claims", now).where(F.col("r_id") > top)
    return _added(added, V.read_current(t.spark, root, "history", now))


@query("publish_claim_changes", "S3", DOCUMENT_C + _state_sql(
    {"is_document_received": "received", "document_received_date": "dt", "invoice_number": "invoice"}),
    ("document_updates", "claims"))
def _publish_claim_changes(t):
    """W4 as two batches that commit only the claims they changed, a compaction between; newest version of each claim."""
    root = _scratch(t, "store")
    V.publish_changes(t.spark, root, {"claims": t["claims"]}, {"claims": "r_id"})
    half = F.col("claim_id") % 2
    for part in (0, 1):
        claims = V.read_current(t.spark, root, "claims")
        batch = W.apply_document_updates(t["document_updates"].where(half == part), claims)
        changed = batch.outcomes.where("outcome = 'accepted'").select(F.col("claim_id").alias("_id")).distinct()
        rows = batch.claims.join(changed, batch.claims["r_id"] == changed["_id"], "left_semi")
        V.publish_changes(t.spark, root, {"claims": rows}, {}, batch=part)
        if part == 0:
            V.compact(t.spark, root)
    return V.read_current(t.spark, root, "claims")


_PAID_STATE = PAYMENT_C + _state_sql({"approved_amount": "amount", "payment_approved_date": "pa", "paid_date": "paid"})


@query("dashboard_after_updates", "A5", f"WITH paid AS ({_PAID_STATE}),\n" + _kpi_sql().replace("fx_claims", "paid").strip()[5:],
       ("payment_updates", "claims", "statuses"))
def _dashboard_after_updates(t):
    """A5 from a stored summary that followed two batches of payment updates; claims and summary change in one commit."""
    root = _scratch(t, "store")
    keys = {"claims": "r_id", "summary": "group_key"}
    V.publish_changes(t.spark, root, {"claims": t["claims"], "summary": _keyed(D.claims_summary(t["claims"]))}, keys)
    half = F.col("claim_id") % 2
    for part in (0, 1):
        claims, summary = (V.read_current(t.spark, root, n) for n in keys)
        batch = W.apply_payment_updates(t["payment_updates"].where(half == part), claims)
        outcomes = checkpointed(batch.outcomes)
        changed = outcomes.where("outcome = 'accepted'").select(F.col("claim_id").alias("_id")).distinct()
        rows = checkpointed(batch.claims.join(changed, batch.claims["r_id"] == changed["_id"], "left_semi"))
        change = D.batch_summary_change(outcomes, claims, rows)
        totals = _keyed(D.changed_summary(summary.drop("group_key"), change, keep_empty=True))
        V.publish_changes(t.spark, root, {"claims": rows, "summary": totals}, {}, batch=part)
    return D.status_kpis_of(t["statuses"], V.read_current(t.spark, root, "summary").where("n_rows <> 0"))


def _keyed(summary):
    """A summary with one key column, as a store wants it."""
    key = F.concat_ws(":", *[F.coalesce(F.concat(F.lit("="), c), F.lit("-")) for c in D.SUMMARY_KEYS])
    return summary.select(key.alias("group_key"), *D.SUMMARY_KEYS, *[F.col(c).cast(k).alias(c) for c, k in zip(D.SUMMARY_SUMS, ("long", "long", "decimal(28,2)"))])


@query("stream_status_updates", "T2", STATUS_CTES + "\nSELECT seq, cid AS claim_id, outcome FROM v", STATUS_FX)
def _stream_status_updates(t):
    """Status updates fed as four JSON files in ``seq`` order; one file per micro-batch."""
    root = _scratch(t, "stream-status")
    feed = os.path.join(root, "feed")
    T.write_feed(t["status_updates"], feed, "seq", chunks=4)
    state = os.path.join(root, "state")
    T.stream_status_updates(t.spark, feed, state, os.path.join(root, "checkpoint"),
                            t["claims"], t["statuses"], t["history"])
    return T.read_state(t.spark, state, "outcomes").select("seq", "claim_id", "outcome")
