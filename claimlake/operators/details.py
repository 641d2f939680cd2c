"""Claim details, history, latest remark and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.text import ci, js_trim, text_or_empty
from .common import broadcast_if_small, checkpointed, first_employee_per_key, is_small, restrict_to_keys

# A request for at most this many claims names them in the filter, which files, row groups and buckets are pruned by.
LITERAL_IDS = 1000

# Output columns of the detail, history and claim reports.
DETAIL_COLUMNS = [
    "claim_id", "reference_no", "opd_date", "amount_requested", "claim_type", "patient_name",
    "computer_no", "is_document_received", "document_received_date", "invoice_number",
    "medical_recommendation", "medical_remark", "doctor_approved_date", "approved_amount",
    "payment_approved_date", "paid_date", "created_at", "updated_at", "claim_for",
    "current_status_name", "nic", "initials", "surname", "employee_name", "division",
]


def claim_detail(requests: DataFrame, claims: DataFrame, employees: DataFrame,
                 divisions: DataFrame, id_col: str = "claim_id") -> DataFrame:
    """The 25 detail columns for each requested claim id, one row per request.

    ``outcome`` is ``invalid_id`` (id ≤ 0 or missing), ``not_found`` or ``ok``.
    Where a computer number is shared by several employees the smallest
    ``e_id`` is shown (the employee side is made unique by a partial
    aggregation before the join, so no per-request sort is needed).
    """
    div = broadcast_if_small(divisions.select("div_code", "division_name"))
    asked = requests.select(F.col(id_col).alias("_asked"))
    small = is_small(requests)
    claims = restrict_to_keys(claims, F.col("r_id"), asked, "_asked", keys_small=small)
    # only the employees of these claims are reduced to one per number: at most one number a request
    numbers = claims.select(ci("emp_computer_number").alias("_number"))
    emp = first_employee_per_key(
        restrict_to_keys(employees, ci("computer_number"), numbers, "_number", keys_small=small),
        {"_emp_key": ci("computer_number")}, ["e_id", "nic", "initials", "surname", "division_code"])
    detail = (claims.withColumn("_emp_key", ci("emp_computer_number"))
              .join(emp, "_emp_key", "left")
              .join(div, F.col("division_code") == F.col("div_code"), "left")
              .select(F.col("r_id").alias("claim_id"), F.col("reference").alias("reference_no"),
                      "opd_date", "amount_requested", "claim_type", "patient_name",
                      F.col("emp_computer_number").alias("computer_no"), "is_document_received",
                      "document_received_date", "invoice_number", "medical_recommendation",
                      "medical_remark", "doctor_approved_date", "approved_amount",
                      "payment_approved_date", "paid_date", "created_at", "updated_at", "claim_for",
                      F.col("status").alias("current_status_name"), "nic", "initials", "surname",
                      labels.employee_name("initials", "surname", "patient_name").alias("employee_name"),
                      labels.division_label("division_name").alias("division")))
    req = requests.select("request_id", F.coalesce(F.col(id_col), F.lit(0)).alias("requested_id"))
    valid = F.col("requested_id") > 0
    joined = req.join(detail, valid & (F.col("requested_id") == F.col("claim_id")), "left")
    outcome = (F.when(~valid, F.lit("invalid_id"))
               .when(F.col("claim_id").isNull(), F.lit("not_found")).otherwise(F.lit("ok")))
    return joined.select("request_id", "requested_id", outcome.alias("outcome"), *DETAIL_COLUMNS)


def rows_of_claims(log: DataFrame, ids: DataFrame, id_col: str, small: bool | None = None) -> DataFrame:
    """The log rows of the claims in ``ids[id_col]``.

    Few ids become literals of the filter: a log stored by claim
    (``sources.claim_log``) opens only their buckets, any other skips row groups.
    More ids are a semi join, which leaves a log stored by claim in place.
    """
    found = [r[0] for r in ids.select(id_col).where(F.col(id_col) > 0).distinct().limit(LITERAL_IDS + 1).collect()]
    if len(found) <= LITERAL_IDS:
        return log.where(F.col("claim_requests_id").isin(found)) if found else log.where(F.lit(False))
    return restrict_to_keys(log, F.col("claim_requests_id"), ids, id_col, keys_small=small)


def claim_history_of(requests: DataFrame, log: DataFrame, statuses: DataFrame, users: DataFrame,
                     id_col: str = "claim_id") -> DataFrame:
    """J3 for the claims that are asked for: ``request_id`` and the admin form, oldest first within a request."""
    asked = requests.select("request_id", F.col(id_col).alias("_asked")).where(F.col("_asked") > 0)
    rows = claim_history_rows(rows_of_claims(log, asked, "_asked", is_small(requests)), statuses, users)
    return (asked.join(rows, asked["_asked"] == rows["claim_id"], "inner").drop("_asked")
            .sortWithinPartitions("request_id", "updated_at", "history_id"))


def _history_names(history: DataFrame, statuses: DataFrame, users: DataFrame, user_cols) -> DataFrame:
    sts = broadcast_if_small(statuses.select("s_id", "status_name"))
    old = sts.select(F.col("s_id").alias("_old_id"), F.col("status_name").alias("old_status_name"))
    new = sts.select(F.col("s_id").alias("_new_id"), F.col("status_name").alias("new_status_name"))
    usr = broadcast_if_small(users.select(F.col("u_id").alias("_uid"), *user_cols))
    return (history
            .join(old, history["old_status_id"] == old["_old_id"], "left")
            .join(new, history["new_status_id"] == new["_new_id"], "left")
            .join(usr, history["updated_by"] == usr["_uid"], "left"))


def claim_history_admin(history: DataFrame, statuses: DataFrame, users: DataFrame) -> DataFrame:
    """J3 (admin form): status names and the acting user's login name, oldest first."""
    return claim_history_rows(history, statuses, users).orderBy("claim_id", "updated_at", "history_id")


def claim_history_rows(history: DataFrame, statuses: DataFrame, users: DataFrame) -> DataFrame:
    """The rows of J3 (admin form) as they come."""
    rows = _history_names(history, statuses, users, ["username"])
    return rows.select(F.col("claim_requests_id").alias("claim_id"),
                       F.col("log_id").alias("history_id"),
                       F.col("old_status_name").alias("old_status"),
                       F.col("new_status_name").alias("new_status"), "remarks",
                       F.col("username").alias("updated_by"), "updated_at")


EMPLOYEE_HISTORY_COLUMNS = ["log_id", "remarks", "updated_at", "claim_requests_id", "updated_by",
                            "updated_by_name", "old_status_id", "old_status_name", "new_status_id",
                            "new_status_name"]


def _employee_history_rows(history: DataFrame, statuses: DataFrame, users: DataFrame) -> DataFrame:
    rows = _history_names(history, statuses, users, [F.col("fullname").alias("updated_by_name")])
    return rows.select(*EMPLOYEE_HISTORY_COLUMNS)


def claim_history_employee(history: DataFrame, statuses: DataFrame, users: DataFrame) -> DataFrame:
    """J3 (employee form): ids, status names and the acting user's full name, oldest first."""
    return (_employee_history_rows(history, statuses, users)
            .orderBy("claim_requests_id", "updated_at", "log_id"))


EMPLOYEE_CLAIM_COLUMNS = [
    "claim_id", "reference", "opd_date", "amount_requested", "claim_type", "patient_name",
    "emp_computer_number", "claim_for", "status", "is_document_received",
    "document_received_date", "invoice_number", "medical_recommendation", "medical_remark",
    "doctor_approved_date", "approved_amount", "payment_approved_date", "paid_date",
    "created_at", "updated_at",
]


def verified_requests(requests: DataFrame, employees: DataFrame, divisions: DataFrame | None = None,
                      profile: list[str] | None = None, batch_small: bool | None = None) -> DataFrame:
    """Trimmed request credentials matched to one employee (smallest ``e_id``).

    Adds ``cn`` / ``nic_in`` (trimmed input) and the employee ``profile``
    columns (NULL when the pair does not verify); with ``divisions`` the
    employee's ``division_name`` too.
    """
    profile = profile or ["e_id"]
    req = (requests.withColumn("cn", text_or_empty("computer_number"))
           .withColumn("nic_in", text_or_empty("nic")))
    # only the employees the batch names, before the per-key reduction
    employees = restrict_to_keys(employees, ci("computer_number"), req.select(ci("cn").alias("_asked")), "_asked",
                                 keys_small=batch_small)
    emp = first_employee_per_key(
        employees, {"_k_cn": ci("computer_number"), "_k_nic": ci("nic")},
        list(dict.fromkeys(["e_id", *profile])))
    cols = [c for c in emp.columns if c not in ("_k_cn", "_k_nic")]
    emp = emp.select("_k_cn", "_k_nic", *[F.col(c).alias(f"vemp_{c}") for c in cols])
    out = req.join(emp, (ci(req["cn"]) == emp["_k_cn"]) & (ci(req["nic_in"]) == emp["_k_nic"]), "left")
    out = out.drop("_k_cn", "_k_nic")
    if divisions is not None:
        div = broadcast_if_small(divisions.select(F.col("div_code").alias("_div"),
                                                  F.col("division_name").alias("vemp_division_name")))
        out = out.join(div, F.col("vemp_division_code") == F.col("_div"), "left").drop("_div")
    return out


def authorized_claim(requests: DataFrame, employees: DataFrame, divisions: DataFrame,
                     claims: DataFrame) -> DataFrame:
    """A claim is shown only to the verified employee whose computer number it carries.

    ``outcome``: ``missing_input`` (blank number or NIC, id ≤ 0), then
    ``invalid_employee``, then ``not_found``, else ``ok``.
    """
    batch_small = is_small(requests)
    ver = verified_requests(requests, employees, divisions,
                            ["e_id", "computer_number", "nic", "initials", "surname", "division_code"],
                            batch_small)
    claims = restrict_to_keys(claims, F.col("r_id"), requests.select(F.col("claim_id").alias("_asked")), "_asked",
                              keys_small=batch_small)
    cl = claims.select(F.col("r_id").alias("_rid"), ci("emp_computer_number").alias("_ckey"),
                       *[F.col(c) for c in claims.columns])
    missing = (F.col("cn") == "") | (F.col("nic_in") == "") | (F.coalesce(F.col("claim_id"), F.lit(0)) <= 0)
    ok_emp = ~missing & F.col("vemp_e_id").isNotNull()
    joined = ver.join(cl, ok_emp & (F.col("claim_id") == F.col("_rid")) & (ci(F.col("cn")) == F.col("_ckey")),
                      "left")
    outcome = (F.when(missing, F.lit("missing_input"))
               .when(F.col("vemp_e_id").isNull(), F.lit("invalid_employee"))
               .when(F.col("_rid").isNull(), F.lit("not_found")).otherwise(F.lit("ok")))
    shown = F.col("_rid").isNotNull()  # the employee block is returned with the claim only
    emp_cols = [
        F.when(shown, F.col("vemp_e_id")).alias("employee_id"),
        F.when(shown, F.col("vemp_computer_number")).alias("employee_computer_number"),
        F.when(shown, F.col("vemp_nic")).alias("employee_nic"),
        F.when(shown, labels.full_name("vemp_initials", "vemp_surname")).alias("full_name"),
        F.when(shown, F.col("vemp_division_name")).alias("division"),
    ]
    claim_cols = [F.when(shown, F.col("_rid")).alias("claim_id")] + [
        F.col(c) for c in EMPLOYEE_CLAIM_COLUMNS[1:]]
    return joined.select("request_id", outcome.alias("outcome"), *emp_cols, *claim_cols)


def authorized_history(requests: DataFrame, employees: DataFrame, divisions: DataFrame,
                       claims: DataFrame, history: DataFrame, statuses: DataFrame,
                       users: DataFrame) -> DataFrame:
    """J5 + J3: the history rows each authorized request may see.

    The history is first cut down to the authorized claims (see
    :func:`rows_of_claims`), so the log table is pruned or scanned, not shuffled.
    """
    # written once: the claim ids prune the log before they are joined with it
    ok = checkpointed(authorized_claim(requests, employees, divisions, claims)
                      .where(F.col("outcome") == "ok").select("request_id", F.col("claim_id").alias("_cid")))
    mine = rows_of_claims(history, ok, "_cid", is_small(ok))
    hist = _employee_history_rows(mine, statuses, users)
    return (ok.join(hist, ok["_cid"] == hist["claim_requests_id"], "inner").drop("_cid")
            .orderBy("request_id", "updated_at", "log_id"))


NO_REMARKS = "No remarks yet."


def latest_remark(history: DataFrame, claims: DataFrame) -> DataFrame:
    """G1: last non-blank history remark (untrimmed), else the medical remark, else a fixed text.

    ``max_by`` is a partial aggregate, so a claim with a very long history is
    folded on the map side before the shuffle.  A log stored by claim is not moved at all.
    """
    last = (history.where(js_trim("remarks") != "")
            .groupBy(F.col("claim_requests_id").alias("_cid"))
            .agg(F.max_by("remarks", F.struct("updated_at", "log_id")).alias("_remark")))
    remark = F.coalesce(F.col("_remark"), F.when(F.col("medical_remark") != "", F.col("medical_remark")),
                        F.lit(NO_REMARKS))
    return (claims.join(last, claims["r_id"] == last["_cid"], "left")
            .select(F.col("r_id").alias("claim_id"), remark.alias("latest_remark")))


# The progress steps shown for a claim, in order.
PROGRESS_STEPS = ["Submitted", "Received Document", "Submitted to Doctor",
                  "Approved by Doctor", "Payment Approved", "Paid"]


def progress_timeline(claims: DataFrame) -> DataFrame:
    """Six rows per claim with ``is_done`` / ``is_current`` (exact, case-sensitive match).

    NULL or '' status reads as Submitted; a status outside the six marks no
    step done.
    """
    steps = F.array(*[F.lit(s) for s in PROGRESS_STEPS])
    status = F.when(F.col("status").isNull() | (F.col("status") == ""), F.lit("Submitted")) \
        .otherwise(F.col("status"))
    base = claims.select(F.col("r_id").alias("claim_id"), status.alias("_status"),
                         F.array_position(steps, status).alias("_current"))
    rows = base.select("claim_id", "_status", "_current", F.posexplode(steps).alias("_pos", "step"))
    return rows.select("claim_id", (F.col("_pos") + 1).cast("int").alias("step_no"), "step",
                       ((F.col("_pos") + 1) <= F.col("_current")).alias("is_done"),
                       (F.col("step") == F.col("_status")).alias("is_current"))
