"""Batch intake of submitted claims.

Each submission is one input row with an arrival order ``seq`` and its event
time.  The outcome of every row is decided set-wise but equals a one-by-one
replay in ``seq`` order: validity never depends on other rows, and only the
duplicate check (last) looks at earlier rows and at the claims table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.text import ci, is_numeric_text, strict_date, text_or_empty
from .common import checkpointed, first_employee_per_key, is_small, number_rows, restrict_to_keys

# Accepted claim types and beneficiaries.
CLAIM_TYPES = ("opd", "specs")
CLAIM_FOR = ("MYSELF", "SPOUSE", "CHILD", "MOTHER", "FATHER")
# What a new claim and its first log row look like.
INITIAL_STATUS = "Submitted"
INITIAL_STATUS_ID = 1
SUBMITTING_USER_ID = 1
SUBMISSION_REMARK = "Claim submitted by employee"
REFERENCE_PREFIX = "MC"
REFERENCE_PATTERN = r"^MC-([0-9]{4})-([0-9]{1,18})$"

# The normalised reference of stored claims, and how many references are looked up by name.
REFERENCE_KEY = "reference_key"
LITERAL_REFERENCES = 500

TEXT_FIELDS = ["reference", "computer_number", "nic", "opd_date", "amount_requested",
               "claim_type", "claim_for", "patient_name"]


def _normalized(submissions: DataFrame) -> DataFrame:
    """Trimmed text of every field (missing → ''), as the server reads it."""
    out = submissions
    for f in TEXT_FIELDS:
        out = out.withColumn(f"in_{f}", text_or_empty(f))
    return (out.withColumn("in_claim_type", F.lower("in_claim_type"))
            .withColumn("in_claim_for", F.upper("in_claim_for")))


def employee_keys(employees: DataFrame) -> DataFrame:
    """One employee per (number, NIC), as :func:`check_submissions` joins them."""
    return first_employee_per_key(
        employees, {"_k_cn": ci("computer_number"), "_k_nic": ci("nic")},
        ["e_id", "initials", "surname"])


def validate_submissions(submissions: DataFrame, employees: DataFrame,
                         client_rules: bool = False, ts_col: str = "submitted_at",
                         batch_small: bool | None = None) -> DataFrame:
    """The first failing rule names the outcome, else ``ok``.

    Order: ``missing_field`` (any of 8 blank after trim) → ``bad_date`` (strict
    YYYY-MM-DD, a real day) → [``future_date``] → ``bad_type`` (opd, specs) →
    ``bad_for`` (5 values) → ``bad_amount`` (numeric text, > 0) →
    ``bad_employee`` (number and NIC of one employee).

    ``client_rules`` (W11) adds the browser checks: for MYSELF a blank patient
    name is filled with the employee's name, and an OPD date after the day of
    submission is rejected as ``future_date``.
    """
    asked = _normalized(submissions).select(ci("in_computer_number").alias("_asked"))
    emp = employee_keys(restrict_to_keys(employees, ci("computer_number"), asked, "_asked",
                                         keys_small=batch_small))
    return check_submissions(submissions, emp, client_rules, ts_col)


def check_submissions(submissions: DataFrame, emp: DataFrame, client_rules: bool = False,
                      ts_col: str = "submitted_at") -> DataFrame:
    """W1 against :func:`employee_keys`; runs no job, so ``submissions`` may be a stream."""
    s = _normalized(submissions)
    s = s.join(emp, (ci(s["in_computer_number"]) == emp["_k_cn"]) & (ci(s["in_nic"]) == emp["_k_nic"]), "left")
    if client_rules:
        own_name = F.coalesce(labels.employee_name_strict("initials", "surname"), F.lit(""))
        s = s.withColumn("in_patient_name", F.when(
            (F.col("in_claim_for") == "MYSELF") & (F.col("in_patient_name") == ""), own_name)
            .otherwise(F.col("in_patient_name")))
    missing = None
    for f in TEXT_FIELDS:
        m = F.col(f"in_{f}") == ""
        missing = m if missing is None else (missing | m)
    opd = strict_date(F.col("in_opd_date"))
    amount = F.when(is_numeric_text("in_amount_requested"), F.col("in_amount_requested").cast("double"))
    rules: list[tuple[str, Column]] = [("missing_field", missing), ("bad_date", opd.isNull())]
    if client_rules:
        rules.append(("future_date", opd > F.to_date(F.col(ts_col))))
    rules += [
        ("bad_type", ~F.col("in_claim_type").isin(list(CLAIM_TYPES))),
        ("bad_for", ~F.col("in_claim_for").isin(list(CLAIM_FOR))),
        ("bad_amount", amount.isNull() | (amount <= 0)),
        ("bad_employee", F.col("e_id").isNull()),
    ]
    outcome = None
    for name, cond in rules:
        outcome = F.when(cond, F.lit(name)) if outcome is None else outcome.when(cond, F.lit(name))
    outcome = outcome.otherwise(F.lit("ok"))
    return s.select(*submissions.columns, outcome.alias("outcome"),
                    F.col("in_reference").alias("v_reference"),
                    F.col("in_computer_number").alias("v_computer_number"),
                    opd.alias("v_opd_date"), amount.alias("v_amount"),
                    F.col("in_claim_type").alias("v_claim_type"),
                    F.col("in_claim_for").alias("v_claim_for"),
                    F.col("in_patient_name").alias("v_patient_name"))


def reference_exists(requests: DataFrame, claims: DataFrame, ref_col: str = "reference",
                     keys_small: bool | None = None) -> DataFrame:
    """Flag rows whose reference is already on a claim (case-insensitive).

    The claims side is first cut down to the references the batch asks about
    (broadcast semi join when that key set is small), then made distinct (no
    fan-out when the table holds a reference twice).  Claims stored with their
    normalised reference (``sinks.write_claims``) are asked by literals for up to
    LITERAL_REFERENCES references: row groups whose Bloom filter holds none of them are not read.
    """
    asked = requests.select(ci(ref_col).alias("_asked"))
    stored = REFERENCE_KEY in claims.columns
    taken = claims.select((F.col(REFERENCE_KEY) if stored else ci("reference")).alias("_ref_key"))
    few = None
    if stored:
        few = [r[0] for r in asked.where(F.col("_asked").isNotNull()).distinct().limit(LITERAL_REFERENCES + 1).collect()]
    if few is not None and len(few) <= LITERAL_REFERENCES:
        known = taken.where(F.col("_ref_key").isin(few) if few else F.lit(False)).distinct()
    else:
        known = restrict_to_keys(taken, F.col("_ref_key"), asked, "_asked", keys_small=keys_small).distinct()
    out = requests.join(known, ci(requests[ref_col]) == known["_ref_key"], "left")
    return out.withColumn("reference_exists", F.col("_ref_key").isNotNull()).drop("_ref_key")


def ingest_submissions(submissions: DataFrame, claims: DataFrame, employees: DataFrame,
                       client_rules: bool = False, ts_col: str = "submitted_at") -> DataFrame:
    """Outcome per submission and the id of each accepted claim.

    Of the valid rows, the first (by ``seq``) of each case-insensitive
    reference is accepted unless the table already holds that reference; the
    others are ``duplicate_reference``.  A rejected row reserves nothing.
    Accepted rows get ids above the table's largest id in ``seq`` order
    (numbered without a global sort on one task, see ``number_rows``).
    """
    batch_small = is_small(submissions)  # bounds every key set derived from the batch
    checked = validate_submissions(submissions, employees, client_rules, ts_col, batch_small)
    first = (checked.where(F.col("outcome") == "ok").groupBy(ci("v_reference").alias("_fk"))
             .agg(F.min("seq").alias("_first_seq")))
    return decide_submissions(checked, first, claims, claims.agg(F.max("r_id")).first()[0] or 0, batch_small)


def decide_submissions(checked: DataFrame, first: DataFrame, claims: DataFrame, base_id: int,
                       batch_small: bool | None = None) -> DataFrame:
    """W2 on checked rows: ``first`` holds, per reference key ``_fk``, the ``_first_seq`` that may take it.

    A valid row whose key is missing from ``first`` or taken by another row or
    by a claim is a duplicate.  New ids start above ``base_id``.
    """
    out = checked.join(first, ci(checked["v_reference"]) == first["_fk"], "left").drop("_fk")
    out = reference_exists(out, claims, "v_reference", keys_small=batch_small)
    outcome = (F.when(F.col("outcome") != "ok", F.col("outcome"))
               .when(F.col("reference_exists") | ~F.col("seq").eqNullSafe(F.col("_first_seq")),
                     F.lit("duplicate_reference"))
               .otherwise(F.lit("accepted")))
    # decided once (the duplicate check scans the claims table) and shared by the numbering and the result
    out = checkpointed(out.withColumn("outcome", outcome).drop("_first_seq", "reference_exists"))
    accepted = number_rows(out.where(F.col("outcome") == "accepted"), ["seq"], out="_n")
    ids = accepted.select(F.col("seq").alias("_aseq"), (F.lit(base_id) + F.col("_n")).cast("int").alias("claim_id"),
                          F.col("_n").alias("accept_no"))
    return out.join(ids, out["seq"] == ids["_aseq"], "left").drop("_aseq")


def new_claims(ingested: DataFrame, ts_col: str = "submitted_at") -> DataFrame:
    """The claim rows the accepted submissions add (status Submitted, both stamps = event time)."""
    acc = ingested.where(F.col("outcome") == "accepted")
    null_s, null_d = F.lit(None).cast("string"), F.lit(None).cast("date")
    return acc.select(
        F.col("claim_id").alias("r_id"), F.col("v_reference").alias("reference"),
        F.col("v_opd_date").alias("opd_date"), F.col("v_amount").alias("amount_requested"),
        F.col("v_claim_type").alias("claim_type"), F.col("v_patient_name").alias("patient_name"),
        F.col("v_computer_number").alias("emp_computer_number"),
        F.lit(0).alias("is_document_received"),
        F.lit(None).cast("timestamp_ntz").alias("document_received_date"),
        null_s.alias("invoice_number"), null_s.alias("medical_recommendation"), null_s.alias("medical_remark"),
        null_d.alias("doctor_approved_date"), F.lit(None).cast("double").alias("approved_amount"),
        null_d.alias("payment_approved_date"), null_d.alias("paid_date"),
        F.col(ts_col).cast("timestamp_ntz").alias("created_at"),
        F.col(ts_col).cast("timestamp_ntz").alias("updated_at"),
        F.col("v_claim_for").alias("claim_for"), F.lit(INITIAL_STATUS).alias("status"))


def submission_history(ingested: DataFrame, history: DataFrame, ts_col: str = "submitted_at") -> DataFrame:
    """One log row per accepted claim, ids above the log's largest id in ``seq`` order."""
    return log_rows(ingested, history.agg(F.max("log_id")).first()[0] or 0, ts_col)


def log_rows(ingested: DataFrame, base_log: int, ts_col: str = "submitted_at") -> DataFrame:
    """W3 with log ids above ``base_log``."""
    acc = ingested.where(F.col("outcome") == "accepted")
    return acc.select(
        (F.lit(base_log) + F.col("accept_no")).cast("long").alias("log_id"),
        F.lit(SUBMISSION_REMARK).alias("remarks"),
        F.col(ts_col).cast("timestamp_ntz").alias("updated_at"),
        F.col("claim_id").alias("claim_requests_id"),
        F.lit(SUBMITTING_USER_ID).alias("updated_by"),
        F.lit(INITIAL_STATUS_ID).alias("old_status_id"),
        F.lit(INITIAL_STATUS_ID).alias("new_status_id"))


def assign_references(submissions: DataFrame, claims: DataFrame, ts_col: str = "submitted_at") -> DataFrame:
    """Fill blank references with ``MC-<year>-<5 digits>``, unique and repeatable.

    Numbers continue above the largest number already used for that year (on
    claims or in the batch), in ``seq`` order within the year of submission.
    The per-year numbering is split across tasks (``number_rows``), so a batch
    that falls in one year is not numbered by a single task.
    """
    s = submissions.withColumn("_ref", text_or_empty("reference"))
    # references compare without case and trailing blanks, so a lower-case one is taken too
    used = (claims.select(F.upper(F.rtrim("reference")).alias("_r"))
            .unionByName(s.select(F.upper(F.rtrim("_ref")).alias("_r")))
            .where(F.col("_r").rlike(REFERENCE_PATTERN))
            .groupBy(F.regexp_extract("_r", REFERENCE_PATTERN, 1).try_cast("int").alias("_y"))
            .agg(F.max(F.regexp_extract("_r", REFERENCE_PATTERN, 2).try_cast("long")).alias("_top")))
    blanks = (s.where(F.col("_ref") == "").select("seq", F.year(ts_col).alias("_y")))
    numbered = number_rows(blanks, ["seq"], ["_y"], out="_n")
    # one row per 4-digit year: at most 10,000 rows
    numbered = numbered.join(F.broadcast(used), "_y", "left")
    made = numbered.select(F.col("seq").alias("_bseq"), F.format_string(
        f"{REFERENCE_PREFIX}-%d-%05d", F.col("_y"), F.coalesce(F.col("_top"), F.lit(0)) + F.col("_n"))
        .alias("_new"))
    out = s.join(made, s["seq"] == made["_bseq"], "left")
    return out.select("seq", F.coalesce(F.col("_new"), F.col("_ref")).alias("reference"),
                      (F.col("_ref") == "").alias("assigned"))


# The five-digit numbers of a year's references.
FIRST_NUMBER, LAST_NUMBER = 10_000, 99_999
FIVE_DIGITS = r"^MC-([0-9]{4})-([1-9][0-9]{4})$"
PLACES = 64     # places of free numbers that are joined at once


def free_numbers(used: DataFrame, years: DataFrame) -> DataFrame:
    """The free numbers of each year as gaps: ``_y``, ``_from`` (first number), ``_place`` (free numbers before it), ``_size``.

    ``used`` are (``_y``, ``_n``).  A gap lies between two used numbers that follow one another, so a
    year has at most as many gaps as used numbers, and never more than half of all numbers.
    """
    edge = years.select("_y", F.lit(LAST_NUMBER + 1).alias("_n"))
    order = Window.partitionBy("_y").orderBy("_n")
    gaps = (used.where(F.col("_n").between(FIRST_NUMBER, LAST_NUMBER)).join(F.broadcast(years), "_y", "left_semi").distinct()
            .unionByName(edge)
            .withColumn("_from", F.coalesce(F.lag("_n").over(order) + 1, F.lit(FIRST_NUMBER)))
            .withColumn("_size", F.col("_n") - F.col("_from")).where(F.col("_size") > 0))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return gaps.withColumn("_place", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_n")


def assign_free_references(submissions: DataFrame, claims: DataFrame, ts_col: str = "submitted_at") -> DataFrame:
    """W10 within five digits: the n-th blank reference of a year (by ``seq``) gets the year's n-th free number.

    Free are numbers that neither a claim nor the batch has.  Numbers are not listed
    but kept as gaps, and places of requests fall into gaps by an interval join on
    (year, stretch of PLACES places), so a year in which all requests fall is split.
    ``outcome``: ``given``, ``assigned``, or ``none_free`` (reference NULL) when
    the year has no free number left.
    """
    s = submissions.select("seq", text_or_empty("reference").alias("_ref"), F.year(ts_col).alias("_year"))
    taken = (claims.select(F.upper(F.rtrim("reference")).alias("_r"))
             .unionByName(s.select(F.upper(F.rtrim("_ref")).alias("_r"))).where(F.col("_r").rlike(FIVE_DIGITS)))
    used = taken.select(F.regexp_extract("_r", FIVE_DIGITS, 1).try_cast("int").alias("_y"), F.regexp_extract("_r", FIVE_DIGITS, 2).try_cast("int").alias("_n"))
    blanks = s.where(F.col("_ref") == "").select(F.col("seq").alias("_bseq"), F.col("_year").alias("_y"))
    years = blanks.select("_y").where(F.col("_y").isNotNull()).distinct()  # at most one row a calendar year
    gaps = free_numbers(used, years)
    last = F.col("_place") + F.col("_size") - 1
    gaps = gaps.withColumn("_part", F.explode(F.sequence((F.col("_place") / PLACES).cast("int"), (last / PLACES).cast("int"))))
    places = (number_rows(blanks, ["_bseq"], ["_y"], out="_k").withColumn("_k", F.col("_k") - 1)
              .where(F.col("_k") <= LAST_NUMBER - FIRST_NUMBER).withColumn("_part", (F.col("_k") / PLACES).cast("int")))
    hit = places.join(gaps, ["_y", "_part"]).where((F.col("_k") >= F.col("_place")) & (F.col("_k") <= last))
    made = hit.select("_bseq", F.format_string(f"{REFERENCE_PREFIX}-%04d-%05d", F.col("_y"), (F.col("_from") + F.col("_k") - F.col("_place")).cast("int")).alias("_new"))
    out = s.join(made, s["seq"] == made["_bseq"], "left")
    blank = F.col("_ref") == ""
    return out.select("seq", F.when(blank, F.col("_new")).otherwise(F.col("_ref")).alias("reference"),
                      F.when(~blank, F.lit("given")).when(F.col("_new").isNotNull(), F.lit("assigned")).otherwise(F.lit("none_free")).alias("outcome"))
