"""The employee self-service views, for a batch of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.text import ci, text_or_empty
from .common import is_small, number_rows, restrict_to_keys
from .details import verified_requests

VERIFY_COLUMNS = [
    "e_id", "port", "computer_number", "initials", "surname", "employee_name", "payoffice",
    "service_number", "nic", "dob", "division_code", "division_name", "balance_opd_amount",
    "balance_specs_amount",
]
_PROFILE = ["e_id", "port", "computer_number", "initials", "surname", "payoffice", "service_number",
            "nic", "dob", "division_code", "balance_opd_amount", "balance_specs_amount"]

# Employee page size default and cap.
EMPLOYEE_DEFAULT_LIMIT, EMPLOYEE_MAX_LIMIT = 10, 50

PAGE_COLUMNS = ["claim_id", "reference", "opd_date", "claim_type", "amount_requested",
                "patient_name", "claim_for", "status", "is_document_received", "created_at"]


def verify_employees(requests: DataFrame, employees: DataFrame, divisions: DataFrame) -> DataFrame:
    """(computer number, NIC) → the 14-column employee profile, or why not.

    ``outcome`` checks in order: ``missing_computer_number``, ``missing_nic``,
    ``invalid_employee``, else ``ok``.  The employee table is reduced to one row
    per (number, NIC) key — smallest ``e_id`` — before the join.
    """
    ver = verified_requests(requests, employees, divisions, _PROFILE)
    outcome = (F.when(F.col("cn") == "", F.lit("missing_computer_number"))
               .when(F.col("nic_in") == "", F.lit("missing_nic"))
               .when(F.col("vemp_e_id").isNull(), F.lit("invalid_employee"))
               .otherwise(F.lit("ok")))
    ok = outcome == "ok"

    def shown(c: Column, name: str) -> Column:
        return F.when(ok, c).alias(name)

    cols = []
    for name in VERIFY_COLUMNS:
        if name == "employee_name":
            cols.append(shown(labels.employee_name_strict("vemp_initials", "vemp_surname"), name))
        elif name == "division_name":
            cols.append(shown(F.col("vemp_division_name"), name))
        else:
            cols.append(shown(F.col(f"vemp_{name}"), name))
    return ver.select("request_id", outcome.alias("outcome"), *cols)


def clamp_employee_paging(page: Column, limit: Column) -> tuple[Column, Column]:
    """page < 1 → 1; limit < 1 → 10; limit > 50 → 50 (missing values take the defaults)."""
    p = F.coalesce(page.cast("int"), F.lit(1))
    p = F.when(p < 1, F.lit(1)).otherwise(p)
    n = F.coalesce(limit.cast("int"), F.lit(EMPLOYEE_DEFAULT_LIMIT))
    n = (F.when(n < 1, F.lit(EMPLOYEE_DEFAULT_LIMIT)).when(n > EMPLOYEE_MAX_LIMIT, F.lit(EMPLOYEE_MAX_LIMIT))
         .otherwise(n))
    return p, n


def _employee_requests(requests: DataFrame, employees: DataFrame,
                       page_col: str, limit_col: str, batch_small: bool | None = None) -> DataFrame:
    p, n = clamp_employee_paging(F.col(page_col), F.col(limit_col))
    ver = verified_requests(requests, employees, batch_small=batch_small)
    outcome = (F.when((F.col("cn") == "") | (F.col("nic_in") == ""), F.lit("missing_input"))
               .when(F.col("vemp_e_id").isNull(), F.lit("invalid_employee")).otherwise(F.lit("ok")))
    return ver.select("request_id", "cn", outcome.alias("outcome"), p.alias("page"), n.alias("page_limit"))


def employee_claim_counts(requests: DataFrame, employees: DataFrame, claims: DataFrame,
                          page_col: str = "page", limit_col: str = "page_limit") -> DataFrame:
    """Claims per verified requester, with page figures (no claims → 1 page).

    Claims are first cut down to the verified requesters' computer numbers
    (broadcast semi join when that set is small), counted per number with a
    partial aggregation, then joined to the requests, so a requester with very
    many claims costs one row.
    """
    batch_small = is_small(requests)
    req = _employee_requests(requests, employees, page_col, limit_col, batch_small)
    asked = req.where(F.col("outcome") == "ok").select(ci(F.col("cn")).alias("_asked"))
    mine = restrict_to_keys(claims.select(ci("emp_computer_number").alias("_k")), F.col("_k"), asked, "_asked",
                            keys_small=batch_small)
    counts = mine.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
    ok = F.col("outcome") == "ok"
    joined = req.join(counts, ok & (ci(F.col("cn")) == F.col("_k")), "left")
    total = F.when(ok, F.coalesce(F.col("_n"), F.lit(0))).cast("long")
    pages = F.when(ok, F.when(total > 0, F.ceil(total / F.col("page_limit"))).otherwise(F.lit(1))).cast("long")
    return joined.select("request_id", "outcome",
                         F.when(ok, F.col("page")).alias("page"),
                         F.when(ok, F.col("page_limit")).alias("page_limit"),
                         total.alias("total_claims"), pages.alias("total_pages"))


def deepest_row(requests: DataFrame, page_col: str = "page", limit_col: str = "page_limit") -> int:
    """Deepest row any request can ask for (clamped page × limit): the ranking bound."""
    p, n = clamp_employee_paging(F.col(page_col), F.col(limit_col))
    return requests.agg(F.max(p.cast("long") * n).alias("m")).first()["m"] or 0


def paged_per_key(requests: DataFrame, claims: DataFrame, batch_small: bool | None = None,
                  deepest: int | None = None) -> DataFrame:
    """For each request (``cn``, ``page``, ``page_limit``) its page of claims, newest first.

    Claims are ranked per computer number by (created_at DESC, r_id DESC) and
    kept up to the deepest row any request asks for.  That bound is a literal,
    so Spark plans the ranking as a window group limit that already trims each
    computer number to the bound on the map side, before the shuffle: a
    requester with very many claims ships at most ``bound`` rows per map task.
    Beyond the planner's group-limit threshold the exact positions come from
    ``number_rows`` instead, which splits a large group across tasks.
    """
    if deepest is None:
        deepest = requests.agg(F.max(F.col("page").cast("long") * F.col("page_limit")).alias("m")).first()["m"] or 0
    asked = requests.select(ci(F.col("cn")).alias("_asked"))
    mine = restrict_to_keys(claims.withColumn("_k", ci("emp_computer_number")), F.col("_k"), asked, "_asked",
                            keys_small=batch_small)
    limit_threshold = int(mine.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if deepest <= limit_threshold:
        order = Window.partitionBy("_k").orderBy(F.col("created_at").desc_nulls_last(), F.col("r_id").desc())
        ranked = mine.withColumn("row_no", F.row_number().over(order)).where(F.col("row_no") <= F.lit(int(deepest)))
    else:
        # very deep pages: exact positions without a per-employee window (newest first
        # written as ascending keys: undated last, then later time, then higher id)
        keyed = (mine.withColumn("_undated", F.col("created_at").isNull())
                 .withColumn("_neg_ts", -F.unix_micros(F.col("created_at").cast("timestamp")))
                 .withColumn("_neg_id", -F.col("r_id")))
        ranked = (number_rows(keyed, ["_undated", "_neg_ts", "_neg_id"], ["_k"], out="row_no")
                  .where(F.col("row_no") <= F.lit(int(deepest))))
    req = requests.select("request_id", ci(F.col("cn")).alias("_rk"), "page", "page_limit")
    lo = (F.col("page").cast("long") - 1) * F.col("page_limit")
    joined = req.join(ranked, (F.col("_rk") == F.col("_k")) & (F.col("row_no") > lo)
                      & (F.col("row_no") <= lo + F.col("page_limit")), "inner")
    return joined.select("request_id", (F.col("row_no") - lo).cast("int").alias("position"),
                         F.col("r_id").alias("claim_id"), *PAGE_COLUMNS[1:])


def paged_per_employee(requests: DataFrame, claims: DataFrame,
                       page_col: str = "page", limit_col: str = "page_limit") -> DataFrame:
    """G3 on raw requests: trimmed computer number, clamped paging, no verification."""
    p, n = clamp_employee_paging(F.col(page_col), F.col(limit_col))
    req = requests.select("request_id", text_or_empty("computer_number").alias("cn"),
                          p.alias("page"), n.alias("page_limit")).where(F.col("cn") != "")
    return paged_per_key(req, claims, is_small(requests), deepest_row(requests, page_col, limit_col))


def employee_page(requests: DataFrame, employees: DataFrame, claims: DataFrame,
                  page_col: str = "page", limit_col: str = "page_limit") -> DataFrame:
    """L4: G3 for the requests whose (computer number, NIC) verify."""
    batch_small = is_small(requests)
    req = _employee_requests(requests, employees, page_col, limit_col, batch_small).where(F.col("outcome") == "ok")
    # the bound comes from the raw requests (an upper bound; each request is cut to its page later)
    return paged_per_key(req, claims, batch_small, deepest_row(requests, page_col, limit_col))
