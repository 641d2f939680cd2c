"""The admin claim search over enriched claims."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.text import ci, like_contains_pattern, truthy_flag
from .common import broadcast_if_small, checkpointed, php_int, restrict_to_keys
from .enrich import enrich_claims
from .paging import SHALLOW, seek

# Statuses that wait for an administrator.
NEEDS_ACTION_STATUSES = ("Submitted", "Document Needed", "Payment Approved")
CLAIM_TYPES = ("opd", "specs")
# Admin page size default and cap.
ADMIN_DEFAULT_LIMIT, ADMIN_MAX_LIMIT = 10, 100

# Columns of a search result row.
SEARCH_COLUMNS = [
    "claim_id", "reference_no", "computer_no", "nic", "employee_name", "division",
    "opd_date", "amount_requested", "claim_type", "claim_for", "patient_name",
    "status_id", "status_name", "created_at", "updated_at",
]


@dataclass(frozen=True)
class SearchFilters:
    """Search form values as typed by the user (all optional)."""
    search: str = ""
    status: str = ""
    status_id: int | str = 0
    claim_type: str = ""
    division: str = ""
    date_from: str = ""
    date_to: str = ""
    needs_action: bool | str = False


def _php_trim(text) -> str:
    return str(text or "").strip(" \t\n\r\x00\x0b")


def text_predicate(term: str) -> Column | None:
    """``%term%`` against reference, computer number, NIC and employee name."""
    term = _php_trim(term)
    if term == "":
        return None
    pattern = like_contains_pattern(term)
    fields = [F.col("reference"), F.col("emp_computer_number"), F.col("nic"),
              F.concat_ws(" ", F.col("initials"), F.col("surname"))]
    pred = None
    for f in fields:
        p = F.lower(f).like(pattern)
        pred = p if pred is None else (pred | p)
    return pred


def status_predicate(status: str = "", status_id=0) -> Column | None:
    """by status id when it is positive, otherwise by name."""
    sid = php_int(status_id)
    if sid > 0:
        return F.col("s_id") == F.lit(sid)
    name = _php_trim(status)
    if name != "":
        return ci("status") == F.lit(name.rstrip(" ").lower())
    return None


def claim_type_predicate(claim_type: str) -> Column | None:
    """opd or specs (the form's "Spectacles" means specs); anything else: no filter."""
    value = _php_trim(claim_type).lower()
    if value == "spectacles":
        value = "specs"
    if value not in CLAIM_TYPES:
        return None
    return ci("claim_type") == F.lit(value)


def division_predicate(division: str) -> Column | None:
    """exact division name (case-insensitive); unassigned claims drop out."""
    name = _php_trim(division)
    if name == "":
        return None
    return ci("division_name") == F.lit(name.rstrip(" ").lower())


def _date_bound(text: str) -> dt.date | None:
    value = _php_trim(text)
    if len(value) != 10 or not (value[:4].isdigit() and value[4] == "-" and value[5:7].isdigit()
                                and value[7] == "-" and value[8:].isdigit()):
        return None  # not shaped YYYY-MM-DD: ignored
    try:
        return dt.date.fromisoformat(value)
    except ValueError as exc:
        raise ValueError(f"impossible date in search filter: {value!r}") from exc


def date_range_predicate(date_from: str = "", date_to: str = "") -> Column | None:
    """inclusive OPD-date range, each end optional (reaches the Parquet scan)."""
    pred = None
    lo, hi = _date_bound(date_from), _date_bound(date_to)
    if lo is not None:
        pred = F.col("opd_date") >= F.lit(lo)
    if hi is not None:
        p = F.col("opd_date") <= F.lit(hi)
        pred = p if pred is None else (pred & p)
    return pred


def needs_action_predicate(flag) -> Column | None:
    """statuses waiting for an administrator."""
    if not truthy_flag(flag):
        return None
    return ci("status").isin([s.lower() for s in NEEDS_ACTION_STATUSES])


def search_predicate(filters: SearchFilters) -> Column | None:
    parts = [text_predicate(filters.search),
             status_predicate(filters.status, filters.status_id),
             claim_type_predicate(filters.claim_type),
             division_predicate(filters.division),
             date_range_predicate(filters.date_from, filters.date_to),
             needs_action_predicate(filters.needs_action)]
    pred = None
    for p in parts:
        if p is not None:
            pred = p if pred is None else (pred & p)
    return pred


def year_partition_predicate(date_from: str = "", date_to: str = "",
                             partition_col: str = "opd_year") -> Column | None:
    """F5 restated on the OPD-year partition column, so a year-partitioned table skips folders."""
    pred = None
    lo, hi = _date_bound(date_from), _date_bound(date_to)
    if lo is not None:
        pred = F.col(partition_col) >= F.lit(lo.year)
    if hi is not None:
        p = F.col(partition_col) <= F.lit(hi.year)
        pred = p if pred is None else (pred & p)
    return pred


def search_claims(enriched: DataFrame, filters: SearchFilters) -> DataFrame:
    """F1–F6 joined by AND over the enriched claims.

    When the claims carry their ``opd_year`` partition column, the date range is
    also stated on it (implied by F5, so results do not change) for partition pruning.
    """
    pred = search_predicate(filters)
    if pred is not None and "opd_year" in enriched.columns:
        years = year_partition_predicate(filters.date_from, filters.date_to)
        if years is not None:
            pred = pred & years
    return enriched if pred is None else enriched.where(pred)


def search_projection(enriched: DataFrame) -> DataFrame:
    """The 15 columns of a search result row (plus the sort keys)."""
    return enriched.select(
        F.col("r_id").alias("claim_id"), F.col("reference").alias("reference_no"),
        F.col("emp_computer_number").alias("computer_no"), "nic",
        labels.employee_name("initials", "surname", "patient_name").alias("employee_name"),
        labels.division_label("division_name").alias("division"),
        "opd_date", "amount_requested", "claim_type", "claim_for", "patient_name",
        F.col("s_id").alias("status_id"), F.col("status").alias("status_name"),
        "created_at", "updated_at", F.col("e_id").alias("_e_id"))


def clamp_admin_paging(page=1, limit=ADMIN_DEFAULT_LIMIT) -> tuple[int, int]:
    page = max(1, php_int(page if page is not None else 1))
    limit = min(ADMIN_MAX_LIMIT, max(1, php_int(limit if limit is not None else ADMIN_DEFAULT_LIMIT)))
    return page, limit


def newest_first(df: DataFrame) -> list[Column]:
    """Newest activity first, then highest id; fan-out rows by employee and status id."""
    return [labels.recent_activity_ts("created_at", "updated_at").desc_nulls_last(),
            F.col("claim_id").desc(), F.col("_e_id").asc_nulls_first(),
            F.col("status_id").asc_nulls_first()]


def _cut(rows: DataFrame, skipped: int, limit: int) -> DataFrame:
    return rows.orderBy(*newest_first(rows)).offset(skipped).limit(limit).select(*SEARCH_COLUMNS)


def search_page(enriched: DataFrame, filters: SearchFilters, page=1, limit=ADMIN_DEFAULT_LIMIT) -> DataFrame:
    """L3: one page of the search over joined rows, newest first; deep pages are sought (``paging``)."""
    page, limit = clamp_admin_paging(page, limit)
    rows = search_projection(search_claims(enriched, filters))
    rows, skipped = seek(rows, labels.recent_activity_ts("created_at", "updated_at"), "claim_id", (page - 1) * limit, limit)
    return _cut(rows, skipped, limit)


def _list_rows(claims: DataFrame, employees: DataFrame, divisions: DataFrame, statuses: DataFrame) -> DataFrame:
    """``claims`` with ``_rows``, the number of rows that each has in the joined list.

    Only numbers, codes and names that are stored more than once take part.
    """
    codes = divisions.groupBy(F.col("div_code").alias("_dc")).agg(F.count(F.lit(1)).alias("_dn")).where("_dn > 1")
    numbers = (employees.join(broadcast_if_small(codes), F.col("division_code") == F.col("_dc"), "left")
               .groupBy(ci("computer_number").alias("_ek")).agg(F.sum(F.coalesce("_dn", F.lit(1))).alias("_en")).where("_en > 1"))
    names = statuses.groupBy(ci("status_name").alias("_sk")).agg(F.count(F.lit(1)).alias("_sn")).where("_sn > 1")
    return (claims.join(broadcast_if_small(numbers), ci(claims["emp_computer_number"]) == F.col("_ek"), "left")
            .join(broadcast_if_small(names), ci(claims["status"]) == F.col("_sk"), "left")
            .withColumn("_rows", F.coalesce("_en", F.lit(1)) * F.coalesce("_sn", F.lit(1)))
            .drop("_ek", "_en", "_sk", "_sn"))


def search_page_of(claims: DataFrame, employees: DataFrame, divisions: DataFrame, statuses: DataFrame,
                   filters: SearchFilters, page=1, limit=ADMIN_DEFAULT_LIMIT) -> DataFrame:
    """L3 from the tables: where the filters concern claims only, claims are cut to the page before any join.

    The list's order starts with claim columns and each claim has at least one row, so
    the first ``n`` rows belong to the first ``n`` claims.  Filters on employee,
    division or status id columns need the joined rows (:func:`search_page`).
    """
    if _php_trim(filters.search) or _php_trim(filters.division) or php_int(filters.status_id) > 0:
        return search_page(enrich_claims(claims, employees, divisions, statuses), filters, page, limit)
    page, limit = clamp_admin_paging(page, limit)
    found, skipped = search_claims(claims, filters), (page - 1) * limit
    activity = labels.recent_activity_ts("created_at", "updated_at")
    if skipped + limit > SHALLOW:
        found, skipped = seek(_list_rows(found, employees, divisions, statuses), activity, "r_id", skipped, limit, F.col("_rows"))
    first = found.orderBy(activity.desc_nulls_last(), F.col("r_id").desc()).limit(skipped + limit).select(*claims.columns)
    first = checkpointed(first)  # few rows, used twice: they name the employees that are joined
    numbers = first.select(ci("emp_computer_number").alias("_number"))
    staff = restrict_to_keys(employees, ci("computer_number"), numbers, "_number", keys_small=True)
    return _cut(search_projection(enrich_claims(first, staff, divisions, statuses)), skipped, limit)


def search_count(enriched: DataFrame, filters: SearchFilters, page=1, limit=ADMIN_DEFAULT_LIMIT) -> DataFrame:
    """Matching rows (fan-out included) and the page figures."""
    page, limit = clamp_admin_paging(page, limit)
    n = search_claims(enriched, filters).agg(F.count(F.lit(1)).alias("total_records"))
    return n.select(
        F.lit(page).alias("current_page"), F.lit(limit).alias("page_limit"), "total_records",
        F.greatest(F.lit(1).cast("long"), F.ceil(F.col("total_records") / F.lit(limit)).cast("long"))
        .alias("total_pages"))


def newest_claim(claims: DataFrame, employees: DataFrame, divisions: DataFrame, statuses: DataFrame) -> DataFrame:
    """Default detail target, the first row of page 1 with limit 1."""
    return search_page_of(claims, employees, divisions, statuses, SearchFilters(), page=1, limit=1)
