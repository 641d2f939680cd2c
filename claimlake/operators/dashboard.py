"""Dashboard figures and lists.

A1–A7 are all read from one pre-aggregate of the claims table,
``claims_summary`` (one row per status × claim type): each has a form over the
claims and a form over the summary (``…_of``).  A stored summary follows the
claims by differences: a batch of updates adds its new rows and takes off the old ones
(``summary_change``, ``changed_summary``), so a dashboard load reads a few
dozen rows and no claims at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.text import ci, money
from .common import is_small, restrict_to_keys
from .facets import CANONICAL_STATUSES
from .search import NEEDS_ACTION_STATUSES

PAID, PAYMENT_APPROVED = "Paid", "Payment Approved"
# Statuses whose amount counts as approved.
APPROVED_STATUSES = ("Approved by Doctor", "Payment Approved", "Paid")
DASHBOARD_LIST_SIZE = 8


def claims_summary(claims: DataFrame) -> DataFrame:
    """One row per (status key, claim type): rows, ids and payable amount (cents)."""
    return (claims.groupBy(ci("status").alias("status_key"), "claim_type")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.count("r_id").alias("n_ids"),
                 F.sum(money(labels.payable_amount("approved_amount", "amount_requested")))
                 .alias("payable")))


SUMMARY_KEYS = ["status_key", "claim_type"]
SUMMARY_SUMS = ["n_rows", "n_ids", "payable"]


def _added_up(parts: DataFrame) -> DataFrame:
    types = {"n_rows": "long", "n_ids": "long", "payable": "decimal(28,2)"}
    return parts.groupBy(*SUMMARY_KEYS).agg(*[F.sum(c).cast(types[c]).alias(c) for c in SUMMARY_SUMS])


def summary_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """What claims that were ``before`` and are ``after`` now change in their summary (only changed claims are needed)."""
    gone = claims_summary(before).select(*SUMMARY_KEYS, *[(-F.col(c)).alias(c) for c in SUMMARY_SUMS])
    return _added_up(claims_summary(after).unionByName(gone))


def changed_summary(summary: DataFrame, change: DataFrame, keep_empty: bool = False) -> DataFrame:
    """The summary after a change.

    Groups without claims are left out, or kept with zeros for a store that
    overwrites groups by key.
    """
    now = _added_up(summary.unionByName(change))
    return now if keep_empty else now.where(F.col("n_rows") != 0)


def batch_summary_change(outcomes: DataFrame, claims: DataFrame, new_claims: DataFrame) -> DataFrame:
    """The change of the summary by an update batch: ``outcomes`` name the claims it accepted, ``new_claims`` is the table after it."""
    hit = outcomes.where(F.col("outcome") == "accepted").select("claim_id")
    small = is_small(hit)
    return summary_change(restrict_to_keys(claims, F.col("r_id"), hit, "claim_id", keys_small=small),
                          restrict_to_keys(new_claims, F.col("r_id"), hit, "claim_id", keys_small=small))


def total_claims(claims: DataFrame) -> DataFrame:
    """A1: every claim row."""
    return claims.agg(F.count(F.lit(1)).alias("total_claims"))


def total_claims_of(summary: DataFrame) -> DataFrame:
    return summary.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).cast("long").alias("total_claims"))


def status_counts(statuses: DataFrame, claims: DataFrame) -> DataFrame:
    """A2: claims per status-table row, zero included, in display order."""
    return status_counts_of(statuses, claims_summary(claims))


def status_counts_of(statuses: DataFrame, summary: DataFrame) -> DataFrame:
    per_key = summary.groupBy("status_key").agg(F.sum("n_ids").alias("_n"))
    sts = statuses.select("s_id", "status_name", "status_order")
    # per_key is one row per status spelling; AQE broadcasts it from its runtime size
    joined = sts.join(per_key, ci(sts["status_name"]) == per_key["status_key"], "left")
    return (joined.select(F.col("s_id").alias("status_id"), "status_name", "status_order",
                          F.coalesce(F.col("_n"), F.lit(0)).cast("long").alias("total"))
            .orderBy("status_order", "status_id"))


def _sum_where(keys: tuple[str, ...]):
    hit = F.col("status_key").isin([k.lower() for k in keys])
    return F.coalesce(F.sum(F.when(hit, F.col("payable"))), F.lit(0).cast("decimal(18,2)")).cast("double")


def payment_summary(claims: DataFrame) -> DataFrame:
    """A3: paid, awaiting payment, and approved amounts (0 on empty input)."""
    return payment_summary_of(claims_summary(claims))


def payment_summary_of(summary: DataFrame) -> DataFrame:
    return summary.agg(
        _sum_where((PAID,)).alias("total_paid_amount"),
        _sum_where((PAYMENT_APPROVED,)).alias("pending_payment_amount"),
        _sum_where(APPROVED_STATUSES).alias("total_approved_amount"))


def claim_type_counts(claims: DataFrame) -> DataFrame:
    """A4: claims per type, the NULL type as its own group."""
    return claims.groupBy("claim_type").agg(F.count(F.lit(1)).alias("total"))


def claim_type_counts_of(summary: DataFrame) -> DataFrame:
    return summary.groupBy("claim_type").agg(F.sum("n_rows").alias("total"))


def _kpi_name(status: str) -> str:
    return status.lower().replace(" ", "_")


KPI_STATUSES = [name for name, _ in CANONICAL_STATUSES]


def status_kpis(statuses: DataFrame, claims: DataFrame) -> DataFrame:
    """A5: one wide row — total, the eight named status counts, paid amount.

    Counts are looked up by exact status-table name (a name missing from the
    table shows 0 even if claims carry it); of duplicate names the last in
    display order wins.
    """
    return status_kpis_of(statuses, claims_summary(claims))


def status_kpis_of(statuses: DataFrame, summary: DataFrame) -> DataFrame:
    per_key = summary.groupBy("status_key").agg(F.sum("n_ids").alias("_n"))
    sts = statuses.select("s_id", "status_name", "status_order")
    counted = (sts.join(per_key, ci(sts["status_name"]) == per_key["status_key"], "left")
               .select("s_id", "status_name", "status_order",
                       F.coalesce("_n", F.lit(0)).alias("total"), F.lit(True).alias("_is_status_row")))
    # status rows and summary rows side by side in one aggregation (no join of one-row results)
    rows = counted.unionByName(summary.withColumn("_is_status_row", F.lit(False)), allowMissingColumns=True)
    order = F.when(F.col("_is_status_row"), F.struct("status_order", "s_id"))
    paid = F.when(~F.col("_is_status_row") & (F.col("status_key") == PAID.lower()), F.col("payable"))
    return rows.agg(
        F.coalesce(F.sum(F.when(~F.col("_is_status_row"), F.col("n_rows"))), F.lit(0)).cast("long")
        .alias("total_claims"),
        F.coalesce(F.sum(paid), F.lit(0).cast("decimal(18,2)")).cast("double").alias("total_paid_amount"),
        *[F.coalesce(F.max_by("total", F.when(F.col("status_name") == name, order)), F.lit(0))
          .cast("long").alias(_kpi_name(name)) for name in KPI_STATUSES])


def status_bars(statuses: DataFrame, claims: DataFrame) -> DataFrame:
    """Bar width per status, round(total / max(max total, 1) * 100) half up."""
    return status_bars_of(statuses, claims_summary(claims))


def status_bars_of(statuses: DataFrame, summary: DataFrame) -> DataFrame:
    counts = status_counts_of(statuses, summary)
    # keyless window on the status list (one row per status), never on claims
    top = F.greatest(F.max("total").over(Window.partitionBy()), F.lit(1))
    return counts.withColumn(
        "bar_pct", F.floor(F.col("total") / top * F.lit(100.0) + F.lit(0.5)).cast("long"))


def type_share(claims: DataFrame) -> DataFrame:
    """Opd and specs counts, their total, and the opd share in percent."""
    return _share(claim_type_counts(claims))


def type_share_of(summary: DataFrame) -> DataFrame:
    return _share(claim_type_counts_of(summary))


def _share(counts: DataFrame) -> DataFrame:
    kind = F.lower(F.col("claim_type"))
    opd = F.coalesce(F.sum(F.when(kind == "opd", F.col("total"))), F.lit(0)).cast("long")
    specs = F.coalesce(F.sum(F.when(kind == "specs", F.col("total"))), F.lit(0)).cast("long")
    agg = counts.agg(opd.alias("opd"), specs.alias("specs"))
    total = F.col("opd") + F.col("specs")
    return agg.select("opd", "specs", total.alias("total"),
                      F.when(total > 0, F.col("opd") / total * F.lit(100.0)).otherwise(F.lit(0.0))
                      .alias("opd_pct"))


# Columns of the dashboard lists.
LIST_COLUMNS = ["claim_id", "reference_no", "computer_no", "employee_name", "opd_date",
                "amount_requested", "claim_type", "status_name", "created_at", "updated_at"]


def _first_claims(claims: DataFrame, activity, n: int) -> DataFrame:
    """The ``n`` claims that lead a list: its order starts with claim columns and the left join
    only adds rows, so the list's first ``n`` rows belong to them."""
    return claims.orderBy(activity.desc_nulls_last(), F.col("r_id").desc()).limit(n)


def _dashboard_rows(claims: DataFrame, employees: DataFrame) -> DataFrame:
    emp = employees.select(ci("computer_number").alias("_k"), "e_id", "initials", "surname")
    return (claims.join(emp, ci(claims["emp_computer_number"]) == emp["_k"], "left")
            .select(F.col("r_id").alias("claim_id"), F.col("reference").alias("reference_no"),
                    F.col("emp_computer_number").alias("computer_no"),
                    labels.employee_name_plain("initials", "surname").alias("employee_name"),
                    "opd_date", "amount_requested", "claim_type",
                    F.col("status").alias("status_name"), "created_at", "updated_at", "e_id"))


def recent_claims(claims: DataFrame, employees: DataFrame, n: int = DASHBOARD_LIST_SIZE) -> DataFrame:
    """L1: the newest claims (by creation, else update time); top-k, no full sort."""
    rows = _dashboard_rows(_first_claims(claims, labels.recent_activity_ts("created_at", "updated_at"), n), employees)
    return (rows.orderBy(labels.recent_activity_ts("created_at", "updated_at").desc_nulls_last(),
                         F.col("claim_id").desc(), F.col("e_id").asc_nulls_first())
            .limit(n).select(*LIST_COLUMNS))


def claims_needing_action(claims: DataFrame, employees: DataFrame, n: int = DASHBOARD_LIST_SIZE) -> DataFrame:
    """L2: claims waiting for an administrator, most recently touched first."""
    waiting = claims.where(ci("status").isin([s.lower() for s in NEEDS_ACTION_STATUSES]))
    rows = _dashboard_rows(_first_claims(waiting, labels.action_activity_ts("created_at", "updated_at"), n), employees)
    return (rows.orderBy(labels.action_activity_ts("created_at", "updated_at").desc_nulls_last(),
                         F.col("claim_id").desc(), F.col("e_id").asc_nulls_first())
            .limit(n).select(*LIST_COLUMNS))
