"""Claims joined to their employee, division and status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ci
from .common import broadcast_if_small

ENRICHED_EMPLOYEE_COLUMNS = ["e_id", "nic", "initials", "surname", "division_code"]


def enrich_claims(claims: DataFrame, employees: DataFrame, divisions: DataFrame,
                  statuses: DataFrame) -> DataFrame:
    """Claims ⟕ employees ⟕ divisions ⟕ statuses.

    Keys compare case- and trailing-blank-insensitively.  A computer number
    shared by several employees, or a status name stored twice, fans the claim
    out into several rows; counts built on this keep those rows.

    The employee side is left to the planner (broadcast when it is small at
    run time, sort-merge otherwise); divisions and statuses are broadcast after
    a size check.
    """
    emp = employees.select(ci("computer_number").alias("_emp_key"), *ENRICHED_EMPLOYEE_COLUMNS)
    div = broadcast_if_small(divisions.select("div_code", "division_name"))
    sts = broadcast_if_small(statuses.select(
        ci("status_name").alias("_status_key"), "s_id", "status_order",
        F.col("status_name").alias("status_table_name")))
    return (claims
            .withColumn("_emp_key", ci("emp_computer_number"))
            .join(emp, "_emp_key", "left")
            .join(div, F.col("division_code") == F.col("div_code"), "left")
            .withColumn("_status_key", ci("status"))
            .join(sts, "_status_key", "left")
            .drop("_emp_key", "_status_key", "div_code"))


def divisions_in_use(divisions: DataFrame, employees: DataFrame) -> DataFrame:
    """Named divisions with at least one employee, one row per name (case-insensitive).

    The employee side is reduced to its distinct division codes first (partial
    aggregation before the shuffle), so the semi join reads a tiny table.
    """
    codes = employees.select(F.col("division_code").alias("_code")).distinct()
    named = divisions.where(F.col("division_name").isNotNull() & (F.rtrim("division_name") != ""))
    used = named.join(codes, named["div_code"] == codes["_code"], "left_semi")
    return (used.groupBy(ci("division_name").alias("_k"))
            .agg(F.min("division_name").alias("division_name"))
            .select("division_name").orderBy("division_name"))
