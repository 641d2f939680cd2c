"""Status choice lists built by UNION ALL and a case-insensitive GROUP BY."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ci

# The canonical statuses and their display order.
CANONICAL_STATUSES = [
    ("Submitted", 10),
    ("Received Document", 20),
    ("Document Needed", 30),
    ("Submitted to Doctor", 40),
    ("Approved by Doctor", 50),
    ("Rejected by Doctor", 60),
    ("Payment Approved", 70),
    ("Paid", 80),
]
UNLISTED_ORDER = 999


def _named(df: DataFrame, name_col: str) -> DataFrame:
    return df.where(F.col(name_col).isNotNull() & (F.rtrim(name_col) != ""))


def _facet(rows: DataFrame) -> DataFrame:
    """Group by name (case-insensitive): smallest real id (else 0), smallest spelling and order."""
    return (rows.groupBy(ci("status_name").alias("_k"))
            .agg(F.coalesce(F.min(F.when(F.col("status_id") != 0, F.col("status_id"))), F.lit(0))
                 .alias("status_id"),
                 F.min("status_name").alias("status_name"),
                 F.min("status_order").alias("status_order"))
            .select("status_id", "status_name", "status_order")
            .orderBy("status_order", "status_name"))


def _table_side(statuses: DataFrame) -> DataFrame:
    return _named(statuses, "status_name").select(
        F.col("s_id").cast("int").alias("status_id"), "status_name",
        F.col("status_order").cast("int").alias("status_order"))


def status_facets(statuses: DataFrame, claims: DataFrame) -> DataFrame:
    """Status table plus every status seen on claims (id 0, order 999).

    The claims side is reduced to its distinct spellings before the union (a hash
    aggregate on the scan; a least string over all claims would sort them), so
    only a handful of rows meet the status table.
    """
    seen = (_named(claims, "status").groupBy("status").agg(F.count(F.lit(1)))
            .select(F.lit(0).alias("status_id"), F.col("status").alias("status_name"),
                    F.lit(UNLISTED_ORDER).alias("status_order")))
    return _facet(_table_side(statuses).unionByName(seen))


def status_choices(statuses: DataFrame) -> DataFrame:
    """Status table plus the canonical statuses (id 0) for the update form."""
    spark = statuses.sparkSession
    canon = spark.createDataFrame(
        [(0, name, order) for name, order in CANONICAL_STATUSES],
        "status_id int, status_name string, status_order int")
    return _facet(_table_side(statuses).unionByName(canon))
