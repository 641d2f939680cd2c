"""The status log stored by claim: bucketed and sorted by claim id.

Reading a claim's history from a log in order of arrival scans all of it.
Stored in buckets of the claim id, a request for some claims opens only the
buckets that can hold them, and joins and aggregates by claim id find the log
dealt already: no exchange and no sort of the whole log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LOG_KEY = "claim_requests_id"
LOG_ORDER = (LOG_KEY, "updated_at", "log_id")


def write_claim_log(history: DataFrame, name: str, path: str, buckets: int) -> DataFrame:
    """Store ``history`` as table ``name`` under ``path``; the stored table.

    Rows are dealt by claim id before the write, so each bucket is one file.
    Choose at least as many buckets as joins have shuffle partitions, so that
    the planner moves the other side.
    """
    spark = history.sparkSession
    (history.repartition(buckets, LOG_KEY).write.mode("overwrite").format("parquet")
     .bucketBy(buckets, LOG_KEY).sortBy(*LOG_ORDER).option("path", path).saveAsTable(name))
    return read_claim_log(spark, name)


def read_claim_log(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)
