"""The claim tables as typed DataFrames.

Storage is one Parquet directory per table (``<dir>/<name>``), read with a
declared schema so a scan never infers types and Catalyst can prune columns
and push filters into the Parquet reader.  ``read_jdbc`` reads the same tables
from a relational database in parallel slices of a numeric key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
_DATE, _TS = T.DateType(), T.TimestampNTZType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


SCHEMAS: dict[str, T.StructType] = {
    "divisions": _schema(("div_code", _I), ("division_name", _S)),
    "employees": _schema(
        ("e_id", _I), ("port", _S), ("computer_number", _S), ("initials", _S), ("surname", _S),
        ("payoffice", _S), ("service_number", _S), ("nic", _S), ("dob", _DATE),
        ("division_code", _I), ("balance_opd_amount", _D), ("balance_specs_amount", _D)),
    "dependants": _schema(
        ("d_id", _I), ("relationship", _S), ("full_name", _S), ("nic", _S),
        ("employee_e_id", _I), ("dob", _DATE), ("document_received", _I)),
    # the password column is deliberately absent: it is never read
    "users": _schema(("u_id", _I), ("fullname", _S), ("username", _S), ("status", _I)),
    "claims": _schema(
        ("r_id", _I), ("reference", _S), ("opd_date", _DATE), ("amount_requested", _D),
        ("claim_type", _S), ("patient_name", _S), ("emp_computer_number", _S),
        ("is_document_received", _I), ("document_received_date", _TS), ("invoice_number", _S),
        ("medical_recommendation", _S), ("medical_remark", _S), ("doctor_approved_date", _DATE),
        ("approved_amount", _D), ("payment_approved_date", _DATE), ("paid_date", _DATE),
        ("created_at", _TS), ("updated_at", _TS), ("claim_for", _S), ("status", _S)),
    "statuses": _schema(("s_id", _I), ("status_name", _S), ("status_order", _I)),
    "history": _schema(
        ("log_id", _L), ("remarks", _S), ("updated_at", _TS), ("claim_requests_id", _I),
        ("updated_by", _I), ("old_status_id", _I), ("new_status_id", _I)),
}

CLAIM_COLUMNS = [f.name for f in SCHEMAS["claims"].fields]


def read_table(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{base_dir.rstrip('/')}/{name}")


def read_tables(spark: SparkSession, base_dir: str,
                names: list[str] | None = None) -> dict[str, DataFrame]:
    """All (or the named) claim tables under ``base_dir`` as DataFrames."""
    return {n: read_table(spark, base_dir, n) for n in (names or list(SCHEMAS))}


def read_jdbc(spark: SparkSession, url: str, table: str, name: str, *,
              partition_column: str, lower_bound: int, upper_bound: int,
              num_partitions: int, properties: dict | None = None) -> DataFrame:
    """One table over JDBC, split into ``num_partitions`` range reads of a key.

    Only the declared columns are selected; the JDBC source pushes that column
    list (and any later filters) into the SQL it sends, quoted for the
    database's dialect, so the database ships only what the operators use
    (never the password column).
    """
    reader = (spark.read.format("jdbc").option("url", url).option("dbtable", table)
              .option("partitionColumn", partition_column)
              .option("lowerBound", str(lower_bound)).option("upperBound", str(upper_bound))
              .option("numPartitions", str(num_partitions)).option("fetchsize", "10000"))
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    return reader.load().select(*[F.col(f.name).cast(f.dataType) for f in SCHEMAS[name].fields])
