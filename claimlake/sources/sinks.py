"""Writing results.

* ``append`` — INSERT: new rows are added as new files.
* ``publish`` — UPDATE: tables are written whole under a new version folder,
  then a commit marker names the version.  Readers take the highest committed
  version, so several tables switch together and a half-written version is
  never read.  Re-running a version rewrites only that version (idempotent).
* ``write_claims`` / ``rewrite_changed_partitions`` — UPDATE at scale: claims
  are stored by OPD year and a batch rewrites only the years it touched
  (dynamic partition overwrite), not the whole table.
* ``export_json`` — result sets as JSON lines, Unicode unescaped.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from ..functions.text import ci
from ..operators.common import checkpointed
from ..operators.submissions import REFERENCE_KEY

COMMITS = "_commits"


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def _version_dir(root: str, version: int) -> str:
    return os.path.join(root, f"v={version:012d}")


def publish(spark: SparkSession, tables: dict[str, DataFrame], root: str, version: int) -> str:
    """Write each table under ``root/v=<version>/<name>``, then commit the version."""
    target = _version_dir(root, version)
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(os.path.join(target, name))
    marker = spark.createDataFrame([(version, sorted(tables))], "version long, tables array<string>")
    marker.coalesce(1).write.mode("overwrite").json(os.path.join(root, COMMITS, f"v={version:012d}"))
    return target


def current_version(spark: SparkSession, root: str) -> int | None:
    """Highest committed version under ``root`` (None before the first commit)."""
    path = os.path.join(root, COMMITS)
    try:
        commits = spark.read.schema("version long, tables array<string>").json(path)
        row = commits.agg(F.max("version")).first()
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return None  # no commit folder yet
    return None if row is None else row[0]


def read_published(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    v = current_version(spark, root) if version is None else version
    if v is None:
        raise FileNotFoundError(f"nothing published under {root}")
    return spark.read.parquet(os.path.join(_version_dir(root, v), name))


# Claims are stored partitioned by the year of the OPD date: a batch of updates
# mostly touches recent claims, and date-range reads can skip whole years.
CLAIM_PARTITION = "opd_year"
# Distinct references expected in a row group of claims (about 128 MB): sizes its Bloom filter.
REFERENCES_PER_GROUP = 1_000_000


def with_claim_partition(claims: DataFrame) -> DataFrame:
    return claims.withColumn(CLAIM_PARTITION, F.year("opd_date"))


def with_reference_key(claims: DataFrame) -> DataFrame:
    """Claims with the normalised reference as a column of its own, so that lookups by it reach the files."""
    return claims.withColumn(REFERENCE_KEY, ci("reference"))


def _writer(claims: DataFrame, distinct_references: int):
    """A writer that adds a Bloom filter of the normalised reference to every row group."""
    return (claims.write.option(f"parquet.bloom.filter.enabled#{REFERENCE_KEY}", "true")
            .option(f"parquet.bloom.filter.expected.ndv#{REFERENCE_KEY}", str(distinct_references)))


def write_claims(claims: DataFrame, path: str, distinct_references: int = REFERENCES_PER_GROUP) -> None:
    """The whole claims table, one folder per OPD year; ``distinct_references`` sizes the Bloom filter of a row group."""
    rows = with_reference_key(with_claim_partition(claims))
    _writer(rows, distinct_references).mode("overwrite").partitionBy(CLAIM_PARTITION).parquet(path)


def read_claims(spark: SparkSession, path: str, schema, keep_partition: bool = False, keep_key: bool = False) -> DataFrame:
    """Claims written by :func:`write_claims`, with the declared columns.

    With ``keep_partition`` the ``opd_year`` column stays, so OPD-date filters
    (F5) can also prune whole year folders.  With ``keep_key`` the normalised
    reference stays, by which J7 skips row groups.
    """
    cols = [F.col(f.name).cast(f.dataType) for f in schema.fields]
    if keep_partition:
        cols.append(F.col(CLAIM_PARTITION))
    if keep_key:
        cols.append(F.col(REFERENCE_KEY))
    return spark.read.parquet(path).select(*cols)


def rewrite_changed_partitions(new_claims: DataFrame, changed_ids: DataFrame, path: str,
                               id_col: str = "claim_id") -> list:
    """Persist an update batch by rewriting only the years that hold a changed claim.

    ``new_claims`` is the table state after the batch and ``changed_ids`` the
    claims the batch changed.  The touched years (at most one row per year) are
    found first; the rows of those years are cut from the table's lineage with
    ``checkpoint()`` (the table is read from ``path`` itself) and written with
    dynamic partition overwrite, so every other year's files stay as they are.
    Returns the rewritten years.
    """
    staged = with_reference_key(with_claim_partition(new_claims))
    ids = changed_ids.select(F.col(id_col).alias("_changed")).distinct()
    years = (staged.join(ids, staged["r_id"] == ids["_changed"], "left_semi")
             .select(CLAIM_PARTITION).distinct())
    touched = [r[0] for r in years.collect()]  # one value per year: bounded by the calendar
    if not touched:
        return touched
    cond = F.col(CLAIM_PARTITION).isin([y for y in touched if y is not None])
    if None in touched:
        cond = cond | F.col(CLAIM_PARTITION).isNull()
    part = checkpointed(staged.where(cond))
    (_writer(part, REFERENCES_PER_GROUP).mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(CLAIM_PARTITION).parquet(path))
    return touched


def export_json(df: DataFrame, path: str) -> None:
    """One JSON object per row; NULL fields kept as ``null``; Unicode not escaped."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def as_json_lines(df: DataFrame) -> DataFrame:
    """The rows as JSON text in a single ``json`` column (no write)."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))
