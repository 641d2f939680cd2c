"""Join, numbering and paging helpers shared by the operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

# Largest dimension that is broadcast on purpose (rows).  Above it the join is
# left to the planner (AQE picks broadcast or sort-merge from runtime sizes).
BROADCAST_MAX_ROWS = 200_000


def is_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> bool:
    """True when ``df`` holds at most ``max_rows`` rows (reads at most ``max_rows + 1``)."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
                       known_small: bool | None = None) -> DataFrame:
    """Broadcast hint only for a side proven to hold at most ``max_rows`` rows.

    The proof is either ``known_small`` — the caller knows an upper bound, e.g.
    a set derived from a request batch is never larger than the batch — or a
    check that reads at most ``max_rows + 1`` rows.  A larger side keeps a
    plain (shuffled, AQE-managed) join.
    """
    small = is_small(df, max_rows) if known_small is None else known_small
    return F.broadcast(df) if small else df


def restrict_to_keys(big: DataFrame, big_key: Column, keys: DataFrame, key_col: str,
                     keys_small: bool | None = None, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Rows of ``big`` whose ``big_key`` occurs in ``keys[key_col]``.

    Used to cut a large table down to the keys a (small) request batch asks
    for before any shuffle: with a key set proven to hold at most ``max_rows``
    keys (``keys_small``, or checked) the semi join is broadcast, so the large
    table is only scanned and filtered; a larger key set falls back to a
    shuffled semi join.
    """
    wanted = keys.select(F.col(key_col).alias("_want")).where(F.col("_want").isNotNull()).distinct()
    return big.join(broadcast_if_small(wanted, max_rows, keys_small), big_key == F.col("_want"), "left_semi")


def first_employee_per_key(employees: DataFrame, keys: dict[str, Column],
                           columns: list[str]) -> DataFrame:
    """One employee per key (smallest ``e_id``), built by partial aggregation.

    Replaces ``LIMIT 1`` after a join that may fan out: the dimension is made
    unique before the join, so a key shared by many employees costs one row.
    """
    keyed = employees.select(*[c.alias(k) for k, c in keys.items()], *columns)
    payload = F.struct(*[F.col(c) for c in columns])
    return (keyed.where(F.col("e_id").isNotNull())
            .groupBy(*keys).agg(F.min_by(payload, F.col("e_id")).alias("_emp"))
            .select(*keys, *[F.col("_emp")[c].alias(c) for c in columns]))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder; cuts its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def leading_int(c: Column | str) -> Column:
    """Integer reading of a request value: its leading integer part, else 0; 0 beyond the id type."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.regexp_extract(c.cast("string"), r"^\s*([+-]?[0-9]+)", 1).try_cast("int"), F.lit(0))


def php_int(value, default: int = 0) -> int:
    """Integer reading of a request value: the leading integer part, else 0."""
    if value is None:
        return default
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, (int, float)):
        return int(value)
    m = re.match(r"\s*([+-]?\d+)", str(value))
    return int(m.group(1)) if m else 0


def number_rows(df: DataFrame, order_by: list[str], group_by: list[str] | None = None,
                out: str = "row_no", num_partitions: int | None = None, total: str | None = None) -> DataFrame:
    """Exact 1-based ``row_number()`` in ``order_by`` order within ``group_by``; one way for every size.

    ``order_by`` (ascending, NULLs first) must be unique within a group, so
    that positions are repeatable.  A two-pass prefix sum: rows are
    range-partitioned on (group, order), so a large group spans many partitions
    and no task holds a whole one; each row takes its position inside its
    partition after a local sort; one count per (group, partition) piece gives
    the offset of the earlier pieces.  With no groups the piece table has at
    most ``num_partitions`` rows.  ``total`` names a further column for the
    number of rows of the group.
    """
    group_by = list(group_by or [])
    keys = group_by + list(order_by)
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written once (reliable checkpoint in the shared folder): the piece counts
    # and the rows must see the same partition of every row, and range bounds
    # drawn from a sample are not repeatable when input order varies.
    tagged = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
              .withColumn("_mid", F.monotonically_increasing_id())
              .withColumn("_part", F.shiftright("_mid", 33))
              .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))))
    tagged = checkpointed(tagged)
    whole = Window.partitionBy(*group_by)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (tagged.groupBy(*group_by, "_part")
              .agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_cnt"))
              .withColumn("_before", F.coalesce(F.sum("_cnt").over(before), F.lit(0))))
    extra = []
    if total is not None:
        pieces = pieces.withColumn("_total", F.sum("_cnt").over(whole))
        extra = [F.col("_total").alias(total)]
    pieces = pieces.select(*[F.col(g).alias(f"_pg{i}") for i, g in enumerate(group_by)],
                           F.col("_part").alias("_pp"), "_first", "_before", *(["_total"] if extra else []))
    # without groups: one row per partition, bounded by n; with groups: left to the planner, no key is hot on either side
    pieces = F.broadcast(pieces) if not group_by else pieces
    cond = [F.col("_part") == F.col("_pp")]
    cond += [F.col(g).eqNullSafe(F.col(f"_pg{i}")) for i, g in enumerate(group_by)]
    numbered = tagged.join(pieces, cond, "inner")
    pos = (F.col("_pos") - F.col("_first") + F.col("_before") + 1).cast("long")
    return numbered.select(*[F.col(c) for c in df.columns], pos.alias(out), *extra)
