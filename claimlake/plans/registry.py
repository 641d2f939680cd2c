"""Registry of named queries: a Spark plan and, where SQL can say it, a DuckDB oracle.

Each query takes ``(spark, sf_dir)``, reads the fixture views over the Parquet
tables in ``sf_dir`` and returns a DataFrame.  The oracle text is plain SQL over
the same fixture views (given as ``WITH`` clauses) that DuckDB runs on the same
files; column names match the Spark result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import FixtureTables, fixture_tables, with_fixtures

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
OPERATOR_IDS: dict[str, str] = {}


def query(name: str, operator_id: str, oracle: str | None = None, fixtures: tuple[str, ...] = ()):
    """Register ``fn(tables) -> DataFrame`` as query ``name``."""

    def wrap(fn: Callable[[FixtureTables], DataFrame]) -> Callable[[FixtureTables], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(fixture_tables(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        OPERATOR_IDS[name] = operator_id
        if oracle is not None:
            ORACLE[name] = with_fixtures(oracle, *fixtures)
        return fn

    return wrap


def load_all() -> None:
    """Import every plan module so its queries are registered."""
    from . import dashboard, details, employee, projections, search, streams, submissions, updates  # noqa: F401
