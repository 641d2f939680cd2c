from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from claimlake.session import SESSION_DEFAULTS

    builder = (SparkSession.builder.master("local[4]").appName("claimlake-tests")
               .config("spark.ui.enabled", "false")
               .config("spark.sql.shuffle.partitions", "8"))
    for k, v in SESSION_DEFAULTS.items():
        builder = builder.config(k, v)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    if not session.sparkContext.getCheckpointDir():
        session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="claimlake-test-ckpt-"))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables_small(spark):
    from claimlake.sources.fixtures import fixture_tables

    return fixture_tables(spark, SF_SMALL)
