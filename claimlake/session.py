"""Spark session defaults and the shared checkpoint folder.

On a cluster the session comes from the launcher and already names a shared
``spark.checkpoint.dir``; :func:`checkpoint_dir` only invents a local folder when
that setting is missing (local runs and tests).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job here relies on.  AQE re-plans joins from runtime sizes
# (broadcast when a side turns out small, split skewed partitions otherwise).
SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # lists of up to so many values are pushed to Parquet value by value, where Bloom filters can answer them
    "spark.sql.parquet.pushdown.inFilterThreshold": "500",
    # of a key that a JSON body repeats the last value counts
    "spark.sql.variant.allowDuplicateKeys": "true",
    # top-k per group (paging) is planned as a partial limit before the shuffle
    # up to this many rows per group
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
}


def build_session(master: str = "local[8]", app: str = "claimlake",
                  shuffle_partitions: int = 8, extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench; clusters pass their own builder."""
    builder = (SparkSession.builder.master(master).appName(app)
               .config("spark.ui.enabled", "false")
               # checkpoint files of numbering steps are removed once their data is unreferenced
               .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
               .config("spark.driver.memory", "16g")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for key, value in {**SESSION_DEFAULTS, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_defaults(spark: SparkSession) -> SparkSession:
    """Set the runtime-settable defaults on an existing session."""
    for key, value in SESSION_DEFAULTS.items():
        try:
            spark.conf.set(key, value)
        except Exception:  # static or locked settings keep the launcher's value
            pass
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    Only a local session without the setting gets a temporary folder; on a
    cluster each executor would write to its own disk, so that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="claimlake-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared checkpoint folder (never a machine-local temp dir)."""
    base = checkpoint_dir(spark)
    if base.startswith("file:"):
        base = base[len("file:"):]
    return os.path.join(base, *parts)
