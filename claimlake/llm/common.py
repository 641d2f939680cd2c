"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

# Rows per Arrow batch: texts may be long, so few rows bound a task's memory.
BATCH_ROWS = 256


def configure(spark: SparkSession) -> SparkSession:
    """Session settings the Arrow-based operators rely on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint folder (a URI)."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage: what follows reads the written files, so a lost executor
    repeats only its own tasks.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(uri: str):
    """(pyarrow file system, path) of a Hadoop-style URI, as executors see it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), os.path.abspath(uri)
    return fs.FileSystem.from_uri(uri)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def rebatch(tables: Iterable, rows: int) -> Iterator:
    """Slices of at most ``rows`` rows of each Arrow batch."""
    for batch in tables:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


class Generations:
    """A bounded cache in two generations: what was used lately stays."""

    def __init__(self, limit: int):
        self.limit, self.now, self.before = limit, {}, {}

    def missing(self, keys: set) -> list:
        """Those of ``keys`` to be computed; the others are in ``now`` afterwards."""
        if len(self.now) > self.limit:
            self.before, self.now = self.now, {}
        before, now, out = self.before, self.now, []
        for key in keys.difference(now):
            if key in before:
                now[key] = before[key]
            else:
                out.append(key)
        return out
