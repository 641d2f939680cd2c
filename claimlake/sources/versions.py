"""S3: several tables changed together, by change folders and one commit marker.

A store is a folder that holds the tables' data folders, each written once, and
``_commits``: one JSON marker per version.  A marker lists for every table its base
folder and the change folders since, and high-water marks (e.g. the largest id
given out).  A version exists when its marker does, so readers see all tables
of a commit or none, and a writer that dies leaves only unlisted folders.

* A *keyed* table (claims by ``r_id``): a change folder holds only the rows that
  a batch changed or added, whole.  Readers take the newest version of each key:
  the base less the changed keys, which is a broadcast anti join while the
  changes are few, and the changes' newest rows.
* A *log* (no key): change folders are simply added.

``compact`` writes a new base where change folders have piled up.  Folders are
never overwritten, so a reader that holds an older marker keeps its state.
Markers are written under another name and then renamed; of two writers of one
version the second fails.  One writer at a time is assumed on file systems
whose rename replaces files.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.common import broadcast_if_small

COMMITS = "_commits"
VERSION = "_version"
COMPACT_AFTER = 16      # change folders of a table


@dataclass
class TableState:
    key: str | None
    schema: str
    base: str | None = None
    changes: list[str] = field(default_factory=list)


@dataclass
class Commit:
    version: int = 0
    tables: dict[str, TableState] = field(default_factory=dict)
    marks: dict[str, int] = field(default_factory=dict)


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _marker(root: str, version: int) -> str:
    return posixpath.join(root, COMMITS, f"v{version:012d}.json")


def current_version(spark: SparkSession, root: str) -> int:
    """The highest committed version, 0 before the first commit; only names are listed."""
    fs, folder = _file_system(spark, posixpath.join(root, COMMITS))
    if not fs.exists(folder):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return max((int(n[1:13]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)


def read_commit(spark: SparkSession, root: str, version: int | None = None) -> Commit:
    version = current_version(spark, root) if version is None else version
    if version == 0:
        return Commit()
    fs, path = _file_system(spark, _marker(root, version))
    stream = fs.open(path)
    try:
        raw = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Commit(raw["version"], {n: TableState(**t) for n, t in raw["tables"].items()}, raw["marks"])


def _commit(spark: SparkSession, root: str, commit: Commit) -> None:
    body = json.dumps({"version": commit.version, "tables": {n: vars(t) for n, t in commit.tables.items()}, "marks": commit.marks})
    fs, target = _file_system(spark, _marker(root, commit.version))
    _, draft = _file_system(spark, posixpath.join(root, COMMITS, f"draft-{uuid.uuid4().hex}"))
    if fs.exists(target):
        raise FileExistsError(f"version {commit.version} of {root} is committed already")
    stream = fs.create(draft, True)
    stream.write(bytearray(body.encode("utf-8")))
    stream.close()
    if not fs.rename(draft, target):
        raise FileExistsError(f"version {commit.version} of {root} is committed already")


def _write(df: DataFrame, root: str, name: str, version: int) -> str:
    folder = f"{name}/v{version:012d}-{uuid.uuid4().hex}"   # relative: a store can be moved
    df.withColumn(VERSION, F.lit(version).cast("long")).write.parquet(posixpath.join(root, folder))
    return folder


def publish_changes(spark: SparkSession, root: str, changes: dict[str, DataFrame], keys: dict[str, str | None],
                    marks: dict[str, int] | None = None, batch: int | None = None) -> int:
    """Commit the changed or added rows of several tables as one version; the version.

    ``keys`` names the key column of each table, None for a log.  A keyed
    table's change holds at most one row a key.  With ``batch`` (a number that
    grows from batch to batch) a batch that is committed already does nothing.
    """
    last = read_commit(spark, root)
    if batch is not None:
        if is_committed(last, batch):
            return last.version
        marks = {**(marks or {}), "batch": batch}
    now = Commit(last.version + 1, dict(last.tables), {**last.marks, **(marks or {})})
    for name, df in changes.items():
        old = last.tables.get(name) or TableState(keys[name], df.schema.json())
        now.tables[name] = TableState(old.key, old.schema, old.base, [*old.changes, _write(df.select(*_columns(old)), root, name, now.version)])
    _commit(spark, root, now)
    return now.version


def is_committed(commit: Commit, batch: int) -> bool:
    return commit.marks.get("batch", -1) >= batch


def _columns(state: TableState) -> list[str]:
    return StructType.fromJson(json.loads(state.schema)).names


def _read(spark: SparkSession, root: str, state: TableState, folders: list[str]) -> DataFrame:
    schema = StructType.fromJson(json.loads(state.schema)).add(VERSION, "long")
    return spark.read.schema(schema).parquet(*[posixpath.join(root, f) for f in folders])


def read_current(spark: SparkSession, root: str, name: str, commit: Commit | None = None, with_version: bool = False) -> DataFrame:
    """The table as of ``commit`` (default: the newest); with ``with_version`` also the version of each row."""
    commit = commit or read_commit(spark, root)
    if name not in commit.tables:
        raise FileNotFoundError(f"no table {name} is published under {root}")
    state = commit.tables[name]
    columns = _columns(state) + ([VERSION] if with_version else [])
    folders = ([state.base] if state.base else []) + state.changes
    if state.key is None or not state.changes or (not state.base and len(state.changes) == 1):
        return _read(spark, root, state, folders).select(*columns)
    changed = _read(spark, root, state, state.changes)
    rest = [F.col(c) for c in changed.columns if c != state.key]
    newest = changed.groupBy(state.key).agg(F.max_by(F.struct(*rest), VERSION).alias("_row")).select(state.key, "_row.*").select(*columns)
    if not state.base:
        return newest
    taken = broadcast_if_small(changed.select(F.col(state.key).alias("_key")).distinct())
    base = _read(spark, root, state, [state.base]).select(*columns)
    return base.join(taken, base[state.key] == taken["_key"], "left_anti").unionByName(newest)


def compact(spark: SparkSession, root: str, names: list[str] | None = None, least: int = 1) -> int:
    """New base folders for the (named) tables with at least ``least`` change folders, in a version of its own."""
    last = read_commit(spark, root)
    chosen = [n for n in (names or last.tables) if len(last.tables[n].changes) >= least]
    if not chosen:
        return last.version
    now = Commit(last.version + 1, dict(last.tables), last.marks)
    for name in chosen:
        old = last.tables[name]
        folder = f"{name}/v{now.version:012d}-{uuid.uuid4().hex}"
        read_current(spark, root, name, last, with_version=True).write.parquet(posixpath.join(root, folder))
        now.tables[name] = TableState(old.key, old.schema, folder, [])
    _commit(spark, root, now)
    return now.version
