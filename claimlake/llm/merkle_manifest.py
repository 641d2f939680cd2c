"""Merkle manifest of a dataset: one root for all rows, and a proof for each.

A leaf is the digest of a row's values.  The leaves of a group (here: a source),
in order of their ids, are folded FAN by FAN into the group's subroot; the
subroots, in order of the groups, are folded likewise into the root.  A row's
proof holds the siblings of its path, from which the root can be computed again.

*Time-forward processing.*  The nodes of a tree are labelled so that children
come before parents.  Going through the labels in order, a node takes the
digests that were sent to its label off a priority queue, computes its own and
sends it to the label of its parent: the order of the sweep, not an index, brings
the data together.  A second sweep in reversed order sends the *path* (all
siblings of a node and its ancestors) from parents to children.

The queue is external: a sweep works on slices of FAN ** HEIGHT consecutive nodes
of one level, one slice after the other, in a task of Spark.  Messages within a
slice wait in a heap of at most FAN * (HEIGHT + 1) entries; those that leave the slice (one per
slice) are written to a table and come back, dealt by Spark to the slice of
their receiver and sorted by label, which spills to disk as needed.  A tree of n
leaves takes log(n) / log(FAN ** HEIGHT) rounds either way.  A group that holds
a third of all rows is many slices; nothing collects a level.

A path is a text: per level the digests of the run with ``*`` in place of the
node's own, levels separated by commas.  Paths of leaves are used where they
arrive and never stored.

Defined cases: nulls are written as ``-`` in a leaf; a null group is a group of
its own, before all others; null ids come first in their group; rows of equal
id are in order of their leaves; a group of one row is its own subroot; an empty
table gives an empty table; very long texts are hashed whole; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.common import number_rows
from .common import materialize, shuffle_partitions

FAN = 16
HEIGHT = 3
SLICE = FAN ** HEIGHT
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NODE = "tree string, pos long, size long, digest string"
PATH = "tree string, pos long, path string, subroot string"
MANIFEST = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


# --- leaves ------------------------------------------------------------------

def _value(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """sha256 of the values: ``-`` for null, else byte count, colon, value."""
    return F.sha2(F.concat(*[_value(v) for v in values]), 256)


# --- sweeps over one slice ---------------------------------------------------

def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def slice_height(size: int) -> int:
    """Levels that a slice of a tree with ``size`` nodes on this level goes up."""
    height = 0
    while size > 1 and height < HEIGHT:
        size, height = -(-size // FAN), height + 1
    return height


class Slice:
    """A slice's subtrees: labels are (last leaf below, level), so children come before parents."""

    def __init__(self, digests: list[str], size: int):
        self.digests, self.height = digests, slice_height(size)
        self.children: dict[tuple, list[str]] = {}

    def _parent(self, label: tuple) -> tuple:
        last, level = label
        width = FAN ** (level + 1)
        return min(last // width * width + width, len(self.digests)) - 1, level + 1

    def forward(self) -> str:
        """Sweep up: the digest that leaves the slice."""
        queue: list[tuple] = []
        sent = self.digests[0]
        for i, digest in enumerate(self.digests):
            if not self.height:
                continue
            heapq.heappush(queue, (*self._parent((i, 0)), i, digest))
            while queue and queue[0][0] <= i:
                label, came = queue[0][:2], []
                while queue and queue[0][:2] == label:
                    came.append(heapq.heappop(queue)[3])
                self.children[label] = came
                sent = _digest("".join(came))
                if label[1] < self.height:
                    heapq.heappush(queue, (*self._parent(label), i, sent))
        return sent

    def backward(self, path: str):
        """Sweep down with the path of the slice's top: (place, path) of each node, the last one first."""
        if not self.height:
            yield 0, path
            return
        queue = [(-(len(self.digests) - 1), -self.height, path)]
        while queue:
            last, level, path = heapq.heappop(queue)
            last, level = -last, -level
            if not level:
                yield last, path
                continue
            came = self.children[last, level]
            width = FAN ** (level - 1)
            first = last // (width * FAN) * FAN
            for k in range(len(came)):
                run = "".join(came[:k]) + "*" + "".join(came[k + 1:])
                end = min((first + k + 1) * width, len(self.digests)) - 1
                heapq.heappush(queue, (-end, -(level - 1), f"{run},{path}" if path else run))


def proof_digest(path: str) -> str:
    return _digest(path.replace("*", "").replace(",", ""))


def fold(digest: str, path: str) -> str:
    """The root that follows from a leaf and its path."""
    for level in path.split(",") if path else ():
        digest = _digest(level.replace("*", digest))
    return digest


# --- rounds ------------------------------------------------------------------

def _slices(batches, columns: list[str], name):
    """Rows of one slice after the other, as lists of dicts, with the message of the slice (or None) first."""
    now, message, held = None, None, []
    for batch in batches:
        for row in batch.select(columns).to_pylist():
            at = name(row)
            if at != now:
                if held:
                    yield message, held
                now, message, held = at, None, []
            if row.get("late") is False:
                message = row
            else:
                held.append(row)
    if held:
        yield message, held


def _dealt(nodes: DataFrame, *order: str) -> DataFrame:
    n = shuffle_partitions(nodes.sparkSession)
    keyed = nodes.withColumn("slice", F.expr(f"pos div {SLICE}"))
    return keyed.repartition(n, "tree", "slice").sortWithinPartitions("tree", "slice", *order)


def _of_slice(row: dict) -> tuple:
    return row["tree"], row["slice"]


def up(nodes: DataFrame) -> DataFrame:
    """tree, pos, size, digest of the next round: one node for each slice of this one."""
    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("size", pa.int64()), ("digest", pa.string())])
        for _, rows in _slices(batches, ["tree", "slice", "size", "digest"], _of_slice):
            first = rows[0]
            top = Slice([r["digest"] for r in rows], first["size"]).forward()
            yield pa.RecordBatch.from_pylist([{"tree": first["tree"], "pos": first["slice"], "size": -(-first["size"] // SLICE), "digest": top}], schema=schema)

    return _dealt(nodes.select("tree", "pos", "size", "digest"), "pos").mapInArrow(run, NODE)


def _with_messages(nodes: DataFrame, paths: DataFrame, columns: list[str]) -> DataFrame:
    """Nodes and, at the head of each slice, the message for its top: ``paths`` are (tree, pos of the slice, path, ...)."""
    extra = [c for c in paths.columns if c not in ("tree", "pos")]
    kinds = {f.name: f.dataType for f in [*nodes.schema.fields, *paths.schema.fields]}
    sent = paths.select("tree", (F.col("pos") * SLICE).alias("pos"), *[F.lit(None).cast(kinds[c]).alias(c) for c in columns], *extra, F.lit(False).alias("late"))
    own = nodes.select("tree", "pos", *columns, *[F.lit(None).cast(kinds[c]).alias(c) for c in extra], F.lit(True).alias("late"))
    return _dealt(sent.unionByName(own), "late", "pos")


def _proofs(message: dict, rows: list[dict]):
    """(row, path) of the nodes of a slice, by both sweeps."""
    nodes = Slice([r["digest"] for r in rows], rows[0]["size"])
    nodes.forward()
    for at, path in nodes.backward(message["path"]):
        yield rows[at], path


def down(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """tree, pos, path, subroot of every node, from ``paths``: those of the slices' tops, by slice number."""
    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("path", pa.string()), ("subroot", pa.string())])
        for message, rows in _slices(batches, ["tree", "slice", "size", "pos", "digest", "path", "subroot", "late"], _of_slice):
            yield pa.RecordBatch.from_pylist([{"tree": r["tree"], "pos": r["pos"], "path": path, "subroot": message["subroot"]} for r, path in _proofs(message, rows)], schema=schema)

    return _with_messages(nodes, paths, ["size", "digest"]).mapInArrow(run, PATH)


def fold_trees(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The nodes at the foot of each round, and tree, digest of every tree's top."""
    rounds = [leaves.select("tree", "pos", "size", "digest")]
    while not rounds[-1].filter("size > 1").isEmpty():
        rounds.append(materialize(up(rounds[-1].filter("size > 1")), "merkle-nodes"))
    tops = rounds[0].filter("size = 1")
    for nodes in rounds[1:]:
        tops = tops.unionByName(nodes.filter("size = 1"))
    return rounds, tops.select("tree", "digest")


def messages(rounds: list[DataFrame], starts: DataFrame) -> DataFrame:
    """What the slices of the lowest round are sent: ``starts`` (tree, pos = 0, path, subroot) go to each tree's top and on down."""
    sent = None
    for k in range(len(rounds) - 1, -1, -1):
        tops = rounds[k].filter("size = 1").select(F.col("tree").alias("_top"))
        here = starts.join(tops, F.col("tree").eqNullSafe(F.col("_top")), "left_semi")
        here = here if sent is None else here.unionByName(sent)
        if k == 0:
            return here
        sent = materialize(down(rounds[k], here), "merkle-paths")


# --- manifest ----------------------------------------------------------------

def manifest(docs: DataFrame, group_col: str = "source", id_col: str = "doc_id", columns: tuple = ("doc_id", "source", "lang", "n_chars", "text"),
             text_col: str = "text", tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    Rows for which ``tampered`` holds are checked with their text's A-Z in
    lower case: folded_root is computed from that leaf and the original siblings.
    """
    changed = F.translate(F.col(text_col), UPPER, UPPER.lower())
    leaf = leaf_digest(*[F.col(c) for c in columns])
    other = leaf_digest(*[changed if c == text_col else F.col(c) for c in columns])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(group_col).cast("string").alias("tree"), leaf.alias("digest"),
                       (F.when(tampered, other) if tampered is not None else F.lit(None).cast("string")).alias("tampered"))
    numbered = number_rows(materialize(rows, "merkle-leaves"), ["doc_id", "digest"], ["tree"], out="pos", total="size")
    leaves = materialize(numbered.withColumn("pos", F.col("pos") - 1), "merkle-leaves")
    rounds, subroots = fold_trees(leaves)
    subroots = materialize(subroots, "merkle-subroots")

    groups = number_rows(subroots.withColumnRenamed("tree", "name"), ["name"], out="pos", total="size")
    groups = materialize(groups.select(F.lit("").alias("tree"), (F.col("pos") - 1).alias("pos"), "size", "digest", "name"), "merkle-groups")
    top_rounds, top = fold_trees(groups)
    found = top.first()
    if found is None:
        return docs.sparkSession.createDataFrame([], MANIFEST)
    start = docs.sparkSession.createDataFrame([("", 0, "", found.digest)], PATH)
    paths = down(top_rounds[0], messages(top_rounds, start)).select("pos", "path")
    starts = groups.join(paths, "pos").select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"))
    return _leaf_proofs(leaves, messages(rounds, materialize(starts, "merkle-paths")), found.digest)


def _leaf_proofs(leaves: DataFrame, sent: DataFrame, root: str) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        schema = pa.schema([(f.split()[0], pa.int64() if f.endswith("long") else pa.bool_() if f.endswith("boolean") else pa.string()) for f in MANIFEST.split(", ")])
        for message, rows in _slices(batches, ["tree", "slice", "size", "digest", "doc_id", "tampered", "path", "subroot", "late"], _of_slice):
            out = []
            for row, path in _proofs(message, rows):
                folded = fold(row["tampered"] or row["digest"], path)
                out.append({"doc_id": row["doc_id"], "leaf": row["digest"], "subroot": message["subroot"], "root": root,
                            "proof_sha256": proof_digest(path), "folded_root": folded, "verified": folded == root})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return _with_messages(leaves, sent, ["size", "digest", "doc_id", "tampered"]).mapInArrow(run, MANIFEST)
