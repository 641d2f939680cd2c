"""N-gram Jaccard join: a metric-space join of shingle sets.

The Jaccard distance is a metric.  Two texts link when their distance is at
most ``1 - 0.8``; the join finds the components of all links.

*Classes.*  Texts with equal sets are one class (named by a 96-bit digest), so
copies cost one row each and never meet.

*Regions.*  Around a text nearly all others lie at the largest distance, 1:
they share no shingle, and distances to such pivots tell nothing.  So the first
regions come from shingles as pivots: a set's nearest one-shingle sets {s} are
those of its own shingles, at distance 1 - 1/n, and the first of them in a
common order is its cell.  Boundary sets are replicated by a window: two linked
sets share one of their first n // 5 + 1 shingles in any common order, so each
set enters the cells of those.  In the order used, shingles of many sets come
last (found by counting all windows of a first pass), so common passages
rarely open a cell.  A set whose cell is its shingle number ``at`` can share only
the ``n - at`` shingles from there on, which bounds the size of its partners
there (:func:`parts`).  In each cell sets that have no partner within these
bounds leave; the others form a region around one of them, the cell's pivot text.

*Recursion.*  In a region all distances to the pivot text are computed.  Sets
within the threshold link to it, and need no more tests among each other.  For
the others, more pivot texts cut the region into Voronoi cells; a set also
enters the cell of pivot p if d(x, p) <= d(x, nearest) + 2 * threshold and
d(x, p) <= radius of the cell + threshold (triangle inequality), and
cells join recursively; small or indivisible ones by exact tests of all pairs
that are not yet connected.

*Large regions* are dealt to blocks with the pivot in each, which makes the
links to the pivot in linear time; only pairs of blocks with a set *outside* the
pivot's threshold are met again, as pairs of blocks (:func:`_across`).  So a
group of near copies of any size is linear, and no task holds more than two
blocks.  Sets travel to their regions as deflated text, a quarter of the size of
their hashes, and are hashed again there.

*Rows* are numbered once: the numbers are written with the texts, and all steps
read that table, so other splits of a later scan cannot renumber anything.

Defined cases: null, empty and blank texts have an empty set, link to nothing
and are their own component; repeated rows and ids are members of their
class; a null doc_id is member of its component but never names it, unless all
members are null; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions, text_or_empty
from .components import components
from .shingles import digest, mix, shingle_sets

PERCENT = 80            # link when 100 * intersection >= PERCENT * union
HEAVY = 20              # a shingle in more windows than this comes last in the order
HEAVY_ROWS = 1 << 20    # bound of the broadcast list of such shingles (the others only cost time)
DOCS_PER_BUCKET = 4000
FLUSH_ENTRIES = 1 << 19
BLOCK_SETS = 1024
LEAF_SETS = 24
PIVOT_TEXTS = 6
UNPACK_BYTES = 1 << 20
ENTRY = np.dtype([("shingle", "<u8"), ("set", "S12"), ("n", "<u4"), ("at", "<u4")])
RADIUS = 1 - PERCENT / 100


# --- sets --------------------------------------------------------------------

def numbered(docs: DataFrame, name: str = "row") -> DataFrame:
    """``docs`` with a number of each row in column ``name``, written once."""
    return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "numbered-rows")


def set_rows(docs: DataFrame) -> DataFrame:
    """Two kinds of rows: (row, doc_id, set, n) of each document, and (bucket, blob) of window shingles."""
    def run(batches):
        import pyarrow as pa

        seen: set[bytes] = set()
        held, size = [], 0

        def flush():
            hashes = np.concatenate(held) if held else np.zeros(0, dtype=np.uint64)
            part = cell_bucket(hashes, buckets)
            order = np.argsort(part, kind="stable")
            hashes, part = hashes[order], part[order]
            keys, first = np.unique(part, return_index=True)
            blobs = [x.tobytes() for x in np.split(hashes, first[1:])] if len(keys) else []
            n = len(keys)
            return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], names=names)

        for batch in batches:
            sets = shingle_sets(batch.column(2).to_pylist())
            names_of = [digest(s) for s in sets]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names_of, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names=names)
            for name, hashes in zip(names_of, sets):
                if len(hashes) and name not in seen:
                    seen.add(name)
                    held.append(hashes[:len(hashes) // 5 + 1])
                    size += len(held[-1])
            if size >= FLUSH_ENTRIES:
                yield flush()
                held, size = [], 0
                seen = set() if len(seen) > 1 << 18 else seen
        yield flush()

    names = ["row", "doc_id", "set", "n", "bucket", "blob"]
    buckets = bucket_count(docs)
    return docs.select("row", "doc_id", "text").mapInArrow(run, "row long, doc_id long, set binary, n long, bucket long, blob binary")


def bucket_count(docs: DataFrame) -> int:
    return min(1 << 16, max(shuffle_partitions(docs.sparkSession), docs.count() // DOCS_PER_BUCKET))


def cell_bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each shingle; mixed again, as a window holds the smallest hashes of its set."""
    return ((mix(hashes) >> np.uint64(48)).astype(np.int64) * buckets) >> 16


def by_key(batches, key: list[str], finish):
    """Feed the rows of equal ``key``, which come together, to ``finish`` as one list of dicts."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            at = tuple(row[k] for k in key)
            if at != now:
                if held:
                    yield finish(now, held)
                now, held = at, []
            held.append(row)
    if held:
        yield finish(now, held)


def heavy_shingles(blobs: DataFrame) -> np.ndarray:
    """Sorted hashes of the shingles in more than HEAVY windows, the most common HEAVY_ROWS at most."""
    def run(batches):
        import pyarrow as pa

        def count(_, rows):
            keys, n = np.unique(np.concatenate([np.frombuffer(r["blob"], dtype=np.uint64) for r in rows]), return_counts=True)
            often = n > HEAVY
            return pa.RecordBatch.from_arrays([pa.array(keys[often].view(np.int64), pa.int64()), pa.array(n[often], pa.int64())], names=["shingle", "n"])

        yield from by_key(batches, ["bucket"], count)

    spark = blobs.sparkSession
    dealt = blobs.repartition(shuffle_partitions(spark), "bucket").sortWithinPartitions("bucket")
    top = dealt.mapInArrow(run, "shingle long, n long").orderBy(F.desc("n"), "shingle").limit(HEAVY_ROWS)
    return np.sort(top.select("shingle").toPandas()["shingle"].to_numpy(dtype=np.int64).view(np.uint64))


def window(hashes: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """The first n // 5 + 1 shingles of a sorted set, heavy ones last."""
    k = len(hashes) // 5 + 1
    if not len(heavy) or not len(hashes):
        return hashes[:k]
    late = heavy[np.minimum(np.searchsorted(heavy, hashes), len(heavy) - 1)] == hashes
    first = hashes[~late][:k]
    return first if len(first) == k else np.concatenate([first, hashes[late][:k - len(first)]])


# --- regions -----------------------------------------------------------------

def window_entries(docs: DataFrame, heavy: np.ndarray) -> DataFrame:
    """(bucket, blob of ENTRY): each set in the cells of its window, once per task."""
    shared = docs.sparkSession.sparkContext.broadcast(heavy)  # at most HEAVY_ROWS numbers
    buckets = bucket_count(docs)

    def run(batches):
        import pyarrow as pa

        seen: set[bytes] = set()
        held, size = [], 0

        def flush():
            entries = np.concatenate(held) if held else np.zeros(0, dtype=ENTRY)
            part = cell_bucket(entries["shingle"], buckets)
            order = np.argsort(part, kind="stable")
            entries, part = entries[order], part[order]
            keys, first = np.unique(part, return_index=True)
            blobs = [x.tobytes() for x in np.split(entries, first[1:])] if len(keys) else []
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

        for batch in batches:
            for hashes in shingle_sets(batch.column(0).to_pylist()):
                name = digest(hashes)
                if not len(hashes) or name in seen:
                    continue
                seen.add(name)
                first = window(hashes, shared.value)
                entry = np.zeros(len(first), dtype=ENTRY)
                entry["shingle"], entry["set"], entry["n"], entry["at"] = first, name, len(hashes), np.arange(len(first))
                held.append(entry)
                size += len(entry)
            if size >= FLUSH_ENTRIES:
                yield flush()
                held, size = [], 0
                seen = set() if len(seen) > 1 << 18 else seen
        yield flush()

    return docs.select("text").mapInArrow(run, "bucket long, blob binary")


def parts(cell: np.ndarray, n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The part of its cell that each entry belongs to, -1 for those without a partner.

    Two sets whose first common shingle has positions i and j share at most
    min(n - i, m - j) shingles.  A link needs 9 * common >= 4 * (n + m), so
    m <= reach(n, i) and n <= reach(m, j) with reach(n, i) = (5 * n - 9 * i) // 4.
    Entries with reach >= n may link when their intervals [n, reach] meet; one
    with a smaller reach may only link to an entry whose interval holds both its
    reach and its size.  Parts are the connected ones of these relations.
    """
    base = cell.astype(np.int64) << 32
    size, reach = base + n, base + (5 * n - 9 * at) // 4
    part = np.full(len(n), -1, dtype=np.int64)
    wide = np.flatnonzero(reach >= size)
    if not len(wide):
        return part
    wide = wide[np.argsort(size[wide], kind="stable")]
    starts, far = size[wide], np.maximum.accumulate(reach[wide])
    number = np.cumsum(np.concatenate([[True], starts[1:] > far[:-1]])) - 1
    part[wide] = number
    narrow = np.flatnonzero(reach < size)
    last = np.searchsorted(starts, reach[narrow], side="right") - 1
    held = (last >= 0) & (far[last] >= size[narrow])
    part[narrow[held]] = number[last[held]]
    part[(np.bincount(part[part >= 0], minlength=len(wide)) == 1)[part] & (part >= 0)] = -1
    return part


def regions(entries: DataFrame) -> DataFrame:
    """pivot, set: distinct members of each region (the pivot is one of them)."""
    def run(batches):
        import pyarrow as pa

        def cells(_, rows):
            # np.unique on (shingle, set, n): repeats from several tasks count once
            e = np.concatenate([np.frombuffer(r["blob"], dtype=ENTRY) for r in rows])
            keys, first, n = np.unique(e["shingle"], return_inverse=True, return_counts=True)
            e, first = e[n[first] > 1], first[n[first] > 1]
            raw = np.ascontiguousarray(e["set"]).view(np.uint8).reshape(len(e), 12) if len(e) else np.zeros((0, 12), np.uint8)
            high = raw[:, :8].copy().view(">u8").ravel() if len(e) else np.zeros(0, np.uint64)
            low = raw[:, 8:].copy().view(">u4").ravel() if len(e) else np.zeros(0, np.uint32)
            order = np.lexsort((low, high, e["n"], first))
            e, cell, high, low = e[order], first[order], high[order], low[order]
            fresh = np.ones(len(e), dtype=bool)
            fresh[1:] = (cell[1:] != cell[:-1]) | (high[1:] != high[:-1]) | (low[1:] != low[:-1])
            e, cell, high, low = e[fresh], cell[fresh], high[fresh], low[fresh]
            region = parts(cell, e["n"].astype(np.int64), e["at"].astype(np.int64))
            near = region >= 0
            e, high, low, region = e[near], high[near], low[near], region[near]
            # the least digest of a region is its pivot
            order = np.lexsort((low, high, region))
            region, raw = region[order], np.ascontiguousarray(e["set"][order]).view(np.uint8).reshape(len(e), 12) if len(e) else np.zeros((0, 12), np.uint8)
            head = np.searchsorted(region, region)
            both = np.concatenate([raw[head], raw], axis=1) if len(e) else np.zeros((0, 24), np.uint8)
            both = np.unique(both, axis=0) if len(e) else both
            flat = both.tobytes()
            return pa.RecordBatch.from_arrays([pa.array([flat[i:i + 12] for i in range(0, len(flat), 24)], pa.binary()), pa.array([flat[i + 12:i + 24] for i in range(0, len(flat), 24)], pa.binary())], names=["pivot", "set"])

        yield from by_key(batches, ["bucket"], cells)

    spark = entries.sparkSession
    dealt = entries.repartition(shuffle_partitions(spark), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "pivot binary, set binary").distinct()


# --- exact join of one region ------------------------------------------------

def pack_text(text: str) -> bytes:
    return zlib.compress(text.encode("utf-8"), 1)


def packed_sets(packed: list[bytes]) -> list[np.ndarray]:
    """The shingle set of each packed text; some UNPACK_BYTES of text, or one text, at a time."""
    out, held, size = [], [], 0
    for blob in packed:
        held.append(zlib.decompress(blob).decode("utf-8"))
        size += len(held[-1])
        if size >= UNPACK_BYTES:
            out += shingle_sets(held)
            held, size = [], 0
    return out + (shingle_sets(held) if held else [])


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether 100 * intersection >= PERCENT * union."""
    small, large = sorted((len(a), len(b)))
    if 100 * small < PERCENT * large:
        return False
    common = int(np.intersect1d(a, b, assume_unique=True).size)
    return 100 * common >= PERCENT * (small + large - common)


def distances(pivot: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Jaccard distances of ``sets`` (none empty) to ``pivot``."""
    flat = np.concatenate(sets)
    hit = pivot[np.minimum(np.searchsorted(pivot, flat), len(pivot) - 1)] == flat
    sizes = np.array([len(s) for s in sets])
    common = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes) - sizes)
    return 1 - common / (len(pivot) + sizes - common)


class RegionJoin:
    """Links of one region's sets, as a forest."""

    EPS = 1e-9  # rounding of distances; only makes windows wider

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.parent = list(range(len(sets)))
        self.edges: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def test(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b and linked(self.sets[i], self.sets[j]):
            self.parent[max(a, b)] = min(a, b)
            self.edges.append((i, j))

    def around(self, pivot: int, members: list[int]) -> np.ndarray:
        """Distances of ``members`` to ``pivot``, linking those within the threshold."""
        d = distances(self.sets[pivot], [self.sets[m] for m in members])
        for m in np.array(members)[d <= RADIUS + self.EPS].tolist():
            if m != pivot:
                self.test(pivot, m)
        return d

    def join(self, members: list[int]) -> None:
        if len(members) <= LEAF_SETS:
            for x, i in enumerate(members):
                for j in members[x + 1:]:
                    self.test(i, j)
            return
        step = len(members) / PIVOT_TEXTS
        pivots = sorted({members[int(k * step)] for k in range(PIVOT_TEXTS)})
        d = np.array([self.around(p, members) for p in pivots])
        if len({self.find(m) for m in members}) == 1:
            return
        home = d.argmin(axis=0)
        nearest = d.min(axis=0)
        cells = []
        for p in range(len(pivots)):
            own = home == p
            if own.any():
                reach = (d[p] <= nearest + 2 * RADIUS + self.EPS) & (d[p] <= nearest[own].max() + RADIUS + self.EPS)
                cells.append((p, own, own | reach))
        # a cut must leave less than half of the pairs, so the work at all depths stays below that of all pairs
        if sum(int(inside.sum()) ** 2 for _, _, inside in cells) <= len(members) ** 2 / 2:
            for _, _, inside in cells:
                self.join([m for m, i in zip(members, inside.tolist()) if i])
            return
        everyone = np.array(members)
        for p, own, inside in cells:  # the pivots hardly divide it: test the sets at home here
            self.exact(everyone[own], everyone[inside], d[p][own], d[p][inside])

    def exact(self, homes: np.ndarray, others: np.ndarray, home_d: np.ndarray, other_d: np.ndarray) -> None:
        """Test pairs whose distances to a pivot differ by no more than the threshold, one set against all others at once."""
        order = np.argsort(other_d, kind="stable")
        others, other_d = others[order], other_d[order]
        sizes = np.array([len(self.sets[o]) for o in others.tolist()])
        for i, at in zip(homes.tolist(), home_d.tolist()):
            low = np.searchsorted(other_d, at - RADIUS - self.EPS)
            high = np.searchsorted(other_d, at + RADIUS + self.EPS, side="right")
            n, m = len(self.sets[i]), sizes[low:high]
            fits = others[low:high][100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)].tolist()
            root = self.find(i)
            left = [j for j in fits if self.find(j) != root]
            if left:
                self.around(i, left)


def _edge_batch(pairs: list[tuple[bytes, bytes]], outside: list[tuple[bytes, bytes]]):
    import pyarrow as pa

    rows = [(a, b, None) for a, b in pairs] + [(None, b, a) for a, b in outside]
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], names=["a", "b", "region"])


def region_edges(members: DataFrame) -> DataFrame:
    """a, b: a forest of the links in each region; rows with ``region``: sets outside the pivot's threshold in divided regions.

    ``members``: pivot, block, blocks, set, packed (with the pivot in each block).
    """
    def run(batches):
        def one(key, rows):
            rows.sort(key=lambda r: (r["set"] != r["pivot"], r["set"]))
            names = [r["set"] for r in rows]
            region = RegionJoin(packed_sets([r["packed"] for r in rows]))
            everyone = list(range(len(names)))
            d = region.around(0, everyone)
            if len({region.find(m) for m in everyone}) > 1:
                region.join(everyone)
            outside = [(key[0], names[i]) for i in np.flatnonzero(d > RADIUS).tolist()] if rows[0]["blocks"] > 1 else []
            return _edge_batch([(names[i], names[j]) for i, j in region.edges], outside)

        yield from by_key(batches, ["pivot", "block"], one)

    spark = members.sparkSession
    dealt = members.repartition(shuffle_partitions(spark), "pivot", "block").sortWithinPartitions("pivot", "block")
    return dealt.mapInArrow(run, "a binary, b binary, region binary")


def _across(outside: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: links of sets outside their pivot's threshold to sets in other blocks of the divided region."""
    def run(batches):
        def one(_, rows):
            names = [r["set"] for r in rows]
            region = RegionJoin(packed_sets([r["packed"] for r in rows]))
            out = [i for i, r in enumerate(rows) if r["asks"]]
            rest = [i for i, r in enumerate(rows) if not r["asks"]]
            both, flat = np.array(out + rest, dtype=np.int64), np.zeros(len(rows))
            region.exact(both[:len(out)], both[len(out):], flat[:len(out)], flat[len(out):])
            return _edge_batch([(names[i], names[j]) for i, j in region.edges], [])

        yield from by_key(batches, ["pivot", "block", "own"], one)

    spark = members.sparkSession
    asks = outside.select(F.col("region").alias("pivot"), F.col("b").alias("set")).distinct()
    blocks = members.select("pivot", "block", "blocks").distinct()
    own = F.pmod(F.xxhash64("set"), F.col("blocks")).alias("own")
    # each asking set to every block of its region, each block's sets to every block of asking sets
    left = asks.join(blocks, "pivot").select("pivot", "block", own, "set", F.lit(True).alias("asks"))
    right = members.select("pivot", "block", "set").join(left.select("pivot", "block", "own").distinct(), ["pivot", "block"]).select("pivot", "block", "own", "set", F.lit(False).alias("asks"))
    rows = left.unionByName(right).join(sets, "set")
    dealt = rows.repartition(shuffle_partitions(spark), "pivot", "block", "own").sortWithinPartitions("pivot", "block", "own")
    return dealt.mapInArrow(run, "a binary, b binary, region binary").select("a", "b")


def region_sets(docs: DataFrame, rows: DataFrame, members: DataFrame) -> DataFrame:
    """set, packed (the deflated text) of every set that is in a region, from one document each."""
    wanted = members.select("set").distinct()
    one = rows.filter("n > 0").groupBy("set").agg(F.min("row").alias("row")).join(wanted, "set")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            packed = [pack_text(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["row", "packed"])

    packed = docs.select("row", "text").mapInArrow(run, "row long, packed binary")
    return materialize(packed.join(one, "row").select("set", "packed"), "region-sets")


# --- the join ----------------------------------------------------------------

def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, n_shingles, component_id, first of every input row.

    ``row`` is a number of the row; ``first`` marks one row of each component.
    """
    return _components(numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))))


def _components(docs: DataFrame) -> DataFrame:
    """:func:`near_duplicates` of a written table row, doc_id, text."""
    written = materialize(set_rows(docs), "shingle-rows")
    rows = written.filter("row is not null").select("row", "doc_id", "set", "n")
    heavy = heavy_shingles(written.filter("row is null").select("bucket", "blob"))
    members = materialize(regions(window_entries(docs, heavy)), "regions")
    sets = region_sets(docs, rows, members)
    # written first: the join then splits or broadcasts, and no task needs a whole region for its count
    large = members.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK_SETS).cast("long").alias("blocks")).filter("blocks > 1")
    large = materialize(large, "large-regions")
    members = members.join(large, "pivot", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    members = members.withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")))
    members = materialize(members.select("pivot", "block", "blocks", "set"), "region-blocks")
    heads = members.select("pivot", "blocks").distinct().select("pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "blocks", F.col("pivot").alias("set"))
    placed = members.filter("set <> pivot").unionByName(heads).join(sets, "set")
    found = materialize(region_edges(placed), "region-edges")
    edges = found.filter("a is not null").select("a", "b").unionByName(_across(found.filter("region is not null"), members.filter("blocks > 1"), sets))
    labels = materialize(components(edges), "set-components")
    joined = rows.join(labels, rows["set"] == labels["node"], "left").select("row", "doc_id", "n", F.coalesce("component", "set").alias("label"))
    joined = materialize(joined, "labelled-rows")
    alone = F.col("n") == 0
    key = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row")
    least = joined.filter(~alone).groupBy("label").agg(F.min(key).alias("k"))
    # written first, like the large regions: the join with a large component's rows can then be split
    least = materialize(least.select("label", F.col("k.doc_id").alias("component_id"), F.col("k.row").alias("least_row")), "component-ids")
    full = joined.filter(~alone).join(least, "label").select("row", "doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("row") == F.col("least_row")).alias("first"))
    empty = joined.filter(alone).select("row", "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
    return full.unionByName(empty)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component; texts without words all stay."""
    stored = numbered(docs, "__row")
    rows = stored.select(F.col("__row").alias("row"), F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    kept = materialize(_components(rows).filter("first").select(F.col("row").alias("__row")), "kept-rows")
    return stored.join(kept, "__row", "left_semi").drop("__row")
