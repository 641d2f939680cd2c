"""Suffix-array dedup: remove strings of 50 bytes that an earlier document has.

A byte goes if it lies in a 50-byte string that also starts in a document with a
smaller doc_id.  Shuffling all suffixes would take 50 times the corpus, so only
suffixes that can matter are sorted:

1. *Anchors.*  Every 50-byte window contains its minimizer, the 20-byte string
   of least hash in it.  Equal windows have it at the same place, so windows
   are compared through their anchors, about one per 16 bytes.  Each anchor is
   sent as a hash of its 20 bytes and one of its *context*, all bytes of the
   windows around it.  Within a task, equal contexts are combined first: only
   the smallest document's goes on, so a group of copies costs one per task.
2. *Buckets* of anchor hashes decide most: if a smaller document has the same
   context, all its windows are repeats; if no smaller document has the anchor,
   none is.  Where only the anchor is shared, the contexts differ somewhere,
   e.g. at the edge of a copied passage; their bytes are fetched.
3. *Suffixes* of the fetched contexts are put into suffix order by deep-shallow
   sorting: a multikey quicksort, eight bytes a key, to a shallow depth of 40
   bytes, then a blind trie for every group that is still tied.  Windows that
   end in one leaf are equal, and repeats of the smallest document there.  A
   seed with more than HOT contexts (the edges of a passage that very many
   documents share) is split: its windows are combined within a task and dealt
   by their own bytes.
4. The marks go back to the texts, which yield the removed runs.

Marks and contexts travel as packed blobs, keyed by a bucket of documents or of
anchors; the number of buckets follows the number of documents.

Defined cases: a null text is empty; texts under 50 bytes lose nothing; rows of
equal doc_id do not count as smaller than one another; a null doc_id is
larger than any other; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions, text_or_empty
from .jaccard_join import by_key
from .shingles import _BASE, _INVERSE, mix, powers

LENGTH = 50             # bytes of a string that counts
SEED = 20               # bytes of an anchor
SIDE = LENGTH - SEED    # bytes a window can reach to either side of its anchor
SHALLOW = 40            # bytes sorted by multikey quicksort before the tries
DOCS_PER_BUCKET = 4000
SLICE = 1 << 22         # bytes hashed at once
FLUSH = 1 << 19         # anchors packed at once
HOT = 1 << 15           # contexts of a seed that are compared in one task; beyond, its windows are dealt by their bytes
LAST = np.int64(2 ** 63 - 1)

ANCHOR = [("seed", "<u8"), ("context", "<u8"), ("doc", "<i8"), ("text", "<u4"), ("at", "<u4")]
MARK = [("doc", "<i8"), ("text", "<u4"), ("at", "<u4"), ("mask", "<u4")]  # bit o: the window that begins o before ``at``
ASK = [("doc", "<i8"), ("text", "<u4"), ("at", "<u4"), ("seed", "<u8"), ("hot", "u1")]
ALL = np.uint32((1 << (SIDE + 1)) - 1)


# --- packing -----------------------------------------------------------------

def pack(columns: dict[str, np.ndarray], kind: list) -> bytes:
    import zstandard

    data = b"".join(np.ascontiguousarray(columns[n], dtype=t).tobytes() for n, t in kind)
    return zstandard.ZstdCompressor(level=1).compress(data)


def unpack(blobs: list[bytes], kind: list) -> dict[str, np.ndarray]:
    import zstandard

    size = sum(np.dtype(t).itemsize for _, t in kind)
    parts: dict[str, list] = {n: [np.zeros(0, dtype=t)] for n, t in kind}
    for blob in blobs:
        data = zstandard.ZstdDecompressor().decompress(blob)
        n, at = len(data) // size, 0
        for name, t in kind:
            parts[name].append(np.frombuffer(data, dtype=t, count=n, offset=at))
            at += n * np.dtype(t).itemsize
    return {n: np.concatenate(p) for n, p in parts.items()}


def blobs_by(key: np.ndarray, columns: dict[str, np.ndarray], kind: list) -> list[tuple[int, bytes]]:
    """(key, packed rows of that key), rows in their given order."""
    order = np.argsort(key, kind="stable")
    keys, first = np.unique(key[order], return_index=True)
    return [(int(k), pack({n: columns[n][part] for n, _ in kind}, kind)) for k, part in zip(keys, np.split(order, first[1:]))]


def doc_bucket(doc: np.ndarray, text: np.ndarray, buckets: int) -> np.ndarray:
    mixed = mix(doc.astype(np.int64).view(np.uint64) ^ (text.astype(np.uint64) << np.uint64(32)))
    return ((mixed >> np.uint64(48)).astype(np.int64) * buckets) >> 16


def seed_bucket(seed: np.ndarray, buckets: int) -> np.ndarray:
    """Mixed again, as anchors have the least hashes of their windows."""
    return ((mix(seed) >> np.uint64(48)).astype(np.int64) * buckets) >> 16


def bucket_count(docs: DataFrame) -> int:
    return min(1 << 16, max(shuffle_partitions(docs.sparkSession), docs.count() // DOCS_PER_BUCKET))


# --- anchors -----------------------------------------------------------------

def anchors(texts: list[bytes]) -> dict[str, np.ndarray]:
    """owner (index of the text), at, seed, context of all anchors of a batch of texts."""
    out = {n: [np.zeros(0, dtype=t)] for n, t in (("owner", np.int64), ("at", np.int64), ("seed", np.uint64), ("context", np.uint64))}
    held, size = [], 0
    for i, text in enumerate(texts):
        if len(text) < LENGTH:
            continue
        for a in range(0, len(text), SLICE):  # a very long text is cut; windows overlap the cuts
            low, high = max(0, a - SIDE), min(len(text), a + SLICE + LENGTH + SIDE)
            held.append((i, text[low:high], low, a - low, min(a + SLICE, len(text)) - low, len(text)))
            size += high - low
            if size >= SLICE:
                _anchors(held, out)
                held, size = [], 0
    if held:
        _anchors(held, out)
    return {n: np.concatenate(p) for n, p in out.items()}


def _anchors(pieces: list[tuple], out: dict[str, list]) -> None:
    """pieces: (text index, bytes, their offset, first and end of the window starts, length of the text)."""
    data = np.frombuffer(b"".join(p[1] for p in pieces), dtype=np.uint8)
    n = len(data)
    if n < LENGTH:
        return
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=sums[1:])
    back = powers(_INVERSE, n)
    seeds = mix((sums[SEED:] - sums[:-SEED]) * back[:n - SEED + 1])
    # least hash, then leftmost place, of the SIDE + 1 seeds of each window
    value = (seeds & ~np.uint64(0xFFFFFF)) | np.arange(len(seeds), dtype=np.uint64)
    width, least = 1, value
    while 2 * width <= SIDE + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = SIDE + 1 - width
    least = np.minimum(least[:len(least) - rest], least[rest:]) if rest else least
    base = np.cumsum([0] + [len(p[1]) for p in pieces])
    place = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    valid = np.zeros(len(place), dtype=bool)
    for (_, text, _, first, end, _), b in zip(pieces, base.tolist()):
        valid[b + first:min(b + end, b + len(text) - LENGTH + 1)] = True
    place = place[valid]
    if not len(place):
        return
    place = place[np.concatenate([[True], place[1:] != place[:-1]])]
    piece = np.searchsorted(base, place, side="right") - 1
    start, end = base[piece], base[piece + 1]
    low, high = np.maximum(place - SIDE, start), np.minimum(place + LENGTH, end)
    shape = ((place - low) * 128 + (high - place)).astype(np.uint64)
    offset = np.array([p[2] for p in pieces])[piece]
    out["owner"].append(np.array([p[0] for p in pieces])[piece])
    out["at"].append(place - start + offset)
    out["seed"].append(seeds[place])
    out["context"].append(mix((sums[high] - sums[low]) * back[low] + mix(shape)))


def text_key(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=4).digest(), "little")


def first_of(keys: tuple, doc: np.ndarray) -> np.ndarray:
    """For rows grouped by the equal ``keys``: the smallest doc of each row's group."""
    order = np.lexsort((doc, *keys[::-1]))
    new = np.zeros(len(order), dtype=bool)
    if len(order):
        new[0] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    least = np.empty(len(order), dtype=doc.dtype)
    heads = np.flatnonzero(new)
    least[order] = doc[order][heads][np.cumsum(new) - 1]
    return least


ROWS = "kind string, bucket long, blob binary"


def _rows(kind: str, blobs: list[tuple[int, bytes]]) -> list[tuple]:
    return [(kind, k, b) for k, b in blobs]


def _batch(rows: list[tuple]):
    import pyarrow as pa

    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], names=["kind", "bucket", "blob"])


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(LAST))).alias("doc"), text_or_empty(text_col).cast("binary").alias("text"))


def _anchor_rows(docs: DataFrame, buckets: int) -> DataFrame:
    """Packed anchors by seed bucket, and marks of those that a smaller document of the same task decides."""
    def run(batches):
        seen: set[tuple] = set()
        held, size = [], 0

        def flush():
            if not held:
                return _batch([])
            a = {n: np.concatenate([h[n] for h in held]) for n, _ in ANCHOR}
            least = first_of((a["seed"], a["context"]), a["doc"])
            later = a["doc"] > least
            marks = {n: a[n][later] for n in ("doc", "text", "at")} | {"mask": np.full(int(later.sum()), ALL)}
            a = {n: v[~later] for n, v in a.items()}
            return _batch(_rows("anchor", blobs_by(seed_bucket(a["seed"], buckets), a, ANCHOR))
                          + _rows("mark", blobs_by(doc_bucket(marks["doc"], marks["text"], buckets), marks, MARK)))

        for batch in batches:
            ids, texts = np.array(batch.column(0).to_pylist(), dtype=np.int64), batch.column(1).to_pylist()
            keys = np.array([text_key(t) for t in texts], dtype=np.uint32)
            fresh = []
            for i, key in enumerate(zip(ids.tolist(), keys.tolist())):
                if key not in seen:
                    seen.add(key)
                    fresh.append(i)
            found = anchors([texts[i] for i in fresh])
            owner = np.array(fresh, dtype=np.int64)[found["owner"]] if fresh else found["owner"]
            held.append({"seed": found["seed"], "context": found["context"], "doc": ids[owner], "text": keys[owner], "at": found["at"].astype(np.uint32)})
            size += len(owner)
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
                seen = set() if len(seen) > 1 << 18 else seen
        yield flush()

    return docs.mapInArrow(run, ROWS)


def _decide(rows: DataFrame, buckets: int) -> DataFrame:
    """Per seed bucket: marks of anchors whose whole context is repeated, and requests for contexts.

    Marks among ``rows`` pass through, so the anchors need not be stored.
    """
    def run(batches):
        def one(key, found):
            if key[1] == "mark":
                return _batch([(r["kind"], r["bucket"], r["blob"]) for r in found])
            a = unpack([r["blob"] for r in found], ANCHOR)
            by_context = first_of((a["seed"], a["context"]), a["doc"])
            later = a["doc"] > by_context
            marks = {n: a[n][later] for n in ("doc", "text", "at")} | {"mask": np.full(int(later.sum()), ALL)}
            rest = {n: v[~later] for n, v in a.items()}
            # a seed with contexts of several documents: fetch them all
            least = first_of((rest["seed"],), rest["doc"])
            most = -first_of((rest["seed"],), -rest["doc"])
            several = least < most
            _, seed, n = np.unique(rest["seed"], return_inverse=True, return_counts=True)
            asks = {n: v[several] for n, v in rest.items()} | {"hot": (n[seed] > HOT)[several].astype(np.uint8)}
            return _batch(_rows("mark", blobs_by(doc_bucket(marks["doc"], marks["text"], buckets), marks, MARK))
                          + _rows("ask", blobs_by(doc_bucket(asks["doc"], asks["text"], buckets), asks, ASK)))

        yield from by_key(batches, ["bucket", "kind"], one)

    return _dealt(rows, "kind").mapInArrow(run, ROWS)


def _dealt(rows: DataFrame, *then: str) -> DataFrame:
    return rows.repartition(shuffle_partitions(rows.sparkSession), "bucket").sortWithinPartitions("bucket", *then)


# --- suffix order ------------------------------------------------------------

def shallow_sort(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group) of the rows of a byte matrix by their first SHALLOW bytes.

    Multikey quicksort with keys of eight bytes: a key is looked at only in
    groups that are tied on all keys before.
    """
    order = np.arange(len(windows))
    group = np.zeros(len(windows), dtype=np.int64)  # by position in ``order``
    for k in range(0, SHALLOW, 8):
        _, first, n = np.unique(group, return_index=True, return_counts=True)
        tied = n[np.searchsorted(first, np.arange(len(order)), side="right") - 1] > 1
        at = np.flatnonzero(tied)
        if not len(at):
            break
        key = np.ascontiguousarray(windows[order[at], k:k + 8]).view(">u8").ravel().astype(np.uint64)
        sub = np.lexsort((key, group[at]))
        order[at], key = order[at][sub], key[sub]
        new = np.ones(len(order), dtype=bool)
        new[1:] = group[1:] != group[:-1]
        inner = np.zeros(len(at), dtype=bool)
        inner[1:] = key[1:] != key[:-1]
        new[at] |= inner
        group = np.cumsum(new) - 1
    return order, group


class BlindTrie:
    """A trie that compares only branching bytes on the way down, and then one whole string.

    An inner node is [place, {byte: child}], a leaf a list of equal strings'
    indexes under its first string.
    """

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.size = len(strings[0])
        self.root: list = [None, [0]]
        for i in range(1, len(strings)):
            self.insert(i)

    def insert(self, i: int) -> None:
        text = self.strings[i]
        node = self.root
        while node[0] is not None:  # blindly: any leaf below shares the longest prefix that there is
            branch = node[1]
            node = branch.get(text[node[0]]) or next(iter(branch.values()))
        other = self.strings[node[1][0]]
        differ = int.from_bytes(text, "big") ^ int.from_bytes(other, "big")
        if not differ:
            node[1].append(i)
            return
        place = self.size - (differ.bit_length() + 7) // 8
        node = self.root
        while node[0] is not None and node[0] < place:
            node = node[1][text[node[0]]]
        if node[0] == place:
            node[1][text[place]] = [None, [i]]
        else:
            node[0], node[1] = place, {other[place]: [node[0], node[1]], text[place]: [None, [i]]}

    def leaves(self) -> list[list[int]]:
        """Indexes of equal strings, in the order of the strings."""
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if node[0] is None:
                out.append(node[1])
            else:
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        return out


def row_hash(windows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of a byte matrix."""
    padded = np.zeros((len(windows), -(-windows.shape[1] // 8) * 8), dtype=np.uint8)
    padded[:, :windows.shape[1]] = windows
    out = np.zeros(len(windows), dtype=np.uint64)
    for column in padded.view("<u8").T:
        out = mix(out * _BASE + column)
    return out


def distinct_rows(windows: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, inverse): the first of each group of equal rows (of equal ``keys``), and the group of each row.

    Groups are found by hashes; rows that differ from their group's first one
    become groups of their own, so a collision only costs work.
    """
    hashes = row_hash(windows)
    for k in keys:
        hashes = mix(hashes ^ mix(k.astype(np.uint64)))
    _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    same = (windows == windows[first[inverse]]).all(axis=1)
    for k in keys:
        same &= k == k[first[inverse]]
    odd = np.flatnonzero(~same)
    inverse[odd] = len(first) + np.arange(len(odd))
    return np.concatenate([first, odd]), inverse


def suffix_order(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, class) of the rows of a byte matrix by deep-shallow sorting; equal rows share a class.

    Equal rows are sorted once: however often a window occurs, it is one key in
    the quicksort and one leaf in a trie.
    """
    first, inverse = distinct_rows(windows)
    order, same = _order_distinct(windows[first])
    rank = np.empty(len(first), dtype=np.int64)
    rank[order] = same
    rank = rank[inverse]
    order = np.argsort(rank, kind="stable")
    return order, rank[order]


def _order_distinct(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order, group = shallow_sort(windows)
    _, first, n = np.unique(group, return_index=True, return_counts=True)
    classes = np.zeros(len(order), dtype=np.int64)  # by position: a new class begins here
    classes[first] = 1
    for a, size in zip(first[n > 1].tolist(), n[n > 1].tolist()):
        rest = np.ascontiguousarray(windows[order[a:a + size], SHALLOW:])
        leaves = BlindTrie([r.tobytes() for r in rest]).leaves()
        order[a:a + size] = order[a:a + size][[i for leaf in leaves for i in leaf]]
        at = a
        for leaf in leaves:
            classes[at] = 1
            at += len(leaf)
    return order, np.cumsum(classes) - 1


CONTEXT = [("seed", "<u8"), ("doc", "<i8"), ("text", "<u4"), ("at", "<u4"), ("left", "u1"), ("size", "u1"), *[(f"b{i}", "u1") for i in range(SIDE + LENGTH)]]


def _context_windows(raw: np.ndarray, left: np.ndarray, size: np.ndarray):
    """(owner, place of the window's first byte, bytes from there to the anchor, window) of all windows of contexts, in parts."""
    for low in range(0, len(raw), FLUSH >> 5):
        part = slice(low, low + (FLUSH >> 5))
        n = size[part].astype(np.int64) - LENGTH + 1
        owner = np.repeat(np.arange(len(n)), n)
        begin = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        yield owner + low, begin, left[part].astype(np.int64)[owner] - begin, raw[part][owner[:, None], begin[:, None] + np.arange(LENGTH)]


def _hot_windows(c: dict, raw: np.ndarray, buckets: int) -> list[tuple]:
    """Windows of contexts of hot seeds, as contexts of their own, dealt by their bytes.

    A task sends a window once, with the smallest document that has it; its places in
    other documents are marked here.
    """
    out = []
    for owner, _, before, windows in _context_windows(raw, c["left"], c["size"]):
        doc, seed = c["doc"][owner], c["seed"][owner]
        _, same = distinct_rows(windows, seed, before)
        least = np.full(int(same.max()) + 1, LAST, dtype=np.int64)
        np.minimum.at(least, same, doc)
        later = doc > least[same]
        at = np.flatnonzero(later)
        marks = {"doc": doc[at], "text": c["text"][owner[at]], "at": c["at"][owner[at]], "mask": np.uint32(1) << before[at].astype(np.uint32)}
        out += _rows("mark", blobs_by(doc_bucket(marks["doc"], marks["text"], buckets), marks, MARK))
        at = np.flatnonzero(~later)
        columns = {n: c[n][owner[at]] for n in ("seed", "doc", "text", "at")}
        columns |= {"left": before[at], "size": np.full(len(at), LENGTH)}
        columns |= {f"b{i}": windows[at, i] if i < LENGTH else np.zeros(len(at), dtype=np.uint8) for i in range(SIDE + LENGTH)}
        out += _rows("context", blobs_by(seed_bucket(mix(columns["seed"]) ^ row_hash(windows[at]), buckets), columns, CONTEXT))
    return out


def _contexts(rows: DataFrame, docs: DataFrame, buckets: int) -> DataFrame:
    """Packed contexts, by seed bucket, of the requested anchors; those of hot seeds window by window."""
    def run(batches):
        wanted: dict = {}
        held: list = []
        now = None

        def flush():
            columns = {n: np.array([h[k] for h in held], dtype=t) for k, (n, t) in enumerate(CONTEXT[:6])}
            raw = np.frombuffer(b"".join([h[6] for h in held]), dtype=np.uint8).reshape(len(held), SIDE + LENGTH)
            hot = np.array([h[7] for h in held], dtype=bool)
            out = _hot_windows({n: v[hot] for n, v in columns.items()}, raw[hot], buckets) if hot.any() else []
            columns = {n: v[~hot] for n, v in columns.items()} | {f"b{i}": raw[~hot, i] for i in range(SIDE + LENGTH)}
            return _batch(out + _rows("context", blobs_by(seed_bucket(columns["seed"], buckets), columns, CONTEXT)))

        for batch in batches:
            for kind, bucket, blob, doc, text in zip(*[batch.column(n).to_pylist() for n in ("kind", "bucket", "blob", "doc", "text")]):
                if bucket != now:
                    now, wanted = bucket, {}
                if kind == "ask":
                    a = unpack([blob], ASK)
                    for key, at, seed, hot in zip(zip(a["doc"].tolist(), a["text"].tolist()), a["at"].tolist(), a["seed"].tolist(), a["hot"].tolist()):
                        wanted.setdefault(key, []).append((at, seed, hot))
                    continue
                key = (doc, text_key(text))
                for at, seed, hot in wanted.pop(key, ()):
                    low, high = max(0, at - SIDE), min(len(text), at + LENGTH)
                    held.append((seed, doc, key[1], at, at - low, high - low, text[low:high].ljust(SIDE + LENGTH, b"\0"), hot))
            if len(held) >= FLUSH // 4:
                yield flush()
                held = []
        if held:
            yield flush()

    return _with_texts(rows.filter("kind = 'ask'"), docs, buckets).mapInArrow(run, ROWS)


def _with_texts(rows: DataFrame, docs: DataFrame, buckets: int) -> DataFrame:
    """Packed rows and whole texts of each document bucket together, the packed rows first."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids = np.array(batch.column(0).to_pylist(), dtype=np.int64)
            keys = np.array([text_key(t) for t in batch.column(1).to_pylist()], dtype=np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array(doc_bucket(ids, keys, buckets), pa.int64()), batch.column(0), batch.column(1)], names=["bucket", "doc", "text"])

    texts = docs.mapInArrow(run, "bucket long, doc long, text binary").selectExpr("'text' as kind", "bucket", "cast(null as binary) as blob", "doc", "text")
    both = rows.selectExpr("kind", "bucket", "blob", "cast(null as long) as doc", "cast(null as binary) as text").unionByName(texts)
    return _dealt(both.withColumn("late", F.col("kind") == "text"), "late").drop("late")


def _compare(rows: DataFrame, buckets: int) -> DataFrame:
    """Marks of the windows of contexts that a smaller document has, per seed bucket; given marks pass through."""
    def run(batches):
        def one(key, found):
            if key[1] == "mark":
                return _batch([(r["kind"], r["bucket"], r["blob"]) for r in found])
            c = unpack([r["blob"] for r in found], CONTEXT)
            raw = np.stack([c[f"b{i}"] for i in range(SIDE + LENGTH)], axis=1)
            n = c["size"].astype(np.int64) - LENGTH + 1  # windows of each context
            owner = np.repeat(np.arange(len(n)), n)
            begin = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            mask = np.zeros(len(n), dtype=np.uint32)
            # windows of different seeds, or of different places before the seed, are never equal through it
            before = c["left"].astype(np.int64)[owner] - begin
            for a in range(SIDE + 1):
                at = np.flatnonzero(before == a)
                if not len(at):
                    continue
                windows = raw[owner[at][:, None], begin[at][:, None] + np.arange(LENGTH)]
                order, same = suffix_order(windows)
                docs = c["doc"][owner[at]]
                least = first_of((same,), docs[order])
                later = order[docs[order] > least]
                np.bitwise_or.at(mask, owner[at][later], np.uint32(1 << a))
            hit = mask > 0
            marks = {"doc": c["doc"][hit], "text": c["text"][hit], "at": c["at"][hit], "mask": mask[hit]}
            return _batch(_rows("mark", blobs_by(doc_bucket(marks["doc"], marks["text"], buckets), marks, MARK)))

        yield from by_key(batches, ["bucket", "kind"], one)

    return _dealt(rows, "kind").mapInArrow(run, ROWS)


# --- result ------------------------------------------------------------------

def removed_bytes(size: int, at: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Whether each byte lies in a marked window."""
    cover = np.zeros(size + LENGTH + 1, dtype=np.int64)
    for o in range(SIDE + 1):
        p = at[(mask >> np.uint32(o)) & np.uint32(1) > 0].astype(np.int64) - o
        p = p[(p >= 0) & (p + LENGTH <= size)]
        np.add.at(cover, p, 1)
        np.add.at(cover, p + LENGTH, -1)
    return np.cumsum(cover)[:size] > 0


def _apply(rows: DataFrame, docs: DataFrame, buckets: int, output, schema: str) -> DataFrame:
    """``output(doc, text, removed)`` rows of every document."""
    def run(batches):
        import pyarrow as pa

        names = [c.split()[0] for c in schema.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string()}
        fields = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])
        now, blobs, marks = None, [], None
        for batch in batches:
            out = []
            for kind, bucket, blob, doc, text in zip(*[batch.column(n).to_pylist() for n in ("kind", "bucket", "blob", "doc", "text")]):
                if bucket != now:
                    now, blobs, marks = bucket, [], None
                if kind == "mark":
                    blobs.append(blob)
                    continue
                if marks is None:
                    m = unpack(blobs, MARK)
                    order = np.lexsort((m["text"], m["doc"]))
                    m = {n: v[order] for n, v in m.items()}
                    new = np.flatnonzero(np.concatenate([[True], (m["doc"][1:] != m["doc"][:-1]) | (m["text"][1:] != m["text"][:-1])])) if len(order) else np.zeros(0, dtype=np.int64)
                    ends = np.append(new[1:], len(order))
                    marks = {(int(m["doc"][a]), int(m["text"][a])): (a, b) for a, b in zip(new.tolist(), ends.tolist())}
                a, b = marks.get((doc, text_key(text)), (0, 0))
                out.append(output(None if doc == LAST else doc, text, removed_bytes(len(text), m["at"][a:b], m["mask"][a:b]) if b else np.zeros(len(text), dtype=bool)))
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=fields)

    return _with_texts(rows.filter("kind = 'mark'"), docs, buckets).mapInArrow(run, schema)


def _summary(doc, text: bytes, removed: np.ndarray) -> tuple:
    runs = int(removed[:1].sum() + (removed[1:] & ~removed[:-1]).sum())
    kept = text if not runs else np.frombuffer(text, dtype=np.uint8)[~removed].tobytes()
    return doc, len(text), int(removed.sum()), runs, hashlib.sha256(kept).hexdigest()


def _kept_text(doc, text: bytes, removed: np.ndarray) -> tuple:
    kept = text if not removed.any() else np.frombuffer(text, dtype=np.uint8)[~removed].tobytes()
    return doc, int(removed.sum()), kept.decode("utf-8", "replace")


def _marks(docs: DataFrame, buckets: int) -> DataFrame:
    decided = materialize(_decide(_anchor_rows(docs, buckets), buckets), "anchor-decisions")
    edges = _compare(_contexts(decided, docs, buckets), buckets)
    return decided.filter("kind = 'mark'").unionByName(edges)


def removal_summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    rows, buckets = _documents(docs, id_col, text_col), bucket_count(docs)
    return _apply(_marks(rows, buckets), rows, buckets, _summary, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_removed, text: the bytes kept of every row (cut characters become U+FFFD)."""
    rows, buckets = _documents(docs, id_col, text_col), bucket_count(docs)
    return _apply(_marks(rows, buckets), rows, buckets, _kept_text, "doc_id long, n_removed long, text string")
