"""Byte-level BPE encoding and decoding.

A text is split by the public pattern; each piece is merged on its UTF-8 bytes.
A segment tree over the piece's byte positions stores, at each node, the
smallest (pair rank, position) below it, so its root is the leftmost pair of
least rank.  A merge joins two live neighbours of a linked list and makes three
point updates, each logarithmic in the piece's length: pieces of any length
take O(n log n).  The trees of all new pieces of a batch are rows of one numpy
array and make each step together.

Only pieces that a worker has not met lately are merged; a bounded
two-generation cache keeps the others.  The work is one map over the rows,
without a shuffle.

Defined cases: a null text is empty (no ids, digests of the empty string); rows
and repeated rows are each encoded; an empty table gives an empty table; other
columns are kept by :func:`encode` and :func:`decode`, and a column named like
an output is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Generations, text_or_empty

CACHE_PIECES = 200_000
# Unicode White_Space, as the public pattern's \\s is read (fixed value)
WHITE_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BLANK_RUN = re.compile(r" (?:\s|\Z)").search
NONE = np.int64(1) << 62
GROUP_CELLS = 1 << 21


class PairRanks:
    """Rank of the token that two adjacent tokens join to, for arrays of pairs.

    The rank of a pair is that of its joined bytes, so every split of a token
    into two tokens is a pair.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.base = max(ranks.values()) + 2
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a * self.base + b] = rank
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        self.bits = 22
        self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
        self._fill()

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def _fill(self) -> None:
        """Open addressing with linear probing; ``self.probes`` bounds every chain."""
        left = np.arange(len(self.keys))
        at = self._slot(self.keys)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], at[lost] + 1 & (1 << self.bits) - 1

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks, -1 where the two don't join (or one is -1)."""
        keys = np.where((a < 0) | (b < 0), np.int64(-1), a * self.base + b)
        out = np.full(len(keys), -1, dtype=np.int64)
        at = self._slot(keys)
        ask = np.arange(len(keys))
        while len(ask):
            found = self.slots[at]
            used = found >= 0
            ask, at, found = ask[used], at[used], found[used]
            same = self.keys[found] == keys[ask]
            out[ask[same]] = self.ranks[found[same]]
            ask, at = ask[~same], at[~same] + 1 & (1 << self.bits) - 1
        return out


def merge_pieces(pieces: list[bytes], byte_ids: np.ndarray, pair_ranks: PairRanks) -> list[np.ndarray]:
    """Ids of each piece of two bytes or more, merged in groups of like length."""
    out: list = [None] * len(pieces)
    lengths = np.array([len(p) for p in pieces], dtype=np.int64)
    bits = np.array([(n - 1).bit_length() for n in lengths.tolist()], dtype=np.int64)
    for k in np.unique(bits).tolist():
        members = np.flatnonzero(bits == k)
        step = max(1, GROUP_CELLS >> k)
        for i in range(0, len(members), step):
            group = members[i:i + step]
            found = _merge_group([pieces[g] for g in group], lengths[group], 1 << k, byte_ids, pair_ranks)
            for g, ids in zip(group.tolist(), found):
                out[g] = ids
    return out


def _merge_group(pieces: list[bytes], n: np.ndarray, size: int, byte_ids: np.ndarray, pair_ranks: PairRanks) -> list[np.ndarray]:
    """Merge pieces of at most ``size`` bytes together, one segment tree (row) each.

    Node 1 of a row is its root, nodes 2v and 2v+1 the children of v, node
    size + p the leaf of byte position p.  A leaf holds rank * size + p of the
    pair that begins at p, NONE if there is none; an inner node the smaller of
    its children: at equal ranks the leftmost pair.  Position ``size`` of the
    linked list stands for both ends and has no id.
    """
    rows = len(pieces)
    width = size + 1
    at = np.arange(size)
    inside = at < n[:, None]
    ids = np.full((rows, width), -1, dtype=np.int64)
    ids[:, :size][inside] = byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
    after = np.tile(np.arange(1, width + 1), (rows, 1))
    after[:, size] = size
    after[np.arange(rows), n - 1] = size
    before = np.tile(np.arange(-1, size), (rows, 1))
    before[:, 0] = size
    live = inside.copy()
    tree = np.full((rows, 2 * size), NONE, dtype=np.int64)
    ranks = pair_ranks(ids[:, :size].ravel(), np.where(at + 1 < n[:, None], ids[:, 1:], -1).ravel()).reshape(rows, size)
    tree[:, size:] = np.where(ranks >= 0, ranks * size + at, NONE)
    half = size >> 1
    while half:
        tree[:, half:2 * half] = np.minimum(tree[:, 2 * half:4 * half:2], tree[:, 2 * half + 1:4 * half:2])
        half >>= 1
    tree, ids, after, before, live = tree.ravel(), ids.ravel(), after.ravel(), before.ravel(), live.ravel()
    row = np.arange(rows)
    while True:
        least = tree[row * (2 * size) + 1]
        going = least < NONE
        row, least = row[going], least[going]
        if not len(row):
            break
        cells, links = row * (2 * size), row * width
        i, new = least % size, least // size
        j = after[links + i]
        k = after[links + j]
        ids[links + i] = new
        after[links + i] = k
        before[links + k] = i
        live[row * size + j] = False
        h = before[links + i]
        right = pair_ranks(new, ids[links + k])
        left = pair_ranks(ids[links + h], new)
        tree[cells + size + j] = NONE
        tree[cells + size + i] = np.where(right >= 0, right * size + i, NONE)
        held = h < size
        tree[cells[held] + size + h[held]] = np.where(left >= 0, left * size + h, NONE)[held]
        for first, position in ((cells, i), (cells, j), (cells[held], h[held])):
            node = position + size >> 1
            while len(node) and node[0]:
                tree[first + node] = np.minimum(tree[first + 2 * node], tree[first + 2 * node + 1])
                node = node >> 1
    live = live.reshape(rows, size)
    ends = np.cumsum(live.sum(axis=1))
    return np.split(ids.reshape(rows, width)[:, :size][live], ends[:-1])


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, rank_path: str, pattern: str):
        import regex

        with open(rank_path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        spelled = pattern.replace(r"[^\s", f"[^{WHITE_SPACE}").replace(r"\S", f"[^{WHITE_SPACE}]").replace(r"\s", f"[{WHITE_SPACE}]")
        self.split = regex.compile(spelled).findall
        self.pair_ranks = PairRanks(self.ranks)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        table = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            table[rank] = token
        self.lengths = np.array([len(t) for t in table], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(table), dtype=np.uint8)
        self.decimal = [str(i) for i in range(len(table))]
        self.pieces = Generations(CACHE_PIECES)  # piece -> (ids as bytes, ids in decimal)
        self.units = Generations(CACHE_PIECES)   # unit -> the same

    def _pieces(self, unit) -> list[str]:
        if isinstance(unit, tuple):
            return self.split(unit[0])
        if unit.isascii() and unit.isalpha():
            return [" " + unit]  # one blank and letters: one piece by the pattern
        return self.split(" " + unit)

    def _learn(self, units: set) -> None:
        """Fill the caches for all of ``units``."""
        new = {unit: self._pieces(unit) for unit in self.units.missing(units)}
        pieces, longer = self.pieces, []
        decimal = self.decimal
        for piece in pieces.missing({p for found in new.values() for p in found}):
            code = piece.encode("utf-8")
            whole = self.ranks.get(code)
            if whole is None:
                longer.append((piece, code))
            else:
                pieces.now[piece] = (whole.to_bytes(4, "little"), decimal[whole])
        merged = merge_pieces([code for _, code in longer], self.byte_ids, self.pair_ranks)
        for (piece, _), ids in zip(longer, merged):
            ids = ids.tolist()
            pieces.now[piece] = (array("I", ids).tobytes(), " ".join([decimal[i] for i in ids]))
        known = pieces.now
        for unit, found in new.items():
            if len(found) == 1:
                self.units.now[unit] = known[found[0]]
            else:
                parts = [known[p] for p in found]
                self.units.now[unit] = (b"".join([p[0] for p in parts]), " ".join([p[1] for p in parts]))

    @staticmethod
    def _units(text: str) -> list:
        """``text`` cut before each blank that a non-blank follows.

        A piece can begin, but not go on, with such a blank, so the units are
        split into pieces independently.  The first unit is a 1-tuple, any other
        a string without its leading blank.
        """
        words = text.split(" ")
        if BLANK_RUN(text):
            units = words[:1]
            for word in words[1:]:
                if word and not word[0].isspace():
                    units.append(word)
                else:
                    units[-1] += " " + word
            words = units
        words[0] = (words[0],)
        return words

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, str]]:
        """For each text its ids, and the same in decimal, joined by blanks."""
        split = [self._units(text) for text in texts]
        self._learn(set().union(*split))
        known, out = self.units.now, []
        for units in split:
            codes, decimals = zip(*[known[u] for u in units])
            decimal = " ".join(decimals if decimals[0] else decimals[1:])  # only a first unit can be empty
            out.append((np.frombuffer(b"".join(codes), dtype="<u4"), decimal))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids, gathered from one table of all tokens' bytes."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        shift = np.repeat(self.starts[ids] - (ends - lengths), lengths)
        return self.bytes[shift + np.arange(total)].tobytes()


_CODERS: dict[tuple[str, str], ByteBpe] = {}


def coder(rank_path: str, pattern: str) -> ByteBpe:
    """One coder, with its cache, per Python worker."""
    key = (rank_path, pattern)
    if key not in _CODERS:
        _CODERS[key] = ByteBpe(rank_path, pattern)
    return _CODERS[key]


def _with(docs: DataFrame, column: T.StructField, fn, source) -> DataFrame:
    """``docs`` with ``column`` = fn(values of ``source``) per batch, replacing a column of that name."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    kept = [c for c in docs.columns if c.lower() != column.name.lower()]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], source.alias("__source"))
    kind = to_arrow_type(column.dataType)

    def run(batches):
        for batch in batches:
            out = pa.array(fn(batch.column(batch.num_columns - 1).to_pylist()), kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], out], names=[*kept, column.name])

    schema = T.StructType([*[rows.schema[i] for i in range(len(kept))], column])
    return rows.mapInArrow(run, schema)


def encode(docs: DataFrame, rank_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text as array<int>."""
    def fn(texts):
        bpe = coder(rank_path, pattern)
        return [ids.astype(np.int32) for ids, _ in bpe.encode(texts)]

    return _with(docs, T.StructField(ids_col, T.ArrayType(T.IntegerType())), fn, text_or_empty(text_col))


def decode(rows: DataFrame, rank_path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``rows`` with the bytes that each array of ids stands for (null or empty: no bytes)."""
    def fn(values):
        bpe = coder(rank_path, pattern)
        return [bpe.decode(np.array(v or [], dtype=np.int64)) for v in values]

    return _with(rows, T.StructField(bytes_col, T.BinaryType()), fn, F.col(ids_col))


def round_trip_digests(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode every text, keep digests only."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        import pyarrow as pa

        bpe = coder(rank_path, pattern)
        for batch in batches:
            counts, first, second = [], [], []
            for ids, decimal in bpe.encode(batch.column(1).to_pylist()):
                counts.append(len(ids))
                first.append(hashlib.sha256(decimal.encode("ascii")).hexdigest())
                second.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, schema)
