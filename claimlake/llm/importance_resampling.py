"""Target-distribution importance resampling.

Documents that look like a target set (here: the benchmark) are drawn without
replacement: each document's weight is the mean log-likelihood ratio of its
hashed word features under the target's and under the corpus's feature counts,
plus Gumbel noise from its id, and the highest scores win.

1. *Array-scored weights.*  A task splits its texts into words with numpy,
   codes them by an Arrow dictionary and gets each feature's crc32 from two
   words' crc32 by lookup tables (crc32 is linear, so that of ``a b`` is that of
   ``a `` moved on by the length of ``b``).  Feature counts of a task are one
   array of BUCKETS numbers; Spark sums them by bucket; the driver turns the
   BUCKETS sums into the array of gains.  A second scan adds gains up.
2. *Weighted median-of-medians selection.*  To find the key (score, then
   doc_id) of the last document drawn, every task reports the median of its
   remaining keys.  The median of these medians, weighted by the numbers of
   remaining keys, has at least a quarter of all remaining keys on either side;
   counting around it discards one side.  That repeats until it is the exact
   cutoff key.  Remaining keys are written again whenever they have shrunk to a
   quarter, so all rounds read a bounded multiple of the keys.  The driver
   gets one row per task and round.
3. *Winners are sorted* by range partitions, and numbered by prefix sums.

Defined cases: a null text has no words; a text without words has weight 0; a
null doc_id is hashed as ``null`` and comes after all others in ties; rows of
equal score and doc_id are ordered by n_features, and of fully equal rows any
may be drawn; an empty target has T = 0; an empty table gives an empty table;
texts of any length are scored whole (a text longer than a slice is a slice of
its own); other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.common import number_rows
from .common import materialize, text_or_empty
from .word_arrays import byte_set, byte_slices, coded, split_words

BUCKETS = 10_000
LAST = 2 ** 63 - 1
FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
# words are runs of digits, letters a-z and everything beyond ASCII
LETTER = byte_set(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)
SHIFTS = 64             # lengths with a table of their own
SHRINK = 4              # remaining keys are written again at this fraction


# --- features ----------------------------------------------------------------

def _crc_table() -> np.ndarray:
    """What crc32's register becomes by one zero byte, for each low byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> 1), table >> 1).astype(np.uint32)
    return table


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


class CrcShift:
    """crc32 values moved on by a number of bytes: crc32(a + b) = shift(crc32(a), len(b)) ^ crc32(b)."""

    def __init__(self):
        step = _crc_table()
        basis = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
        tables = [basis]
        for _ in range(SHIFTS):
            tables.append(step[tables[-1] & 255] ^ (tables[-1] >> np.uint32(8)))
        self.tables = np.stack(tables)          # [length, byte, value]
        self.doubled = [self.tables[SHIFTS]]    # 64, 128, 256, ... bytes

    def __call__(self, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
        rest = length % SHIFTS
        out = np.zeros(len(crc), dtype=np.uint32)
        for k in range(4):
            out ^= self.tables[rest, k, (crc >> np.uint32(8 * k)) & 255]
        whole = length // SHIFTS
        bit = 0
        while len(at := np.flatnonzero(whole >> bit)):
            if bit == len(self.doubled):
                last = self.doubled[-1]
                self.doubled.append(_apply(last, last.ravel()).reshape(4, 256))
            at = at[(whole[at] >> bit) & 1 == 1]
            out[at] = _apply(self.doubled[bit], out[at])
            bit += 1
        return out


_SHIFT: list[CrcShift] = []


def feature_buckets(column, shift: CrcShift) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(counts, words, pairs, joined) of an Arrow array of texts.

    counts: words per row; words: bucket of each word; pairs: bucket of each
    word with the next one; joined: whether these two are in one row.
    """
    words, counts = split_words(column, LETTER, FOLD)
    codes, distinct = coded(words)
    plain = np.array([zlib.crc32(w) for w in distinct], dtype=np.uint32)
    spaced = np.array([zlib.crc32(b" ", c) for c in plain.tolist()], dtype=np.uint32)
    size = np.array([len(w) for w in distinct], dtype=np.int64)
    joined = np.ones(max(len(codes) - 1, 0), dtype=bool)
    edges = np.cumsum(counts)[:-1]
    edges = edges[(edges > 0) & (edges < len(codes))]
    joined[edges - 1] = False
    if not len(codes):
        return counts, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), joined
    pairs = shift(spaced[codes[:-1]], size[codes[1:]]) ^ plain[codes[1:]]
    return counts, (plain % BUCKETS)[codes].astype(np.int64), (pairs % BUCKETS).astype(np.int64), joined


def _scan(batches):
    """Per slice of texts: its batch, row range and feature buckets."""
    if not _SHIFT:
        _SHIFT.append(CrcShift())
    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        for first, end in byte_slices(column):
            yield batch, first, end, feature_buckets(column.slice(first, end - first), _SHIFT[0])


def bucket_counts(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket; BUCKETS numbers reach the driver."""
    def run(batches):
        import pyarrow as pa

        total = np.zeros(BUCKETS, dtype=np.int64)
        for _, _, _, (_, words, pairs, joined) in _scan(batches):
            total += np.bincount(words, minlength=BUCKETS) + np.bincount(pairs[joined], minlength=BUCKETS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])

    out = np.zeros(BUCKETS, dtype=np.int64)
    counts = texts.select(text_or_empty(text_col).alias("text")).mapInArrow(run, "bucket long, n long")
    for r in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1) (S + BUCKETS) / ((s + 1) (T + BUCKETS)))) of each bucket."""
    big_s, big_t = int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((float(t + 1) * float(big_s + BUCKETS)) / (float(s + 1) * float(big_t + BUCKETS))))
                     for s, t in zip(corpus.tolist(), target.tolist())], dtype=np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    key = f"{seed}:{'null' if doc_id is None else doc_id}".encode()
    h = int(hashlib.sha256(key).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score_documents(docs: DataFrame, gain: np.ndarray, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row."""
    def run(batches):
        import pyarrow as pa

        for batch, first, end, (counts, words, pairs, joined) in _scan(batches):
            ids = batch.column(0).slice(first, end - first).to_pylist()
            sums = np.zeros(len(words) + 1, dtype=np.int64)
            np.cumsum(gain[words], out=sums[1:])
            both = np.zeros(len(words) + 1, dtype=np.int64)
            if len(words):
                np.cumsum(np.append(np.where(joined, gain[pairs], 0), 0), out=both[1:])
            ends = np.cumsum(counts)
            starts = ends - counts
            features = counts + np.maximum(counts - 1, 0)
            weight = (sums[ends] - sums[starts] + both[ends] - both[starts]) // np.maximum(features, 1)
            score = weight + np.array([noise(d, seed) for d in ids], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts), pa.array(features), pa.array(weight), pa.array(score)],
                                             names=["doc_id", "n_words", "n_features", "weight", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


# --- selection ---------------------------------------------------------------

def median_key(low: np.ndarray, ids: np.ndarray) -> tuple[int, int]:
    """The lower median of keys (low, id), in linear time."""
    at = (len(low) - 1) // 2
    value = np.partition(low, at)[at]
    tied = np.sort(ids[low == value])
    return int(value), int(tied[at - int((low < value).sum())])


def _round(keys: DataFrame, above: tuple | None, below: tuple | None, pivot: tuple | None) -> list:
    """Per task: the keys between the bounds on either side of the pivot, counted and with their medians."""
    def run(batches):
        import pyarrow as pa

        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        low = np.concatenate([h[0] for h in held]) if held else np.zeros(0, dtype=np.int64)
        ids = np.concatenate([h[1] for h in held]) if held else np.zeros(0, dtype=np.int64)

        def before(key):
            return (low < key[0]) | ((low == key[0]) & (ids < key[1]))

        def equal(key):
            return (low == key[0]) & (ids == key[1])

        open_ = np.ones(len(low), dtype=bool)
        if above is not None:
            open_ &= ~before(above) & ~equal(above)
        if below is not None:
            open_ &= before(below)
        left = open_ & before(pivot) if pivot is not None else np.zeros(len(low), dtype=bool)
        same = open_ & equal(pivot) if pivot is not None else left
        right = open_ & ~left & ~same
        row = {"n_left": int(left.sum()), "n_same": int(same.sum()), "n_right": int(right.sum())}
        for side, mask in (("left", left), ("right", right)):
            row[f"{side}_low"], row[f"{side}_id"] = median_key(low[mask], ids[mask]) if mask.any() else (0, 0)
        fields = ["n_left", "n_same", "n_right", "left_low", "left_id", "right_low", "right_id"]
        yield pa.RecordBatch.from_pylist([row] if row["n_left"] + row["n_same"] + row["n_right"] else [], schema=pa.schema([(f, pa.int64()) for f in fields]))

    return keys.mapInArrow(run, "n_left long, n_same long, n_right long, left_low long, left_id long, right_low long, right_id long").collect()


def _weighted_median(rows: list, side: str) -> tuple[int, int] | None:
    """The first of the sorted medians up to which half of the remaining keys are."""
    found = sorted((r[f"{side}_low"], r[f"{side}_id"], r[f"n_{side}"]) for r in rows if r[f"n_{side}"])
    half, seen = sum(f[2] for f in found) / 2, 0
    for low, key, n in found:
        seen += n
        if seen >= half:
            return low, key
    return None


def cutoff(keys: DataFrame, k: int) -> tuple[int, int] | None:
    """The ``k``-th least key of the columns (low, id), counted from 1; None if there is none."""
    if k < 1:
        return None
    above = below = None
    passed = 0              # keys known to come before all remaining ones
    rows = _round(keys, None, None, None)
    pivot, stored = _weighted_median(rows, "right"), sum(r.n_right for r in rows)
    while pivot is not None:
        rows = _round(keys, above, below, pivot)
        left, same, right = (sum(r[n] for r in rows) for n in ("n_left", "n_same", "n_right"))
        if passed + left >= k:
            below, pivot, rest = pivot, _weighted_median(rows, "left"), left
        elif passed + left + same >= k:
            return pivot
        else:
            passed += left + same
            above, pivot, rest = pivot, _weighted_median(rows, "right"), right
        if rest * SHRINK <= stored:
            between = F.lit(True)
            if above is not None:
                between &= (F.col("low") > above[0]) | ((F.col("low") == above[0]) & (F.col("id") > above[1]))
            if below is not None:
                between &= (F.col("low") < below[0]) | ((F.col("low") == below[0]) & (F.col("id") < below[1]))
            keys, stored = materialize(keys.filter(between), "remaining-keys"), rest
    return None


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7,
             id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs``; rank is null for rows not drawn."""
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_col))
    scored = materialize(score_documents(docs, gain, seed, id_col, text_col)
                         .withColumn("low", -F.col("score")).withColumn("id", F.coalesce("doc_id", F.lit(LAST))), "resampling-scores")
    eligible = F.col("n_words") >= least_words
    drawn = scored.filter(eligible).count() * percent // 100
    last = cutoff(scored.filter(eligible).select("low", "id"), drawn)
    wins = F.lit(False)
    if last is not None:
        wins = eligible & ((F.col("low") < last[0]) | ((F.col("low") == last[0]) & (F.col("id") <= last[1])))
    columns = ["doc_id", "n_features", "weight", "score"]
    ranked = number_rows(scored.filter(wins), ["low", "id", "n_features"], out="rank")
    winners = ranked.select(*columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return winners.unionByName(scored.filter(~wins).select(*columns, F.lit(None).cast("long").alias("rank")))
