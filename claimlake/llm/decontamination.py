"""Benchmark decontamination: a BM25 inverted index of test items, block-max WAND.

Items become the documents of a BM25 index; every passage of every training
text is a query.  An item's impacts are divided by the score it gives itself,
so one threshold holds for all: retrieve every item of which a passage has at
least ``THRESHOLD`` of the score.  Items are ordered by their own score, so that
like ones are neighbours; postings are in item order, cut into blocks with
their largest impact.  WAND moves a pivot over them and skips blocks whose
bounds cannot reach the threshold.  The test against block maxima is first made
for many passages at once, in stretches of bounded size: an item block's bound is the sum of the
maxima of the passage's rare terms and the most that common terms (in more than
``COMMON`` of the items) give any of its items; where that most alone reaches the
threshold (templated items) the block's common terms are counted like rare ones.  Retrieved items are
verified: their question (all sentences but the last) and answer (the last)
must each overlap the passage's word trigrams by ``OVERLAP``.

A passage is a window of twice the words of the longest item, every window
beginning at half of the former, so an item of any place lies whole in one.
Whole texts are read; the corpus is never shuffled.  The items are taken in
shards of ``SHARD_ITEMS`` on average (by hash), each collected, indexed and
broadcast.  What BM25 and the passages take from the items as a whole (their
number, words, longest one and each term's holders) is counted over all items
by Spark and given to every shard, so shards change no result.  Repeated item
rows are counted before that and are one entry of a shard.

Very long texts are matched whole, in memory of about their own size.  Of passages of one
text that match an item equally well the first is reported.

Defined cases: null and empty texts hold no passage and match nothing; items
without words are left out, equal items are each reported; a repeated row gives
the same rows again; a null doc_id stays null; with no items the result is
empty; other columns are ignored by :func:`matches` and kept by :func:`clean`.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import repeat
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

THRESHOLD = 0.5
OVERLAP = 0.5
GRAM = 3
BLOCK_ITEMS = 4
COMMON = 0.05
SHARD_ITEMS = 20_000
FLUSH_TERMS = 1 << 18
EXPANDED = 1 << 21      # entries of term lists expanded at once by the block test
GROUP_CHARS = 1 << 19   # text matched at once; a longer text is matched by itself
K1, B = 1.2, 0.75

_FOLD = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Words: runs of letters and digits (Unicode's), case-folded, as UTF-8."""
    text = text.casefold()
    if not text.isascii():
        for c in set(text):
            if c > "\x7f" and not c.isalnum():
                text = text.replace(c, " ")
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def grams(words: list) -> set:
    n = min(GRAM, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if n else set()


def question_and_answer(text: str) -> tuple[list, list]:
    """Words of all sentences but the last, and of the last (empty if there is one only)."""
    sentences = [w for w in map(words_of, re.split(r"(?<=[.!?])\s+", text)) if w]
    if len(sentences) < 2:
        return (sentences or [[]])[0], []
    return [w for s in sentences[:-1] for w in s], sentences[-1]


class Totals(NamedTuple):
    """Figures over all items with words, a repeated row counted each time."""

    items: int
    words: int
    longest: int
    holders: dict[bytes, int]  # items of each term (in a shard: of the shard's terms)

    @classmethod
    def of(cls, items: list[tuple[int, str, int]]) -> Totals:
        """Of (id, text, rows)."""
        words = [(w, n) for w, n in ((words_of(t), n) for _, t, n in items) if w]
        holders: Counter = Counter()
        for w, n in words:
            for term in set(w):
                holders[term] += n
        return cls(sum(n for _, n in words), sum(len(w) * n for w, n in words), max((len(w) for w, _ in words), default=1), holders)


class ItemIndex:
    """BM25 impacts of items over their terms, as shares of each item's own score.

    ``items`` are (id, text) or (id, text, rows with these); ``totals`` are those of
    all items where these are a shard.
    """

    def __init__(self, items: list[tuple], totals: Totals | None = None):
        rows = [(*x, 1)[:3] for x in items]
        totals = totals or Totals.of(rows)
        holders, every = totals.holders, totals.items
        kept = [(i, t, words_of(t), r) for i, t, r in sorted(rows, key=lambda x: (x[0] is None, x[0], x[1]))]
        kept = [x for x in kept if x[2]]
        kept.sort(key=lambda x: math.fsum(self.idf(every, holders[t]) for t in set(x[2])))
        self.ids = [i for i, _, _, _ in kept]
        self.rows = [r for _, _, _, r in kept]
        parts = [question_and_answer(t) for _, t, _, _ in kept]
        self.questions = [grams(q) for q, _ in parts]
        self.answers = [grams(a) for _, a in parts]
        self.longest = totals.longest
        n = len(kept)
        mean = totals.words / max(every, 1)
        postings: dict[bytes, list[tuple[int, float]]] = {}
        for item, (_, _, words, _) in enumerate(kept):
            norm = K1 * (1 - B + B * len(words) / mean)
            impact = {t: self.idf(every, holders[t]) * f * (K1 + 1) / (f + norm) for t, f in Counter(words).items()}
            own = sum(impact.values())
            for term, value in impact.items():
                postings.setdefault(term, []).append((item, value / own))
        self.terms = {t: k for k, t in enumerate(postings)}
        self.postings = []  # of each term: block of items -> (largest impact, [(item, impact)])
        for listed in postings.values():
            cut: dict[int, list] = {}
            for item, value in listed:
                cut.setdefault(item // BLOCK_ITEMS, []).append((item, value))
            self.postings.append({k: (max(v for _, v in p), p) for k, p in cut.items()})
        # the block test for all passages of a batch: rare terms' (block, maximum) lists, end to end
        self.blocks = -(-n // BLOCK_ITEMS)
        common = np.array([len(p) > max(1, COMMON * n) for p in postings.values()], dtype=bool)
        shared = np.zeros(n)
        for k in np.flatnonzero(common).tolist():
            for _, listed in self.postings[k].values():
                for item, value in listed:
                    shared[item] += value
        self.common_share = np.maximum.reduceat(shared, np.arange(0, n, BLOCK_ITEMS)) if n else shared
        # in blocks that common terms alone may bring in (templated items) these are listed like rare ones
        listed_all = self.common_share >= THRESHOLD * (1 - 1e-9)
        self.common_share[listed_all] = 0.0
        rows = [sorted((b, m) for b, (m, _) in p.items() if not c or listed_all[b]) for p, c in zip(self.postings, common)]
        self.rare_size = np.array([len(r) for r in rows], dtype=np.int64)
        self.rare_start = np.cumsum(self.rare_size) - self.rare_size
        self.rare_block = np.array([b for r in rows for b, _ in r], dtype=np.int64)
        self.rare_value = np.array([v for r in rows for _, v in r])

    @staticmethod
    def idf(n: int, holders: int) -> float:
        return math.log(1 + (n - holders + 0.5) / (holders + 0.5))

    def block_test(self, cell: np.ndarray, term: np.ndarray, threshold: float) -> np.ndarray:
        """Ascending (cell * blocks + block) that may reach ``threshold``, of distinct pairs (cell, term).

        Cells are tested in stretches whose lists have about EXPANDED entries, whatever the texts hold.
        """
        order = np.argsort(cell, kind="stable")
        cell, term = cell[order], term[order]
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        work = np.cumsum(np.add.reduceat(self.rare_size[term], first)) // EXPANDED
        cuts = first[np.flatnonzero(work[1:] != work[:-1]) + 1]
        parts = [self._likely(c, t, threshold) for c, t in zip(np.split(cell, cuts), np.split(term, cuts))]
        return np.concatenate(parts)

    def _likely(self, cell: np.ndarray, term: np.ndarray, threshold: float) -> np.ndarray:
        threshold *= 1 - 1e-9  # rounding must not lose an item
        size = self.rare_size[term]
        at = np.repeat(self.rare_start[term] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        keys, inverse = np.unique(np.repeat(cell, size) * self.blocks + self.rare_block[at], return_inverse=True)
        bound = np.bincount(inverse, weights=self.rare_value[at], minlength=len(keys)) + self.common_share[keys % self.blocks]
        alone = np.flatnonzero(self.common_share >= threshold)  # none unless ``threshold`` is below THRESHOLD
        extra = (np.unique(cell)[:, None] * self.blocks + alone).ravel()
        return np.unique(np.concatenate([keys[bound >= threshold], extra]))

    def retrieve(self, terms: list[int], threshold: float, blocks: list[int]) -> list[tuple[int, float]]:
        """(item, score) of the items of ``blocks``, ascending, that score ``threshold`` or more, by WAND.

        Cursors stand on each term's postings in the block.  The pivot is the
        first item at which the maxima of the lists up to it can reach the
        threshold: items before it are passed over unscored.
        """
        reach = threshold * (1 - 1e-9)  # rounding must not lose an item
        found = []
        for block in blocks:
            lists = [self.postings[t].get(block) for t in terms]
            # [item at the cursor, place, the block's maximum, postings]
            cursors = [[p[1][0][0], 0, p[0], p[1]] for p in lists if p]
            while cursors:
                cursors.sort(key=lambda c: c[0])
                bound, pivot = 0.0, None
                for c in cursors:
                    bound += c[2]
                    if bound >= reach:
                        pivot = c[0]
                        break
                if pivot is None:
                    break
                shares = []
                for c in cursors:
                    postings = c[3]
                    while c[1] < len(postings) and postings[c[1]][0] < pivot:
                        c[1] += 1
                    if c[1] < len(postings) and postings[c[1]][0] == pivot:
                        shares.append(postings[c[1]][1])
                        c[1] += 1
                    c[0] = postings[c[1]][0] if c[1] < len(postings) else -1
                score = math.fsum(shares)  # in any order of the terms
                if score >= threshold:
                    found.append((pivot, score))
                cursors = [c for c in cursors if c[0] >= 0]
        return found

    def verify(self, words: list[bytes], item: int) -> tuple[float, float]:
        """Shares of the item's question and answer grams in the passage (an empty part: that of the other)."""
        have = {n: {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} for n in range(1, GRAM + 1)}
        share = [sum(g in have[len(g)] for g in part) / len(part) if part else None for part in (self.questions[item], self.answers[item])]
        q, a = share
        return (a if q is None else q), (q if a is None else a)

    def match(self, texts: list[str], threshold: float = THRESHOLD, overlap: float = OVERLAP) -> list[list[tuple]]:
        """Per text: (item id, passage, score, question share, answer share, rows of the item), the best passage of each item.

        Texts are matched in groups of about GROUP_CHARS characters; a longer text is a group of its own.
        """
        out, low, size = [], 0, 0
        for high, text in enumerate(texts):
            if size and size + len(text) > GROUP_CHARS:
                out += self._match(texts[low:high], threshold, overlap)
                low, size = high, 0
            size += len(text)
        return out + self._match(texts[low:], threshold, overlap)

    def _match(self, texts: list[str], threshold: float, overlap: float) -> list[list[tuple]]:
        out: list[list[tuple]] = [[] for _ in texts]
        if not texts:
            return out
        stride = self.longest
        get = self.terms.get
        owner, place, term, held = [], [], [], []
        for d, text in enumerate(texts):
            words = words_of(text)
            held.append(words)
            ids = np.fromiter(map(get, words, repeat(-1)), dtype=np.int64, count=len(words))
            at = np.flatnonzero(ids >= 0)
            owner.append(np.full(len(at), d))
            place.append(at)
            term.append(ids[at])
        owner, place, term = np.concatenate(owner), np.concatenate(place), np.concatenate(term)
        if not len(owner):
            return out
        # a passage s has the words from s * stride to (s + 2) * stride; each word is in passages s and s - 1
        same = np.lexsort((place, term, owner))
        previous = np.full(len(owner), -1)
        chained = (owner[same][1:] == owner[same][:-1]) & (term[same][1:] == term[same][:-1])
        previous[same[1:][chained]] = place[same[:-1][chained]]
        last = np.array([max(0, -(-len(w) // stride) - 2) for w in held])
        first = np.cumsum(last + 1) - (last + 1)
        members = []
        for back in (0, 1):
            passage = place // stride - back
            fits = (passage >= 0) & (passage <= last[owner]) & (previous < passage * stride)
            members.append((first[owner[fits]] + passage[fits], term[fits]))
        cell, terms = np.concatenate([c for c, _ in members]), np.concatenate([t for _, t in members])
        likely = self.block_test(cell, terms, threshold)
        if not len(likely):
            return out
        passages, ask = np.unique(likely // self.blocks, return_index=True)
        picked = np.isin(cell, passages)
        cell, terms = cell[picked], terms[picked]
        order = np.argsort(cell, kind="stable")
        cell, terms = cell[order], terms[order]
        starts = np.searchsorted(cell, passages)
        ends = np.searchsorted(cell, passages, side="right")
        texts_of = np.searchsorted(first, passages, side="right") - 1
        best: dict[tuple, tuple] = {}
        for c, a, b, d, blocks in zip(passages.tolist(), starts.tolist(), ends.tolist(), texts_of.tolist(), np.split(likely % self.blocks, ask[1:])):
            s = c - int(first[d])
            passage = held[d][s * stride:(s + 2) * stride]
            for item, score in self.retrieve(terms[a:b].tolist(), threshold, blocks.tolist()):
                q, w = self.verify(passage, item)
                if q >= overlap and w >= overlap:
                    row = (min(q, w), score, -s, q, w)
                    best[d, item] = max(best.get((d, item), row), row)
        for (d, item), (_, score, s, q, w) in sorted(best.items()):
            out[d].append((self.ids[item], -s, score, q, w, self.rows[item]))
        return out


def shard_terms(rows: DataFrame) -> DataFrame:
    """Partial counts over (i, t, n, shard): shard, term, items with it; without shard and term: items, words, longest."""
    def run(batches):
        import pyarrow as pa

        held: Counter = Counter()
        items = words = longest = 0

        def flush(totals):
            keys = list(held)
            shard, term = [s for s, _ in keys] + [None] * len(totals), [t for _, t in keys] + [None] * len(totals)
            n, w, m = ([held[k] for k in keys] + [t[0] for t in totals], *([None] * len(keys) + [t[k] for t in totals] for k in (1, 2)))
            columns = [pa.array(shard, pa.int64()), pa.array(term, pa.binary()), *(pa.array(c, pa.int64()) for c in (n, w, m))]
            return pa.RecordBatch.from_arrays(columns, names=["shard", "term", "items", "words", "longest"])

        for batch in batches:
            for text, n, shard in zip(*(c.to_pylist() for c in batch.columns)):
                found = words_of(text)
                items += n if found else 0
                words += n * len(found)
                longest = max(longest, len(found))
                for term in set(found):
                    held[shard, term] += n
                if len(held) >= FLUSH_TERMS:
                    yield flush([])
                    held.clear()
        yield flush([(items, words, longest)])

    return rows.select("t", "n", "shard").mapInArrow(run, "shard long, term binary, items long, words long, longest long")


def item_shards(items: DataFrame, id_col: str = "item_id", text_col: str = "text"):
    """Indexes of the items, SHARD_ITEMS distinct ones (by hash) each on average, under the totals of all."""
    rows = items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).filter("t is not null")
    rows = materialize(rows.groupBy("i", "t").agg(F.count("*").alias("n")), "decontamination-items")
    shards = max(1, -(-rows.count() // SHARD_ITEMS))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("i", "t"), F.lit(shards)))
    counts = materialize(shard_terms(rows), "decontamination-counts")
    every = counts.filter("term is null").agg(F.sum("items").alias("items"), F.sum("words").alias("words"), F.max("longest").alias("longest")).first()
    known = counts.filter("term is not null")
    holders = materialize(known.groupBy("term").agg(F.sum("items").alias("n")), "decontamination-terms")
    for shard in range(shards):
        terms = known.filter(F.col("shard") == shard).select("term").distinct().join(holders, "term").select("term", "n")
        totals = Totals(every["items"] or 0, every["words"] or 0, every["longest"] or 1, {bytes(r.term): r.n for r in terms.toLocalIterator()})
        part = rows.filter(F.col("shard") == shard).select("i", "t", "n").collect()
        yield ItemIndex([(r.i, r.t, r.n) for r in part], totals)


MATCH = "item_id long, passage long, score double, question_overlap double, answer_overlap double"


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, passage, score, question_overlap, answer_overlap: the best passage of each verified pair."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = None
    for index in item_shards(items):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            import pyarrow as pa

            for batch in batches:
                found = shared.value.match(batch.column(1).to_pylist())
                flat = [(d, *m) for d, ms in zip(batch.column(0).to_pylist(), found) for m in ms]
                columns = list(zip(*flat)) or [()] * 7
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "passage", "score", "question_overlap", "answer_overlap", "rows"])

        part = rows.mapInArrow(run, f"doc_id long, {MATCH}, rows long")
        out = part if out is None else out.unionByName(part)
    # a repeated item row gives its rows again
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).drop("rows", "copy")


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that match an item; all columns stay."""
    out = docs
    position = docs.columns.index(text_col)
    for index in item_shards(items):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            import pyarrow as pa

            for batch in batches:
                found = shared.value.match([t or "" for t in batch.column(position).to_pylist()])
                yield batch.filter(pa.array([not m for m in found], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
