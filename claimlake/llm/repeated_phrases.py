"""Repeated-phrase automata: remove passages of 20 words that occur earlier in the corpus.

A word goes if a window of WINDOW words over it also starts earlier: in a
document with a smaller doc_id, or before in the same document.

1. *Recurring passages are confirmed.*  Every window contains its anchor, the
   SEED words of least hash in it, so equal windows have equal anchors.  A
   *passage* is what the consecutive windows of one anchor span.  Passages are
   dealt by a 96-bit hash of their words: one that occurs more than once is
   confirmed with the smallest document that has it.  Where two different
   passages share an anchor, parts of them may recur: their windows are
   dealt one by one likewise.
2. *Sharded automata.*  Confirmed passages go to the shards (buckets of
   documents) in which they occur again; overlapping ones are put together, up
   to about RUN words.  A shard compiles them with pyahocorasick, AUTOMATON
   words an automaton, over words coded as characters, so no automaton grows with
   the corpus and no document meets passages that it cannot hold.
3. *All documents are streamed* through the automata of their shard, which
   locate every occurrence of every passage; occurrences in documents after the
   passage's first one lose their words.

No task holds a whole group: a task of the first scan combines its occurrences of a passage
to one row, of a hot anchor to one row beside its passages, so a passage that a
third of all documents share costs one row a task and one a shard.

Defined cases: a null or empty text has no words; texts under 20 words lose
nothing; rows of equal doc_id are not earlier than one another, each is a
document of its own; a null doc_id is larger than any other; an empty table
gives an empty table; texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions, text_or_empty
from .jaccard_join import by_key
from .shingles import _BASE, _INVERSE, mix, powers
from .substring_dedup import LAST, ROWS, _batch, _dealt, _rows, blobs_by, text_key, unpack
from .word_arrays import byte_set, byte_slices, coded, split_words

WINDOW = 20             # words of a window
SEED = 8                # words of an anchor
REACH = WINDOW - SEED + 1
AUTOMATON = 1 << 18     # words of the passages compiled into one automaton
DIGIT = 64              # values of a character
RUN = 512               # words after which overlapping passages are no longer put together
BUCKET_BYTES = 8 << 20  # text of a shard
FLUSH = 1 << 19         # occurrences combined at once
CHUNK = 1 << 20         # window starts hashed at once, below 2 ** 24
LETTER = byte_set(lambda b: b != 32 and not 9 <= b <= 13)

PLACE = [("doc", "<i8"), ("row", "<u4"), ("at", "<u4"), ("size", "u1")]  # words at .. at + size of a document
PHRASE = [("key", "<u8"), ("check", "<u4"), *PLACE]
ANCHOR = [("seed", "<u8"), ("key", "<u8"), ("many", "u1"), *PLACE]
FOUND = [("doc", "<i8"), ("row", "<u4"), ("at", "<u4"), ("size", "<u4"), ("first", "<i8")]


def spread(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (((mix(hashes) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def shard_of(doc: np.ndarray, row: np.ndarray, buckets: int) -> np.ndarray:
    return spread(mix(doc.astype(np.int64).view(np.uint64)) ^ row.astype(np.uint64), buckets)


def _taken(a: dict, part) -> dict:
    return {n: v[part] for n, v in a.items()}


def _joined(held: list[dict], names) -> dict:
    kinds = {"doc": np.int64, "row": np.uint32, "at": np.uint32, "size": np.uint8, "key": np.uint64, "check": np.uint32, "seed": np.uint64, "first": np.int64, "many": np.uint8}
    return {n: np.concatenate([np.zeros(0, dtype=kinds[n]), *[h[n] for h in held]]) for n in names}


# --- hashes of runs of words -------------------------------------------------

class Runs:
    """Hashes of runs of words of a slice of texts."""

    def __init__(self, column):
        words, self.counts = split_words(column, LETTER)
        self.ends = np.cumsum(self.counts)
        self.starts = self.ends - self.counts
        codes, distinct = coded(words)
        digests = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in distinct), dtype="<u8").reshape(-1, 2)
        n = len(codes)
        self.sums = [np.zeros(n + 1, dtype=np.uint64) for _ in range(2)]
        for k in range(2):
            np.cumsum(digests[codes, k] * powers(_BASE, n), out=self.sums[k][1:])

    def _hash(self, k: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        back = powers(_INVERSE, len(self.sums[k]))
        return mix((self.sums[k][b] - self.sums[k][a]) * back[a] + (b - a).astype(np.uint64))

    def key(self, a, b):
        return self._hash(0, a, b)

    def check(self, a, b):
        return (self._hash(1, a, b) >> np.uint64(32)).astype(np.uint32)

    def passages(self):
        """(row, at, size, seed, key, check) of all passages of the slice."""
        out = [(np.zeros(0, dtype=np.int64),) * 3 + (np.zeros(0, dtype=np.uint64),) * 2 + (np.zeros(0, dtype=np.uint32),)]
        n = len(self.sums[0]) - 1
        for low in range(0, max(n - WINDOW + 1, 0), CHUNK):
            high = min(low + CHUNK, n - WINDOW + 1)      # windows low .. high
            at = np.arange(low, high + REACH - 1)
            seeds = self.key(at, at + SEED)
            value = (seeds & ~np.uint64(0xFFFFFF)) | np.arange(len(at), dtype=np.uint64)
            width, least = 1, value
            while 2 * width <= REACH:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            rest = REACH - width
            least = np.minimum(least[:len(least) - rest], least[rest:]) if rest else least
            starts = np.arange(low, high)
            row = np.searchsorted(self.ends, starts, side="right")
            valid = starts + WINDOW <= self.ends[row]
            starts, row, place = starts[valid], row[valid], (least[valid] & np.uint64(0xFFFFFF)).astype(np.int64)
            if not len(starts):
                continue
            new = np.ones(len(starts), dtype=bool)
            new[1:] = (starts[1:] != starts[:-1] + 1) | (place[1:] != place[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(starts)) - 1
            a, b = starts[first], starts[last] + WINDOW
            out.append((row[first], a - self.starts[row[first]], b - a, seeds[place[first]], self.key(a, b), self.check(a, b)))
        return [np.concatenate(p) for p in zip(*out)]


def combine(a: dict) -> tuple[dict, dict]:
    """(first places, others): of each phrase the places in its smallest document, one a row, and all other places.

    The others carry ``first``, the phrase's smallest document known here.
    """
    a = _taken(a, np.lexsort((a["at"], a["row"], a["doc"], a["check"], a["key"])))
    n = len(a["doc"])

    def differs(*names):
        out = np.ones(n, dtype=bool)
        if n:
            out[1:] = np.logical_or.reduce([a[x][1:] != a[x][:-1] for x in names])
        return out

    a = _taken(a, differs("key", "check", "doc", "row", "at"))
    n = len(a["doc"])
    phrase = differs("key", "check")
    group = np.cumsum(phrase) - 1
    least = a["doc"][phrase][group] if n else a["doc"]
    own = (a["doc"] == least) & differs("key", "check", "doc", "row")
    return _taken(a, own), _taken({**a, "first": least}, ~own)


def put_together(a: dict) -> dict:
    """Overlapping places of phrases that smaller documents have become one, with the largest of their ``first``.

    Every word of it lies in one of the phrases, so wherever its words occur in a
    document after ``first``, all of them go.  Places that repeat within
    their document only stay as they are.
    """
    again = a["first"] >= a["doc"]
    rest = _taken(a, again)
    a = _taken(a, ~again)
    a = _taken(a, np.lexsort((a["at"], a["row"], a["doc"])))
    at, end = a["at"].astype(np.int64), a["at"].astype(np.int64) + a["size"]
    if not len(at):
        return rest
    new = np.ones(len(at), dtype=bool)
    new[1:] = (a["doc"][1:] != a["doc"][:-1]) | (a["row"][1:] != a["row"][:-1]) | (at[1:] // RUN != at[:-1] // RUN)
    far = (np.cumsum(new) - 1) << 33
    reach = np.maximum.accumulate(end + far) - far
    new[1:] |= at[1:] > reach[:-1]
    first = np.flatnonzero(new)
    out = _taken(a, first) | {"size": (np.maximum.reduceat(end, first) - at[first]).astype(np.uint32), "first": np.maximum.reduceat(a["first"], first)}
    return {n: np.concatenate([out[n], rest[n].astype(out[n].dtype)]) for n, _ in FOUND}


def _by_shard(kind: str, a: dict, layout: list, buckets: int) -> list[tuple]:
    return _rows(kind, blobs_by(shard_of(a["doc"], a["row"], buckets), a, layout))


# --- confirming passages -----------------------------------------------------

def _occurrences(docs: DataFrame, buckets: int) -> DataFrame:
    """Packed phrases and anchors by hash, and what a task can tell by itself by shard."""
    def flush(held):
        a = _joined(held, ["key", "check", "seed", "doc", "row", "at", "size"])
        own, others = combine(a)
        order = np.lexsort((own["key"], own["seed"]))
        own = _taken(own, order)
        n = len(order)
        seed = np.ones(n, dtype=bool)
        pair = np.ones(n, dtype=bool)
        if n:
            seed[1:] = own["seed"][1:] != own["seed"][:-1]
            pair[1:] = seed[1:] | (own["key"][1:] != own["key"][:-1])
        group = np.cumsum(seed) - 1
        many = np.bincount(group, weights=pair, minlength=1)[group] > 1 if n else pair
        anchors = _taken({**own, "many": many.astype(np.uint8)}, ~many | seed)
        return _batch(_rows("phrase", blobs_by(spread(own["key"], buckets), own, PHRASE))
                      + _rows("anchor", blobs_by(spread(anchors["seed"], buckets), anchors, ANCHOR))
                      + _by_shard("ask", _taken(own, many), PLACE, buckets) + _by_shard("found", put_together(others), FOUND, buckets))

    def run(batches):
        held, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, end in byte_slices(batch.column(1)):
                texts = batch.column(1).slice(first, end - first)
                row, at, length, seed, key, check = Runs(texts).passages()
                keys = np.array([text_key(t) for t in texts.to_pylist()], dtype=np.uint32)
                held.append({"key": key, "check": check, "seed": seed, "doc": ids[first:end][row], "row": keys[row], "at": at.astype(np.uint32), "size": length.astype(np.uint8)})
                size += len(row)
                if size >= FLUSH:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return docs.mapInArrow(run, ROWS)


def _confirm(rows: DataFrame, buckets: int) -> DataFrame:
    """Places of confirmed phrases, and passages whose windows are to be compared; other kinds pass through."""
    def one(key, found):
        if key[1] == "phrase":
            a = unpack([r["blob"] for r in found], PHRASE)
            return _batch(_by_shard("found", _later(a), FOUND, buckets))
        if key[1] == "anchor":
            a = unpack([r["blob"] for r in found], ANCHOR)
            a = _taken(a, np.lexsort((a["key"], a["seed"])))
            n = len(a["seed"])
            seed, pair = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
            seed[1:] = a["seed"][1:] != a["seed"][:-1]
            pair[1:] = seed[1:] | (a["key"][1:] != a["key"][:-1])
            group = np.cumsum(seed) - 1
            several = (np.bincount(group, weights=pair)[group] > 1) | (np.bincount(group, weights=a["many"])[group] > 0)
            return _batch(_by_shard("ask", _taken(a, several & (a["many"] == 0)), PLACE, buckets))
        return _batch([(r["kind"], r["bucket"], r["blob"]) for r in found])

    def run(batches):
        yield from by_key(batches, ["bucket", "kind"], one)

    return _dealt(rows, "kind").mapInArrow(run, ROWS)


def _later(a: dict) -> dict:
    """The places of phrases that a smaller document has, too."""
    a = _taken(a, np.lexsort((a["doc"], a["check"], a["key"])))
    new = np.ones(len(a["doc"]), dtype=bool)
    new[1:] = (a["key"][1:] != a["key"][:-1]) | (a["check"][1:] != a["check"][:-1])
    first = a["doc"][new][np.cumsum(new) - 1]
    return _taken({**a, "first": first}, a["doc"] > first)


def _with_texts(rows: DataFrame, docs: DataFrame, buckets: int) -> DataFrame:
    """Packed rows and whole texts of each shard together, the packed rows first."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            keys = np.array([text_key(t) for t in batch.column(1).to_pylist()], dtype=np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(ids, keys, buckets)), batch.column(0), pa.array(keys.astype(np.int64)), batch.column(1)], names=["bucket", "doc", "row", "text"])

    texts = docs.mapInArrow(run, "bucket long, doc long, row long, text binary").selectExpr("bucket", "cast(null as binary) as blob", "doc", "row", "text")
    both = rows.selectExpr("bucket", "blob", "cast(null as long) as doc", "cast(null as long) as row", "cast(null as binary) as text").unionByName(texts)
    return _dealt(both.withColumn("late", F.col("blob").isNull()), "late").drop("late")


def _shards(batches, limit: int | None = None):
    """(bucket, packed rows, doc ids, text keys, texts) shard by shard; with ``limit`` in parts of about so many bytes of text."""
    now, blobs, docs, keys, texts, size = None, [], [], [], [], 0
    for batch in batches:
        for bucket, blob, doc, key, text in zip(*[batch.column(n).to_pylist() for n in ("bucket", "blob", "doc", "row", "text")]):
            if bucket != now or (limit is not None and size >= limit):
                if texts:
                    yield now, blobs, docs, keys, texts
                if bucket != now:
                    now, blobs = bucket, []
                docs, keys, texts, size = [], [], [], 0
            if blob is not None:
                blobs.append(blob)
            else:
                docs.append(doc)
                keys.append(key)
                texts.append(text)
                size += len(text)
    if texts:
        yield now, blobs, docs, keys, texts


def _windows(rows: DataFrame, docs: DataFrame, buckets: int) -> DataFrame:
    """Packed windows, as phrases by hash, of the passages asked for."""
    def flush(held):
        own, others = combine(_joined(held, ["key", "check", "doc", "row", "at", "size"]))
        return _batch(_rows("phrase", blobs_by(spread(own["key"], buckets), own, PHRASE)) + _by_shard("found", put_together(others), FOUND, buckets))

    def run(batches):
        import pyarrow as pa

        held, size, now, asked, done = [], 0, None, {}, set()
        for bucket, blobs, ids, keys, texts in _shards(batches, BUCKET_BYTES // 2):
            if bucket != now:
                a = unpack(blobs, PLACE)
                now, asked, done = bucket, {}, set()
                for key, at, n in zip(zip(a["doc"].tolist(), a["row"].tolist()), a["at"].tolist(), a["size"].tolist()):
                    asked.setdefault(key, []).append((at, n))
            wanted = []
            for i, key in enumerate(zip(ids, keys)):
                if key in asked and key not in done:
                    done.add(key)   # a repeated row is compared once
                    wanted.append(i)
            if not wanted:
                continue
            runs = Runs(pa.array([texts[i] for i in wanted], pa.binary()))
            places = [(k, at, n) for k, i in enumerate(wanted) for at, n in asked[ids[i], keys[i]]]
            owner, at, n = (np.array(x, dtype=np.int64) for x in zip(*places))
            n = n - WINDOW + 1
            part = np.repeat(np.arange(len(n)), n)
            at = at[part] + np.arange(len(part)) - np.repeat(np.cumsum(n) - n, n)
            owner = owner[part]
            a = runs.starts[owner] + at
            chosen = np.array(wanted)[owner]
            held.append({"key": runs.key(a, a + WINDOW), "check": runs.check(a, a + WINDOW), "doc": np.array(ids, dtype=np.int64)[chosen],
                         "row": np.array(keys, dtype=np.uint32)[chosen], "at": at.astype(np.uint32), "size": np.full(len(at), WINDOW, dtype=np.uint8)})
            size += len(at)
            if size >= FLUSH:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return _with_texts(rows.filter("kind = 'ask'"), docs, buckets).mapInArrow(run, ROWS)


# --- automata ----------------------------------------------------------------

class Shard:
    """The words of a shard's documents, coded."""

    def __init__(self, ids: list, keys: list, texts: list[bytes]):
        import pyarrow as pa

        words, self.counts = split_words(pa.array(texts, pa.large_binary()), LETTER)
        self.codes, _ = coded(words)
        self.ends = np.cumsum(self.counts)
        self.starts = self.ends - self.counts
        self.ids = np.array(ids, dtype=np.int64)
        self.rows = dict(reversed([((d, k), i) for i, (d, k) in enumerate(zip(ids, keys))]))

    def text(self, used: np.ndarray) -> tuple[str, int]:
        """(all words as characters, how many a word), one line a document.

        A node of an automaton looks through its children one by one, so words
        are written as digits of DIGIT values, each place with letters of its own;
        all words that are not ``used`` are alike.
        """
        width = 1
        while DIGIT ** width < len(used):
            width += 1
        number = np.full(int(self.codes.max()) + 1 if len(self.codes) else 1, -1, dtype=np.int64)
        number[used] = np.arange(len(used))
        number = number[self.codes]
        out = np.zeros((len(self.codes) + len(self.counts), width), dtype="<u4")
        place = np.arange(len(self.codes)) + np.repeat(np.arange(len(self.counts)), self.counts)
        for k in range(width):
            out[place, k] = np.where(number < 0, 1, 2 + k * DIGIT + number // DIGIT ** (width - 1 - k) % DIGIT)
        return out.tobytes().decode("utf-32-le"), width

    def removed(self, found: dict) -> np.ndarray:
        """Whether each word lies in an occurrence of a passage after its first one."""
        import ahocorasick

        found = put_together(found)
        cover = np.zeros(len(self.codes) + 1, dtype=np.int64)
        row = np.array([self.rows[k] for k in zip(found["doc"].tolist(), found["row"].tolist())], dtype=np.int64)
        place = self.starts[row] + found["at"]
        size = found["size"].astype(np.int64)
        line_starts = self.starts + np.arange(len(self.starts))
        share = np.cumsum(size) // AUTOMATON
        for k in np.unique(share):
            part = share == k
            a, n, r = place[part], size[part], row[part]
            each = np.repeat(a, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            text, width = self.text(np.unique(self.codes[each]))
            automaton, firsts, sizes = ahocorasick.Automaton(), [], []
            for at, length, first in zip((a + r).tolist(), n.tolist(), found["first"][part].tolist()):
                phrase = text[at * width:(at + length) * width]
                known = automaton.get(phrase, None)
                if known is None:
                    automaton.add_word(phrase, len(firsts))
                    firsts.append(first)
                    sizes.append(length)
                elif first < firsts[known]:
                    firsts[known] = first
            automaton.make_automaton()
            firsts, sizes = np.array(firsts, dtype=np.int64), np.array(sizes, dtype=np.int64)
            for b, e in self._stretches(line_starts, len(text) // width):
                hits = np.array(list(automaton.iter(text, b * width, e * width)), dtype=np.int64).reshape(-1, 2)
                phrase = hits[:, 1]
                at = hits[:, 0] // width - sizes[phrase] + 1
                line = np.searchsorted(line_starts, at, side="right") - 1
                doc, first = self.ids[line], firsts[phrase]
                again = doc > first
                same = np.flatnonzero(doc == first)
                if len(same):
                    same = same[np.lexsort((at[same], line[same], phrase[same]))]
                    repeat = np.zeros(len(same), dtype=bool)
                    repeat[1:] = (phrase[same][1:] == phrase[same][:-1]) & (line[same][1:] == line[same][:-1])
                    again[same[repeat]] = True
                word = (at - line)[again]
                np.add.at(cover, word, 1)
                np.add.at(cover, word + sizes[phrase][again], -1)
        return np.cumsum(cover)[:-1] > 0

    @staticmethod
    def _stretches(line_starts: np.ndarray, size: int):
        """Ranges of whole lines, about CHUNK words each."""
        low = 0
        while low < size:
            k = int(np.searchsorted(line_starts, low + CHUNK, side="left"))
            high = int(line_starts[k]) if k < len(line_starts) else size
            yield low, high
            low = high


def _apply(rows: DataFrame, docs: DataFrame, buckets: int, output, schema: str) -> DataFrame:
    """``output(doc, words, keep)`` rows of every document; ``keep`` is None if all words stay."""
    def run(batches):
        import pyarrow as pa

        kinds = {"long": pa.int64(), "string": pa.string()}
        fields = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])
        for _, blobs, ids, keys, texts in _shards(batches):
            gone, ends = None, None
            if blobs:
                shard = Shard(ids, keys, texts)
                gone, ends = shard.removed(unpack(blobs, FOUND)), shard.ends
            for low in range(0, len(texts), 256):
                out = []
                for i in range(low, min(low + 256, len(texts))):
                    words, keep = texts[i].split(), None
                    if gone is not None:
                        mine = gone[ends[i] - len(words):ends[i]]
                        keep = ~mine if mine.any() else None
                    out.append(output(None if ids[i] == LAST else ids[i], words, keep))
                yield pa.RecordBatch.from_pylist([dict(zip(fields.names, r)) for r in out], schema=fields)

    return _with_texts(rows.filter("kind = 'found'"), docs, buckets).mapInArrow(run, schema)


def _summary(doc, words: list[bytes], keep) -> tuple:
    kept = words if keep is None else list(compress(words, keep.tolist()))
    return doc, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def _kept_text(doc, words: list[bytes], keep) -> tuple:
    kept = words if keep is None else list(compress(words, keep.tolist()))
    return doc, len(words) - len(kept), b" ".join(kept).decode("utf-8")


def _found(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, int]:
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(LAST))).alias("doc"), text_or_empty(text_col).cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(shuffle_partitions(docs.sparkSession), size // BUCKET_BYTES)
    decided = materialize(_confirm(_occurrences(rows, buckets), buckets), "phrase-decisions")
    windows = _confirm(_windows(decided, rows, buckets), buckets)
    return decided.filter("kind = 'found'").unionByName(windows), rows, buckets


def removal_summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    found, rows, buckets = _found(docs, id_col, text_col)
    return _apply(found, rows, buckets, _summary, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_removed, text: the words kept of every row, joined by blanks."""
    found, rows, buckets = _found(docs, id_col, text_col)
    return _apply(found, rows, buckets, _kept_text, "doc_id long, n_removed long, text string")
