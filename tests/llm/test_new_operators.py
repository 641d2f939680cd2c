"""Resampling, Merkle manifest and repeated phrases against brute force on small tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimlake.llm import importance_resampling as resampling
from claimlake.llm import merkle_manifest as merkle
from claimlake.llm import repeated_phrases as phrases
from claimlake.llm.common import configure

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, tree string, `digest` string"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(["th", "ER", "on", "an", "re", "in", "é", "7"]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty, short and very long texts, copies, near copies, repeats in a text, repeated rows, a hot source."""
    rng = random.Random(3)
    base = [prose(rng, 70) for _ in range(8)]
    phrase = prose(rng, 30)
    texts = [None, "", " \n\t", "one two", LONG, "a b " + LONG, *base, base[0], base[0], " ".join(base[1].split()[:40]) + " x " + " ".join(base[2].split()[20:]),
             phrase + " mid " + phrase, "q " + phrase + " z " + phrase, phrase, "x " * 100, "x " * 30, base[3] + "\r\n" + base[3], base[4].upper(), "u v " + phrase.replace(" ", "  ")]
    out = [(i, t, "en" if i % 3 else None, None if i % 7 == 0 else "hot" if i % 2 else f"s{i % 5}", i, 1, "t", "d") for i, t in enumerate(texts)]
    out += [(100 + i, prose(rng, 25), "en", "hot", None, 1, "t", "d") for i in range(60)]
    out += [out[7], out[7], (None, base[4], "en", "s1", 1, 1, "t", "d"), (None, base[4], None, "s1", 1, 1, "t", "d"), (9, base[5] + " " + base[1], "fr", "hot", 2, 1, "t", "d")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    configure(spark)
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def same(got, want):
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


# --- resampling --------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [zlib.crc32(f.encode()) % 10000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def resampled(rows, target, percent=25, least=20):
    s, t = [0] * 10000, [0] * 10000
    found = [features(r[1]) for r in rows]
    for counts, lists in ((s, [f for _, f in found]), (t, [features(x)[1] for x in target])):
        for f in lists:
            for b in f:
                counts[b] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10000) / ((a + 1) * (sum(t) + 10000)))) for a, b in zip(s, t)]
    out = []
    for r, (n, f) in zip(rows, found):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'null' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        out.append([r[0], len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    best = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], 2 ** 63 if r[0] is None else r[0], r[1]))
    for i, r in enumerate(best[:len(best) * percent // 100]):
        r[4] = i + 1
    return [tuple(r[:5]) for r in out]


@pytest.mark.parametrize("percent", [0, 1, 25, 80, 100])
def test_resampling(spark, docs, rows, percent):
    target = [rows[7][1], "TH on th 7 é", None, ""]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "doc_id long, text string")
    got = resampling.resample(docs, bench, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    same(got.collect(), resampled(rows, target, percent))


def test_resampling_of_empty_tables(spark, docs, rows):
    none = spark.createDataFrame([], SCHEMA)
    assert resampling.resample(none, docs).collect() == []
    same(resampling.resample(docs, none).collect(), resampled(rows, []))


def test_crc_of_pairs():
    rng = random.Random(1)
    words = [bytes(rng.choices(b"abcxyz0", k=n)) for n in (1, 2, 5, 63, 64, 65, 127, 128, 1000, 70_001)]
    shift = resampling.CrcShift()
    for a in words:
        got = shift(np.full(len(words), zlib.crc32(a + b" "), dtype=np.uint32), np.array([len(w) for w in words]))
        want = [zlib.crc32(a + b" " + w) for w in words]
        assert [int(g) ^ zlib.crc32(w) for g, w in zip(got, words)] == want
    column = pa.array(["a bc", "", "D--eé f", "bc"])
    counts, single, pairs, joined = resampling.feature_buckets(column, shift)
    assert counts.tolist() == [2, 0, 3, 1]
    want = [b for t in column.to_pylist() for b in features(t)[1]]
    assert sorted(single.tolist() + pairs[joined].tolist()) == sorted(want)


@pytest.mark.parametrize("k", [1, 2, 250, 499, 500])
def test_cutoff_is_exact(spark, k):
    rng = random.Random(k)
    keys = [(rng.randint(0, 9), rng.randint(0, 40)) for _ in range(500)]   # many ties and repeated keys
    df = spark.createDataFrame(keys, "low long, id long").repartition(7)
    assert resampling.cutoff(df, k) == sorted(keys)[k - 1]
    assert resampling.cutoff(df, 501) is None and resampling.cutoff(df, 0) is None


# --- Merkle manifest ---------------------------------------------------------

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(r, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))


def tree_of(digests):
    paths, own, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for j, o in enumerate(own):
            a = o // 16 * 16
            paths[j].append((level[a:o], level[o + 1:a + 16]))
        own = [o // 16 for o in own]
        level = [sha("".join(level[i:i + 16])) for i in range(0, len(level), 16)]
    return level[0], paths


def manifested(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    trees = {}
    for s, members in groups.items():
        members.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[1])))
        trees[s] = tree_of([leaf_of(r, r[1]) for r in members])
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    root, upper = tree_of([trees[s][0] for s in order])
    out = []
    for s, above in zip(order, upper):
        for r, path in zip(groups[s], trees[s][1]):
            leaf = leaf_of(r, r[1])
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None
            folded, siblings = leaf_of(r, r[1].translate(LOWER)) if changed else leaf, ""
            for a, b in path + above:
                siblings += "".join(a + b)
                folded = sha("".join(a + [folded] + b))
            out.append((r[0], leaf, trees[s][0], root, sha(siblings), folded, folded == root))
    return out


def changed():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def test_manifest(docs, rows):
    got = merkle.manifest(docs, tampered=changed()).collect()
    same(got, manifested(rows))
    assert {r.verified for r in got} == {True, False}


def test_manifest_of_many_slices(spark):
    """Trees of several rounds: more leaves than a slice has, and a last slice of one leaf."""
    configure(spark)
    rows = [(i, f"Text {i}", None, "hot", i) for i in range(merkle.SLICE + 1)] + [(10_000 + i, "x", None, f"s{i:03}", i) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    same(merkle.manifest(df, tampered=changed()).collect(), manifested(rows))


def test_manifest_of_an_empty_table_and_of_one_row(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert merkle.manifest(none, tampered=changed()).collect() == []
    one = [(5, None, None, None, None, 1, "t", "d")]
    same(merkle.manifest(spark.createDataFrame(one, SCHEMA), tampered=changed()).collect(), manifested(one))


@pytest.mark.parametrize("n", [1, 2, 16, 17, 33, 256, 257, 4095, 4096])
def test_sweeps_of_a_slice(n):
    digests = [sha(str(i)) for i in range(n)]
    top, paths = tree_of(digests)
    one = merkle.Slice(digests, n)
    assert one.forward() == top
    got = dict(one.backward(""))
    assert len(got) == n
    for i in range(0, n, max(1, n // 20)):
        assert merkle.fold(digests[i], got[i]) == top
        assert merkle.proof_digest(got[i]) == sha("".join("".join(a + b) for a, b in paths[i]))


# --- repeated phrases --------------------------------------------------------

def removed(rows):
    """Every pair of equal windows, by definition; rows of equal doc_id are documents of their own."""
    keyed = [(2 ** 63 - 1 if r[0] is None else r[0], k, re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for k, r in enumerate(rows)]
    least, inside = {}, {}
    for d, k, w in keyed:
        for i in range(len(w) - 19):
            window = tuple(w[i:i + 20])
            least[window] = min(least.get(window, d), d)
            inside.setdefault((k, window), i)
    out = []
    for (d, k, w), r in zip(keyed, rows):
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            window = tuple(w[i:i + 20])
            if least[window] < d or inside[k, window] < i:
                gone[i:i + 20] = [True] * 20
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((r[0], len(w), len(w) - len(kept), sha(" ".join(kept))))
    return out


@pytest.mark.parametrize("flush, automaton, chunk, run", [(1 << 19, 1 << 18, 1 << 20, 512), (40, 60, 50, 30)])
def test_repeated_phrases(docs, rows, monkeypatch, flush, automaton, chunk, run):
    from pyspark import cloudpickle

    # small limits reach every split: several flushes a task, several automata a shard, texts hashed in chunks
    cloudpickle.register_pickle_by_value(phrases)
    for name, value in (("FLUSH", flush), ("AUTOMATON", automaton), ("CHUNK", chunk), ("RUN", run)):
        monkeypatch.setattr(phrases, name, value)
    try:
        got = phrases.removal_summary(docs).collect()
    finally:
        cloudpickle.unregister_pickle_by_value(phrases)
    assert list(got[0].asDict()) == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    same(got, removed(rows))


def test_phrases_of_random_texts(spark):
    """Few words, so that windows repeat within and across texts at all offsets."""
    configure(spark)
    rng = random.Random(11)
    parts = [" ".join(rng.choice("abcde") for _ in range(rng.randint(5, 45))) for _ in range(6)]
    rows = [(i, "\t".join(rng.choice(parts) for _ in range(rng.randint(1, 5)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    same(phrases.removal_summary(df).collect(), removed(rows))


def test_phrases_kept_text_and_empty_table(spark, docs, rows):
    none = spark.createDataFrame([], SCHEMA)
    assert phrases.removal_summary(none).collect() == []
    got = phrases.remove_repeats(docs)
    assert got.columns == ["doc_id", "n_removed", "text"]
    same([(r.doc_id, r.n_removed, sha(r.text)) for r in got.collect()], [(r[0], r[2], r[3]) for r in removed(rows)])
