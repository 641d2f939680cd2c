"""Edge cases and brute-force checks of the training-data operators on small tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from claimlake.llm import byte_bpe, decontamination, jaccard_join, language_id, permutation_index, secrets, substring_dedup, token_files, url_filter, warc
from claimlake.llm.common import Generations, configure

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
LONG = "lorem ipsum dolor sit amet " * 4000
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "in", "é"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    """Nulls, empty, blank, tiny and very long texts, repeated rows and copies, near copies, extra columns."""
    configure(spark)
    rng = random.Random(5)
    base = [prose(rng, 120) for _ in range(12)]
    near = [" ".join(w if i % 40 else "changed" for i, w in enumerate(t.split())) for t in base[:5]]
    texts = [None, "", " \n\t", "one", "two words", LONG, LONG + " end", *base, *near, base[0], base[0], base[1].upper(), base[2] + " " + base[3]]
    rows = [(i, t, "en" if i % 3 else None, "src", 1, "x") for i, t in enumerate(texts)]
    rows += [rows[8], (None, base[4], "en", "src", 1, "x"), (7, "same id, another text", "fr", "src", 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row int, set string")


@pytest.fixture(scope="module")
def stored(spark, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus") / "documents.parquet")
    corpus.write.parquet(path)
    return spark.read.parquet(path)


def rows_of(df) -> list[tuple]:
    return [tuple(r) for r in df.collect()]


def test_token_files(spark, stored):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    planted = ["a <|endoftext|> b", "<|endoftext|><|startoftext|>x", "<|EndOfText|> <|end oftext|>", "n<|startoftext|>\n<|endoftext", "<|endoftext|>"]
    stored = stored.unionByName(spark.createDataFrame([(900 + i, t) for i, t in enumerate(planted)], "doc_id long, text string"), allowMissingColumns=True)
    manifest, id_of = token_files.write_token_files(stored, WORDS, end_id=2)
    got = sorted(rows_of(token_files.read_token_files(manifest, id_of).select("doc_id", "n_tokens", "ids")), key=str)
    want = [(r.doc_id, tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in stored.collect()]
    assert got == sorted([(d, len(ids), ids) for d, ids in want], key=str)
    crc = token_files.read_token_files(manifest, id_of, digests=True).orderBy("start").collect()
    assert [r.start for r in crc] == np.cumsum([0] + [r.n_tokens for r in crc])[:-1].tolist()
    assert [r.doc_id for r in crc if r.doc_id is not None] == sorted(d for d, _ in want if d is not None)
    assert sorted(r.ids_crc32 for r in crc) == sorted(zlib.crc32(np.array(ids, dtype="<u4").tobytes()) for _, ids in want)
    empty, ids = token_files.write_token_files(stored.limit(0), WORDS, end_id=2)
    assert token_files.read_token_files(empty, ids).count() == 0


def test_token_code_round_trip():
    values = np.array([0, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1, 7, 9], dtype=np.uint32)
    for n in range(len(values) + 1):
        assert (token_files.unpack(*token_files.pack(values[:n]), n) == values[:n]).all()


def test_encoders_survive_cache_rotation():
    rng = random.Random(1)
    texts = [prose(rng, 50) for _ in range(40)]
    small, large = token_files.WordEncoder(WORDS), token_files.WordEncoder(WORDS)
    small.pieces, small.chunks = Generations(5), Generations(5)
    bpe, other = byte_bpe.ByteBpe(RANKS, public_tokenizers.PATTERN), byte_bpe.ByteBpe(RANKS, public_tokenizers.PATTERN)
    bpe.pieces, bpe.units = Generations(5), Generations(5)
    for i in range(0, 40, 4):
        assert small.encode(texts[i:i + 4]) == large.encode(texts[i:i + 4])
        assert [d for _, d in bpe.encode(texts[i:i + 4])] == [d for _, d in other.encode(texts[i:i + 4])]


def test_byte_bpe_is_tiktoken(spark, stored):
    import tiktoken

    bpe = byte_bpe.coder(RANKS, public_tokenizers.PATTERN)
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    odd = ["  \n foo\x1c \x1d bar \x85x  y ", "x" * 3000 + "é" * 400, "it's 12 345\r\n\r\n don't", "\u2003 a\u3000b", " " * 9]
    for text, (ids, decimal) in zip(odd, bpe.encode(odd)):
        assert ids.tolist() == reference.encode_ordinary(text) and bpe.decode(ids) == text.encode()
        assert decimal == " ".join(map(str, ids.tolist()))
    back = byte_bpe.decode(byte_bpe.encode(stored, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect()
    assert len(back) == stored.count() and all(bytes(r.decoded).decode() == (r.text or "") and r.set == "x" for r in back)
    got = sorted(rows_of(byte_bpe.round_trip_digests(stored, RANKS, public_tokenizers.PATTERN)), key=str)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in stored.collect():
        ids = reference.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids)).encode()), sha((r.text or "").encode())))
    assert got == sorted(want, key=str)
    assert byte_bpe.round_trip_digests(stored.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.fixture
def other_splits(spark, monkeypatch):
    """Files are dealt to partitions of several until an operator has written its first table, then of one each."""
    name = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(name)

    def use(module):
        write = module.materialize

        def written(*args):
            out = write(*args)
            spark.conf.set(name, "128m")
            return out

        monkeypatch.setattr(module, "materialize", written)
        spark.conf.set(name, "0")

    yield use
    spark.conf.set(name, before)


def test_warc_numbers_rows_once(spark, tmp_path, other_splits):
    pages = [(i, f"http://h/{i}", f"<p>{i % 7}</p>" if i % 3 else f"own {i}") for i in range(60)]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(8).write.parquet(str(tmp_path / "p"))
    other_splits(warc)
    captures = warc.assemble(warc.read_warc(warc.write_warc(spark.read.parquet(str(tmp_path / "p")))))
    first: dict = {}
    for i, _, html in pages:
        first.setdefault(html, i)
    got = sorted(rows_of(warc.capture_digests(captures).select("page_id", "record_type", "refers_to")))
    assert got == [(i, "response", None) if first[h] == i else (i, "revisit", first[h]) for i, _, h in pages]


def test_warc(spark):
    pages = spark.createDataFrame([(3, "http://a/", "<p>x</p>", 1), (1, None, "<p>x</p>", 1), (2, "http://b\r\nc", None, 1), (4, "u", "", 1), (None, "u", "é" * 50_000, 1), (1, None, "<p>x</p>", 1)],
                                  "page_id long, url string, html string, row int")
    captures = warc.assemble(warc.read_warc(warc.write_warc(pages)))
    assert captures.filter("request is null or response is null or size(metadata) <> 1").count() == 0
    assert "é" * 50_000 in {bytes(r.p).decode() for r in captures.selectExpr("response.payload as p").collect() if r.p is not None}
    got = sorted(rows_of(warc.capture_digests(captures).select("page_id", "payload_bytes", "record_type", "refers_to")), key=str)
    assert got == sorted([(3, 8, "revisit", 1), (1, 8, "response", None), (1, 8, "revisit", 1), (2, 0, "response", None), (4, 0, "revisit", 2), (None, 100_000, "response", None)], key=str)
    assert warc.capture_digests(warc.assemble(warc.read_warc(warc.write_warc(pages.limit(0))))).count() == 0


def test_secrets(spark, stored):
    key = "AKIA" + "Q" * 16
    texts = [None, "", f"é {key} token: {'v' * 14} tail", f"token=secret=abcdefghijkl {'0a' * 8}", "api_key: 'short7x' near AKIAABCDEFGHIJ", "api_key: 'short7x' alone",
             f"https://h.example/x {key} password = {'p' * 12}", LONG, LONG + f" token: {'z' * 20}"]
    docs = spark.createDataFrame([(i // 2, t, "kept") for i, t in enumerate(texts)] + [(9, texts[2], "kept")] * 2, "doc_id long, text string, row string")
    out = secrets.scan(docs).collect()
    assert len(out) == len(texts) + 2
    spans = {r.spans for r in out}
    assert "access:2:22,assign:23:44" in spans and "assign:0:25,hex:26:42" in spans
    assert any("weak_access" in s and "weak_secret" in s for s in spans)
    assert sum("weak_secret" in s for s in spans) == 1 and any(s.startswith("endpoint:0:19") for s in spans)
    redacted = secrets.redact(docs)
    assert redacted.count() == len(texts) + 2 and redacted.columns == docs.columns
    assert {r.text for r in redacted.filter("doc_id = 9").collect()} == {"é [SECRET] [SECRET] tail"}
    assert redacted.filter("text like '%short7x% alone'").count() == 1
    assert secrets.scan(docs.limit(0)).count() == 0


def test_language(spark, stored):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the house and the garden", "en"), ("das haus und der garten", "de"), ("la maison et le jardin", "fr")] * 20)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    docs = spark.createDataFrame([(1, "the garden and the house"), (2, "der garten und das haus"), (3, None), (4, "123 !!"), (None, "le jardin et la maison"), (1, "the garden and the house")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.lang_pred) for r in language_id.predict(docs, model).collect()), key=str)
    assert got == sorted([(1, "en"), (1, "en"), (2, "de"), (3, "und"), (4, "und"), (None, "fr")], key=str)
    assert language_id.keep_identified(docs, model).count() == 4
    untrained = language_id.train(stored.limit(0))
    assert {r.lang_pred for r in language_id.predict(stored, untrained).collect()} == {"und"}
    code = language_id.codewords(12)
    assert len(np.unique(code, axis=0)) == 12


def brute_components(rows: list[tuple]) -> list[tuple]:
    sets = []
    for _, text in rows:
        w = re.findall("[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append(frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min([x for x in (least.get(find(i)), d) if x is not None], default=None)
    return sorted([(d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))], key=str)


def test_jaccard_join(stored):
    got = sorted(rows_of(jaccard_join.near_duplicates(stored).select("doc_id", "n_shingles", "component_id")), key=str)
    assert got == brute_components([(r.doc_id, r.text) for r in stored.collect()])
    kept = jaccard_join.keep_first(stored)
    assert kept.columns == stored.columns and kept.count() < stored.count()
    assert jaccard_join.near_duplicates(stored.limit(0)).count() == 0


def test_jaccard_join_numbers_rows_once(spark, tmp_path, other_splits):
    rng = random.Random(21)
    base = [prose(rng, 60) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base + [t + " end" for t in base[:15]] + base[10:25])]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(8).write.parquet(str(tmp_path / "d"))
    other_splits(jaccard_join)
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = jaccard_join.near_duplicates(docs).select("doc_id", "n_shingles", "component_id")
    want = brute_components(rows)
    assert sorted(rows_of(got), key=str) == want
    other_splits(jaccard_join)
    assert sorted(rows_of(jaccard_join.keep_first(docs))) == sorted(r for r in rows if r[0] in {c for _, _, c in want})


def test_jaccard_join_divided_regions(spark, tmp_path, monkeypatch):
    """Groups larger than a block, with members outside the pivot's threshold."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 8)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        own = list(words)
        own[:i % 9] = [f"x{rng.randrange(6)}" for _ in range(i % 9)]
        rows.append((i, " ".join(own)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    got = jaccard_join.near_duplicates(spark.read.parquet(str(tmp_path / "d"))).select("doc_id", "n_shingles", "component_id")
    assert sorted(rows_of(got), key=str) == brute_components(rows)


def test_parts_of_cells_are_the_connected_entries():
    rng = random.Random(11)
    for _ in range(200):
        rows = [(rng.randrange(3), n, rng.randrange(n // 5 + 1)) for n in (rng.randint(1, 60) for _ in range(rng.randrange(40)))]
        cell, n, at = (np.array([r[k] for r in rows], dtype=np.int64) for k in range(3))
        got = jaccard_join.parts(cell, n, at)
        group = list(range(len(rows)))
        for i, (c, n1, a1) in enumerate(rows):
            for j, (d, n2, a2) in enumerate(rows[:i]):
                if c == d and 9 * min(n1 - a1, n2 - a2) >= 4 * (n1 + n2):
                    group = [group[j] if g == group[i] else g for g in group]
        lonely = [group.count(g) == 1 for g in group]
        assert [p < 0 for p in got.tolist()] == lonely
        for i in range(len(rows)):
            assert all((got[i] == got[j]) == (group[i] == group[j]) for j in range(i) if not (lonely[i] or lonely[j]))


def test_linked_sets_meet_in_a_part_of_a_cell():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 1 << 62, rng.integers(4, 80)).astype(np.uint64)
        for _ in range(4):
            keep = base[rng.random(len(base)) > rng.choice([0.02, 0.1, 0.2])]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 62, rng.integers(0, 6)).astype(np.uint64)])))
    heavy = np.sort(rng.choice(np.concatenate(sets), 300))
    entries = [(h, i, len(s), k) for i, s in enumerate(sets) for k, h in enumerate(jaccard_join.window(s, heavy).tolist())]
    _, cell = np.unique(np.array([e[0] for e in entries], dtype=np.uint64), return_inverse=True)
    part = jaccard_join.parts(cell, np.array([e[2] for e in entries]), np.array([e[3] for e in entries]))
    together = {}
    for p, e in zip(part.tolist(), entries):
        if p >= 0:
            together.setdefault(p, set()).add(e[1])
    links = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i]) and len(sets[j]) and jaccard_join.linked(sets[i], sets[j])]
    assert len(links) > 40
    assert all(any({i, j} <= m for m in together.values()) for i, j in links)


@pytest.mark.parametrize("hot", [1 << 15, 2])
def test_substring_dedup(stored, monkeypatch, hot):
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(substring_dedup)  # tasks see the changed bound
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    try:
        check_substring_dedup(stored)
    finally:
        cloudpickle.unregister_pickle_by_value(substring_dedup)


def check_substring_dedup(stored):
    rows = sorted(((r.doc_id, (r.text or "").encode()) for r in stored.collect()), key=lambda r: (r[0] is None, r[0]))
    want, seen, held, last = [], set(), set(), object()
    for doc, data in rows:
        if doc != last:
            seen, held, last = seen | held, set(), doc
        gone = np.zeros(len(data), dtype=bool)
        for p in range(len(data) - 49):
            if data[p:p + 50] in seen:
                gone[p:p + 50] = True
            held.add(data[p:p + 50])
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        want.append((doc, len(data), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest()))
    assert sorted(rows_of(substring_dedup.removal_summary(stored)), key=str) == sorted(want, key=str)
    assert substring_dedup.removal_summary(stored.limit(0)).count() == 0


def test_deep_shallow_order():
    rng = np.random.default_rng(0)
    windows = rng.integers(97, 99, (400, 50), dtype=np.uint8)
    windows[:, :40] = windows[0, :40]
    windows[50:80] = windows[3]
    order, same = substring_dedup.suffix_order(windows)
    text = [windows[i].tobytes() for i in order]
    assert text == sorted(text)
    assert all((a == b) == (x == y) for a, b, x, y in zip(text, text[1:], same.tolist(), same[1:].tolist()))


def test_permutation_index(spark):
    rng = np.random.default_rng(4)
    data = rng.normal(size=(1200, 16)).astype(np.float32)
    data[5:400] = data[0]
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    bad = [(2000, None), (2100, [0.0] * 16), (2200, [float("nan")] + [1.0] * 15), (2300, [1.0]), (None, data[7].tolist()), (2400, []), rows[3]]
    vectors = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    got: dict = {}
    for r in permutation_index.search(vectors, "vec_id % 100 = 0", block_rows=300).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sorted(got) == list(range(0, 1200, 100)) and all(len(v) == 10 for v in got.values())
    assert [v for v, _ in got[0]] == list(range(5, 15)) and [v for v, _ in got[200]] == [0, *range(5, 14)]
    exact = data.astype(np.float64)
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((exact - exact[q]) ** 2).sum(1))
        assert all(abs(d[v] - s) < 1e-12 for v, s in found)
        d[q] = np.inf
        hits += len({v for v, _ in found} & set(np.lexsort((np.arange(1200), d))[:10].tolist()))
    assert hits >= 0.9 * 120
    assert permutation_index.search(vectors.limit(0), "vec_id % 100 = 0").count() == 0


def test_url_filter(spark):
    rules = {"net/": "block", "example.net/en/": "allow"}
    urls = ["http://A.Example.NET/en/x?q", "http://example.net/de/", "http://net", "http://xnet/", None, "no scheme", "http://spamfarm.org/buy/1", "ftp://h/p?x://y/z", "http://example.net/en/x?q"]
    pages = spark.createDataFrame([(i, u, "<p>spam farm spam farm</p>", "h") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in url_filter.judge(pages, rules).collect()}
    assert len(got) == len(urls)
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert (got[1].rule, got[1].verdict, got[2].rule, got[3].rule) == ("net/", "block", None, None)
    assert (got[4].host, got[4].path, got[5].host, got[7].host, got[7].path) == ("", "", "", "h", "/p")
    assert got[6].words[:2] == ["spam", "farm"]
    assert url_filter.judge(pages.limit(0), rules).count() == 0


def test_decontamination(spark, stored):
    rng = random.Random(9)
    items = [(i, prose(rng, 20).capitalize() + ". " + prose(rng, 12).capitalize() + ".") for i in range(60)]
    leak = [(100, prose(rng, 300) + " " + items[3][1] + " " + prose(rng, 300)), (101, items[4][1].upper()), (102, items[5][1].split(". ")[0]), (103, LONG + items[6][1]), (100, items[7][1])]
    docs = spark.createDataFrame(leak + [(r.doc_id, r.text) for r in stored.collect()], "doc_id long, text string")
    bench = spark.createDataFrame([*items, (70, None), (71, ""), (72, items[3][1])], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.matches(docs, bench).collect()}
    assert got >= {(100, 3), (100, 72), (103, 6), (100, 7)} and {d for d, _ in got} <= {100, 101, 103}
    assert decontamination.clean(docs, bench).filter("doc_id in (100, 103)").count() == 0
    assert decontamination.clean(docs, bench.limit(0)).count() == docs.count()
    assert decontamination.matches(docs.limit(0), bench).count() == 0


def test_decontamination_ignores_case_and_punctuation_beyond_ascii(spark):
    rng = random.Random(9)
    items = [(i, prose(rng, 20).capitalize() + ". " + prose(rng, 12).capitalize() + ".") for i in range(60)]
    changes = [str.upper, str.title, lambda t: "\u201c" + t.replace(" ", "\u00a0\u2014 ") + "\u201d", lambda t: t.replace(" ", "_")]
    docs = spark.createDataFrame([(100 * k + i, change(t)) for k, change in enumerate(changes) for i, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.matches(docs, bench).collect()}
    assert got == {(100 * k + i, i) for k in range(len(changes)) for i, _ in items}
    assert decontamination.clean(docs, bench).count() == 0
    assert decontamination.words_of("STRASSE \u00c9t\u00c9_\u00ab\u0645\u0663\u00bb") == decontamination.words_of("stra\u00dfe, \u00e9t\u00e9 \u0645\u0663")


def test_decontamination_in_shards_is_that_of_one_index(spark, monkeypatch):
    """Partly copied items near the bounds, a long item and one that a third of the item rows repeat."""
    rng = random.Random(12)
    texts = [prose(rng, rng.randint(6, 25)).capitalize() + ". " + prose(rng, rng.randint(3, 12)).capitalize() + "." for _ in range(70)]
    texts[11] = prose(rng, 150) + ". " + prose(rng, 20) + "."
    items = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5])] * 35 + [(70, None), (71, " "), (None, texts[8]), (None, texts[8])]
    parts = []
    for i, t in enumerate(texts):
        words = t.split()
        parts += [(i, " ".join(w if rng.random() < keep else "qq" for w in words)) for keep in (1, 0.95, 0.9, 0.8)]
    docs = spark.createDataFrame(parts, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    sizes, build = [], decontamination.ItemIndex.__init__
    monkeypatch.setattr(decontamination.ItemIndex, "__init__", lambda self, given, *more: (sizes.append(len(given)), build(self, given, *more))[1])
    one = sorted(rows_of(decontamination.matches(docs, bench)), key=str)
    assert len(sizes) == 1
    monkeypatch.setattr(decontamination, "SHARD_ITEMS", 12)
    many = sorted(rows_of(decontamination.matches(docs, bench)), key=str)
    assert many == one and len(sizes) == 1 + 6
    assert max(sizes[1:]) <= 30 and sum(sizes[1:]) == 72
    whole = decontamination.ItemIndex([r for r in items if r[1] is not None])
    want = [(d, *m[:5]) for (d, _), ms in zip(parts, whole.match([t for _, t in parts])) for m in ms]
    assert one == sorted(want, key=str) and sum(r[1] == 5 for r in one) % 36 == 0 and len({r[1] for r in one}) == 71


def test_wand_retrieves_what_full_scoring_does():
    rng = random.Random(6)
    index = decontamination.ItemIndex([(i, prose(rng, 15)) for i in range(80)])
    for _ in range(40):
        words = set(decontamination.words_of(prose(rng, 60)))
        terms = [index.terms[w] for w in words if w in index.terms]
        full: dict = {}
        for t in terms:
            for _, listed in index.postings[t].values():
                for item, value in listed:
                    full[item] = full.get(item, 0.0) + value
        likely = index.block_test(np.zeros(len(terms), dtype=np.int64), np.array(terms, dtype=np.int64), 0.3)
        got = dict(index.retrieve(terms, 0.3, (likely % index.blocks).tolist()))
        assert set(got) == {i for i, s in full.items() if s >= 0.3 and abs(s - 0.3) > 1e-9} | {i for i in got if abs(full[i] - 0.3) <= 1e-9}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    clean = [(i, prose(rng, 80), "en", "s", 1) for i in range(10)]
    item = prose(rng, 20) + ". " + prose(rng, 10) + "."
    docs = clean + [(20, None, None, "s", 0), (21, "12 34", "en", "s", 0), (22, clean[0][1], "en", "s", 0), (23, prose(rng, 50) + " " + item, "en", "s", 0),
                    (24, "token: " + "v" * 20 + " " + prose(rng, 40), "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out) == [*range(10), 24]
    bpe = byte_bpe.coder(RANKS, public_tokenizers.PATTERN)
    text = {r.doc_id: bpe.decode(np.array(r.ids)).decode() for r in out}
    assert text[24].startswith("[SECRET] ") and all(text[i] == t for i, t, *_ in clean)
