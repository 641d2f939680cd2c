"""URL filters: rules, and a model of the words that names are made of.

Hosts like ``bestnewssite`` hide their words.  A unigram Viterbi search splits
each part of a host name into its most probable words, by the counts of words
on all pages; a multinomial naive Bayes then scores the words of host and path.
It learns from the URLs that the rules decide, and decides the others.

The word counts stay a distributed table: the substrings of the *distinct* host
parts are joined with it, and a task gets one part's candidate words at a time
(a part has at most 63 characters, so their number is bounded).  Naive Bayes
counts words in ``BUCKETS`` hashed cells, so the model has a fixed size.

Defined cases: a null URL or one without ``://`` has an empty host and path;
every row gives a row, also repeated ones and null ids; without labelled URLs
the model allows; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

BUCKETS = 1 << 16
SMOOTHING = 1.0
LONGEST_WORD = 24
SALTS = 16
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host in ASCII lower case, path); both empty without ``://``."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.when(has, F.translate(host, ASCII_UPPER, ASCII_LOWER)).otherwise(""), F.when(has, path).otherwise("")


def match_rules(rules: dict[str, str], host: Column, path: Column) -> tuple[Column, Column]:
    """(longest rule that fits, its verdict); null if none fits.  ``rules``: ``host/path`` to verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text in sorted(rules, key=lambda r: (len(r), r)):  # the longest is asked first
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, rules[text]).otherwise(verdict)
    return rule, verdict


def word_counts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """word, n over all pages: runs of ASCII letters outside tags."""
    text = F.regexp_replace(F.translate(F.col(html_col), ASCII_UPPER, ASCII_LOWER), "<[^>]*>", " ")
    words = pages.select(F.explode(F.split(text, r"[^a-z]+")).alias("word")).filter(F.length("word").between(1, LONGEST_WORD))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def best_split(part: str, counts: dict[str, int], total: int) -> list[str]:
    """The most probable split of ``part`` into words (ties: the longer last word).

    A word that no page has gets the probability of an unseen word, ten times
    less for each of its letters.
    """
    best = [0.0] + [-math.inf] * len(part)
    back = [0] * (len(part) + 1)
    for end in range(1, len(part) + 1):
        for start in range(max(0, end - LONGEST_WORD), end):
            word = part[start:end]
            n = counts.get(word)
            score = best[start] + (math.log(n / total) if n else -math.log(total + 1) - len(word) * math.log(10))
            if score > best[end]:
                best[end], back[end] = score, start
    words, end = [], len(part)
    while end:
        words.append(part[back[end]:end])
        end = back[end]
    return words[::-1]


def segment_parts(parts: DataFrame, counts: DataFrame) -> DataFrame:
    """part, words: each distinct ``part`` (runs of letters of host names) split into words."""
    total = counts.agg(F.sum("n")).first()[0] or 1
    starts = F.sequence(F.lit(1), F.length("part"))
    spans = parts.select("part", F.explode(starts).alias("i")).select(
        "part", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), F.length("part") - F.col("i") + 1)), lambda n: F.substring("part", F.col("i"), n))).alias("word")).distinct()
    known = spans.join(counts, "word", "left").groupBy("part").agg(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("word", "n"))).alias("known"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = batch.to_pylist()
            split = [best_split(r["part"], {k["word"]: k["n"] for k in r["known"]}, total) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(split, pa.list_(pa.string()))], names=["part", "words"])

    return known.mapInArrow(run, "part string, words array<string>")


def segment_hosts(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """host, words of each distinct host: its letter runs split, other runs of digits as they are."""
    runs = materialize(hosts.select("host").distinct().select("host", F.posexplode(F.regexp_extract_all("host", F.lit("[a-z]+|[0-9]+"), F.lit(0))).alias("i", "part")), "host-parts")
    words = segment_parts(runs.filter(F.col("part").rlike("^[a-z]") & (F.length("part") <= 63)).select("part").distinct(), counts)
    joined = runs.join(words, "part", "left").withColumn("words", F.coalesce("words", F.array("part")))
    return joined.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("i", "words"))).alias("w")).select("host", F.flatten("w.words").alias("words"))


_TOKENS = re.compile(r"[a-z]+|[0-9]+").findall


def buckets(words: list[str] | None, path: str) -> list[int]:
    """Cells of the host's words and the path's tokens (numbers by their length)."""
    tokens = ["h:" + w for w in words or []] + ["p:" + (t if t[0] > "9" else f"#{len(t)}") for t in _TOKENS(path.lower())]
    return [zlib.crc32(t.encode("utf-8")) % BUCKETS for t in tokens]


class UrlBayes:
    """Multinomial naive Bayes over hashed tokens; allow (0) and block (1)."""

    def __init__(self, documents: np.ndarray, counts: np.ndarray):
        self.known = bool((documents > 0).all())
        smooth = counts + SMOOTHING
        logs = np.log(smooth / smooth.sum(axis=1, keepdims=True))
        self.weights = logs[1] - logs[0]
        self.prior = float(np.log((documents[1] + 1) / (documents[0] + 1)))

    def margin(self, cells: list[int]) -> float:
        """Log odds of block against allow (0 if a class has no example)."""
        return self.prior + float(self.weights[cells].sum()) if self.known else 0.0


def train(labelled: DataFrame) -> UrlBayes:
    """From rows (words, path, verdict); the driver gets at most 2 x (BUCKETS + 1) sums."""
    def run(batches):
        import pyarrow as pa

        counts = np.zeros((2, BUCKETS + 1), dtype=np.int64)
        for batch in batches:
            for r in batch.to_pylist():
                row = counts[int(r["verdict"] == "block")]
                row[BUCKETS] += 1
                np.add.at(row, buckets(r["words"], r["path"]), 1)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts.ravel()[seen], pa.int64())], names=["cell", "n"])

    found = labelled.select("words", "path", "verdict").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(2 * (BUCKETS + 1))
    for r in found:
        counts[r.cell] = r.n
    counts = counts.reshape(2, BUCKETS + 1)
    return UrlBayes(counts[:, BUCKETS], counts[:, :BUCKETS])


def judge(pages: DataFrame, rules: dict[str, str], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict, margin, words of every row."""
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = match_rules(rules, F.col("host"), F.col("path"))
    rows = rows.select("*", rule.alias("rule"), verdict.alias("ruled"))
    words = segment_hosts(rows, materialize(word_counts(pages, html_col), "page-words"))
    # a host may have a third of all rows: its row is joined with SALTS parts of the pages
    salted = words.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int"))
    rows = materialize(rows.join(salted, ["host", "salt"], "left").drop("salt"), "url-words")
    model = train(rows.filter("ruled is not null").withColumnRenamed("ruled", "verdict"))
    shared = pages.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = batch.to_pylist()
            margins = [shared.value.margin(buckets(r["words"], r["path"])) for r in rows]
            verdicts = [r["ruled"] or ("block" if m > 0 else "allow") for r, m in zip(rows, margins)]
            out = {n: batch.column(n) for n in ("page_id", "host", "path", "rule")}
            yield pa.RecordBatch.from_arrays([*out.values(), pa.array(verdicts, pa.string()), pa.array(margins, pa.float64()), batch.column("words")], names=[*out, "verdict", "margin", "words"])

    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, margin double, words array<string>")
