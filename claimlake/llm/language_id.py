"""Language identification by error-correcting output codes.

Every language has a codeword of +1/-1 bits (all distinct two-way splits of the
languages up to five, else a seeded random code).  One binary classifier per
bit, a naive Bayes over hashed byte trigrams, predicts whether a text's
language is on the bit's + or - side.  Decoding is loss-weighted: the language
whose codeword has the smallest total logistic loss against the bits' margins;
a text whose two best codewords are nearly as good is flagged ambiguous.

Training counts the trigrams of *all* labelled texts by language in one pass;
the model has (languages x BUCKETS) counts, whatever the corpus, and goes to
the tasks as a broadcast of that bounded size.

Defined cases: a null, empty or letterless text is ``und`` with score 0; with
no training rows every text is ``und``; rows are predicted one by one, so
repeated rows and null ids each give a row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14
SMOOTHING = 0.5
MAX_LANGUAGES = 500     # the model's bound: MAX_LANGUAGES * BUCKETS counts
AMBIGUOUS_BELOW = 0.6   # score under which a prediction is flagged
CODE_SEED = 7
UND = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, bucket) of every byte trigram; non-letters of ASCII count as one blank."""
    coded = [t.encode("utf-8") for t in texts]
    size = np.array([len(c) + 2 for c in coded], dtype=np.int64)
    data = _FOLD[np.frombuffer(b"".join([b" " + c + b" " for c in coded]), dtype=np.uint8)]
    owner = np.repeat(np.arange(len(coded), dtype=np.int32), size)
    keep = np.ones(len(data), dtype=bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32) | (owner[1:] != owner[:-1])
    data, owner = data[keep].astype(np.uint32), owner[keep]
    if len(data) < 3:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
    whole = owner[2:] == owner[:-2]
    code = (data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:])[whole]
    bucket = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - 14)
    return owner[2:][whole], bucket.astype(np.int64)


def codewords(k: int) -> np.ndarray:
    """(k, bits) matrix of +1/-1; rows differ, no column is constant."""
    if k <= 1:
        return np.ones((k, 0))
    if k <= 5:
        splits = np.arange(1, 1 << (k - 1))
        bits = (splits[None, :] >> np.arange(k)[:, None]) & 1
    else:
        rng = np.random.default_rng(CODE_SEED)
        length = int(np.ceil(10 * np.log2(k)))
        while True:
            bits = rng.integers(0, 2, (k, length))
            if len(np.unique(bits, axis=0)) == k and (bits.min(0) < bits.max(0)).all():
                break
    return np.where(bits > 0, 1.0, -1.0)


class LanguageModel:
    """Languages, their codewords, and each bit's trigram weights."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        self.code = codewords(len(languages))
        weights = []
        for bit in self.code.T:
            plus, minus = counts[bit > 0].sum(axis=0) + SMOOTHING, counts[bit < 0].sum(axis=0) + SMOOTHING
            weights.append(np.log(plus / plus.sum()) - np.log(minus / minus.sum()))
        self.weights = np.array(weights, dtype=np.float64).reshape(self.code.shape[1], BUCKETS).T

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        names, scores = [UND] * n, np.zeros(n)
        if not self.languages:
            return names, scores
        owner, bucket = trigrams(texts)
        total = np.bincount(owner, minlength=n)
        margins = np.empty((n, self.code.shape[1]))
        for b in range(self.code.shape[1]):
            margins[:, b] = np.bincount(owner, weights=self.weights[bucket, b], minlength=n)
        # mean log odds, weighted by how much text there is, up to 100 trigrams
        margins *= (np.sqrt(np.minimum(total, 100)) / np.maximum(total, 1))[:, None]
        losses = np.logaddexp(0, -margins[:, None, :] * self.code[None]).sum(axis=2)
        losses -= losses.min(axis=1, keepdims=True)
        best = losses.argmin(axis=1)
        share = 1 / np.exp(-losses).sum(axis=1)
        for i, text in enumerate(texts):
            if any(map(str.isalpha, text)):
                names[i], scores[i] = self.languages[best[i]], share[i]
        return names, scores


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Count trigrams of all rows of ``labelled`` (null languages and texts aside)."""
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")
    languages = [r.lang for r in rows.select("lang").distinct().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()]
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    index = {lang: i for i, lang in enumerate(languages)}

    def run(batches):
        import pyarrow as pa

        counts = np.zeros(len(index) * BUCKETS, dtype=np.int64)
        for batch in batches:
            langs = np.array([index[x] for x in batch.column(0).to_pylist()], dtype=np.int64)
            owner, bucket = trigrams(batch.column(1).to_pylist())
            if len(owner):
                counts += np.bincount(langs[owner] * BUCKETS + bucket, minlength=len(counts))
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64())], names=["cell", "n"])

    counts = np.zeros(len(languages) * BUCKETS)
    if languages:
        found = rows.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
        counts[found["cell"].to_numpy(dtype=np.int64)] = found["n"].to_numpy()
    return LanguageModel(languages, counts.reshape(len(languages), BUCKETS))


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", kept: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``kept`` columns, lang_pred, score, ambiguous of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_LANGUAGES x BUCKETS numbers
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    names = [*kept, "lang_pred", "score", "ambiguous"]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            langs, scores = shared.value.predict(batch.column(batch.num_columns - 1).to_pylist())
            out = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(scores < AMBIGUOUS_BELOW, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *out], names=names)

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]], "lang_pred string, score double, ambiguous boolean"])
    return rows.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose language is ``und`` or ambiguous; all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_LANGUAGES x BUCKETS numbers
    position = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            langs, scores = shared.value.predict([t or "" for t in batch.column(position).to_pylist()])
            yield batch.filter(pa.array([lang != UND and score >= AMBIGUOUS_BELOW for lang, score in zip(langs, scores.tolist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 5, is 0 (a null id is held out)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))
