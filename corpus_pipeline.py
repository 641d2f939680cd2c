"""A training-corpus pipeline over ``documents``, part of the ``claimlake.llm`` subpackage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet in the shared folder and read again as the next stage's ``docs``.
All stages but the last return the columns of ``documents``.

Defined cases, stage by stage: a null, empty or letterless text has no
language and goes in the first stage, as does one that the classifier cannot tell;
so no later stage sees one.  Of a group of near copies the row of the smallest
doc_id stays; rows of equal doc_id are documents of their own, and of fully
equal rows one stays; a null doc_id is larger than any other.  A document is
dropped once, however many benchmark items it holds; an empty benchmark drops none.
Texts without secrets stay as they are; null lang, source and n_chars pass through.
Very long texts are read whole by every stage.  An empty table gives an empty
result with the columns of the last stage.  Further columns of ``documents`` pass
through all stages but the last; names that begin with two underscores are reserved.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlake.llm import byte_bpe, decontamination, jaccard_join, language_id, secrets
from claimlake.llm.common import configure, materialize, read_table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts whose language cannot be told (null, empty, letterless or ambiguous)."""
    configure(spark)
    return language_id.keep_identified(docs, language_id.train(docs.filter(~language_id.held_out())))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the smallest id, of each near-duplicate group."""
    configure(spark)
    return jaccard_join.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a passage of a benchmark item."""
    configure(spark)
    return decontamination.clean(docs, read_table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace credentials by a mark; n_chars follows the text."""
    configure(spark)
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the byte-level BPE ids of each text."""
    configure(spark)
    ids = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return ids.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("secrets", redact_secrets),
    ("byte_bpe", encode_tokens),
]

# no SQL says what the language classifier and BPE do: tests/llm holds the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the whole of ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
