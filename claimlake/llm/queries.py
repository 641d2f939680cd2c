"""The registered queries of the training-data operators.

Each takes (spark, sf_dir), applies its operator to the whole table and returns
the full result.  ``ORACLE`` holds DuckDB SQL where SQL can say the same.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import configure, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = oracle
        return run

    return wrap


@query("op1_token_files")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents, write frequency-ranked token files, read them back."""
    from .token_files import read_token_files, write_token_files

    manifest, id_of = write_token_files(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_token_files(manifest, id_of, digests=True)


@query("op4_byte_bpe")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of all documents, and the bytes they decode to, as digests."""
    from .byte_bpe import round_trip_digests

    return round_trip_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op3_secrets")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: base spans and linked weak ones."""
    from .secrets import scan

    return scan(read_table(spark, sf_dir, "documents"))


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from the rows outside the held-out fold."""
    from .language_id import held_out, predict, train

    docs = read_table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model, kept=("doc_id", "held_out"))


@query("op2_warc", oracle="""
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, b32 AS payload_digest,
           CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first_id THEN first_id END AS refers_to
    FROM (SELECT page_id, html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id,
                 (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST('0b' || substr(bits, 5 * g + 1, 5) AS INTEGER), 1), '' ORDER BY g)
                  FROM (SELECT CAST(from_hex(sha1(coalesce(html, ''))) AS BIT)::VARCHAR AS bits) d, range(32) t(g)) AS b32
          FROM pages)""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as WARC transactions, read the archives back and assemble them."""
    from .warc import assemble, capture_digests, read_warc, write_warc

    manifest = write_warc(read_table(spark, sf_dir, "pages"))
    return capture_digests(assemble(read_warc(manifest, payload=False)))


# fixed values: the rules of the URL query
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


@query("op8_url_filter")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the URL of every page: the longest rule's, else the word model's."""
    from .url_filter import judge

    return judge(read_table(spark, sf_dir, "pages"), URL_RULES)


@query("op6_permutation_index")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors found for every vec_id divisible by 100."""
    from .permutation_index import search

    return search(read_table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


@query("op10_decontamination")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified pairs of training documents and benchmark items."""
    from .decontamination import matches

    return matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query("op7_jaccard_join")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents by their word shingles."""
    from .jaccard_join import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op5_substring_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document that repeat 50-byte strings of documents with smaller ids."""
    from .substring_dedup import removal_summary

    return removal_summary(read_table(spark, sf_dir, "documents"))


@query("op11_importance_resampling")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents, drawn by their likeness to the benchmark."""
    from .importance_resampling import resample

    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query("op12_merkle_manifest")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle leaves, subroots and proofs of all documents; every fifth is checked with changed text."""
    from .merkle_manifest import manifest

    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return manifest(read_table(spark, sf_dir, "documents"), tampered=changed)


@query("op13_repeated_phrases")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document in passages of 20 words that occur earlier in the corpus."""
    from .repeated_phrases import removal_summary

    return removal_summary(read_table(spark, sf_dir, "documents"))
