"""F1 by postings: three-gram lists of the searched fields narrow the claims before ``LIKE`` looks at them.

A claim is found by its reference, its computer number, or its employee's NIC or name.  The
postings are kept in blocks of rows: for every three letters of a claim's own fields the
list of the block's claim ids, for those of an employee's fields the list of its employee numbers,
and for every number the claims that carry it.  A block's lists are built where its rows are
read, so what is sorted and written are lists, not a row for each gram of each claim.
Three letters in a row that a search term holds must stand in a field that it
matches, so a field without one of them is no candidate; ``LIKE`` then decides as
without postings.  Terms without three letters in a row (between wildcards) narrow nothing and search all claims.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ci, like_contains_pattern
from .common import checkpointed, is_small, restrict_to_keys
from .details import LITERAL_IDS
from .enrich import enrich_claims
from .search import SearchFilters, _php_trim, search_claims

GRAM = 3
POSTING = "gram string, field string, block long, ids array<int>, numbers array<string>"
# a block ends after so many rows, or so many letters
BLOCK_ROWS, BLOCK_LETTERS = 1 << 16, 1 << 20


def _gram_lists(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct three-grams of the texts in order, where each one's list begins (and the last ends), and the lists: places of texts."""
    sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    letters = np.frombuffer("".join(t or "" for t in texts.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    first = np.flatnonzero(np.arange(len(letters)) + GRAM <= np.cumsum(sizes)[owner])
    packed = letters[first] << 42 | letters[first + 1] << 21 | letters[first + 2]  # a letter has 21 bits
    found = np.unique(packed)
    code, place = np.divmod(np.unique(np.searchsorted(found, packed) * len(sizes) + owner[first]), max(1, len(sizes)))
    spelt = np.stack([found >> 42, found >> 21 & 0x1FFFFF, found & 0x1FFFFF], axis=1).astype("<u4").tobytes().decode("utf-32-le")
    return [spelt[i:i + GRAM] for i in range(0, len(spelt), GRAM)], np.searchsorted(code, np.arange(len(found) + 1)), place


def _blocks(batches: Iterator[pa.RecordBatch], fields: list[str], max_rows: int) -> Iterator[pa.Table]:
    held, rows, letters = [], 0, 0
    for whole in batches:
        for at in range(0, whole.num_rows, max_rows):
            batch = whole.slice(at, max_rows)
            if held and rows + batch.num_rows > max_rows:
                yield pa.Table.from_batches(held)
                held, rows, letters = [], 0, 0
            held.append(batch)
            rows += batch.num_rows
            letters += sum(pc.sum(pc.utf8_length(batch[f])).as_py() or 0 for f in fields)
            if rows >= max_rows or letters >= BLOCK_LETTERS:
                yield pa.Table.from_batches(held)
                held, rows, letters = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def _block_lists(rows: DataFrame, fields: list[str], keys: str, max_rows: int) -> DataFrame:
    """A row per gram, field and block of ``rows`` (_key and the fields in lower case); ``keys`` names the list column."""

    def build(batches):
        block = TaskContext.get().partitionId() << 32
        for part in _blocks(batches, fields, max_rows):
            key = part["_key"].combine_chunks()
            for field in fields:
                grams, starts, place = _gram_lists(part[field].combine_chunks())
                n = len(grams)
                lists = {"ids": pa.nulls(n, pa.list_(pa.int32())), "numbers": pa.nulls(n, pa.list_(pa.string()))}
                taken = key.take(pa.array(place)).cast(lists[keys].type.value_type)
                lists[keys] = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), taken)
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array([field] * n, pa.string()),
                                                  pa.array(np.full(n, block)), lists["ids"], lists["numbers"]],
                                                 names=["gram", "field", "block", "ids", "numbers"])
            block += 1

    return rows.mapInArrow(build, POSTING)


def postings(claims: DataFrame, employees: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """gram, field, block, ids (claims' fields and numbers) or numbers (employees' fields)."""
    ids = claims.where(F.col("r_id").isNotNull()).withColumn("_key", F.col("r_id").cast("int"))
    own = ["reference", "emp_computer_number"]
    staff = employees.withColumn("_key", ci("computer_number")).where(F.col("_key").isNotNull())
    fields = {"nic": F.col("nic"), "name": F.concat_ws(" ", "initials", "surname")}
    owner = ids.select(F.concat(F.lit("="), ci("emp_computer_number")).alias("gram"), F.lit("owner").alias("field"),
                       F.lit(None).cast("long").alias("block"), F.array("_key").alias("ids"), F.lit(None).cast("array<string>").alias("numbers"))
    return (_block_lists(ids.select("_key", *[F.lower(c).alias(c) for c in own]), own, "ids", block_rows)
            .unionByName(_block_lists(staff.select("_key", *[F.lower(c).alias(n) for n, c in fields.items()]), list(fields), "numbers", block_rows))
            .unionByName(owner.where(F.col("gram").isNotNull())))


def write_postings(claims: DataFrame, employees: DataFrame, path: str, block_rows: int = BLOCK_ROWS) -> None:
    """Stored by gram within each file, a common gram over several blocks: a lookup by gram reads few row groups."""
    rows = postings(claims, employees, block_rows)
    rows.sortWithinPartitions("gram", "field", "block").write.mode("overwrite").parquet(path)


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POSTING).parquet(path)


def term_grams(term: str) -> list[str]:
    """The three-grams that every match of a search term holds: those of its stretches without wildcards."""
    stretches, now, escaped = [], "", False
    for c in like_contains_pattern(term):
        if escaped:
            now, escaped = now + c, False
        elif c == "\\":
            escaped = True
        elif c in "%_":
            stretches.append(now)
            now = ""
        else:
            now += c
    stretches.append(now)
    return sorted({s[i:i + GRAM] for s in stretches for i in range(len(s) - GRAM + 1)})


def _matched(index: DataFrame, grams: list[str], fields: tuple, keys: str, out: str) -> DataFrame:
    """Keys (some repeated) with a field that holds all ``grams``: a block's lists are cut with each other."""
    hits = index.where(F.col("gram").isin(grams) & F.col("field").isin(list(fields)))
    if len(grams) > 1:  # each (gram, field, block) stands once
        hits = (hits.groupBy("field", "block").agg(F.collect_list(keys).alias("_lists")).where(F.size("_lists") == len(grams))
                .select(F.aggregate(F.slice("_lists", 2, len(grams) - 1), F.element_at("_lists", 1), F.array_intersect).alias(keys)))
    return hits.select(F.explode(keys).alias(out))


def search_text(index: DataFrame, claims: DataFrame, employees: DataFrame, divisions: DataFrame, statuses: DataFrame,
                filters: SearchFilters) -> DataFrame:
    """The enriched claims that ``filters`` find, as ``search_claims`` over all of them; ``index`` is read_postings."""
    grams = term_grams(_php_trim(filters.search)) if _php_trim(filters.search) else []
    if not grams:
        return search_claims(enrich_claims(claims, employees, divisions, statuses), filters)
    numbers = _matched(index, grams, ("nic", "name"), "numbers", "number").select(F.concat(F.lit("="), F.col("number")).alias("_gram"))
    owned = restrict_to_keys(index.where(F.col("field") == "owner"), F.col("gram"), numbers, "_gram").select(F.explode("ids").alias("r_id"))
    # looked up once: counted here and joined below
    ids = checkpointed(_matched(index, grams, ("reference", "emp_computer_number"), "ids", "r_id").unionByName(owned).distinct())
    few = [r[0] for r in ids.limit(LITERAL_IDS + 1).collect()]
    if len(few) <= LITERAL_IDS:
        found = claims.where(F.col("r_id").isin(few)) if few else claims.where(F.lit(False))
    else:
        found = restrict_to_keys(claims, F.col("r_id"), ids, "r_id", keys_small=is_small(ids))
    return search_claims(enrich_claims(found, employees, divisions, statuses), filters)
