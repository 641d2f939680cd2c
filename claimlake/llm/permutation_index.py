"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its ``NEAREST`` nearest pivots.  Inverted
files list for each pivot the vectors that have it, with its place in their
order.  A query reads the files of its own pivots and ranks vectors by the
footrule distance of the two (cut) orders; the best ``candidate share`` of each
block are reranked by their exact Euclidean distance.

Equal vectors are one entry of the index that keeps its smallest ids (as many as
can be asked for), so a vector that a third of all rows have costs one entry.
Index entries are dealt to blocks of about ``BLOCK_ROWS`` by their hash, queries to
blocks of ``QUERY_ROWS``; each pair of blocks is one group with bounded memory,
and every query meets every block.  Only the pivots, a bounded sample by hash
order, pass through the driver.

Defined cases: rows without id and vectors that are null, empty, zero or hold
null or non-finite components take no part; so do vectors whose length is not
the most common one (ties: the smaller); repeated rows (equal id and vector)
count once; rows of one id with different vectors are candidates each, and as
queries share their id's answer; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

PIVOTS = 128
NEAREST = 48
CANDIDATE_SHARE = 0.2
LEAST_CANDIDATES = 500
BLOCK_ROWS = 8192
QUERY_ROWS = 2048


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v of the rows that take part, repeated rows once."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).filter("vec_id is not null and v is not null").filter(fine)
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.filter(F.size("v") == (sizes[0].n if sizes else 0)).distinct()


def entries(rows: DataFrame, k: int) -> DataFrame:
    """v, ids: distinct vectors, each with its k + 1 smallest ids."""
    place = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))
    return rows.withColumn("place", place).filter(F.col("place") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _matrix(column) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64).reshape(len(column), -1)


def pivot_order(vectors: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """(rows, nearest) pivots of each vector, nearest first, ties to the smaller pivot."""
    d = (vectors ** 2).sum(1)[:, None] - 2 * vectors @ pivots.T + (pivots ** 2).sum(1)[None]
    return np.argsort(d, axis=1, kind="stable")[:, :nearest]


class Block:
    """The inverted files of one block of vectors."""

    def __init__(self, vectors: np.ndarray, ids: list[list[int]], pivots: np.ndarray, nearest: int):
        self.vectors, self.ids, self.nearest = vectors, ids, nearest
        order = pivot_order(vectors, pivots, nearest)
        flat = order.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        ends = np.cumsum(np.bincount(flat, minlength=len(pivots)))
        self.files = [(at // nearest, at % nearest) for at in np.split(by_pivot, ends[:-1])]  # (vector, place in its order)

    def search(self, query: np.ndarray, order: np.ndarray, own: int, k: int, share: float) -> list[tuple[float, int]]:
        """The k nearest of the candidates, as (distance, id).

        With places 0 to m-1 and m for an absent pivot, the footrule distance is
        m(m+1) less 2(m - max(place, place')) for each shared pivot.
        """
        closeness = np.zeros(len(self.vectors), dtype=np.int64)
        for place, pivot in enumerate(order):
            vectors, places = self.files[pivot]
            closeness[vectors] += 2 * (self.nearest - np.maximum(places, place))
        n = max(LEAST_CANDIDATES, int(share * len(closeness)))
        found = np.argpartition(-closeness, n - 1)[:n] if n < len(closeness) else np.arange(len(closeness))
        distance = np.sqrt(((self.vectors[found] - query) ** 2).sum(axis=1))
        if len(found) > k + 1:
            bound = np.partition(distance, k)[k]
            found, distance = found[distance <= bound], distance[distance <= bound]
        return sorted((d, i) for d, f in zip(distance.tolist(), found.tolist()) for i in self.ids[f] if i != own)[:k]


def search(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS,
           nearest: int = NEAREST, share: float = CANDIDATE_SHARE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row that ``is_query`` (a condition on vec_id) holds for."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    index = materialize(entries(rows, k), "permutation-index")
    chosen = [r.v for r in index.orderBy(F.xxhash64("v"), "v").limit(pivots).select("v").collect()]  # at most ``pivots`` rows
    sample = spark.sparkContext.broadcast(np.array(chosen, dtype=np.float64))
    m = min(nearest, len(chosen))
    queries = rows.filter(is_query)
    blocks = max(1, -(-index.count() // block_rows))
    query_blocks = max(1, -(-queries.count() // QUERY_ROWS))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = index.select(F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int").alias("ib"), every(query_blocks, "qb"), "v", "ids")
    right = queries.select(F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int").alias("qb"), every(blocks, "ib"), "vec_id", "v")

    def run(index_rows, query_rows):
        import pyarrow as pa

        out = []
        if index_rows.num_rows and query_rows.num_rows:
            block = Block(_matrix(index_rows.column("v")), index_rows.column("ids").to_pylist(), sample.value, m)
            asked = _matrix(query_rows.column("v"))
            orders = pivot_order(asked, sample.value, m)
            for own, query, order in zip(query_rows.column("vec_id").to_pylist(), asked, orders):
                out += [(own, i, d) for d, i in block.search(query, order, own, k, share)]
        columns = list(zip(*out)) or [(), (), ()]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    found = left.groupBy("ib", "qb").cogroup(right.groupBy("ib", "qb")).applyInArrow(run, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
