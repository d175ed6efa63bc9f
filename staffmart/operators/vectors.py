"""Exact nearest-neighbour retrieval over given vectors."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staffmart.session import materialise, store

TOP = 3
# Queries that travel to the vectors at once, and a task's table of their products with a slice of vectors.
BLOCK_BYTES = 32 << 20
MEETING_BYTES = 32 << 20
# Relative error allowed for products; what lies within it is measured exactly.
ROUNDING = 1e-11

HIT_SCHEMA = "query_id long, vec_id long, distance double"


def build_index(vectors: DataFrame, path: str) -> DataFrame:
    """An exact index is the stored vector table."""
    return store(vectors, path)


def as_matrix(vectors: Iterable) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def distances(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Euclidean distance of each query to the vector in the same row."""
    return np.sqrt(((vectors - queries) ** 2).sum(axis=1))


class Nearest:
    """The ``k`` nearest vectors so far of each of a block of queries; memory is k per query."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.squares = (queries**2).sum(axis=1)
        self.distance = np.full((len(ids), k), np.inf)
        self.vec_id = np.full((len(ids), k), np.iinfo(np.int64).max)

    def add(self, vec_ids: np.ndarray, vectors: np.ndarray) -> None:
        """Products of both sides tell which pairs can matter; those are measured exactly and ranked."""
        squares = (vectors**2).sum(axis=1)
        about = self.squares[:, None] + squares[None, :] - 2 * (self.queries @ vectors.T)
        slack = ROUNDING * (self.squares[:, None] + squares[None, :]) + np.finfo(float).tiny
        limit = np.minimum(self.distance[:, -1] ** 2, np.inf)
        if len(vec_ids) >= self.k:
            upper = np.partition(about + slack, self.k - 1, axis=1)[:, self.k - 1]
            limit = np.minimum(limit, upper)
        query, place = np.nonzero(about - slack <= (limit * (1 + ROUNDING))[:, None])
        if not len(query):
            return
        found = distances(self.queries[query], vectors[place])
        every = np.concatenate((query, np.repeat(np.arange(len(self.ids)), self.k)))
        far = np.concatenate((found, self.distance.ravel()))
        who = np.concatenate((vec_ids[place], self.vec_id.ravel()))
        order = np.lexsort((who, far, every))
        every = every[order]
        nth = np.arange(len(every)) - np.searchsorted(every, every)
        best = order[nth < self.k]
        self.distance, self.vec_id = far[best].reshape(-1, self.k), who[best].reshape(-1, self.k)

    def hits(self) -> pd.DataFrame:
        found = np.isfinite(self.distance)
        rows = np.broadcast_to(self.ids[:, None], found.shape)
        return pd.DataFrame({"query_id": rows[found], "vec_id": self.vec_id[found], "distance": self.distance[found]})


def ranked(candidates: DataFrame, k: int) -> DataFrame:
    """Best ``k`` per query out of the candidates of all tasks (a few rows per query and task)."""
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def scan_block(spark, ids: np.ndarray, matrix: np.ndarray, vectors: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest vectors of one block of queries in every task's share of the vectors."""
    block = spark.sparkContext.broadcast((ids, matrix))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = Nearest(*block.value, k)
        rows = max(1, MEETING_BYTES // (8 * max(1, len(best.ids))))
        for batch in batches:
            batch = batch[batch["embedding"].notna()]
            for at in range(0, len(batch), rows):
                part = batch.iloc[at : at + rows]
                best.add(part["vec_id"].to_numpy(dtype=np.int64), as_matrix(part["embedding"]))
        yield best.hits()

    return vectors.select("vec_id", "embedding").mapInPandas(scan, HIT_SCHEMA)


def knn(queries: DataFrame, vectors: DataFrame, k: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Exact ``k`` nearest vectors (Euclidean, ties by id) of every query; rows without a vector take no part.

    ``queries`` has query_id and embedding, ``vectors`` has vec_id and embedding. Blocks of queries of at most ``block_bytes``
    go to the vectors, one scan of the vectors a block; each task hands on ``k`` rows per query, whatever the number of
    vectors or of copies among them. Blocks are dealt by a hash of the id, so the driver holds one at a time.
    """
    spark = vectors.sparkSession
    asked = queries.select("query_id", "embedding").where(F.col("embedding").isNotNull())
    asked = materialise(asked, "queries")
    size = asked.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    blocks = max(1, -(-size[0] * 8 * (size[1] or 0) // block_bytes))
    if blocks > 1:
        asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        asked = materialise(asked.repartition(blocks, "block").sortWithinPartitions("block"), "query-blocks")
    found = None
    for number in range(blocks):
        held = (asked.where(F.col("block") == number) if blocks > 1 else asked).select("query_id", "embedding").toArrow()
        if not held.num_rows:
            continue
        matrix = as_matrix(held["embedding"].to_numpy())
        hits = scan_block(spark, held["query_id"].to_numpy().astype(np.int64), matrix, vectors, k)
        if blocks > 1:
            hits = materialise(ranked(hits, k), "hits")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return ranked(spark.createDataFrame([], HIT_SCHEMA), k)
    return found if blocks > 1 else ranked(found, k)
