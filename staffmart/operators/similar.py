"""Approximate similarity join of vectors by hashed buckets.

Vectors are projected on random directions and cut into buckets of a width that belongs to the radius asked for. Several projections make
one key, several keys one vector's places; their number follows from the recall promised for a pair at the very radius, closer
pairs meet more surely. All pairs that meet are measured, so what is returned is right, and only misses are possible.

Copies collapse first: of equal vectors only the ``k`` least ids can be among anyone's ``k`` nearest, and equal queries are
asked once. In a crowded bucket blocks of either side meet in tasks that hand on ``k`` rows a query, so near copies don't multiply.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staffmart.operators.joins import lookup
from staffmart.operators.vectors import HIT_SCHEMA, TOP, Nearest, as_matrix
from staffmart.session import materialise

RECALL = 0.95  # of pairs as far apart as the radius
PROJECTIONS = 6  # of one key
WIDTH = 4.0  # of a bucket, in radii
CROWDED = 64  # different vectors of a bucket beyond which its sides meet in blocks
BLOCK_VECTORS, BLOCK_QUERIES = 20_000, 2_000
SEED = 17


def keys_needed(recall: float, projections: int = PROJECTIONS, width: float = WIDTH) -> int:
    """Keys after which two vectors one radius apart have met with probability ``recall``."""
    once = math.erf(width / math.sqrt(2)) - math.sqrt(2 / math.pi) / width * (1 - math.exp(-width * width / 2))
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - once**projections)))


def collapsed(rows: DataFrame, id_col: str, keep: int) -> DataFrame:
    """(node, ids, embedding) of every different vector: its least id, and its ``keep`` least ids in order."""
    rows = rows.select(F.col(id_col).cast("long").alias("id"), "embedding").where("id IS NOT NULL AND embedding IS NOT NULL")
    nth = F.row_number().over(Window.partitionBy("embedding").orderBy("id"))
    few = rows.withColumn("nth", nth).where(F.col("nth") <= keep)
    return few.groupBy("embedding").agg(F.min("id").alias("node"), F.sort_array(F.collect_list("id")).alias("ids"))


def placed(nodes: DataFrame, model, keys: int) -> DataFrame:
    """(key, node, embedding): every vector at each of its places."""
    hashed = model.transform(nodes.withColumn("vector", array_to_vector(F.col("embedding").cast("array<double>"))))
    bucket = F.transform("hashes", lambda h: vector_to_array(h)[0].cast("long"))
    hashed = hashed.select("node", "embedding", bucket.alias("buckets"))
    wide = F.transform(
        F.sequence(F.lit(0), F.lit(keys - 1)), lambda i: F.xxhash64(i, F.slice("buckets", i * PROJECTIONS + 1, F.lit(PROJECTIONS)))
    )
    return hashed.select(F.explode(wide).alias("key"), "node", "embedding")


def in_blocks(asked: DataFrame, held: DataFrame, crowded: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of every query in each block of vectors of a crowded bucket."""

    def dealt(rows: DataFrame, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("node"), F.col(own_n)).cast("int").alias(own)
        others = F.explode(F.sequence(F.lit(0), F.col(other_n) - 1)).alias(other)
        return lookup(rows, crowded, [("key", "in_key")], how="inner").select("key", mine, others, "node", "embedding")

    left = dealt(held, "v", "v_blocks", "q", "q_blocks").select("key", "v", "q", "node", "embedding")
    right = dealt(asked, "q", "q_blocks", "v", "v_blocks").select("key", "v", "q", "node", "embedding")

    def meet(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "distance": []})
        best = Nearest(queries["node"].to_numpy(np.int64), as_matrix(queries["embedding"]), k)
        for at in range(0, len(vectors), 2048):
            part = vectors.iloc[at : at + 2048]
            best.add(part["node"].to_numpy(np.int64), as_matrix(part["embedding"]))
        return best.hits()

    keys = ["key", "v", "q"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, HIT_SCHEMA)


def similar(queries: DataFrame, vectors: DataFrame, radius: float, k: int = TOP, recall: float = RECALL, crowd: int = CROWDED) -> DataFrame:
    """(query_id, vec_id, distance, rank): of the vectors within ``radius`` of each query the ``k`` nearest, ties by id.

    ``queries`` has query_id and embedding, ``vectors`` has vec_id and embedding. Rows without an id or a vector take no part.
    """
    spark = vectors.sparkSession
    asked = materialise(collapsed(queries.withColumnRenamed("query_id", "id"), "id", 1).drop("ids"), "similar-asked")
    held = materialise(collapsed(vectors.withColumnRenamed("vec_id", "id"), "id", k), "similar-held")
    first = held.select(F.size("embedding")).first()
    if first is None or not first[0]:
        return spark.createDataFrame([], f"{HIT_SCHEMA}, rank int")
    keys = keys_needed(recall)
    # The directions are unit vectors, so a projection is shorter than the vector by the root of the dimension.
    lsh = BucketedRandomProjectionLSH(
        inputCol="vector", outputCol="hashes", seed=SEED, numHashTables=keys * PROJECTIONS, bucketLength=WIDTH * radius / math.sqrt(first[0])
    )
    model = lsh.fit(held.limit(1).select(array_to_vector(F.col("embedding").cast("array<double>")).alias("vector")))
    asked_at = materialise(placed(asked, model, keys), "similar-asked-at")
    # Only buckets that a query is in matter.
    held_at = materialise(placed(held, model, keys).join(asked_at.select("key").distinct(), "key", "left_semi"), "similar-held-at")

    counts = held_at.groupBy(F.col("key").alias("in_key")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd)
    asking = asked_at.groupBy("key").agg(F.count(F.lit(1)).alias("m"))
    blocks = counts.join(asking, F.col("in_key") == F.col("key"))
    crowded = materialise(
        blocks.select("in_key", F.ceil(F.col("n") / BLOCK_VECTORS).cast("int").alias("v_blocks"), F.ceil(F.col("m") / BLOCK_QUERIES).cast("int").alias("q_blocks")),
        "similar-crowded",
    )
    sparse = [lookup(rows, crowded.select("in_key"), [("key", "in_key")], how="left_anti") for rows in (asked_at, held_at)]
    a = sparse[0].select("key", F.col("node").alias("query_id"), F.col("embedding").alias("q"))
    pairs = a.join(sparse[1], "key").select("query_id", F.col("node").alias("vec_id"), "q", "embedding").dropDuplicates(["query_id", "vec_id"])
    squares = F.zip_with("q", "embedding", lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2))
    distance = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))
    near = pairs.select("query_id", "vec_id", distance.alias("distance"))
    near = near.unionByName(in_blocks(asked_at, held_at, crowded, k)).where(F.col("distance") <= radius).dropDuplicates(["query_id", "vec_id"])

    # Every different vector stands for its least ids; k of those in order are enough.
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    near = near.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)
    ids = held.select(F.col("node").alias("held_node"), "ids")
    near = lookup(near, ids, [("vec_id", "held_node")], how="inner").select("query_id", "distance", F.explode("ids").alias("vec_id"))
    near = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    lists = near.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "distance"))).alias("hits"))
    # Equal queries have equal hits.
    nodes = asked.select("embedding", F.col("node"))
    named = lookup(nodes, lists, [("node", "query_id")], how="inner").select(F.xxhash64("embedding").alias("h"), "embedding", "hits")
    named = materialise(named.withColumnsRenamed({"embedding": "in_embedding", "h": "in_h"}), "similar-hits")
    all_queries = queries.where("query_id IS NOT NULL AND embedding IS NOT NULL").select("query_id", "embedding", F.xxhash64("embedding").alias("h"))
    found = lookup(all_queries, named, [("h", "in_h"), ("embedding", "in_embedding")], how="inner")
    return found.select("query_id", F.explode("hits").alias("hit")).select("query_id", "hit.vec_id", "hit.distance", "hit.rank")
