"""Approximate nearest neighbours by a permutation index.

A vector is represented by its `prefix` nearest pivots in order. Each block of vectors posts them in inverted files, one per pivot, with
their places. A query walks the files of its own nearest pivots and adds up what shared pivots take off the footrule distance (the sum
of differences of places, absent pivots standing behind the prefix); the share of the block that is nearest by footrule is reranked by
exact inner products. Largest inner product becomes nearest angle by one more component, sqrt(M^2 - |x|^2), zero for queries.

All rows are indexed in blocks of bounded size and all queries, in blocks, meet all of them; only each block's best k travel on. Of
exactly equal vectors the k + 1 smallest ids suffice, as the others can't be among anyone's k nearest. Pivots are a bounded sample
(`pivots` distinct vectors, by hash).

Defined cases: vectors that are null, zero, of another than the most frequent dimension, or hold null or non-finite components, and
rows with a null id take no part; ties go to the smaller id; of repeated ids the row with the least vector counts; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIVOTS, PREFIX = 512, 64
#: Share of each block that is reranked, and its least number.
RERANK, LEAST = 0.08, 300
INDEX_BLOCK, QUERY_BLOCK = 8192, 1024


def prefixes(x: np.ndarray, pivots: np.ndarray, n: int) -> np.ndarray:
    """Indices of each row's n nearest pivots, nearest first."""
    s = x @ pivots.T
    some = np.argpartition(-s, n - 1, axis=1)[:, :n]
    near = np.take_along_axis(s, some, 1)
    return np.take_along_axis(some, np.lexsort((some, -near)), 1)


class Block:
    """Pivot inverted files of some vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, radius: float, pivots: np.ndarray, prefix: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x, self.pivots, self.prefix = ids[order], x[order], pivots, min(prefix, len(pivots))
        more = np.sqrt(np.maximum(0.0, radius * radius - (self.x * self.x).sum(1)))
        perm = prefixes(np.column_stack([self.x, more]), pivots, self.prefix)
        flat = perm.ravel()
        by = np.argsort(flat, kind="stable")
        rows, places = by // self.prefix, by % self.prefix
        edges = np.searchsorted(flat[by], np.arange(len(pivots) + 1))
        self.files = [(rows[a:b], (self.prefix - places[a:b]).astype(np.int32)) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def nearest(self, ids: np.ndarray, q: np.ndarray, k: int, share: float, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query id, ids, scores) of the best k found here."""
        perm = prefixes(np.column_stack([q, np.zeros(len(q))]), self.pivots, self.prefix)
        n = min(len(self.ids), max(least, int(np.ceil(share * len(self.ids)))))
        for i in range(len(q)):
            shared = np.zeros(len(self.ids), np.int32)
            for place, p in enumerate(perm[i]):
                rows, worth = self.files[p]
                shared[rows] += np.minimum(worth, self.prefix - place)  # footrule = constant - 2 * shared
            rows = np.argsort(-shared, kind="stable")[:n] if n < len(shared) else np.arange(len(shared))
            rows = rows[self.ids[rows] != ids[i]]
            score = (self.x[rows] * q[i]).sum(1)
            best = np.lexsort((self.ids[rows], -score))[:k]
            yield int(ids[i]), self.ids[rows[best]], score[best]


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def search(df: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, pivots: int = PIVOTS, prefix: int = PREFIX, share: float = RERANK, least: int = LEAST, index_block: int = INDEX_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), key, score: each query's k nearest found. queries: a condition over the key column."""
    spark = df.sparkSession
    usable = F.exists(vector, lambda v: v.cast("double") != 0) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    rows = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).where(usable).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), queries.alias("asks"))
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    out = "query_id long, rank int, id long, score double"
    if dims is None:
        return spark.createDataFrame([], out).withColumnRenamed("id", key)
    rows = rows.where(F.size("v") == dims["d"]).groupBy("id").agg(F.min(F.struct("v", "asks")).alias("own")).select("id", "own.*")
    radius, total, asked = rows.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))), F.count("*"), F.count_if("asks")).first()
    chosen = rows.select("v", F.xxhash64("v").alias("h")).dropDuplicates(["v"]).orderBy("h").limit(pivots).collect()
    centre = np.array([r["v"] for r in chosen], np.float64)
    centre = np.column_stack([centre, np.sqrt(np.maximum(0.0, radius * radius - (centre * centre).sum(1)))])
    shared = spark.sparkContext.broadcast(centre)

    first = Window.partitionBy("v").orderBy("id")
    index = rows.select("id", "v").withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    index_blocks, query_blocks = max(1, -(-total // index_block)), max(1, -(-asked // query_block))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.select(F.pmod(F.xxhash64("id"), F.lit(index_blocks)).cast("int").alias("ib"), "id", "v").select("*", spread(query_blocks).alias("qb"))
    right = rows.where("asks").select(F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int").alias("qb"), "id", "v").select("*", spread(index_blocks).alias("ib"))

    def found(vectors: pa.Table, asking: pa.Table) -> pa.Table:
        names = ["query_id", "id", "score"]
        if not vectors.num_rows or not asking.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        block = Block(vectors["id"].to_numpy(), matrix(vectors["v"]), radius, shared.value, prefix)
        got = list(block.nearest(asking["id"].to_numpy(), matrix(asking["v"]), k, share, least))
        return pa.table([pa.array(np.repeat([g[0] for g in got], [len(g[1]) for g in got]), pa.int64()), pa.array(np.concatenate([g[1] for g in got]), pa.int64()), pa.array(np.concatenate([g[2] for g in got]), pa.float64())], names=names)

    near = left.groupBy("ib", "qb").cogroup(right.groupBy("ib", "qb")).applyInArrow(found, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), F.col("id").alias(key), "score")
