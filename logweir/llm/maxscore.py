"""Exact top-k inner products over whole-number vectors, by MaxScore.

A term is a dimension; its postings in a shard are the vectors with a component other than zero there. What a term can add to a query's
score is bounded by the largest product in the shard (never below zero, as absent vectors add nothing). Terms in ascending order of
bounds are non-essential as long as their bounds together stay below the k-th best score known so far: a vector that only they hold can't
come among the best. The postings of the essential terms are traversed term by term; then the other terms are probed, largest bound first,
for the vectors that are still competitive, and those whose score can't reach the threshold any more leave. A vector is never scored
further than that, and all that remain are scored whole.

The index is dealt over tasks, each a shard or several one after another; a task keeps each query's best from shard to shard, so its
threshold rises. Thresholds begin with the k-th best score among a bounded sample of vectors (`seeds` rows), which is a score that k
vectors do reach. Queries come in blocks of bounded size, broadcast one after another; a task passes on k rows a query, and a window
merges them.

Defined cases: each row is a candidate and, if its id asks, a query of its own, also where ids repeat; rows without id are candidates and
come last among equal scores; a query with fewer candidates than k gets them all; vectors that are null or hold null or non-finite
components take no part, nor do those whose products could pass 64 bits (a norm of 2^31 or more after rounding down); an empty vector and
a zero vector score 0; components that a shorter vector lacks count as zero; other columns are not read; an empty table gives an empty
table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, written

#: Vectors of a shard, queries broadcast at once, and vectors whose scores give the first thresholds.
SHARD, BLOCK, SEEDS = 8192, 16384, 2048
#: Bytes that the numbers of a shard, of a block or of the sample take at most; wider vectors make them shorter.
BYTES = 32 << 20
#: A column is traversed in place if more than this share of it is asked for, else through its row numbers.
DENSE = 0.125
NONE = np.iinfo(np.int64).min


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers, filled up with zeros to the width."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


class Shard:
    """The postings of some vectors: a column of components per term, row numbers where few vectors hold it, and its extremes."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray):
        self.rows, self.ids = rows, ids
        self.columns = np.ascontiguousarray(x.T)
        self.high, self.low = np.maximum(x.max(0, initial=0), 0), np.minimum(x.min(0, initial=0), 0)
        self.norm = float(np.sqrt((x.astype(np.float64) ** 2).sum(1).max(initial=0.0)))
        self.held = [r if len(r := np.flatnonzero(c)) <= DENSE * len(ids) else None for c in self.columns]

    def best(self, row: int, q: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the k best vectors with a score of at least `least`, the query's own row left out."""
        terms = np.flatnonzero(q)
        # floats stand for bounds only; margins keep them above the exact sums, whatever the size of the scores they are added to
        slack = 1e-15 * self.norm * float(np.sqrt((q.astype(np.float64) ** 2).sum()))
        bound = np.maximum(q[terms] * self.high[terms].astype(np.float64), q[terms] * self.low[terms].astype(np.float64)) * (1 + 1e-9)
        order = np.argsort(bound, kind="stable")
        terms, bound = terms[order], bound[order]
        up = np.cumsum(bound)
        few = int(np.searchsorted(up, least, side="left")) if least > 0 else 0
        score, seen = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), bool)
        for t in terms[few:]:
            if (held := self.held[t]) is None:
                score += self.columns[t] * q[t]
                seen[:] = True
            else:
                score[held] += self.columns[t][held] * q[t]
                seen[held] = True
        if not few:
            seen[:] = True  # nothing is excluded: vectors without any of the terms score 0
        seen &= self.rows != row
        left = (up[few - 1] if few else 0.0) + slack
        alive = np.flatnonzero(seen & (score + left >= least))
        score = score[alive]
        for i in range(few - 1, -1, -1):
            if not len(alive):
                break
            t = terms[i]
            score += self.columns[t][alive] * q[t]
            left = (up[i - 1] if i else 0.0) + slack
            stay = score + left >= least
            if not stay.all():
                alive, score = alive[stay], score[stay]
        if len(alive) > 4 * k:  # ties at the k-th score stay
            stay = score >= np.partition(score, len(score) - k)[len(score) - k]
            alive, score = alive[stay], score[stay]
        top = np.lexsort((self.ids[alive], -score))[:k]
        return alive[top], score[top]


def whole(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """row (a number of its own), id and v (floor(scale * x) of each component) of the vectors that take part."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    good = F.col(vector).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < float(1 << 31)))
    v = F.transform(x, lambda c: F.floor(c * scale).cast("long"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    return df.where(good).select(F.col(key).cast("long").alias("id"), v.alias("v")).where(norm < float(1 << 62) * (1 - 1e-9)).withColumn("row", F.monotonically_increasing_id())


def search(df: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5, scale: int = 256, shard: int = SHARD, block: int = BLOCK, seeds: int = SEEDS) -> DataFrame:
    """query_id, rank (from 1), key, score: each query's k highest inner products. queries: a condition over the key column."""
    spark = df.sparkSession
    small_batches(spark)
    out = f"query_id long, rank int, `{key}` long, score long"
    rows = written(whole(df.select(F.col(key), F.col(vector)), key, vector, scale), "vectors")
    told = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    asking = rows.withColumn(key, F.col("id")).where(queries).select("row", "id", "v")
    if not told["n"]:
        return spark.createDataFrame([], out)
    width = told["width"]
    shard, block, seeds = (max(1, min(n, BYTES // (8 * max(1, width)))) for n in (shard, block, seeds))
    parts, blocks = max(1, -(-told["n"] // shard)), max(1, -(-asking.count() // block))
    index = written(rows.repartition(parts, "row"), "index")
    numbers = written(asking.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))), "queries")
    sample = index.orderBy(F.xxhash64("row"), "row").limit(seeds).toArrow()
    first, first_rows = matrix(sample["v"], width), sample["row"].to_numpy()
    found = []
    for b in range(blocks):  # each block meets all rows
        some = numbers.where(F.col("block") == b).toArrow()
        if not some.num_rows:
            continue
        found.append(written(index.mapInArrow(task(spark, some, first, first_rows, width, k, shard), "asked long, query_id long, id long, score long"), "found"))
    if not found:
        return spark.createDataFrame([], out)
    merged = found[0]
    for f in found[1:]:
        merged = merged.unionByName(f)
    order = Window.partitionBy("asked").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")


def task(spark, some: pa.Table, first: np.ndarray, first_rows: np.ndarray, width: int, k: int, shard: int):
    """The work of a task for a block of queries."""
    queries = matrix(some["v"], width)
    asked, names = some["row"].to_numpy(), some["id"].to_numpy()
    least = np.full(len(asked), NONE, np.int64)
    if len(first) > k:
        for i in range(len(asked)):
            scores = (first @ queries[i])[first_rows != asked[i]]
            least[i] = np.partition(scores, len(scores) - k)[len(scores) - k]
    shared = spark.sparkContext.broadcast((queries, asked, names, least))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, asked, names, least = shared.value
        kept_ids, kept_nulls, kept_scores = (np.zeros((len(asked), k), t) for t in (np.int64, bool, np.int64))
        kept_n, least = np.zeros(len(asked), np.int64), least.copy()

        def over(rows: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(rows)
            missing = table["id"].is_null().to_numpy()
            # rows in order of ids, those without one last, so that places break ties as ids do
            order = np.lexsort((table["id"].fill_null(0).to_numpy(), missing))
            ids, missing = table["id"].fill_null(0).to_numpy()[order], missing[order]
            own = Shard(table["row"].to_numpy()[order], np.arange(len(order)), matrix(table["v"], width)[order])
            for i in range(len(asked)):
                at, score = own.best(int(asked[i]), queries[i], k, int(least[i]))
                if not len(at):
                    continue
                n = kept_n[i]
                all_ids, all_nulls, all_scores = np.concatenate([kept_ids[i, :n], ids[at]]), np.concatenate([kept_nulls[i, :n], missing[at]]), np.concatenate([kept_scores[i, :n], score])
                top = np.lexsort((all_ids, all_nulls, -all_scores))[:k]
                n = kept_n[i] = len(top)
                kept_ids[i, :n], kept_nulls[i, :n], kept_scores[i, :n] = all_ids[top], all_nulls[top], all_scores[top]
                if n == k:
                    least[i] = max(least[i], kept_scores[i, k - 1])

        held, size = [], 0
        for b in batches:
            held.append(b.select(["row", "id", "v"]))
            size += b.num_rows
            if size >= shard:
                over(held)
                held, size = [], 0
        if size:
            over(held)
        for a in range(0, len(asked), 2048):
            mask = np.arange(k) < kept_n[a : a + 2048, None]
            times = mask.sum(1)
            ids = pa.array(kept_ids[a : a + 2048][mask], pa.int64(), mask=kept_nulls[a : a + 2048][mask])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked[a : a + 2048], times)), pa.array(np.repeat(names[a : a + 2048], times)), ids, pa.array(kept_scores[a : a + 2048][mask])], names=["asked", "query_id", "id", "score"])

    return searched
