"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source is a stream of words (its documents in the order of their hashes) cut into blocks of equal size. A source's target fixes
exactly how many blocks are drawn (and how many words of the last one): whole passes over the source, and a part of one more. The tree
splits these quotas recursively among the output shards: each node gives its left half a multivariate-hypergeometric share of every
source's pass. A second tree splits the blocks that are not drawn. A shard so has a pool of every pass, a run of its blocks in the
order of a keyed permutation (a Feistel network with cycle walking), and draws its quota from its own pool: pools are disjoint, and the
quotas decide which blocks are taken. A shard orders what it took by a hash.

Rows learn their place from prefix sums over hash buckets; the driver only holds a row per source (sources x shards numbers).

Defined cases: null text has size 0; a null source is a source of its own, last in order; sources without words get target 0; rows of
size 0 are never taken; repeated rows are taken on their own account; an empty table gives an empty table; further columns are left
out unless named in `keep` (names with a leading underscore are reserved).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import pandas_udf

from .common import mix64

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block at least; blocks are larger where there would be more of them than exact draws allow.
BLOCK_WORDS, BLOCKS = 256, 1 << 28
SHARDS = 64
SEED = 20
#: Rows summed by one task at most, on average.
BUCKET_ROWS = 4_000
#: Rows that a task of the ranking gets, on average.
TASK_ROWS = 40_000
ROUNDS = 4
def targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Shares of `total` by weight, none above most * size: what a source can't take is shared anew by weight."""
    out, open_ = [0.0] * len(sizes), {i for i, n in enumerate(sizes) if n > 0}
    while open_:
        rest = total - sum(out[i] for i in range(len(sizes)) if i not in open_)
        unit = rest / sum(weights[i] for i in open_)
        above = {i for i in open_ if weights[i] * unit > most * sizes[i]}
        for i in above or open_:
            out[i] = most * sizes[i] if above else weights[i] * unit
        open_ -= above or open_
    return out


def split(quotas: Sequence[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Blocks of each source by shard, (sources, shards); shards' totals differ by one at most."""
    out = np.zeros((len(quotas), shards), np.int64)
    total = sum(quotas)
    edges = [total * i // shards for i in range(shards + 1)]

    def node(lo: int, hi: int, left: list[int]) -> None:
        if hi - lo == 1:
            out[:, lo] = left
            return
        mid, rng = (lo + hi) // 2, np.random.default_rng([seed, lo, hi])
        need, rest, share = edges[mid] - edges[lo], sum(left), []
        for q in left:
            got = int(rng.hypergeometric(q, rest - q, need)) if need else 0
            share.append(got)
            need, rest = need - got, rest - q
        node(lo, mid, share)
        node(mid, hi, [q - g for q, g in zip(left, share, strict=True)])

    if shards > 0 and len(quotas):
        node(0, shards, [int(q) for q in quotas])
    return out


def permuted(x: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Place of each x in a keyed permutation of 0..n-1: a balanced Feistel network over the next even power of two, until it is in range."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2).astype(float))).astype(np.uint64) + np.uint64(1)) // np.uint64(2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, open_ = x.astype(np.uint64), np.arange(len(x))
    while len(open_):
        h, m, k = half[open_], mask[open_], key[open_].astype(np.int64).view(np.uint64)
        left, right = out[open_] >> h, out[open_] & m
        for r in range(ROUNDS):
            left, right = right, left ^ (mix64(right + k + np.uint64(r * 0x9E3779B97F4A7C15 % (1 << 64))) & m)
        out[open_] = (left << h) | right
        open_ = open_[out[open_] >= n[open_].astype(np.uint64)]
    return out.astype(np.int64)


@pandas_udf(T.ArrayType(T.LongType()))
def places(first: pd.Series, last: pd.Series, blocks: pd.Series, key: pd.Series) -> pd.Series:
    """Place of each block first..last among the `blocks` whole ones of a source; a shorter one at its end keeps its place."""
    a, count, n = first.to_numpy(np.int64), (last - first + 1).to_numpy(np.int64), blocks.to_numpy(np.int64)
    rows = np.repeat(np.arange(len(a)), count)
    x = a[rows] + np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
    whole = x < n[rows]
    out = x.copy()
    out[whole] = permuted(x[whole], n[rows[whole]], key.to_numpy(np.int64)[rows[whole]])
    return pd.Series(np.split(out, np.cumsum(count)[:-1]) if len(a) else [], dtype=object)


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", cycle: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED, keep: Sequence[str] = ()) -> DataFrame:
    """One row per row of df: key, size, source_size, target, taken, spans (array of what is drawn) and `keep`.

    A span has pass, shard, draw (the block's place in the pass), order (its place in the shuffled shard), start (its first word in the
    text, from 0) and words. Weights repeat `cycle` over the sources by code point, null last; passes are 0 and up to most.
    """
    spark = df.sparkSession
    rows = df.select(
        F.col(key).alias("_key"),
        F.coalesce(F.col(source), F.lit("")).alias("_source"),
        F.col(source).isNull().alias("_none"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("_size"),
        F.xxhash64(F.col(key), F.col(text)).alias("_hash"),
        *[F.col(c).alias(f"_keep_{c}") for c in keep],
    )
    by = ["_source", "_none"]
    known = rows.groupBy(*by).agg(F.sum("_size").alias("size"), F.count("*").alias("n")).orderBy("_none", "_source").collect()
    sizes = [r["size"] for r in known]
    goals = targets(sizes, [cycle[i % len(cycle)] for i in range(len(known))], share * sum(sizes), most)
    block = max(block, -(-sum(sizes) // BLOCKS))
    passes = max(1, int(-(-most // 1)))
    # per source and pass: blocks drawn, blocks not drawn; a target ends within the last pass that draws any
    drawn, spared, parts = [], [], []
    for n, goal in zip(sizes, goals, strict=True):
        full, rest = divmod(min(round(goal), int(most * n)), max(1, n))
        a_pass, part = -(-n // block), -(-rest // block)
        some = [a_pass if p < full else part if p == full else 0 for p in range(passes)]
        drawn.append(some)
        spared.append([a_pass - d for d in some])
        parts.append((full, rest % block or block) if part else (-1, block))
    quotas = split([d for some in drawn for d in some], shards, seed).reshape(-1, passes, shards)
    others = split([d for some in spared for d in some], shards, seed + 1).reshape(-1, passes, shards)
    begins = np.cumsum(quotas + others, axis=2) - quotas - others
    planned = []
    for i, (r, goal, (cut_pass, part)) in enumerate(zip(known, goals, parts, strict=True)):
        # the last block drawn of the pass that the target ends in gives its first words only
        last = int(np.flatnonzero(quotas[i, cut_pass]).max()) if cut_pass >= 0 else 0
        cut = int(begins[i, cut_pass, last] + quotas[i, cut_pass, last]) - 1 if cut_pass >= 0 else -1
        planned.append((r["_source"], r["_none"], r["size"], goal, cut_pass, cut, part, begins[i].tolist(), quotas[i].tolist(), -(-r["n"] // BUCKET_ROWS)))
    plan = spark.createDataFrame(planned, "_source string, _none boolean, _total long, _target double, _cut_pass int, _cut long, _part long, _begins array<array<long>>, _quotas array<array<long>>, _buckets long")
    plan = F.broadcast(plan) if len(planned) * (16 * passes * shards + 200) <= 64 << 20 else plan

    rows = rows.join(plan.select(*by, "_buckets"), by).withColumn("_bucket", F.pmod("_hash", "_buckets"))
    sums = rows.groupBy(*by, "_bucket").agg(F.sum("_size").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy(*by, "_bucket").orderBy("_hash", "_key", "_size").rowsBetween(Window.unboundedPreceding, -1)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(r["n"] for r in known) // TASK_ROWS))
    dealt = rows.drop("_buckets").repartition(tasks, *by, "_bucket")
    placed = dealt.withColumn("_within", F.coalesce(F.sum("_size").over(within), F.lit(0))).join(sums, [*by, "_bucket"]).join(plan.drop("_buckets"), by)
    placed = placed.withColumn("_at", F.col("_first") + F.col("_within")).withColumns({"_b": F.expr(f"_at div {block}"), "_e": F.expr(f"(_at + greatest(_size, 1L) - 1) div {block}")})
    for p in range(passes):
        placed = placed.withColumn(f"_p{p}", places("_b", "_e", F.expr(f"_total div {block}"), F.xxhash64(F.lit(seed + 101 * p), *by)))
    spans = F.expr(f"""
      IF(_size = 0, array(), filter(transform(flatten(array({", ".join(f"transform(_p{p}, (d, i) -> named_struct('pass', {p}, 'block', _b + i, 'draw', d))" for p in range(passes))})),
          s -> named_struct('pass', s.pass, 'block', s.block, 'draw', s.draw, 'shard', size(filter(_begins[s.pass], e -> e <= s.draw)) - 1)),
        s -> s.draw - _begins[s.pass][s.shard] < _quotas[s.pass][s.shard]))""")
    cut = F.expr(f"""
      filter(transform(_spans, s -> named_struct(
        'pass', s.pass, 'shard', s.shard, 'draw', s.draw, 'order', xxhash64({seed}, _source, _none, s.pass, s.draw),
        'start', greatest(0L, s.block * {block} - _at),
        'words', least(_at + _size, s.block * {block} + IF(s.pass = _cut_pass AND s.draw = _cut, _part, {block})) - greatest(_at, s.block * {block}))), s -> s.words > 0)""")
    placed = placed.withColumn("_spans", spans).withColumn("_spans", cut)
    return placed.select(
        F.col("_key").alias(key),
        F.col("_size").alias("size"),
        F.col("_total").alias("source_size"),
        F.col("_target").alias("target"),
        F.expr("aggregate(_spans, 0L, (n, s) -> n + s.words)").alias("taken"),
        F.col("_spans").alias("spans"),
        *[F.col(f"_keep_{c}").alias(c) for c in keep],
    )


def shard_rows(mixed: DataFrame, key: str = "doc_id") -> DataFrame:
    """The mix itself: a row per drawn span, each shard's spans together and in its shuffled order."""
    return mixed.select(key, F.explode("spans").alias("s")).select(key, "s.*").repartition("shard").sortWithinPartitions("shard", "order", "start")


def mixed_texts(mixed: DataFrame, text: str = "text") -> DataFrame:
    """A row for each document and pass that took words of it, its text being these words (the whole text if all were taken)."""
    rows = mixed.withColumn("_pass", F.explode(F.expr("array_distinct(transform(spans, s -> s.pass))")))
    own = rows.withColumn("_own", F.expr("filter(spans, s -> s.pass = _pass)")).withColumn("_taken", F.expr("aggregate(_own, 0L, (n, s) -> n + s.words)"))
    words = F.expr(rf"regexp_extract_all({text}, r'{WORD}', 0)")
    part = F.expr("array_join(flatten(transform(array_sort(_own, (a, b) -> cast(a.start - b.start as int)), s -> slice(_words, cast(s.start + 1 as int), cast(s.words as int)))), ' ')")
    partial = own.withColumn("_words", F.when(F.col("_taken") < F.col("size"), words)).withColumn(text, F.when(F.col("_taken") < F.col("size"), part).otherwise(F.col(text)))
    return partial.drop("_pass", "_own", "_taken", "_words")
