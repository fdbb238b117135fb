"""Sharding by rendezvous hashing: each record goes to the shard whose weighted hash of the record's key is best.

The key and the shard list alone decide, so a new shard takes records only into itself and a removed one gives up only its own.
DataFrame functions only; the one shuffle carries keys and sizes, never texts.

Defined cases: a null text has the CRC of no bytes and size 16; a null key is a key of its own (all such rows share a shard); repeated
rows each get their own slot; an empty table gives an empty table; other columns, whatever their names, are left out of the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows ranked by one task at most, on average.
BUCKET_ROWS = 50_000


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Number of the shard with the least -ln(u) / weight, u being the hash of key and shard number in (0, 1]."""
    scored = [
        # 52 bits of the hash; ln(0) is kept out by the half added to it
        F.struct((-F.log((F.shiftrightunsigned(F.xxhash64(key, F.lit(f"shard-{i}")), 12).cast("double") + 0.5) / float(1 << 52)) / float(w)).alias("d"), F.lit(i).alias("i"))
        for i, w in enumerate(weights)
        if w > 0
    ]
    return F.array_min(F.array(*scored))["i"]


def shard(df: DataFrame, key: str = "doc_id", text: str = "text", weights: Sequence[float] = (1.0,) * 40, grown: Sequence[float] | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per row of df: the key, size, text_crc32, shard, slot (gapless from 0 in its shard) and grown_shard.

    grown is the weight list after adding a shard (default: one more shard of the last weight). Slots follow the hash of the key: rows
    are counted by (shard, hash bucket), the counts' running sum gives each bucket its first slot, and rows are ranked within buckets.
    """
    grown = [*weights, weights[-1]] if grown is None else grown
    rows = df.select(
        F.col(key).alias("_key"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 16).alias("_size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("_crc"),
        rendezvous(F.col(key), weights).alias("_shard"),
        rendezvous(F.col(key), grown).alias("_grown"),
    )
    total = df.count()
    buckets = max(1, -(-total // (bucket_rows * len(weights))))
    # the CRC and size in the bucket's hash spread rows that share a key
    rows = rows.withColumn("_hash", F.xxhash64("_key", "_crc", "_size")).withColumn("_bucket", F.pmod(F.col("_hash"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("_shard", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("_shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("_shard", "_bucket").orderBy("_hash", "_key", "_crc", "_size")
    ranked = rows.withColumn("_rank", F.row_number().over(within))
    return ranked.join(F.broadcast(first) if buckets * len(weights) <= 500_000 else first, ["_shard", "_bucket"]).select(
        F.col("_key").alias(key),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.col("_shard").cast("int").alias("shard"),
        (F.col("_first") + F.col("_rank") - 1).cast("long").alias("slot"),
        F.col("_grown").cast("int").alias("grown_shard"),
    )
