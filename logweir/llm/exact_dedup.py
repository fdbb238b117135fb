"""Exact deduplication by composable polynomial fingerprints.

A text's fingerprint is the value of its normalised UTF-8 bytes as a polynomial, modulo two primes. Chunks are hashed apart and
combined by length-shifted arithmetic, h(ab) = h(a) * base^len(b) + h(b), so a huge text needs one chunk in memory. Rows with equal
fingerprint and length are then compared for real, chunk by chunk: each distinct chunk of a group is kept once per task, and a group
in which some chunk has two variants is told apart by its digests. Only keys are shuffled for rows whose fingerprint is unique.

Defined cases: null counts as the empty text; equal rows keep exactly one row (of equal doc_ids, any one); an empty table gives an
empty table; further columns are ignored, and kept_rows returns them whatever their names. Null doc_ids sort last, so they stay only if all ids of the group are null.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, WHITE, freed, small_batches, text_bytes, written

PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_000_003, 998_244_353)
CHUNK_BYTES = 1 << 16
#: Partial groups per fingerprint: one group of copies is counted by this many tasks.
SALTS = 64


def powers(base: int, prime: int, n: int) -> np.ndarray:
    """base^(n-1) .. base^0 modulo prime, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        step = np.uint64(pow(base, len(out), prime))
        out = np.concatenate([(out * step) % np.uint64(prime), out])
    return out[len(out) - n :]


def combine(left: int, right: int, right_length: int, base: int, prime: int) -> int:
    """Fingerprint of two joined byte strings from theirs."""
    return (left * pow(base, right_length, prime) + right) % prime


def fingerprint(raw: np.ndarray, base: int, prime: int, table: np.ndarray, chunk: int) -> int:
    """Fingerprint of bytes; each byte counts one more than its value, so that leading zeros matter."""
    h = 0
    for at in range(0, len(raw), chunk):
        part = raw[at : at + chunk]
        # products stay below 2^40 and a chunk has at most 2^16 of them
        own = int(((part.astype(np.uint64) + np.uint64(1)) * table[len(table) - len(part) :]).sum() % np.uint64(prime))
        h = combine(h, own, len(part), base, prime)
    return h


def fingerprints(column: pa.Array, primes: Sequence[int], chunk: int) -> pa.Array:
    """One 64-bit fingerprint per row: both remainders side by side."""
    raw, off = text_bytes(column)
    out = np.zeros(len(off) - 1, np.int64)
    tables = [powers(b, p, chunk) for b, p in zip(BASES, primes, strict=True)]
    for i in range(len(out)):
        own = raw[off[i] : off[i + 1]]
        a, b = (fingerprint(own, base, p, t, chunk) for base, p, t in zip(BASES, primes, tables, strict=True))
        out[i] = (a << 31) | b
    return pa.array(out)


def normalised(text: str):
    """The compared form: null as empty, each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WHITE, " ")


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", primes: Sequence[int] = PRIMES, chunk: int = CHUNK_BYTES) -> DataFrame:
    """One row per row of df: key, keep_id, group_size, kept, text_sha256."""
    spark = df.sparkSession
    small_batches(spark)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), fingerprints(b.column(4), primes, chunk)], names=["k", "h", "n_bytes", "sha", "fp"])

    # rows are found again by key and a hash of their text, so rows of one key (or without any) don't meet each other's texts
    source = df.select(F.col(key).alias("k"), normalised(text).alias("t")).withColumn("h", F.xxhash64("t"))
    slim = source.select("k", "h", F.octet_length("t").cast("long").alias("n_bytes"), F.sha2(F.col("t").cast("binary"), 256).alias("sha"), "t")
    kind = dict(source.dtypes)["k"]
    slim = slim.mapInArrow(freed(hashed), f"k {kind}, h long, n_bytes long, sha string, fp long").withColumn("rid", F.monotonically_increasing_id())
    slim = written(slim, "fingerprints")
    salt = F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int")
    # groups are counted per salt first, so a group of copies of any size meets in few rows
    parts = written(slim.groupBy("fp", "n_bytes", salt.alias("salt")).agg(F.count("*").alias("c")), "counts")
    repeated = parts.groupBy("fp", "n_bytes").agg(F.sum("c").alias("c")).where("c > 1").select("fp", "n_bytes")
    spread = written(parts.join(repeated, ["fp", "n_bytes"], "left_semi").select("fp", "n_bytes", "salt"), "repeated")
    members = written(slim.withColumn("salt", salt).join(spread, ["fp", "n_bytes", "salt"], "left_semi").select("k", "h", "fp", "n_bytes", "sha", "rid"), "members")

    # the real comparison, over members only
    count = members.count()
    ids = members.select(F.col("k").alias("k2"), F.col("h").alias("h2"), "fp", "n_bytes").distinct()
    ids = F.broadcast(ids) if count * 100 <= BROADCAST_BYTES else ids
    seen = source.join(ids, (F.col("h") == F.col("h2")) & F.col("k").eqNullSafe(F.col("k2"))).select("fp", "n_bytes", "t").where(F.octet_length("t") == F.col("n_bytes"))
    # bytes are bound once, so that a text of any length is cut in one pass
    cut = f"transform(array(cast(t as binary)), b -> transform(sequence(0, greatest(0, (octet_length(b) - 1) div {chunk})), i -> substring(b, cast(i * {chunk} + 1 as int), {chunk})))[0]"
    pieces = seen.select("fp", "n_bytes", F.posexplode(F.expr(cut)).alias("no", "piece"))
    variants = pieces.groupBy("fp", "n_bytes", "no", "piece").agg(F.lit(1).alias("one"))
    # a row met by the hash of another text can add variants: that only sends its group to the digest comparison below
    clashes = variants.groupBy("fp", "n_bytes", "no").agg(F.count("*").alias("v")).where("v > 1").select("fp", "n_bytes").distinct()
    clashes = written(clashes, "clashes")

    marked = members.join(clashes.withColumn("clash", F.lit(True)), ["fp", "n_bytes"], "left")
    marked = marked.withColumn("class", F.when(F.col("clash"), F.col("sha"))).select("k", "fp", "n_bytes", "sha", "rid", "class", salt.alias("salt"))
    order = F.struct(F.col("k").isNull().alias("z"), F.col("k").alias("k"), F.col("rid").alias("rid"))
    by = ["fp", "n_bytes", F.coalesce("class", F.lit("")).alias("class")]
    some = written(marked.groupBy(*by, "salt").agg(F.count("*").alias("c"), F.min(order).alias("first")), "partial-groups")
    whole = some.groupBy("fp", "n_bytes", "class").agg(F.sum("c").alias("group_size"), F.min("first").alias("first"))
    told = some.select("fp", "n_bytes", "class", "salt").join(whole, ["fp", "n_bytes", "class"])
    grouped = marked.withColumn("class", F.coalesce("class", F.lit(""))).join(told, ["fp", "n_bytes", "class", "salt"])
    grouped = grouped.select("rid", F.col("first")["k"].alias("keep"), "group_size", (F.col("first")["rid"] == F.col("rid")).alias("kept"))
    out = slim.join(grouped, "rid", "left")
    return out.select(
        F.col("k").alias(key),
        F.when(F.col("group_size").isNull(), F.col("k")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce("kept", F.lit(True)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def kept_rows(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df that stay, with all columns: of rows that share key and text, any one."""
    told = written(dedup(df, key, text), "told")
    # the row travels in a column of its own, so that no name of df clashes
    marked = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(key).alias("k"), F.sha2(normalised(text).cast("binary"), 256).alias("s"))
    pairs = told.groupBy(F.col(key).alias("k2"), F.col("text_sha256").alias("s2")).agg(F.count("*").alias("n"), F.max("kept").alias("stays"))
    pairs = written(pairs.where("not stays or n > 1"), "pairs")
    n = pairs.count()
    pairs = F.broadcast(pairs) if n * 120 <= BROADCAST_BYTES else pairs
    joined = marked.join(pairs, F.col("k").eqNullSafe(F.col("k2")) & (F.col("s") == F.col("s2")), "left")
    once = joined.where("n is null").select("row.*")
    if not n:
        return once
    return once.unionByName(joined.where("stays and n > 1").dropDuplicates(["k2", "s2"]).select("row.*"))
