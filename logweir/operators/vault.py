"""The vault: raw bytes in checked, compressed blocks of about 1 MiB, addressed by locators.

Blocks are rows of a Parquet table partitioned by segment. A record's block follows from the running sum of bytes before it, so blocks
fill side by side; locators are given out after packing and never go stale. A read opens each block that is asked for once, where the
distinct places asked of it meet it, and only the bytes asked for leave.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import os
import zlib

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written
from .order import before, dealt, number

SCHEME = "weir"
BLOCK_BYTES, SEGMENT_BYTES, LEVEL = 1 << 20, 64 << 20, 3
# fixed values: flags of a block
ENCRYPTED, ZSTD = 1, 2
BLOCKS = "seg int, block int, ulen long, clen long, crc long, flags int, payload binary"


def key_of(passphrase: str, salt: bytes) -> bytes:
    """256-bit key of a passphrase."""
    return hashlib.scrypt(passphrase.encode(), salt=salt, n=1 << 14, r=8, p=1, dklen=32)


def key_in(into, passphrase: str) -> bytes:
    """The key of a lake's vault: from its salt, which the first run draws and stores beside the vault together with a check of the key.
    A passphrase that doesn't fit the check is refused."""
    fs, at = into.located(f"{into.path}/_vault_key.json")
    if fs.exists(at):
        stream = fs.open(at)
        try:
            stored = json.loads(into.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        key = key_of(passphrase, bytes.fromhex(stored["salt"]))
        if not hmac.compare_digest(check_of(key), stored["check"]):
            raise ValueError("the passphrase doesn't fit this vault")
        return key
    salt = os.urandom(16)
    key = key_of(passphrase, salt)
    out = fs.create(at, False)
    try:
        out.write(bytearray(json.dumps({"salt": salt.hex(), "check": check_of(key)}).encode()))
    finally:
        out.close()
    return key


def check_of(key: bytes) -> str:
    return hmac.new(key, b"vault", hashlib.sha256).hexdigest()


def locator(seg: Column, block: Column, off: Column, length: Column, scheme: str = SCHEME) -> Column:
    return F.format_string(f"{scheme}:raw:%d:%d:%d:%d", seg, block, off, length)


def parse_locator(text: Column) -> Column:
    """seg, block, off, len of a locator; the short form without a block means block 0; null if it is none."""
    p = F.split(text, ":")
    short = F.size(p) == 5
    n = lambda i: F.get(p, F.lit(i)).try_cast("long")
    seg, block = n(2), F.when(short, F.lit(0)).otherwise(n(3))
    off, length = F.when(short, n(3)).otherwise(n(4)), F.when(short, n(4)).otherwise(n(5))
    good = F.size(p).isin(5, 6) & (F.get(p, F.lit(1)) == "raw") & seg.isNotNull() & off.isNotNull() & length.isNotNull()
    return F.when(good, F.struct(seg.cast("int").alias("seg"), block.cast("int").alias("block"), off.alias("off"), length.cast("int").alias("len")))


def place(df: DataFrame, order: str = "line_no", source: str = "source", raw: str = "raw_bytes", first_segment: int = 0, block_bytes: int = BLOCK_BYTES, segment_bytes: int = SEGMENT_BYTES, sequence: int | None = None) -> DataFrame:
    """Adds seg, block, off, len, locator and raw_sha256; with sequence, also a column of that name with consecutive numbers from it on.

    Records are dealt by ranges of (source, order); where one begins is the sum of all lengths before it, within its range and over
    earlier ranges. Records of a block may lie in several ranges: for the block in which a range begins, its first record is looked up.
    """
    ranged = dealt(df.withColumn("len", F.octet_length(raw)), source, order)
    firsts = written(before(ranged, _first="len", _rows=F.lit(1)), "firsts")  # a row a range
    within = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    begins = lambda rows: rows.join(F.broadcast(firsts), "_range").withColumn("_byte", F.col("_first") + F.coalesce(F.sum("len").over(within), F.lit(0))).withColumn("_block", F.floor(F.col("_byte") / block_bytes).cast("long"))
    shared = firsts.select(F.floor(F.col("_first") / block_bytes).cast("long").alias("_block")).distinct()
    opened = begins(ranged.select("_range", "_at", "len")).join(F.broadcast(shared), "_block", "left_semi").groupBy("_block").agg(F.min("_byte").alias("_open"))
    per = segment_bytes // block_bytes
    rows = begins(ranged).withColumn("_own", F.min("_byte").over(Window.partitionBy("_range", "_block"))).join(F.broadcast(opened), "_block", "left")
    # offsets count from the first record that starts in the block
    rows = rows.withColumn("off", F.col("_byte") - F.coalesce("_open", "_own"))
    rows = rows.withColumn("seg", (F.lit(first_segment) + F.floor(F.col("_block") / per)).cast("int")).withColumn("block", F.pmod("_block", F.lit(per)).cast("int"))
    rows = rows.withColumn("locator", locator(F.col("seg"), F.col("block"), F.col("off"), F.col("len"))).withColumn("raw_sha256", F.sha2(raw, 256))
    if sequence is not None:
        rows = rows.withColumn("sequence", number(F.col("_rows"), sequence))
    return rows.drop("_range", "_at", "_first", "_rows", "_byte", "_block", "_own", "_open")


def blocks(placed: DataFrame, raw: str = "raw_bytes", key: bytes | None = None) -> DataFrame:
    """The block table of placed records."""

    def sealed(table: pa.Table) -> pa.Table:
        table = table.sort_by("off")
        data = b"".join(table["raw"].to_pylist())
        packed = zstandard.ZstdCompressor(level=LEVEL).compress(data)
        return pa.table({"seg": table["seg"][:1], "block": table["block"][:1], "ulen": pa.array([len(data)], pa.int64()), "clen": pa.array([len(packed)], pa.int64()), "crc": pa.array([zlib.crc32(data)], pa.int64()), "flags": pa.array([ZSTD], pa.int32()), "payload": pa.array([packed], pa.binary())})

    out = placed.select("seg", "block", "off", F.col(raw).alias("raw")).groupBy("seg", "block").applyInArrow(sealed, BLOCKS)
    if key is None:
        return out
    sealed_ = F.aes_encrypt("payload", F.lit(key), F.lit("GCM"))
    return out.withColumn("payload", sealed_).withColumns({"clen": F.octet_length("payload").cast("long"), "flags": (F.col("flags").bitwiseOR(ENCRYPTED))})


def read(locators: DataFrame, table: DataFrame, column: str = "locator", key: bytes | None = None) -> DataFrame:
    """Adds raw (the addressed bytes) and intact; both are null where the locator is none or its block is missing.

    Only blocks that are asked for are shuffled, compressed, and opened, each once; the places asked of a block are at most as many as it
    has records, however often each is asked for.
    """
    place = ["seg", "block", "off", "len"]
    asked = locators.withColumn("_l", parse_locator(F.col(column)))
    wanted = asked.where("_l is not null").select(*[F.col(f"_l.{c}").alias(c) for c in place]).distinct()
    payload = F.col("payload") if key is None else F.when(F.col("flags").bitwiseAND(ENCRYPTED) > 0, F.try_aes_decrypt("payload", F.lit(key), F.lit("GCM"))).otherwise(F.col("payload"))
    some = table.join(wanted.select("seg", "block").distinct(), ["seg", "block"], "left_semi").select("seg", "block", "crc", payload.alias("payload"), "ulen", "flags")

    def sliced(places: pa.Table, found: pa.Table) -> pa.Table:
        if not found.num_rows or not places.num_rows:
            return pa.schema([("seg", pa.int32()), ("block", pa.int32()), ("off", pa.int64()), ("len", pa.int32()), ("raw", pa.binary()), ("intact", pa.bool_())]).empty_table()
        packed, size = found["payload"][0].as_py(), found["ulen"][0].as_py()
        data = packed or b""
        if packed and found["flags"][0].as_py() & ZSTD:
            data = zstandard.ZstdDecompressor().decompress(packed, max_output_size=size)
        intact = packed is not None and zlib.crc32(data) == found["crc"][0].as_py()
        raw = [data[o : o + n] for o, n in zip(places["off"].to_pylist(), places["len"].to_pylist(), strict=True)]
        return places.select(place).append_column("raw", pa.array(raw, pa.binary())).append_column("intact", pa.array([intact] * len(raw)))

    slices = wanted.groupBy("seg", "block").cogroup(some.groupBy("seg", "block")).applyInArrow(sliced, "seg int, block int, off long, len int, raw binary, intact boolean")
    slices = slices.select(*[F.col(c).alias(f"_{c}") for c in place], "raw", "intact")
    same = [F.col(f"_l.{c}") == F.col(f"_{c}") for c in place]
    return asked.join(slices, same[0] & same[1] & same[2] & same[3], "left").drop("_l", *[f"_{c}" for c in place])


def headers(table: DataFrame) -> DataFrame:
    """The index of a block table, from its narrow columns alone."""
    return table.select("seg", "block", "ulen", "clen", "crc", "flags")


def latest(table: DataFrame) -> tuple[int, int] | None:
    """Last (segment, block): where writing goes on."""
    last = table.agg(F.max(F.struct("seg", "block"))).first()[0]
    return (last["seg"], last["block"]) if last else None


def audit(events: DataFrame, table: DataFrame, key: bytes | None = None) -> DataFrame:
    """One row: records, matching (bytes read back have the recorded digest), for all rows with locator and raw_sha256."""
    back = read(events.select("locator", "raw_sha256"), table, key=key)
    return back.agg(F.count("*").alias("records"), F.count_if(F.col("intact") & (F.sha2("raw", 256) == F.col("raw_sha256"))).alias("matching"))
