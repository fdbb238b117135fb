"""Helpers that several operators of this subpackage share: byte views of Arrow text, written tables, sized broadcasts."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that a Python worker gets at once; a longer text stands alone.
ARROW_ROWS, ARROW_BYTES = 512, 16 << 20
#: Bytes of text that numpy code handles at once.
SLICE_BYTES = 1 << 18
#: Tables above this size are never broadcast.
BROADCAST_BYTES = 64 << 20
WHITE = r"[\x20\x09-\x0D]+"


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for a worker's memory. This lowers two settings of the session, and never raises them."""
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}", None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        at = tempfile.mkdtemp(prefix="spark-", dir="/tmp" if os.path.isdir("/tmp") else None)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: later steps survive lost executors and don't compute it twice."""
    path = f"{shared_dir(df.sparkSession)}/logweir-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables made by written() that nothing reads any more."""
    for df in tables:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def sized_broadcast(df: DataFrame, row_bytes: int, rows: int | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, with a broadcast hint only if its counted rows stay below the limit; beyond it Spark shuffles both sides."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n * row_bytes <= limit else df


_kept: list[dict] = []


def worker_cache() -> dict:
    """A dictionary that a Python worker keeps from task to task, for one operator."""
    _kept.append({})
    return _kept[-1]


def release() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim:
        trim(0)


def take_over(own: dict | None = None) -> None:
    """Empties what other operators keep in this worker, whose memory all stages share, and gives freed memory back to the system."""
    held = [d for d in _kept if d is not own and d]
    for d in held:
        d.clear()
    release()


def freed(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's work over batches, after which its worker, which waits for other tasks, gives freed memory back."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            release()

    return run


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty. offsets has a place more than rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes each; a longer text stands alone."""
    start, n = 0, len(off) - 1
    while start < n:
        end = int(np.searchsorted(off, off[start] + most, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end


def word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each maximal run of bytes other than ASCII white space, within rows."""
    white = (raw == 32) | ((raw >= 9) & (raw <= 13))
    flag = np.empty(len(raw) + 1, dtype=bool)
    flag[:-1] = ~white
    flag[-1] = False
    first = flag[:-1].copy()
    first[1:] &= white[:-1]
    last = flag[:-1].copy()
    last[:-1] &= white[1:]
    # a row's first and last bytes bound words too
    lengths = np.diff(off)
    begins, ends = off[:-1][lengths > 0], off[1:][lengths > 0] - 1
    first[begins] = ~white[begins]
    last[ends] = ~white[ends]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, stops, np.searchsorted(off, starts, side="right") - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and odd multiplications), so that all bits depend on all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
