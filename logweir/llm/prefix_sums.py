"""Running counts and sums over a sorted table of any size, also where one segment holds most of its rows.

Rows are dealt by range and sorted; each task adds up its own range, and what a range takes over from those before it follows from one row
a range. So a long segment lies over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written


def running(df: DataFrame, order: Sequence[str], sums: Sequence[str] = (), segment: str | None = None, name: str = "running") -> DataFrame:
    """df with `at` (rows of the segment up to this one, from 1) and sum_<name> for each whole-number column of `sums` (up to this row).

    `order` begins with the segment, a column of non-null longs (None: all rows are one segment), and should tell all rows apart; sums of
    a segment must fit in 63 bits. The result is written once, so that later readers see the same ranges.
    """
    held = df.columns

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, count, total, row = None, 0, np.zeros(len(sums), np.int64), 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            ids = b.column(held.index(segment)).to_numpy(zero_copy_only=False) if segment else np.zeros(n, np.int64)
            new = np.empty(n, bool)
            new[0], new[1:] = own is not None and ids[0] != own, ids[1:] != ids[:-1]
            index = np.arange(n)
            start = np.maximum.accumulate(np.where(new, index, -1))  # -1: goes on from the batch before
            at = np.where(start < 0, index + 1 + count, index - start + 1)
            out = []
            for i, s in enumerate(sums):
                x = b.column(held.index(s)).to_numpy(zero_copy_only=False).astype(np.int64)
                up = np.cumsum(x)
                out.append(up + np.where(start < 0, total[i], (x - up)[start]))
            own, count, total = ids[-1], int(at[-1]), np.array([o[-1] for o in out], np.int64)
            more = [pa.array(at, pa.int64()), *(pa.array(o, pa.int64()) for o in out), pa.array(row + index, pa.int64())]
            row += n
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*held, "_range", "at", *(f"sum_{s}" for s in sums), "_row"])

    made = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id())
    schema = T.StructType([*made.schema.fields, *(T.StructField(c, T.LongType()) for c in ("at", *(f"sum_{s}" for s in sums), "_row"))])
    parts = written(made.mapInArrow(added, schema), name)
    own = F.col(segment) if segment else F.lit(0).cast("long")
    last = F.max_by(F.struct(own.alias("own"), "at", *[f"sum_{s}" for s in sums]), "_row")
    ends = parts.groupBy("_range").agg(F.min_by(own, "_row").alias("first"), last.alias("last")).orderBy("_range").collect()  # a row a task
    carried, state = [], None
    for e in ends:
        goes_on = state is not None and state[0] == e["first"]
        if goes_on:
            carried.append((e["_range"], *state))
        end = list(e["last"])
        if goes_on and end[0] == e["first"]:
            end = [end[0], *(a + b for a, b in zip(end[1:], state[1:], strict=True))]
        state = end
    names = ["at", *(f"sum_{s}" for s in sums)]
    before = df.sparkSession.createDataFrame(carried, "_in long, _own long, " + ", ".join(f"_{c} long" for c in names))
    joined = parts.join(F.broadcast(before), (F.col("_range") == F.col("_in")) & (own == F.col("_own")), "left")
    return joined.select(*held, *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in names])


__all__ = ["running"]
