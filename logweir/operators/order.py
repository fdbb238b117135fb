"""Rows in order over many tasks: dealt by ranges and written once; what goes on from row to row is counted in each range, and over the
ranges by their sums, a row a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

#: Ranges at least; where the session has more shuffle partitions, as many as these.
LEAST = 64
#: monotonically_increasing_id: the partition above these bits, the row's place in it below.
PLACE_BITS = 33


def dealt(df: DataFrame, *order: str, parts: int | None = None) -> DataFrame:
    """df in ranges of `order`, with _at, which grows with the order and has no ties, and _range, its range.

    It is written, as another sampling would deal rows differently, and so that rows that tie keep their order in all later passes.
    """
    n = parts or max(LEAST, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return written(rows, "ranges").withColumn("_range", F.shiftright("_at", PLACE_BITS))


def before(ranges: DataFrame, **values: Column | str) -> DataFrame:
    """_range and, for each name, the sum of its value over all earlier ranges. ranges: as dealt() makes them. A row a range."""
    order = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranges.groupBy("_range").agg(*[F.sum(v).alias(k) for k, v in values.items()])
    return sums.select("_range", *[F.coalesce(F.sum(k).over(order), F.lit(0)).alias(k) for k in values])


def number(rows_before: Column, start: int) -> Column:
    """Consecutive numbers of dealt rows: the rows of earlier ranges and the place in the own one; needs no window over rows."""
    return (rows_before + F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)) + start).cast("long")
