"""Reading raw records: text files and lists as rows (source, line_no, raw_bytes, raw_text)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "source string, line_no long, raw_bytes binary, raw_text string"


def shaped(df: DataFrame) -> DataFrame:
    """Bytes stay as they are; the text is what they decode to, stripped; blank records are left out."""
    text = F.make_valid_utf8(F.col("raw_bytes").cast("string"))
    # Catalyst moves the condition below a shuffle of the lines, to the scan's few tasks, so it is the cheapest one: some character
    return df.where(text.rlike(r"\S")).withColumn("raw_text", F.regexp_replace(text, r"^\s+|\s+$", "")).select("source", "line_no", "raw_bytes", "raw_text")


#: Rows of a task that decodes lines, about: a table of twice the rows is twice the tasks, not tasks of twice the length.
SPREAD = 50_000


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan dealt to tasks of SPREAD rows, and to all cores at least: decoding a line costs far more than moving it, and a
    scan's splits grow with the table and are no smaller than its row groups. df must be a plain scan, as its rows are counted (for
    Parquet from the footers) and its partitions too; one that has the tasks already stays as it is."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // SPREAD))
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def files(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files. line_no follows the order in each file: block start, then place in the block's rows.

    Text files have no row numbers, so the number is the line's rank by (block start, place as read); files are numbered apart, and a
    file's lines meet in one task only if it is a single split anyway.
    """
    rows = spark.read.text(path).select(F.col("value").cast("binary").alias("raw_bytes"), F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    counts = rows.groupBy("source", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("source", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("source", "block").orderBy("at")))
    return shaped(ranked.join(first, ["source", "block"]).withColumn("line_no", F.col("first") + F.col("rank")))


def records(spark: SparkSession, items: Iterable[str | bytes], source: str = "batch") -> DataFrame:
    """Records handed over in memory; numbered from 1."""
    rows = [(source, i, bytearray(x if isinstance(x, bytes) else x.encode("utf-8", "surrogatepass"))) for i, x in enumerate(items, 1)]
    return shaped(spark.createDataFrame(rows, "source string, line_no long, raw_bytes binary"))


def texts(df: DataFrame, text: str, source: str, order: str) -> DataFrame:
    """Records from a text column of a table."""
    return shaped(df.select(F.lit(source).alias("source"), F.col(order).cast("long").alias("line_no"), F.col(text).cast("binary").alias("raw_bytes")))
