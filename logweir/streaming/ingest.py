"""Streaming ingest: each micro-batch runs the batch pipeline and goes on where the lake's chain and vault end."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import lake
from ..plans import pipeline
from ..sources import lines
from ..sources.packs import BUILT_IN, Pack
from . import sources


def ingest(stream: DataFrame, path: str, checkpoint: str, packs: Sequence[Pack] = BUILT_IN, now_ms: int = 0, inference: bool = False, forward: dict | None = None, **trigger) -> StreamingQuery:
    """Writes a stream of (source, line_no, raw_bytes) into the lake at path.

    A batch that was committed before a failure is recognised by its number and left out. forward: options of the "udp" sink, which then
    gets each record's text.
    """
    spark = stream.sparkSession
    into = lake.Lake(spark, path)

    def batch(df: DataFrame, number: int) -> None:
        if df.isEmpty():
            return
        if into.committed(number):
            return
        rows = lines.shaped(df.withColumn("source", F.concat("source", F.lit(f"#{number}"))))
        pipeline.commit(pipeline.process(rows, packs, now_ms, inference, keep=pipeline.for_lake(), **pipeline.resume(into)), into, number)
        if forward:
            rows.select("raw_text").write.format("udp").mode("append").options(**forward).save()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def collect(spark: SparkSession, host: str, port: int, path: str, journal: str, checkpoint: str, every: str = "5 seconds", **more) -> StreamingQuery:
    """Datagrams of a port into a lake: received into the journal, a folder that executors share, and read from there batch by batch."""
    sources.register(spark)
    stream = spark.readStream.format("udp").option("host", host).option("port", port).option("journal", journal).load()
    return ingest(stream, path, checkpoint, processingTime=every, **more)


def windowed(stream: DataFrame, every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events and failures per window and source address of a stream of lake rows with a timestamp in milliseconds; late rows are
    taken in until the watermark passes."""
    low = F.lower("activity_name")
    at = stream.withColumn("at", F.timestamp_millis("timestamp")).withWatermark("at", late)
    return at.groupBy(F.window("at", every).alias("w"), "src_ip").agg(F.count("*").alias("events"), F.sum((low.contains("fail") | low.contains("deny")).cast("long")).alias("failed")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "src_ip", "events", "failed")


