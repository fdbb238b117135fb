"""Features of events, per row and per time window, and the counters of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lookups import CLASS_NETWORK
from .detect import SALVAGE

NAMES = ["class_uid", "is_network", "is_failed", "src_port", "dst_port"]


def rows(df: DataFrame, *keep: str) -> DataFrame:
    """Five float features a row of the lake's columns."""
    low = F.lower("activity_name")
    made = [F.col("class_uid"), F.col("class_uid") == CLASS_NETWORK, low.contains("fail") | low.contains("deny"), F.coalesce("src_port", F.lit(0)), F.coalesce("dst_port", F.lit(0))]
    return df.select(*keep, *[F.coalesce(c.cast("float"), F.lit(0.0).cast("float")).alias(n) for n, c in zip(NAMES, made, strict=True)])


def windows(df: DataFrame, every: str = "5 minutes", *keys: str) -> DataFrame:
    """Per window (and keys): events, distinct addresses and ports, shares of failed and unmapped events."""
    low = F.lower("activity_name")
    at = F.window(F.timestamp_millis("timestamp"), every)
    return df.groupBy(at.alias("w"), *keys).agg(
        F.count("*").alias("events"), F.countDistinct("src_ip").alias("src_ips"), F.countDistinct("dst_port").alias("dst_ports"),
        F.avg((low.contains("fail") | low.contains("deny")).cast("int")).alias("failed_ratio"), F.avg((F.col("class_uid") == 0).cast("int")).alias("unknown_ratio"),
    ).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "events", "src_ips", "dst_ports", "failed_ratio", "unknown_ratio")


def totals() -> list[Column]:
    """Counters over processed records: records, bytes, claimed, salvaged, alerts (findings), classed; for agg() or observe()."""
    gone = F.col("pack") == SALVAGE
    return [
        F.count(F.lit(1)).alias("records"), F.coalesce(F.sum(F.octet_length("raw_bytes")), F.lit(0)).cast("long").alias("bytes"), F.count_if(~gone).alias("claimed"), F.count_if(gone).alias("salvaged"),
        F.count_if(F.col("event.class_uid") == 2001).alias("alerts"), F.count_if(F.col("event.class_uid") > 0).alias("classed"),
    ]


def counters(df: DataFrame) -> DataFrame:
    """One row: records, bytes, claimed, salvaged, alerts, salvage_rate, mapped (share with a class)."""
    share = lambda c: F.when(F.col("records") > 0, F.col(c) / F.col("records")).otherwise(F.lit(0.0))
    return df.agg(*totals()).select("records", "bytes", "claimed", "salvaged", "alerts", share("salvaged").alias("salvage_rate"), share("classed").alias("mapped"))


def with_rates(counts: dict[str, int], seconds: float, stored: int | None = None) -> dict[str, float]:
    """Counters with what follows from them: salvage_rate, mapped, events_per_second, daily_capacity, and compression_ratio if the stored
    bytes are known."""
    n = max(1, counts["records"])
    speed = counts["records"] / max(1e-9, seconds)
    out = {k: v for k, v in counts.items() if k != "classed"} | {"salvage_rate": counts["salvaged"] / n, "mapped": counts["classed"] / n, "events_per_second": round(speed, 1), "daily_capacity": int(speed * 86_400)}
    return out | ({"compression_ratio": round(counts["bytes"] / stored, 2)} if stored else {})


def lossless(df: DataFrame, *keys: str) -> DataFrame:
    """Per category: records and bytes, how many came back byte for byte (column same), and whether all did."""
    back = F.count_if(F.coalesce(F.col("same"), F.lit(False)))
    return df.groupBy(*keys).agg(F.count("*").alias("records"), F.coalesce(F.sum(F.octet_length("raw_bytes")), F.lit(0)).cast("long").alias("bytes"), back.alias("matching"), (back == F.count("*")).alias("lossless"))


def daily(df: DataFrame, at: str, *distinct: str, size: int = 14) -> DataFrame:
    """Per day of a millisecond column: events, first and last time, and a sketch of each column's distinct values, which merged() adds up.
    2^size registers: the standard error is 1.04 / 2^(size / 2), 0.8 % for 14."""
    sketches = [F.hll_sketch_agg(F.col(c).cast("string"), size).alias(c) for c in distinct]
    return df.groupBy(F.to_date(F.timestamp_millis(at)).alias("day")).agg(F.count("*").alias("events"), F.min(at).alias("first_ms"), F.max(at).alias("last_ms"), *sketches)


def merged(days: DataFrame, *distinct: str) -> DataFrame:
    """One row from the days' sketches: events, first_ms, last_ms, and an estimate for each distinct column. The events are not read again."""
    return days.agg(F.sum("events").alias("events"), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"), *[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in distinct])


def prometheus(totals: dict[str, float], prefix: str = "logweir") -> str:
    """Counters in the text format that monitoring scrapes."""
    kinds = dict.fromkeys(("salvage_rate", "mapped", "events_per_second", "daily_capacity", "compression_ratio"), "gauge")
    return "".join(f"# TYPE {prefix}_{k} {kinds.get(k, 'counter')}\n{prefix}_{k} {v}\n" for k, v in totals.items())


def accuracy(matched: DataFrame, expected: str = "expected") -> DataFrame:
    """One row over matched keys with expected targets: top1, top3, mean_confidence, auto, review, custom."""
    hit = F.col("target_field") == F.col(expected)
    among = F.exists("top_candidates", lambda c: c["field"] == F.col(expected)) | hit
    share = lambda d: F.avg((F.col("decision") == d).cast("int"))
    return matched.agg(F.count("*").alias("keys"), F.avg(hit.cast("int")).alias("top1"), F.avg(among.cast("int")).alias("top3"), F.avg("confidence").alias("mean_confidence"), share("AUTO_MAP").alias("auto"), share("HUMAN_REVIEW").alias("review"), share("CUSTOM_FALLBACK").alias("custom"))
