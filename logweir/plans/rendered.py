"""Log lines rendered from the driver's tables, as SQL text that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import lines

USER = "'u' || CAST(user_id AS STRING)"
SRC = "'10.' || CAST(user_id % 200 AS STRING) || '.' || CAST(event_id % 250 AS STRING) || '.7'"
DST = "'192.0.2.' || CAST(event_id % 200 AS STRING)"
SPORT = "CAST(1024 + event_id % 50000 AS STRING)"
DPORT = "CAST(1 + user_id % 1000 AS STRING)"
#: one format for each remainder of the event's id
FORMATS = {
    0: f"'Oct 12 10:14:22 web-01 sshd[' || CAST(event_id AS STRING) || ']: ' || CASE WHEN event_type = 'error' THEN 'Failed' ELSE 'Accepted' END || ' password for ' || {USER} || ' from ' || {SRC} || ' port ' || {SPORT} || ' ssh2'",
    1: f"'%ASA-6-302013: Built outbound TCP connection ' || CAST(event_id AS STRING) || ' for outside:' || {SRC} || '/' || {SPORT} || ' to inside:' || {DST} || '/' || {DPORT}",
    2: f"""'{{"event_type":"' || event_type || '","src_ip":"' || {SRC} || '","src_port":' || {SPORT} || ',"dest_ip":"' || {DST} || '","dest_port":' || {DPORT} || ',"proto":"TCP"}}'""",
    3: f"""'devname="fw ' || CAST(user_id % 5 AS STRING) || '" type=traffic srcip=' || {SRC} || ' srcport=' || {SPORT} || ' dstip=' || {DST} || ' dstport=' || {DPORT} || ' proto=6 action=' || event_type""",
    4: f"'CEF:0|Acme|Wall|1.0|' || CAST(user_id % 9 AS STRING) || '|' || event_type || '|High|src=' || {SRC} || ' dst=' || {DST} || ' spt=' || {SPORT} || ' dpt=' || {DPORT} || ' act=deny'",
    5: f"'job ' || CAST(event_id AS STRING) || ' of ' || event_type || ' took ' || CAST(user_id AS STRING) || ' ms at ' || {SRC} || ' port ' || {DPORT}",
}
LINE = "CASE CAST(event_id % 6 AS INT) " + " ".join(f"WHEN {k} THEN {v}" for k, v in FORMATS.items()) + " END"
PACKS = {0: "linux_sshd", 1: "cisco_asa", 2: "suricata_eve", 3: "fortinet_fortios", 4: "cef", 5: "salvage"}
PACK = "CASE CAST(event_id % 6 AS INT) " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in PACKS.items()) + " END"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table with its log line."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("line", F.expr(LINE))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines as records, numbered by event. Rows are dealt before their lines are rendered."""
    rows = lines.spread(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type"))
    return lines.texts(rows.withColumn("line", F.expr(LINE)), "line", "events", "event_id")
