"""Registered queries of the log engine, each with the SQL that DuckDB runs on the same tables where SQL can express it.

The driver's tables hold no logs: lines are rendered from their columns and decoded again, so SQL states the result from the columns.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import client
from ..client import aliased
from ..functions import canonical, decoders, lookups, salvage, templates
from ..operators import chain, clusters, detect, features, keys, lake, matching, merkle, normalize, vault
from ..sources import lines
from ..sources import packs as sources
from ..sources.tables import fresh, written
from ..streaming import ingest
from . import pipeline, rendered
from .rendered import DPORT, DST, FORMATS, LINE, PACK, SPORT, SRC, USER, events, records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def fields(df: DataFrame, decoded, *names: str, key: str = "event_id") -> DataFrame:
    """The named fields of a decoded line as columns."""
    rows = df.withColumn("_f", decoded)
    return rows.select(key, *[F.try_element_at("_f", F.lit(n)).alias(n) for n in names])


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).withColumnRenamed("line_no", "event_id")
    rows = rows.withColumns({"locator": F.concat(F.lit("weir:raw:0:0:0:"), F.octet_length("raw_bytes").cast("string")), "raw_sha256": F.sha2("raw_bytes", 256)})
    return detect.extract(detect.route(rows))


def salvaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that no pack claims, or that their pack can't decode."""
    rows = extracted(spark, sf_dir).select("event_id", "raw_text", "pack")
    return written(rows, "salvaged").where(F.col("pack") == detect.SALVAGE).select("event_id", "raw_text")  # a pushed filter would decode anew for each pack


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.normalize(extracted(spark, sf_dir), now_ms=0)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route, decode and normalise log lines, and summarise them by source."""
    rows = normalized(spark, sf_dir)
    e = F.col("event")
    return rows.groupBy("pack", e["class_uid"].alias("class_uid")).agg(F.count("*").alias("n"), F.countDistinct(e["src_endpoint"]["ip"]).alias("src_ips"), F.count(e["dst_endpoint"]["port"]).alias("with_dst_port"))


@query("flagship", f"""SELECT {PACK} AS pack, CAST(CASE CAST(event_id % 6 AS INT) WHEN 0 THEN 3001 WHEN 2 THEN 2001 WHEN 5 THEN 0 ELSE 4001 END AS INT) AS class_uid, count(*) AS n,
  count(DISTINCT CASE WHEN event_id % 6 < 5 THEN {SRC} END) AS src_ips, count(CASE WHEN event_id % 6 BETWEEN 1 AND 4 THEN 1 END) AS with_dst_port FROM events GROUP BY ALL""")
def _(spark, sf_dir):
    return flagship(spark, sf_dir)


@query("dec1_rfc3164", """SELECT o_orderkey, CAST(o_orderkey % 192 AS VARCHAR) AS pri, 'host' || CAST(o_custkey AS VARCHAR) AS hostname, 'app' AS app, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_custkey AS VARCHAR) END AS pid,
  CAST(o_orderkey % 192 // 8 AS VARCHAR) AS facility, CAST(o_orderkey % 192 % 8 AS VARCHAR) AS severity, 'order ' || o_orderpriority AS message FROM orders""")
def _(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    line = F.expr("'<' || CAST(o_orderkey % 192 AS STRING) || '>Oct 12 10:14:22 host' || CAST(o_custkey AS STRING) || ' app' || CASE WHEN o_orderkey % 3 > 0 THEN '[' || CAST(o_custkey AS STRING) || ']' ELSE '' END || ': order ' || o_orderpriority")
    return fields(df.withColumn("line", line), decoders.rfc3164(F.col("line")), "pri", "hostname", "app", "pid", "facility", "severity", "message", key="o_orderkey")


@query("dec2_rfc5424", """SELECT o_orderkey, CAST(o_orderkey % 192 AS VARCHAR) AS pri, 'host' || CAST(o_custkey AS VARCHAR) AS hostname, 'app' AS app, CAST(o_custkey AS VARCHAR) AS procid, 'ID47' AS msgid,
  CASE WHEN o_orderkey % 2 = 0 THEN '-' ELSE '[x@1 k="v"]' END AS sd, CAST(o_orderkey % 192 // 8 AS VARCHAR) AS facility, CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS message FROM orders""")
def _(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    line = F.expr("""'<' || CAST(o_orderkey % 192 AS STRING) || '>1 2026-09-26T22:14:15Z host' || CAST(o_custkey AS STRING) || ' app ' || CAST(o_custkey AS STRING) || ' ID47 ' || CASE WHEN o_orderkey % 2 = 0 THEN '-' ELSE '[x@1 k="v"]' END || CASE WHEN o_orderkey % 5 > 0 THEN ' ' || o_orderpriority ELSE '' END""")
    return fields(df.withColumn("line", line), decoders.rfc5424(F.col("line")), "pri", "hostname", "app", "procid", "msgid", "sd", "facility", "message", key="o_orderkey")


@query("dec3_keyvalue", f"SELECT event_id, 'fw ' || CAST(user_id % 5 AS VARCHAR) AS devname, {SRC} AS srcip, {DPORT} AS dstport, event_type AS action, CAST(event_id AS VARCHAR) AS again FROM events")
def _(spark, sf_dir):
    df = events(spark, sf_dir).withColumn("line", F.expr(FORMATS[3] + " || ' again=x again=' || CAST(event_id AS STRING)"))
    return fields(df, decoders.keyvalue(F.col("line")), "devname", "srcip", "dstport", "action", "again")


@query("dec4_csv", "SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS col_0, p_name || ', \"' || p_brand || '\"' AS col_1, p_type AS col_2, '' AS col_3, CAST(p_size AS VARCHAR) AS col_4 FROM part")
def _(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/part.parquet")
    line = F.expr('''CAST(p_partkey AS STRING) || ',"' || p_name || ', ""' || p_brand || '""",' || p_type || ',,' || CAST(p_size AS STRING)''')
    return fields(df.withColumn("line", line), decoders.csv(F.col("line")), *[f"col_{i}" for i in range(5)], key="p_partkey")


@query("dec5_cef", f"SELECT event_id, 'Acme' AS device_vendor, CAST(user_id % 9 AS VARCHAR) AS device_event_class_id, event_type AS name, 'High' AS severity, {SRC} AS src, {DPORT} AS dpt, 'deny' AS act FROM events")
def _(spark, sf_dir):
    df = events(spark, sf_dir).withColumn("line", F.expr("'<34>Oct 1 00:00:00 fw ' || " + FORMATS[4])).withColumn("_f", decoders.cef(F.col("line")))
    ext = F.from_json(F.try_element_at("_f", F.lit("extension")), decoders.STRINGS)
    return df.select("event_id", *[F.try_element_at("_f", F.lit(n)).alias(n) for n in ("device_vendor", "device_event_class_id", "name", "severity")], *[F.try_element_at(ext, F.lit(n)).alias(n) for n in ("src", "dpt", "act")])


@query("dec6_leef", f"SELECT event_id, '2.0' AS leef_version, 'Acme' AS vendor, event_type AS event_id_field, {SRC} AS src, {USER} AS usr FROM events")
def _(spark, sf_dir):
    df = events(spark, sf_dir).withColumn("line", F.expr(f"'LEEF:2.0|Acme|Wall|1|' || event_type || '|src=' || {SRC} || chr(9) || 'usr=' || {USER}")).withColumn("_f", decoders.leef(F.col("line")))
    ext = F.from_json(F.try_element_at("_f", F.lit("extension")), decoders.STRINGS)
    return df.select("event_id", F.try_element_at("_f", F.lit("leef_version")).alias("leef_version"), F.try_element_at("_f", F.lit("vendor")).alias("vendor"), F.try_element_at("_f", F.lit("event_id")).alias("event_id_field"), F.try_element_at(ext, F.lit("src")).alias("src"), F.try_element_at(ext, F.lit("usr")).alias("usr"))


@query("dec7_json", f"SELECT event_id, event_type, {SRC} AS src_ip, {SPORT} AS src_port, json_extract_string(props, '$.k') AS k FROM events")
def _(spark, sf_dir):
    line = F.concat(F.lit("syslog header "), F.expr(FORMATS[2]), F.lit(" tail"))
    df = events(spark, sf_dir).withColumns({"_a": decoders.json_object(line), "_b": decoders.json_object(F.col("props"))})
    return df.select("event_id", *[F.try_element_at("_a", F.lit(n)).alias(n) for n in ("event_type", "src_ip", "src_port")], F.try_element_at("_b", F.lit("k")).alias("k"))


@query("dec8_xml", "SELECT s_suppkey, s_name AS name, CAST(s_nationkey AS VARCHAR) AS id FROM supplier")
def _(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    line = F.expr("""'<Event xmlns="http://example.org/x"><System><Name a="1">' || s_name || '</Name><Id n="' || CAST(s_nationkey AS STRING) || '"/></System></Event>'""")
    body = F.try_element_at(decoders.xml(line), F.lit("Event"))
    return df.select("s_suppkey", F.get_json_object(body, "$.System.Name").alias("name"), F.get_json_object(body, "$.System.Id.@n").alias("id"))


@query("dec9_regex", f"SELECT event_id, {USER} AS username, {SRC} AS src_ip, {SPORT} AS src_port, CASE WHEN event_type = 'error' THEN 'Failed' ELSE 'Accepted' END AS action FROM events")
def _(spark, sf_dir):
    pack = next(p for p in sources.BUILT_IN if p.id == "linux_sshd")
    df = events(spark, sf_dir).withColumn("line", F.expr(FORMATS[0]))
    return fields(df, decoders.groups(F.col("line"), pack.regex), "username", "src_ip", "src_port", "action")


@query("prd1_prd2_route", f"SELECT {PACK} AS pack, CASE CAST(event_id % 6 AS INT) WHEN 0 THEN 'regex' WHEN 1 THEN 'regex' WHEN 2 THEN 'json' WHEN 3 THEN 'keyvalue' WHEN 4 THEN 'cef' ELSE 'salvage' END AS decoder, count(*) AS n FROM events GROUP BY ALL")
def _(spark, sf_dir):
    return extracted(spark, sf_dir).groupBy("pack", "decoder").agg(F.count("*").alias("n"))


@query("src9_packs", f"""SELECT CAST(place AS INT) AS place, p.pack, vendor, CAST(class_uid AS INT) AS class_uid, CAST(mappings AS INT) AS mappings, coalesce(n, 0) AS claimed FROM (VALUES {", ".join(f"({i}, '{p.id}', '{p.vendor}', {p.class_uid}, {len(p.mappings)})" for i, p in enumerate(sources.BUILT_IN))}) p(place, pack, vendor, class_uid, mappings)
  LEFT JOIN (SELECT {PACK} AS pack, count(*) AS n FROM events GROUP BY 1) c ON c.pack = p.pack""")
def _(spark, sf_dir):
    """The built-in sources and how many of the events' lines each claims."""
    claimed = detect.route(records(spark, sf_dir)).groupBy(F.col("claimed").alias("pack")).agg(F.count("*").alias("claimed"))
    return sources.listing(spark).join(claimed, "pack", "left").na.fill(0, ["claimed"]).select("place", "pack", "vendor", "class_uid", "mappings", "claimed")


@query("src7_records", f"SELECT event_id AS line_no, {LINE} AS raw_text, CAST(strlen({LINE}) AS INT) AS n_bytes FROM events")
def _(spark, sf_dir):
    return records(spark, sf_dir).select("line_no", "raw_text", F.octet_length("raw_bytes").alias("n_bytes"))


DUCK = {k: p.replace("(?i)", "") for k, p in salvage.PATTERNS.items()}


def duck(pattern: str, flags: str = "") -> str:
    quoted = pattern.replace("'", "''")
    return f"CAST(len(list_distinct(regexp_extract_all(text, '{flags}{quoted}'))) AS INT)"


@query("sal_observables", f"SELECT doc_id, {duck(DUCK['ip_addresses'])} AS ips, {duck(DUCK['mac_addresses'])} AS macs, {duck(DUCK['emails'])} AS emails, {duck(DUCK['hashes_md5'])} AS md5s, {duck(DUCK['hashes_sha256'])} AS sha256s FROM documents")
def _(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", salvage.observables(F.col("text")).alias("o"))
    n = lambda c: F.coalesce(F.size(F.col(f"o.{c}")), F.lit(0))
    return df.select("doc_id", n("ip_addresses").alias("ips"), n("mac_addresses").alias("macs"), n("emails").alias("emails"), n("hashes_md5").alias("md5s"), n("hashes_sha256").alias("sha256s"))


@query("sal5_ports", f"SELECT event_id, {DPORT} AS ports, {SRC} AS ips FROM events WHERE event_id % 6 = 5")
def _(spark, sf_dir):
    df = salvaged(spark, sf_dir).select("event_id", salvage.observables(F.col("raw_text")).alias("o"))
    return df.select("event_id", F.array_join("o.ports", ",").alias("ports"), F.array_join("o.ip_addresses", ",").alias("ips"))


@query("tpl2_tpl4_templates", """SELECT 'job <*> of ' || event_type || ' took <*> ms at <*> port <*>' AS template, count(*) AS n, round(7.0 / 11, 3)::DOUBLE AS specificity,
  row_number() OVER (ORDER BY min(event_id)) AS cluster_id FROM events WHERE event_id % 6 = 5 GROUP BY event_type""")
def _(spark, sf_dir):
    found = clusters.summary(salvaged(spark, sf_dir), "raw_text", "event_id")
    return found.select("template", F.col("count").alias("n"), "specificity", "cluster_id")


@query("tpl5_cluster_sizes", "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY event_id) AS cluster_size FROM events WHERE event_id % 6 = 5")
def _(spark, sf_dir):
    return clusters.assign(salvaged(spark, sf_dir), "raw_text", "event_id").select("event_id", "cluster_size")


@query("tpl6_top", """SELECT 'job <*> of ' || event_type || ' took <*> ms at <*> port <*>' AS template, count(*) AS n FROM events WHERE event_id % 6 = 5 GROUP BY event_type ORDER BY n DESC, min(event_id) LIMIT 3""")
def _(spark, sf_dir):
    return clusters.top(salvaged(spark, sf_dir), 3, "raw_text", "event_id").select("template", F.col("count").alias("n"))


@query("tpl1_refine", """SELECT 'job <*> of <*> took <*> ms at <*> port <*>' AS merged, count(*) AS n FROM events WHERE event_id % 6 = 5""")
def _(spark, sf_dir):
    known = clusters.summary(salvaged(spark, sf_dir), "raw_text", "event_id")
    return clusters.refine(known).groupBy("merged").agg(F.sum("count").alias("n"))


def orders_said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of which masks see one template for each status, priority and clerk, the tree one for each status and token count."""
    said = F.expr("""CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'opened' ELSE 'changed' END || ' order ' || CAST(o_orderkey AS STRING) || ' for customer ' || CAST(o_custkey AS STRING) || ' priority ' || replace(o_orderpriority, ' ', '_')
      || ' id 0f8fad5b-d9cb-469f-a165-' || lpad(CAST(o_orderkey AS STRING), 12, '0') || CASE WHEN o_custkey % 2 = 0 THEN ' at 0x1f' ELSE '' END""")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", said.alias("raw_text"))


@query("tpl1_drain", """WITH m AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'opened' ELSE 'changed' END AS verb, CASE WHEN o_custkey % 2 = 0 THEN ' at <HEX>' ELSE '' END AS tail, replace(o_orderpriority, ' ', '_') AS priority, o_orderkey FROM orders)
SELECT row_number() OVER (ORDER BY min(o_orderkey)) AS cluster_id, verb || ' order <NUM> for customer <NUM> priority ' || CASE WHEN count(DISTINCT priority) > 1 THEN '<*>' ELSE '<NUM>' || substr(any_value(priority), 2) END || ' id <UUID>' || tail AS template, count(*) AS count,
  CAST(round(CASE WHEN tail = '' THEN 6.0 / 10 ELSE 7.0 / 12 END, 3) AS DOUBLE) AS specificity FROM m GROUP BY verb, tail""")
def _(spark, sf_dir):
    return clusters.mine(orders_said(spark, sf_dir), order="o_orderkey").select("cluster_id", "template", F.col("count"), "specificity")


@query("tpl3_tpl5_batches", "SELECT event_id, dense_rank() OVER (ORDER BY f) AS cluster_id, cluster_size FROM (SELECT event_id, min(event_id) OVER (PARTITION BY event_type) AS f, count(*) OVER (PARTITION BY event_type ORDER BY event_id) AS cluster_size FROM events WHERE event_id % 6 = 5)")
def _(spark, sf_dir):
    """Two batches, the second one going on from the clusters that the first has left in the lake, give what one gives."""
    rows = written(salvaged(spark, sf_dir), "two-batches")
    half = rows.agg(F.percentile_approx("event_id", 0.5)).first()[0]
    into, out, known = lake.Lake(spark, fresh(spark, "clusters")), [], None
    for n, some in enumerate((rows.where(F.col("event_id") <= half), rows.where(F.col("event_id") > half))):
        told = written(clusters.summary(some, "raw_text", "event_id", known), "told")
        out.append(clusters.assign(some, "raw_text", "event_id", known, told).select("event_id", "cluster_id", "cluster_size"))
        into.write(told, "clusters", n)
        known = into.latest("clusters")
    return out[0].unionByName(out[1])


@query("inf1_types", """SELECT event_id, 'ip' AS a, 'port' AS b, 'url' AS c, 'email' AS d, 'bool' AS e, 'timestamp' AS f, 'string' AS g FROM events""")
def _(spark, sf_dir):
    df = events(spark, sf_dir)
    kind = lambda key, value: matching.value_type(F.lit(key), F.array(value))
    return df.select("event_id", kind("addr", F.expr(SRC)).alias("a"), kind("sport", F.expr(SPORT)).alias("b"), kind("ref", F.concat(F.lit("http://h/"), F.col("event_type"))).alias("c"), kind("who", F.concat(F.expr(USER), F.lit("@example.org"))).alias("d"), kind("flag", F.lit("true")).alias("e"), kind("seen", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("f"), kind("kind", F.concat(F.lit("x"), F.col("event_type"))).alias("g"))


@query("inf10_match", """SELECT * FROM (VALUES ('src_ip', 'AUTO_MAP', 'src_endpoint.ip', 1.0), ('dport', 'AUTO_MAP', 'dst_endpoint.port', 1.0), ('username', 'AUTO_MAP', 'actor.user.name', 0.94), ('log-level', 'AUTO_MAP', 'severity_id', 0.94)) t(key, decision, target_field, confidence)""")
def _(spark, sf_dir):
    values = {"src_ip": F.expr(SRC), "dport": F.expr(DPORT), "username": F.expr(USER), "log-level": F.col("event_type")}
    pairs = events(spark, sf_dir).select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.array(v).alias("samples")) for k, v in values.items()])).alias("p"))
    rows = pairs.select("p.*", F.lit(None).cast("string").alias("vendor")).distinct()
    # a row for each way that a key's values are matched
    return matching.match(rows).select("key", "decision", "target_field", F.round("confidence", 2).alias("confidence")).distinct()


SQL["inf10_match"] = SQL["inf10_match"].replace("SELECT * FROM", "SELECT key, decision, target_field, CAST(confidence AS DOUBLE) AS confidence FROM")


@query("nrm_normalize", f"""SELECT event_id, CASE CAST(event_id % 6 AS INT) WHEN 0 THEN CASE WHEN event_type = 'error' THEN 'Failed' ELSE 'Accepted' END WHEN 1 THEN 'Built' WHEN 4 THEN 'deny' WHEN 5 THEN NULL ELSE event_type END AS activity_name,
  CAST(CASE WHEN event_id % 6 = 4 THEN 2 END AS INT) AS disposition_id, CASE WHEN event_id % 6 < 5 THEN {SRC} END AS src_ip, CAST(CASE WHEN event_id % 6 < 5 THEN {SPORT} END AS INT) AS src_port,
  CASE WHEN event_id % 6 BETWEEN 1 AND 4 THEN {DST} END AS dst_ip, CASE WHEN event_id % 6 = 0 THEN {USER} END AS user_name, CASE WHEN event_id % 6 = 3 THEN 'fw ' || CAST(user_id % 5 AS VARCHAR) END AS hostname,
  CASE WHEN event_id % 6 = 4 THEN 'Acme' WHEN event_id % 6 = 0 THEN 'Linux' WHEN event_id % 6 = 1 THEN 'Cisco' WHEN event_id % 6 = 2 THEN 'OISF' WHEN event_id % 6 = 3 THEN 'Fortinet' ELSE 'Generic' END AS vendor, true AS valid FROM events""")
def _(spark, sf_dir):
    e = F.col("event")
    return normalized(spark, sf_dir).select("event_id", e["activity_name"].alias("activity_name"), e["disposition_id"].alias("disposition_id"), e["src_endpoint"]["ip"].alias("src_ip"), e["src_endpoint"]["port"].alias("src_port"), e["dst_endpoint"]["ip"].alias("dst_ip"), e["actor"]["user"]["name"].alias("user_name"), e["device"]["hostname"].alias("hostname"), e["metadata"]["product"]["vendor_name"].alias("vendor"), normalize.valid(e).alias("valid"))


#: a source whose mappings name paths that no built-in one has: new objects, and members of known ones
MAPPED = {"srcip": "src_endpoint.ip", "srcport": "src_endpoint.port", "dstip": "traffic.peer.ip", "dstport": "traffic.peer.port", "action": "traffic.verdict", "devname": "device.zone.name", "type": "kind"}


@query("prj4_paths", f"""SELECT event_id, {SRC} AS src_ip, CAST({SPORT} AS INT) AS src_port, {DST} AS peer_ip, {DPORT} AS peer_port, event_type AS verdict, 'fw ' || CAST(user_id % 5 AS VARCHAR) AS zone, 'traffic' AS kind, CAST(NULL AS VARCHAR) AS hostname, '6' AS unmapped_proto FROM events WHERE event_id % 6 = 3""")
def _(spark, sf_dir):
    own = [dataclasses.replace(p, mappings=MAPPED) if p.id == "fortinet_fortios" else p for p in sources.BUILT_IN]
    rows = normalize.normalize(extracted(spark, sf_dir), own).where(F.col("pack") == "fortinet_fortios")
    return rows.select("event_id", *[F.col(f"event.{path}").alias(name) for path, name in (("src_endpoint.ip", "src_ip"), ("src_endpoint.port", "src_port"), ("traffic.peer.ip", "peer_ip"), ("traffic.peer.port", "peer_port"), ("traffic.verdict", "verdict"), ("device.zone.name", "zone"), ("kind", "kind"), ("device.hostname", "hostname"))], F.try_element_at("event.unmapped", F.lit("proto")).alias("unmapped_proto"))


@query("inf9_vendor_hint", """SELECT event_id, 'custom.' || CASE WHEN user_id % 2 = 0 THEN 'acme' ELSE 'unknown' END || '.zzqx' AS target, CASE WHEN user_id % 2 = 0 THEN 'Acme' ELSE 'Generic' END AS vendor FROM events""")
def _(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", F.expr("'zzqx=w' || CAST(user_id AS STRING) || ' vvwk=' || event_type").alias("raw_text"), F.when(F.col("user_id") % 2 == 0, "Acme").alias("vendor_hint"))
    rows = written(rows, "hinted")
    guessed = matching.infer(rows).select("event_id", "mappings")
    lines_ = rows.join(guessed, "event_id").withColumns({"claimed": F.lit(None).cast("string"), "pack": F.lit(detect.SALVAGE), "decoder": F.lit(detect.SALVAGE), "fields": matching.candidates(F.col("raw_text")), "locator": F.lit(""), "raw_sha256": F.lit("")})
    return normalize.normalize(lines_).select("event_id", F.try_element_at("mappings", F.lit("zzqx")).alias("target"), F.col("event.metadata.product.vendor_name").alias("vendor"))


@query("agg6_accuracy", f"""WITH k AS (SELECT unnest([{{'key': 'src_ip', 'value': {SRC}, 'c': 1.0}}, {{'key': 'dport', 'value': {DPORT}, 'c': 1.0}}, {{'key': 'username', 'value': {USER}, 'c': 0.94}}, {{'key': 'log-level', 'value': event_type, 'c': 0.94}}], recursive := true) FROM events), d AS (SELECT DISTINCT * FROM k)
SELECT count(*) AS keys, CAST(1 AS DOUBLE) AS top1, CAST(1 AS DOUBLE) AS top3, CAST(round(avg(c), 6) AS DOUBLE) AS mean_confidence, CAST(1 AS DOUBLE) AS auto, CAST(0 AS DOUBLE) AS review, CAST(0 AS DOUBLE) AS custom FROM d""")
def _(spark, sf_dir):
    told = {"src_ip": (F.expr(SRC), "src_endpoint.ip"), "dport": (F.expr(DPORT), "dst_endpoint.port"), "username": (F.expr(USER), "actor.user.name"), "log-level": (F.col("event_type"), "severity_id")}
    pairs = events(spark, sf_dir).select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.array(v).alias("samples"), F.lit(t).alias("expected")) for k, (v, t) in told.items()])).alias("p")).select("p.*").distinct()
    matched = matching.match(pairs.select("key", "samples", F.lit(None).cast("string").alias("vendor")))
    return features.accuracy(matched.join(pairs, ["key", "samples"])).withColumn("mean_confidence", F.round("mean_confidence", 6))


@query("att12_roots", r"""WITH RECURSIVE n AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, sha256(CAST(event_id AS VARCHAR)) AS fp FROM events),
l(blk, level, pos, hash) AS (SELECT i // 1000, 0, i % 1000, sha256('\x00'::BLOB || encode(fp)) FROM n
  UNION ALL SELECT blk, level + 1, pos // 2, sha256('\x01'::BLOB || unhex(arg_min(hash, pos)) || unhex(arg_max(hash, pos))) FROM (SELECT *, count(*) OVER (PARTITION BY blk) AS c FROM l) WHERE c > 1 GROUP BY blk, level, pos // 2)
SELECT max(i) + 1 AS checkpoint_seq, count(*) AS events, arg_max(fp, i) AS chain_head, any_value(r.root) AS merkle_root FROM n JOIN (SELECT blk, arg_max(hash, level) AS root FROM l GROUP BY blk) r ON r.blk = i // 1000 GROUP BY i // 1000""")
def _(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", F.sha2(F.col("event_id").cast("string"), 256).alias("fingerprint"))
    return merkle.block_roots(chain.sequenced(rows, "event_id", parts=16)).select("checkpoint_seq", "events", "chain_head", "merkle_root")


@query("agg1_sketches", """SELECT count(*) AS events, min(epoch_us(ts) // 1000) AS first_ms, max(epoch_us(ts) // 1000) AS last_ms, CAST(count(DISTINCT CAST(ts AS DATE)) AS BIGINT) AS days, true AS users_within, true AS ids_within FROM events""")
def _(spark, sf_dir):
    """Estimates of distinct values from sketches of days stay within four standard errors of the exact numbers."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"))
    days = written(features.daily(rows, "timestamp", "user_id", "event_id"), "days")
    exact = rows.agg(F.countDistinct("user_id").alias("users"), F.countDistinct("event_id").alias("ids"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.col(b) * 4 * 1.04 / 128
    told = features.merged(days, "user_id", "event_id").crossJoin(days.agg(F.count("*").alias("days"))).crossJoin(exact)  # one row each
    return told.select("events", "first_ms", "last_ms", "days", near("user_id", "users").alias("users_within"), near("event_id", "ids").alias("ids_within"))


@query("agg7_lossless", f"SELECT {PACK} AS pack, count(*) AS records, CAST(sum(strlen({LINE})) AS BIGINT) AS bytes, count(*) AS matching, true AS lossless FROM events GROUP BY ALL")
def _(spark, sf_dir):
    placed = written(detect.route(vault.place(records(spark, sf_dir), block_bytes=1 << 16)), "placed")
    back = vault.read(placed.select("locator", "claimed", "raw_bytes", "raw_sha256"), written(vault.blocks(placed), "blocks"))
    tallied = back.withColumns({"same": F.col("intact") & (F.sha2("raw", 256) == F.col("raw_sha256")), "pack": F.coalesce("claimed", F.lit(detect.SALVAGE))})
    return features.lossless(tallied, "pack")


@query("vlt6_random_read", f"SELECT event_id, {LINE} AS said, true AS intact FROM events WHERE event_type = 'error'")
def _(spark, sf_dir):
    placed = written(vault.place(records(spark, sf_dir), block_bytes=1 << 16), "placed")
    wanted = placed.join(events(spark, sf_dir).where("event_type = 'error'").select(F.col("event_id").alias("line_no")), "line_no").select("line_no", "locator")
    return vault.read(wanted, written(vault.blocks(placed), "blocks")).select(F.col("line_no").alias("event_id"), F.col("raw").cast("string").alias("said"), "intact")


@query("nrm67_lookups", """SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 4 WHEN '3-MEDIUM' THEN 3 ELSE 1 END AS INT) AS severity_id,
  CAST(CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END AS INT) AS disposition_id, CAST(CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END AS INT) AS status_id FROM orders""")
def _(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    word = F.when(F.col("o_orderpriority") == "1-URGENT", "CRITICAL").when(F.col("o_orderpriority") == "2-HIGH", "High").when(F.col("o_orderpriority") == "3-MEDIUM", "warn").otherwise("other")
    act = F.when(F.col("o_orderstatus") == "F", "Denied").when(F.col("o_orderstatus") == "O", "ACCEPT").otherwise("?")
    state = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "OK").otherwise("unknown")
    return df.select("o_orderkey", lookups.severity_id(word).alias("severity_id"), lookups.disposition_id(act).alias("disposition_id"), lookups.status_id(state).alias("status_id"))


@query("sequence", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS sequence FROM events")
def _(spark, sf_dir):
    return chain.sequenced(events(spark, sf_dir).select("event_id", "ts"), "ts", "event_id", parts=16).select("event_id", "sequence")


def chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lake rows of the rendered lines, with names as verification wants them."""
    return written(lake.flat(pipeline.process(records(spark, sf_dir), inference=False, keep=lake.kept()).events).withColumnRenamed("ocsf_json", "event_json"), "chained")


def both_levels(rows: DataFrame, links: DataFrame, *within: int) -> DataFrame:
    return chain.verify(rows, *within, chain="_chain", links=links)


@query("att4_att5_chain", "SELECT true AS ok, count(*) AS events, CAST(NULL AS BIGINT) AS broken_sequence FROM events")
def _(spark, sf_dir):
    rows = chained(spark, sf_dir)
    return both_levels(rows, chain.linked(chain.ranges(rows, "_chain")))


@query("att15_tamper", "SELECT false AS ok, count(*) AS events, CAST(500 AS BIGINT) AS broken_sequence FROM events")
def _(spark, sf_dir):
    rows = chained(spark, sf_dir)
    return both_levels(chain.tampered(rows, 500), chain.linked(chain.ranges(rows, "_chain")))


def small_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with two members, chained per type in ranges of 64 numbers: what SQL can chain again."""
    rows = events(spark, sf_dir).select(F.col("event_id").cast("string").alias("event_id"), F.col("event_type").alias("chain_id"), F.struct("event_type", "user_id").alias("event"), F.col("event_id").alias("at"))
    return written(chain.append(chain.sequenced(rows, "at", parts=16).drop("at"), size=64), "small-chain")


#: every step of a range takes one row of each range, all ranges at once
CHAINED = """WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY event_type, r ORDER BY s) AS k FROM (SELECT *, (s - 1) // 64 AS r FROM (SELECT event_id, event_type, user_id, row_number() OVER (ORDER BY event_id) AS s FROM events))),
c(event_type, r, k, s, prev, fp) AS (SELECT event_type, r, CAST(0 AS BIGINT), CAST(0 AS BIGINT), '', sha256(event_type || '#' || r) FROM e WHERE k = 1
  UNION ALL SELECT e.event_type, e.r, e.k, e.s, c.fp, sha256('{"event_id":"' || e.event_id || '","event_type":"' || e.event_type || '","prev_hash":"' || c.fp || '","sequence":' || e.s || ',"user_id":' || e.user_id || '}')
  FROM c JOIN e ON e.event_type = c.event_type AND e.r = c.r AND e.k = c.k + 1)"""


@query("att4_ranges", f"{CHAINED} SELECT event_type AS chain_id, s AS sequence, prev AS prev_hash, fp AS fingerprint FROM c WHERE k > 0")
def _(spark, sf_dir):
    return small_chain(spark, sf_dir).select("chain_id", "sequence", "prev_hash", "fingerprint")


@query("att4_links", f"""{CHAINED}, h AS (SELECT event_type, r, max(k) AS events, min(s) AS first, max(s) AS last, arg_max(fp, k) AS head, row_number() OVER (PARTITION BY event_type ORDER BY r) AS i FROM c WHERE k > 0 GROUP BY event_type, r),
l(chain_id, i, range, events, first, last, head, prev_link, link) AS (SELECT DISTINCT event_type, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), '', '', repeat('0', 64) FROM h
  UNION ALL SELECT h.event_type, h.i, h.r, h.events, h.first, h.last, h.head, l.link, sha256(l.link || ':' || h.r || ':' || h.events || ':' || h.last || ':' || h.head) FROM l JOIN h ON h.event_type = l.chain_id AND h.i = l.i + 1)
SELECT chain_id, range, events, first, last, head, prev_link, link FROM l WHERE i > 0""")
def _(spark, sf_dir):
    return chain.linked(chain.ranges(small_chain(spark, sf_dir), size=64))


@query("att8_merkle_levels", "WITH RECURSIVE l(level, n) AS (SELECT 0, count(*) FROM events UNION ALL SELECT level + 1, (n + 1) // 2 FROM l WHERE n > 1) SELECT CAST(level AS INT) AS level, n FROM l")
def _(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.col("event_id"), F.sha2(F.col("event_id").cast("string"), 256).alias("fp"))
    numbered = chain.sequenced(rows, "event_id", start=0, parts=16)
    return merkle.levels(numbered, "sequence", "fp").groupBy("level").agg(F.count("*").alias("n"))


@query("att12_blocks", "SELECT max(event_id + 1) AS checkpoint_seq, count(*) AS events FROM (SELECT row_number() OVER (ORDER BY event_id) - 1 AS event_id FROM events) GROUP BY event_id // 1000")
def _(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", F.sha2(F.col("event_id").cast("string"), 256).alias("fingerprint"))
    # the SQL has no roots; blocks count only with a root, so that all are folded
    return merkle.block_roots(chain.sequenced(rows, "event_id", parts=16)).where(F.length("merkle_root") == 64).select("checkpoint_seq", "events")


@query("att1_att2_canonical", """SELECT event_id, sha256('{"a":"' || event_type || '","b":' || CAST(user_id AS VARCHAR) || '}') AS digest FROM events""")
def _(spark, sf_dir):
    text = F.expr("""'{ "b" : ' || CAST(user_id AS STRING) || ', "a": "' || event_type || '" }'""")
    return events(spark, sf_dir).select("event_id", canonical.digest(canonical.canonical(text)).alias("digest"))


@query("vlt_round_trip", f"SELECT count(*) AS records, count(*) AS matching, CAST(sum(strlen({LINE})) AS BIGINT) AS bytes FROM events")
def _(spark, sf_dir):
    placed = written(vault.place(records(spark, sf_dir), block_bytes=1 << 16), "placed")
    table = written(vault.blocks(placed), "blocks")
    return vault.audit(placed, table).crossJoin(table.agg(F.sum("ulen").alias("bytes")))  # one row each


@query("vlt5_locators", "SELECT event_id, CAST(user_id % 7 AS INT) AS seg, CAST(event_id % 5 AS INT) AS block, event_id AS off, CAST(user_id AS INT) AS len FROM events")
def _(spark, sf_dir):
    made = vault.locator(F.col("user_id") % 7, F.col("event_id") % 5, F.col("event_id"), F.col("user_id"))
    return events(spark, sf_dir).select("event_id", vault.parse_locator(made).alias("l")).select("event_id", "l.*")


LAKE = f"SELECT event_id, CAST(CASE CAST(event_id % 6 AS INT) WHEN 0 THEN 3001 WHEN 2 THEN 2001 WHEN 5 THEN 0 ELSE 4001 END AS INT) AS class_uid, CASE WHEN event_id % 6 < 5 THEN {SRC} ELSE '' END AS src_ip, CAST(CASE WHEN event_id % 6 < 5 THEN {SPORT} END AS INT) AS src_port, CAST(CASE WHEN event_id % 6 BETWEEN 1 AND 4 THEN {DPORT} END AS INT) AS dst_port, CASE CAST(event_id % 6 AS INT) WHEN 0 THEN CASE WHEN event_type = 'error' THEN 'Failed' ELSE 'Accepted' END WHEN 1 THEN 'Built' WHEN 4 THEN 'deny' WHEN 5 THEN '' ELSE event_type END AS activity_name, event_type, ts FROM events"


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lake-like rows without chain, written and read again as a lake is: conditions of the read side reach the scan."""
    e = F.col("event")
    rows = normalized(spark, sf_dir)
    return written(rows.select("event_id", e["class_uid"].alias("class_uid"), F.coalesce(e["src_endpoint"]["ip"], F.lit("")).alias("src_ip"), e["src_endpoint"]["port"].alias("src_port"), e["dst_endpoint"]["port"].alias("dst_port"), F.coalesce(e["activity_name"], F.lit("")).alias("activity_name")), "flat")


@query("prd5_filter", f"SELECT event_id, src_ip, dst_port FROM ({LAKE}) WHERE class_uid = 4001 AND dst_port < 100 ORDER BY event_id")
def _(spark, sf_dir):
    return flat(spark, sf_dir).where(aliased("class_uid = 4001 AND dst_endpoint.port < 100")).orderBy("event_id").select("event_id", "src_ip", "dst_port")


@query("srt3_latest", f"SELECT event_id, class_uid, activity_name FROM ({LAKE}) ORDER BY event_id DESC LIMIT 50")
def _(spark, sf_dir):
    return flat(spark, sf_dir).orderBy(F.desc("event_id")).limit(50).select("event_id", "class_uid", "activity_name")


@query("agg1_summary", "SELECT count(*) AS n, count(DISTINCT user_id) AS users, min(epoch_us(ts) // 1000) AS first_ms, max(epoch_us(ts) // 1000) AS last_ms FROM events")
def _(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return df.agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.min(F.unix_millis(F.col("ts").cast("timestamp"))).alias("first_ms"), F.max(F.unix_millis(F.col("ts").cast("timestamp"))).alias("last_ms"))


@query("agg3_counters", f"SELECT count(*) AS records, CAST(sum(strlen({LINE})) AS BIGINT) AS bytes, count(*) FILTER (event_id % 6 < 5) AS claimed, count(*) FILTER (event_id % 6 = 5) AS salvaged, count(*) FILTER (event_id % 6 = 2) AS alerts FROM events")
def _(spark, sf_dir):
    return features.counters(normalized(spark, sf_dir)).select("records", "bytes", "claimed", "salvaged", "alerts")


@query("fea1_features", f"SELECT event_id, CAST(class_uid AS FLOAT) AS class_uid, CAST(class_uid = 4001 AS FLOAT) AS is_network, CAST(contains(lower(activity_name), 'fail') OR contains(lower(activity_name), 'deny') AS FLOAT) AS is_failed, CAST(coalesce(src_port, 0) AS FLOAT) AS src_port, CAST(coalesce(dst_port, 0) AS FLOAT) AS dst_port FROM ({LAKE})")
def _(spark, sf_dir):
    return features.rows(flat(spark, sf_dir), "event_id")


@query("fea2_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS events, count(DISTINCT user_id % 200) AS src_ips FROM events GROUP BY 1")
def _(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), (F.col("user_id") % 200).alias("src_ip"), F.lit(0).alias("dst_port"), F.col("event_type").alias("activity_name"), F.lit(4001).alias("class_uid"))
    return features.windows(df, "1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), "events", "src_ips")


@query("nrm12_lineage", f"SELECT event_id, {PACK} AS pack, CASE WHEN event_id % 6 = 5 THEN 'SALVAGE_FALLBACK' ELSE 'CLAIMED' END AS status, CAST(strlen({LINE}) AS INT) AS byte_length, 'GREEN' AS band FROM events")
def _(spark, sf_dir):
    rows = normalized(spark, sf_dir).withColumns({"fingerprint": F.lit(""), "prev_hash": F.lit("")})
    return normalize.lineage(rows).select("event_id", F.col("lineage.stage_2_detection.pack").alias("pack"), F.col("lineage.stage_2_detection.status").alias("status"), F.col("lineage.stage_1_raw.byte_length").alias("byte_length"), F.col("lineage.stage_4_inference.confidence_band").alias("band"))


@query("inf11_infer_review")
def _(spark, sf_dir):
    lines_ = events(spark, sf_dir).select("event_id", F.expr(f"'temp=' || CAST(user_id AS STRING) || ' status=' || event_type || ' client_address=' || {SRC}").alias("raw_text"))
    return matching.infer(lines_).select("event_id", F.to_json("mappings").alias("mappings"), "confidence", F.size("review").alias("to_review"))


@query("snk1_lake")
def _(spark, sf_dir):
    return chained(spark, sf_dir).select("event_id", "sequence", "class_uid", "src_ip", "fingerprint")


@query("src1_text_files", f"SELECT count(*) AS records, CAST(sum(strlen({LINE})) AS BIGINT) AS bytes, count(*) AS last_line FROM events")
def _(spark, sf_dir):
    at = fresh(spark, "lines")
    events(spark, sf_dir).select("line").coalesce(1).write.text(at)
    return lines.files(spark, at).agg(F.count("*").alias("records"), F.sum(F.octet_length("raw_bytes")).cast("long").alias("bytes"), F.max("line_no").alias("last_line"))


@query("snk3_ndjson", f"SELECT CAST(class_uid AS BIGINT) AS class_uid, count(*) AS n FROM ({LAKE}) GROUP BY ALL")
def _(spark, sf_dir):
    at = fresh(spark, "ndjson")
    lake.ndjson(pipeline.process(records(spark, sf_dir), inference=False, keep=[F.col("event_id")]).events, at)
    text = spark.read.text(at)
    return text.groupBy(F.get_json_object("value", "$.class_uid").cast("long").alias("class_uid")).agg(F.count("*").alias("n"))


@query("snk4_parquet_days", "SELECT CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month, CAST(day(ts) AS INT) AS day, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY ALL")
def _(spark, sf_dir):
    at = fresh(spark, "days")
    lake.parquet(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts"), at, F.col("ts"))
    back = spark.read.parquet(at).groupBy(*[F.col(c).cast("int").alias(c) for c in ("year", "month", "day")])
    return back.agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("snk1_upsert", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'second' ELSE 'first' END AS lineage_json FROM events")
def _(spark, sf_dir):
    into = lake.Lake(spark, fresh(spark, "upsert"))
    ids = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    into.write(ids.withColumn("lineage_json", F.lit("first")), "lineage_log", 0)
    into.write(ids.where("event_id % 2 = 0").withColumn("lineage_json", F.lit("second")), "lineage_log", 1)
    return into.latest("lineage_log").select("event_id", "lineage_json")


@query("snk5_lineage", f"SELECT {PACK} AS pack, count(*) AS n, CAST(sum(strlen({LINE})) AS BIGINT) AS bytes FROM events GROUP BY ALL")
def _(spark, sf_dir):
    into = lake.Lake(spark, fresh(spark, "lake"))
    pipeline.commit(pipeline.process(records(spark, sf_dir), inference=False, keep=pipeline.for_lake()), into)
    json = lambda path: F.get_json_object("lineage_json", path)
    return client.Client(spark, into.path).lineage().groupBy(json("$.stage_2_detection.pack").alias("pack")).agg(F.count("*").alias("n"), F.sum(json("$.stage_1_raw.byte_length").cast("long")).alias("bytes"))


def asked(spark: SparkSession, sf_dir: str) -> client.Client:
    """A client over a lake with the flat rows, numbered by event."""
    into = lake.Lake(spark, fresh(spark, "asked"))
    into.write(flat(spark, sf_dir).withColumn("sequence", F.col("event_id")), "parsed_logs", upsert=False)
    return client.Client(spark, into.path)


@query("prj1_srt2_query", f"SELECT event_id, src_ip, dst_port FROM ({LAKE}) WHERE class_uid = 4001 AND dst_port < 500 AND src_ip <> 'src_endpoint.ip' ORDER BY event_id LIMIT 25")
def _(spark, sf_dir):
    return asked(spark, sf_dir).query("class_uid = 4001 AND dst_endpoint.port < 500 AND src_endpoint.ip <> 'src_endpoint.ip'", "event_id, src_endpoint.ip, dst_endpoint.port", 25)


@query("prd7_lookup", f"SELECT event_id, class_uid, activity_name FROM ({LAKE}) WHERE event_id = 7")
def _(spark, sf_dir):
    return asked(spark, sf_dir).query("event_id = 7", "event_id, class_uid, activity_name")


@query("prd4_strict", "SELECT count(*) AS n, count(*) AS valid, count(*) AS strictly FROM events")
def _(spark, sf_dir):
    e = F.col("event")
    return normalized(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(normalize.valid(e)).alias("valid"), F.count_if(normalize.strictly_valid(e)).alias("strictly"))


@query("att6_range", "SELECT true AS ok, count(*) AS events, CAST(NULL AS BIGINT) AS broken_sequence FROM (SELECT row_number() OVER (ORDER BY event_id) AS s FROM events) WHERE s BETWEEN 100 AND 899")
def _(spark, sf_dir):
    rows = chained(spark, sf_dir)
    return both_levels(rows, chain.linked(chain.ranges(rows, "_chain")), 100, 899)


@query("srt4_heads", "SELECT 'main' AS chain_id, count(*) AS sequence, true AS last_seal FROM events")
def _(spark, sf_dir):
    rows = written(pipeline.process(records(spark, sf_dir), inference=False, keep=[F.col("chain_id"), F.col("sequence")]).events.select("chain_id", "sequence", "fingerprint"), "heads")
    last = rows.orderBy(F.desc("sequence")).limit(1).select("chain_id", F.col("fingerprint").alias("own"))
    return chain.heads(chain.linked(chain.ranges(rows))).join(last, "chain_id").select("chain_id", "sequence", (F.col("fingerprint") == F.col("own")).alias("last_seal"))


def leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", F.sha2(F.col("event_id").cast("string"), 256).alias("fp"))
    return written(chain.sequenced(rows, "event_id", start=0, parts=16), "leaves")


@query("att7_leaves", r"SELECT event_id, sha256('\x00'::BLOB || encode(sha256(CAST(event_id AS VARCHAR)))) AS leaf FROM events")
def _(spark, sf_dir):
    return leaves(spark, sf_dir).select("event_id", merkle.leaf(F.col("fp")).alias("leaf"))


TREE = r"""WITH RECURSIVE l(level, pos, hash) AS (
  SELECT 0, row_number() OVER (ORDER BY event_id) - 1, sha256('\x00'::BLOB || encode(sha256(CAST(event_id AS VARCHAR)))) FROM events
  UNION ALL SELECT level + 1, pos // 2, sha256('\x01'::BLOB || unhex(arg_min(hash, pos)) || unhex(arg_max(hash, pos))) FROM l GROUP BY level, pos // 2 HAVING (SELECT count(*) FROM l) > 1)"""


@query("att8_nodes", f"{TREE} SELECT CAST(level AS INT) AS level, CAST(pos AS BIGINT) AS place, hash FROM l")
def _(spark, sf_dir):
    return merkle.levels(leaves(spark, sf_dir), "sequence", "fp").select("level", F.col("at").alias("place"), "hash")


@query("att9_att10_proof", f"{TREE}, w AS (SELECT level, count(*) AS n FROM l GROUP BY level), s AS (SELECT level, n, 100 // (1 << level) AS own FROM w WHERE n > 1) SELECT CAST(s.level AS INT) AS step, CASE WHEN own % 2 = 1 THEN 'left' ELSE 'right' END AS direction, hash, true AS proved FROM s JOIN l ON l.level = s.level AND l.pos = CASE WHEN own % 2 = 1 THEN own - 1 WHEN own + 1 < n THEN own + 1 ELSE own END")
def _(spark, sf_dir):
    rows = leaves(spark, sf_dir)
    steps, top = merkle.proof(rows, "sequence", "fp", 100), merkle.root(rows, "sequence", "fp")
    found = spark.createDataFrame([(i, s["direction"], s["hash"]) for i, s in enumerate(steps)], "step int, direction string, hash string")
    path = F.array(*[F.struct(F.lit(s["direction"]).alias("direction"), F.lit(s["hash"]).alias("hash")) for s in steps])
    proved = rows.where("sequence = 100").select(merkle.proved_at(F.col("fp"), F.lit(100), F.lit(rows.count()), path, F.lit(top)).alias("proved"))
    return found.crossJoin(proved)  # one row


@query("att13_att14_signed", "SELECT max(event_id + 1) AS checkpoint_seq, true AS genuine, false AS forged FROM (SELECT row_number() OVER (ORDER BY event_id) - 1 AS event_id FROM events) GROUP BY event_id // 1000")
def _(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", F.sha2(F.col("event_id").cast("string"), 256).alias("fingerprint"))
    signer = keys.Signer(spark)
    signed = written(keys.checkpoints(merkle.block_roots(chain.sequenced(rows, "event_id", parts=16)), signer), "signed")
    told = keys.verified(signed, signer).select("checkpoint_seq", "genuine")
    forged = keys.verified(signed.withColumn("merkle_root", F.lit(merkle.EMPTY)), signer).select("checkpoint_seq", F.col("genuine").alias("forged"))
    return told.join(forged, "checkpoint_seq")


@query("att9_stored_nodes", f"{TREE}, w AS (SELECT count(*) AS n FROM events) SELECT CASE WHEN (pos + 1) * (CAST(1 AS BIGINT) << level) <= n THEN 0 ELSE n END AS tree, CAST(level AS INT) AS level, CAST(pos AS BIGINT) AS place, hash FROM l, w")
def _(spark, sf_dir):
    """The nodes of a tree that grew twice, without those of its earlier right edge."""
    rows = leaves(spark, sf_dir).select(F.col("sequence").alias("at"), merkle.leaf(F.col("fp")).alias("hash"))
    n, into, before = rows.count(), lake.Lake(spark, fresh(spark, "nodes")), 0
    kept = lambda level, start, stop: into.appended("nodes").where((F.col("tree") == 0) & (F.col("level") == level) & F.col("at").between(start, stop - 1)).select("at", "hash")
    for end in (n * 2 // 3, n):
        own = rows.where(F.col("at").between(before >> merkle.HEIGHT << merkle.HEIGHT, end - 1))
        into.write(merkle.grown(own, before, end, kept), "nodes", upsert=False)
        before = end
    return into.latest("nodes").where(F.col("tree").isin(0, n)).select("tree", "level", F.col("at").alias("place"), "hash")


@query("vlt8_index", f"SELECT CAST(sum(strlen({LINE})) AS BIGINT) AS bytes, true AS dense, count(*) AS in_bounds FROM events")
def _(spark, sf_dir):
    placed = written(vault.place(records(spark, sf_dir), block_bytes=1 << 16, segment_bytes=1 << 18), "placed")
    index = vault.headers(written(vault.blocks(placed), "blocks"))
    inside = placed.join(index, ["seg", "block"]).where("off + len <= ulen").agg(F.count("*").alias("in_bounds"))
    whole = index.agg(F.sum("ulen").alias("bytes"), (F.count("*") == F.max(F.col("seg") * 4 + F.col("block")) + 1).alias("dense"))
    return whole.crossJoin(inside)  # one row each


@query("vlt9_encrypted", "SELECT count(*) AS records, count(*) AS matching, CAST(3 AS INT) AS flags FROM events")
def _(spark, sf_dir):
    key = vault.key_of("a passphrase", b"a salt of its own")
    placed = written(vault.place(records(spark, sf_dir), block_bytes=1 << 16), "placed")
    table = written(vault.blocks(placed, key=key), "blocks")
    return vault.audit(placed, table, key).crossJoin(table.agg(F.max("flags").alias("flags")))  # one row each


@query("sal3_urls", f"SELECT page_id, {duck(salvage.URL).replace('text,', 'html,')} AS urls FROM pages")
def _(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.coalesce(F.size(salvage.found(F.col("html"), salvage.URL)), F.lit(0)).alias("urls"))


@query("fea2_ratios", f"SELECT time_bucket(INTERVAL '1 hour', ts) AS start, count(DISTINCT coalesce(dst_port, -1)) AS ports, avg(CAST(contains(lower(activity_name), 'fail') OR contains(lower(activity_name), 'deny') AS INT)) AS failed_ratio, avg(CAST(class_uid = 0 AS INT)) AS unknown_ratio FROM ({LAKE}) GROUP BY 1")
def _(spark, sf_dir):
    times = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"))
    rows = flat(spark, sf_dir).join(times, "event_id").withColumn("dst_port", F.coalesce("dst_port", F.lit(-1)))
    return features.windows(rows, "1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("dst_ports").alias("ports"), "failed_ratio", "unknown_ratio")


@query("agg5_rates", "SELECT avg(CAST(event_id % 6 = 5 AS INT)) AS salvage_rate, avg(CAST(event_id % 6 < 5 AS INT)) AS mapped FROM events")
def _(spark, sf_dir):
    return features.counters(normalized(spark, sf_dir)).select("salvage_rate", "mapped")


@query("sal7_salvaged_events", f"""SELECT event_id, '["' || {SRC} || '"]' AS ips, '[' || {DPORT} || ']' AS ports, 'job <*> of ' || event_type || ' took <*> ms at <*> port <*>' AS template, '0.636' AS specificity FROM events WHERE event_id % 6 = 5""")
def _(spark, sf_dir):
    kept = [F.col("line_no"), F.col("pack"), F.col("event.unmapped").alias("unmapped")]
    rows = pipeline.process(records(spark, sf_dir), keep=kept).events.where(F.col("pack") == detect.SALVAGE)
    rest = lambda k: F.try_element_at(F.col("unmapped"), F.lit(k))
    seen = lambda k: F.get_json_object(rest("observables"), f"$.{k}")
    return rows.select(F.col("line_no").alias("event_id"), seen("ip_addresses").alias("ips"), seen("ports").alias("ports"), rest("cluster_template").alias("template"), rest("specificity").alias("specificity"))


@query("snk2_att16_stream", "SELECT true AS ok, count(*) AS events, CAST(NULL AS BIGINT) AS broken_sequence FROM events")
def _(spark, sf_dir):
    at, where = fresh(spark, "stream"), fresh(spark, "streamed")
    raw = records(spark, sf_dir).select("source", "line_no", "raw_bytes")
    raw.repartition(2, "line_no").write.parquet(at)
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(at)
    ingest.ingest(stream, where, f"{where}-progress").awaitTermination()
    return client.Client(spark, where).verify()  # each batch goes on where the one before ended


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


__all__ = ["flagship", "oracle_sql", "queries", "rendered", "templates"]
