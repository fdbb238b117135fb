"""Enumerations and the catalogue of canonical fields, with the Column expressions that look them up."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# fixed values: word -> id
SEVERITIES = {"unknown": 0, "informational": 1, "info": 1, "low": 2, "medium": 3, "warn": 3, "warning": 3, "high": 4, "err": 4, "error": 4, "critical": 5, "crit": 5, "fatal": 6, "emerg": 6, "emergency": 6}
DISPOSITIONS = {"allow": 1, "allowed": 1, "permit": 1, "pass": 1, "accept": 1, "block": 2, "blocked": 2, "deny": 2, "denied": 2, "drop": 2, "dropped": 2, "reject": 3, "rejected": 3, "quarantine": 4, "isolate": 5, "alert": 6}
STATUSES = {"success": 1, "ok": 1, "passed": 1, "succeeded": 1, "failure": 2, "failed": 2, "error": 2, "fail": 2, "unknown": 0}
SEVERITY_DEFAULT, DISPOSITION_DEFAULT, STATUS_DEFAULT = 1, 0, 0
CLASS_SYSTEM, CLASS_FINDING, CLASS_AUTHENTICATION, CLASS_NETWORK, CLASS_UNMAPPED = 1001, 2001, 3001, 4001, 0
SCHEMA_VERSION = "1.9.0"
#: confidence at which a mapping is taken over, and at which people review it
AUTO, REVIEW = 0.85, 0.60

# fixed values: canonical field -> (type, keywords, description), in the order that breaks ties
CATALOGUE = [
    ("src_endpoint.ip", "ip", "src srcip source_ip sourceip client_ip saddr src_ip client", "Source IP address initiator of network traffic connection packet"),
    ("dst_endpoint.ip", "ip", "dst dstip dest_ip destination_ip destip daddr server_ip target", "Destination IP address target server host receiving network packet"),
    ("src_endpoint.port", "port", "src_port sport source_port srcport client_port", "Source port transport layer socket originating port number"),
    ("dst_endpoint.port", "port", "dst_port dport dest_port destination_port dstport service_port", "Destination port service listening target port number 80 443 22 53"),
    ("actor.user.name", "string", "user username account login uname user_name src_user", "User account name login identity principal username"),
    ("device.hostname", "hostname", "host hostname device_name computer_name sysname machine", "Device host system computer machine hostname name"),
    ("activity_name", "enum", "action act activity event_type operation status disposition", "Action activity event disposition operation result Logon Logoff Block Allow Drop"),
    ("severity_id", "enum", "severity level priority pri sev log_level", "Event severity priority level emergency alert critical error warning info debug"),
    ("http_request.url", "url", "url uri path request_url http_path web_url", "Uniform resource locator web address requested URI path HTTP"),
    ("http_request.http_method", "enum", "method http_method verb", "HTTP method verb GET POST PUT DELETE HEAD OPTIONS PATCH"),
    ("time", "timestamp", "timestamp time date datetime epoch event_time", "Timestamp date time event occurrence epoch millisecond UTC"),
    ("file.name", "string", "filename file file_name path doc_name", "File name executable document artifact path target filename"),
    ("file.hashes.sha256", "string", "sha256 file_hash checksum hash", "Cryptographic SHA256 checksum digest fingerprint of binary or file"),
    ("network_endpoint.mac", "mac", "mac smac dmac mac_address hardware_address", "Hardware MAC address physical network interface adapter"),
    ("message", "string", "msg message description details raw_msg", "Raw event message description payload narrative details text"),
]


def looked_up(word: Column, table: dict[str, int], default: int) -> Column:
    """The id of a word in any case; null stays null."""
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.when(word.isNotNull(), F.coalesce(F.try_element_at(pairs, F.lower(word)), F.lit(default))).cast("int")


def severity_id(word: Column) -> Column:
    return looked_up(word, SEVERITIES, SEVERITY_DEFAULT)


def disposition_id(word: Column) -> Column:
    return looked_up(word, DISPOSITIONS, DISPOSITION_DEFAULT)


def status_id(word: Column) -> Column:
    return looked_up(word, STATUSES, STATUS_DEFAULT)


def catalogue(spark: SparkSession):
    """The canonical fields as a table: place, field, type, keywords, description."""
    rows = [(i, f, t, k.split(), d) for i, (f, t, k, d) in enumerate(CATALOGUE)]
    return spark.createDataFrame(rows, "place int, field string, type string, keywords array<string>, description string")
