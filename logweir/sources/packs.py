"""Source definitions ("packs"): what claims a line, how it is decoded and which fields go where; built in, or from a folder of YAML files."""

from __future__ import annotations

import json
import logging
from dataclasses import dataclass, field
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Pack:
    """A source definition. contains: all must occur (any case); prefixes: one must start the line; patterns: one must be found."""

    id: str
    vendor: str = "Generic"
    product: str = "Unknown"
    name: str = ""
    version: str = "1.0"
    class_uid: int = 1001
    category_uid: int | None = None
    contains: tuple[str, ...] = ()
    prefixes: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    decoders: tuple[str, ...] = ("json",)
    regex: str | None = None
    mappings: dict[str, str] = field(default_factory=dict)
    labels: tuple[str, ...] = ()
    fixtures: tuple[dict, ...] = ()

    @property
    def category(self) -> int:
        return self.class_uid // 1000 if self.category_uid is None else self.category_uid

    @classmethod
    def parsed(cls, id: str, entry: dict) -> Pack:
        seen = entry.get("detection") or {}
        return cls(
            id=id,
            vendor=entry.get("vendor", "Generic"),
            product=entry.get("product", "Unknown"),
            name=entry.get("name", id),
            version=str(entry.get("version", "1.0")),
            class_uid=int(entry.get("class_uid", 1001)),
            category_uid=None if entry.get("category_uid") is None else int(entry["category_uid"]),
            contains=tuple(seen.get("contains") or ()),
            prefixes=tuple(seen.get("prefixes") or ()),
            patterns=tuple(seen.get("patterns") or ()),
            decoders=tuple(entry.get("decoders") or ("json",)),
            regex=entry.get("regex_pattern"),
            mappings=dict(entry.get("mappings") or {}),
            labels=tuple(entry.get("labels") or ()),
            fixtures=tuple(entry.get("fixtures") or ()),
        )


# fixed values: the built-in sources, in the order in which they claim
BUILT_IN = (
    Pack(
        "apache_access", "Apache", "HTTP Server", "Apache access log", "2.4", 4001,
        patterns=(r'^\d+\.\d+\.\d+\.\d+\s+-\s+[^\s]+\s+\[\d{2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2}\s+[+-]\d{4}\]\s+"(GET|POST|PUT|DELETE|HEAD|OPTIONS)',),
        decoders=("regex",),
        regex=r'^(?P<src_ip>\d+\.\d+\.\d+\.\d+)\s+-\s+(?P<username>[^\s]+)\s+\[(?P<timestamp>[^\]]+)\]\s+"(?P<http_method>[A-Z]+)\s+(?P<url>[^\s]+)\s+HTTP/[0-9.]+"\s+(?P<status_code>\d+)\s+(?P<bytes_sent>\d+)',
        mappings={"src_ip": "src_endpoint.ip", "username": "actor.user.name", "http_method": "http_request.http_method", "url": "http_request.url", "status_code": "status_id"},
        labels=("web", "apache", "http"),
    ),
    Pack(
        "apache_error", "Apache", "HTTP Server", "Apache error log", "2.4", 1001,
        patterns=(r"^\[[A-Za-z]{3}\s+[A-Za-z]{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+\d{4}\]\s+\[(notice|error|warn|crit|alert|emerg|info|debug)\]",),
        decoders=("regex",),
        regex=r"^\[(?P<timestamp>[A-Za-z]{3}\s+[A-Za-z]{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+\d{4})\]\s+\[(?P<severity>[^\]]+)\]\s+(?:\[client\s+(?P<src_ip>[^\]]+)\]\s+)?(?P<message>.*)",
        mappings={"src_ip": "src_endpoint.ip", "severity": "severity", "message": "message"},
        labels=("web", "apache", "error_log"),
    ),
    Pack(
        "aws_vpc_flow", "AWS", "VPC Flow", "AWS VPC flow log", "2", 4001,
        patterns=(r"^2\s+\d+\s+eni-[a-f0-9]+\s+\d+\.\d+\.\d+\.\d+\s+\d+\.\d+\.\d+\.\d+\s+\d+\s+\d+",),
        decoders=("csv",),
        mappings={"col_3": "src_endpoint.ip", "col_4": "dst_endpoint.ip", "col_5": "src_endpoint.port", "col_6": "dst_endpoint.port", "col_7": "connection_info.protocol_num", "col_12": "activity_name"},
        labels=("cloud", "aws", "vpc"),
    ),
    Pack(
        "cef", "Firewall", "CEF", "CEF firewall", "1.0", 4001,
        patterns=(r"^CEF:\d+\|", r"\s+CEF:\d+\|"),
        decoders=("cef",),
        mappings={"device_vendor": "metadata.product.vendor_name", "device_product": "metadata.product.name", "device_version": "metadata.product.version", "device_event_class_id": "metadata.event_code", "name": "activity_name", "severity": "severity"},
        labels=("cef", "firewall", "security"),
    ),
    Pack(
        "cisco_asa", "Cisco", "ASA", "Cisco ASA firewall", "9.16", 4001,
        contains=("%ASA-",),
        patterns=(r"%ASA-\d-\d{6}:",),
        decoders=("regex", "syslog_rfc3164"),
        regex=r"%ASA-(?P<severity>\d)-(?P<message_id>\d{6}):\s+(?P<action>Built|Teardown)\s+(?P<direction>\w+)\s+(?P<protocol>TCP|UDP|ICMP)\s+connection\s+\d+\s+for\s+(?P<src_interface>[^:]+):(?P<src_ip>\d+\.\d+\.\d+\.\d+)/(?P<src_port>\d+)\s+to\s+(?P<dst_interface>[^:]+):(?P<dst_ip>\d+\.\d+\.\d+\.\d+)/(?P<dst_port>\d+)",
        mappings={"src_ip": "src_endpoint.ip", "src_port": "src_endpoint.port", "dst_ip": "dst_endpoint.ip", "dst_port": "dst_endpoint.port", "action": "activity_name"},
        labels=("firewall", "cisco", "network"),
    ),
    Pack(
        "fortinet_fortios", "Fortinet", "FortiGate", "Fortinet FortiOS", "7.2", 4001,
        contains=("type=traffic", "devname="),
        decoders=("keyvalue",),
        mappings={"srcip": "src_endpoint.ip", "dstip": "dst_endpoint.ip", "srcport": "src_endpoint.port", "dstport": "dst_endpoint.port", "action": "activity_name", "proto": "connection_info.protocol_num", "devname": "device.hostname"},
        labels=("firewall", "fortinet", "fortigate"),
    ),
    Pack(
        "linux_sshd", "Linux", "OpenSSH", "OpenSSH logins", "1.0", 3001,
        contains=("sshd",),
        patterns=(r"sshd\[\d+\]: (Accepted|Failed) (password|publickey)",),
        decoders=("regex", "syslog_rfc3164"),
        regex=r"sshd\[(?P<pid>\d+)\]:\s+(?P<action>Accepted|Failed)\s+(?P<auth_method>\w+)\s+for\s+(?P<username>[^\s]+)\s+from\s+(?P<src_ip>\d+\.\d+\.\d+\.\d+)\s+port\s+(?P<src_port>\d+)",
        mappings={"username": "actor.user.name", "src_ip": "src_endpoint.ip", "src_port": "src_endpoint.port", "action": "activity_name"},
        labels=("auth", "ssh", "linux"),
    ),
    Pack(
        "nginx_access", "F5 Nginx", "Nginx", "Nginx access log", "1.24", 4001,
        patterns=(r"^\d+\.\d+\.\d+\.\d+\s+-\s+\[\d{2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2}",),
        decoders=("regex",),
        regex=r'^(?P<src_ip>\d+\.\d+\.\d+\.\d+)\s+-\s+\[(?P<timestamp>[^\]]+)\]\s+"(?P<http_method>[A-Z]+)\s+(?P<url>[^\s]+)\s+HTTP/[0-9.]+"\s+(?P<status_code>\d+)\s+(?P<bytes_sent>\d+)\s+"(?P<referrer>[^"]*)"\s+"(?P<user_agent>[^"]*)"',
        mappings={"src_ip": "src_endpoint.ip", "http_method": "http_request.http_method", "url": "http_request.url", "status_code": "status_id"},
        labels=("web", "nginx", "proxy"),
    ),
    Pack(
        "paloalto_panos", "Palo Alto Networks", "PAN-OS", "PAN-OS traffic", "10.2", 4001,
        contains=("TRAFFIC",),
        patterns=(r"^1,\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2}:\d{2},\d+,TRAFFIC,",),
        decoders=("csv",),
        mappings={"col_7": "src_endpoint.ip", "col_8": "dst_endpoint.ip", "col_24": "src_endpoint.port", "col_25": "dst_endpoint.port", "col_29": "connection_info.protocol_name", "col_30": "activity_name"},
        labels=("firewall", "paloalto", "panos"),
    ),
    Pack(
        "rfc5424_fallback", "IETF", "Syslog", "RFC 5424 syslog", "RFC5424", 1001,
        patterns=(r"^<\d{1,3}>1\s+",),
        decoders=("syslog_rfc5424",),
        mappings={"hostname": "device.hostname", "app": "metadata.product.name", "procid": "process.pid", "msgid": "metadata.event_code", "message": "message"},
        labels=("syslog", "standard", "rfc5424"),
    ),
    Pack(
        "suricata_eve", "OISF", "Suricata", "Suricata EVE", "7.0", 2001,
        contains=('"event_type"', '"src_ip"'),
        decoders=("json",),
        mappings={"src_ip": "src_endpoint.ip", "src_port": "src_endpoint.port", "dest_ip": "dst_endpoint.ip", "dest_port": "dst_endpoint.port", "proto": "connection_info.protocol_name", "event_type": "activity_name"},
        labels=("ids", "suricata", "security_finding"),
    ),
    Pack(
        "windows_security", "Microsoft", "Windows", "Windows security events", "10/11/Server", 3001,
        contains=("Microsoft-Windows-Security-Auditing",),
        decoders=("xml", "json"),
        mappings={"TargetUserName": "actor.user.name", "WorkstationName": "device.hostname", "IpAddress": "src_endpoint.ip", "IpPort": "src_endpoint.port"},
        labels=("windows", "security", "auth"),
    ),
)


def from_folder(path: str) -> list[Pack]:
    """Packs of a folder: *.yaml by name, then *.yml; files that can't be read are logged and left out; of equal stems the later one counts."""
    found: dict[str, Pack] = {}
    for file in [*sorted(Path(path).glob("*.yaml")), *sorted(Path(path).glob("*.yml"))]:
        try:
            found[file.stem] = Pack.parsed(file.stem, yaml.safe_load(file.read_text(encoding="utf-8")) or {})
        except Exception as e:  # a bad file must not stop the others
            log.warning("source definition %s can't be read: %s", file, e)
    return list(found.values())


def read_config(path: str) -> dict:
    """Settings (output, packs, passphrase, source) of a YAML or JSON file."""
    raw = Path(path).read_text(encoding="utf-8")
    return (json.loads(raw) if path.endswith(".json") else yaml.safe_load(raw)) or {}


def listing(spark: SparkSession, packs: list[Pack] | tuple[Pack, ...] = BUILT_IN) -> DataFrame:
    """The packs as a table, in claim order."""
    rows = [(i, p.id, p.vendor, p.product, p.version, p.class_uid, p.category, list(p.decoders), len(p.mappings), list(p.labels)) for i, p in enumerate(packs)]
    return spark.createDataFrame(rows, "place int, pack string, vendor string, product string, version string, class_uid int, category_uid int, decoders array<string>, mappings int, labels array<string>")
