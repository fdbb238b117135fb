"""python -m logweir process FILE [--output DIR] [--packs DIR] [--config FILE] [--format NAME] [--source NAME] [--no-integrity] [--json]
python -m logweir collect --output DIR [--host HOST] [--port PORT] [--journal DIR] [--every SECONDS]

Exit codes: 0 done, 1 failed, 2 bad arguments, 3 no such file, 4 nothing to read, 5 integrity broken.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .client import Client
from .functions import decoders
from .operators import detect, features, lake, vault
from .operators.normalize import valid
from .plans import pipeline
from .sources import lines, packs

# fixed values: names of formats that may be asked for, and what they are called
FORMATS = {
    "cef": "CEF", "leef": "LEEF", "json": "JSON", "syslog": "Syslog", "rfc3164": "Syslog (RFC 3164)", "rfc5424": "Syslog (RFC 5424)", "cisco": "Cisco ASA", "cisco_asa": "Cisco ASA",
    "paloalto": "Palo Alto PAN-OS", "panos": "Palo Alto PAN-OS", "aws": "AWS VPC Flow", "aws_vpc": "AWS VPC Flow", "fortinet": "Fortinet FortiOS", "fortios": "Fortinet FortiOS", "sshd": "Linux SSHD", "linux_sshd": "Linux SSHD",
    "apache": "Apache Access", "nginx": "Nginx Access", "windows": "Windows Security XML", "keyvalue": "Key-Value", "kv": "Key-Value", "csv": "CSV",
}
# fixed values: format and source of lines that no pack claims, by the first decoder that reads them
UNCLAIMED = [("cef", "CEF", "Firewall"), ("json", "JSON", "Application / Security"), ("leef", "LEEF", "Security Device"), ("syslog_rfc5424", "Syslog (RFC 5424)", "Syslog"), ("syslog_rfc3164", "Syslog (RFC 3164)", "Syslog"), ("keyvalue", "Key-Value", "Security Device")]
OTHER = ("Raw / Unstructured", "Generic")


def described(rows: DataFrame, known=packs.BUILT_IN, name: str | None = None, source: str | None = None) -> tuple[str, str]:
    """(format, source) of records for display: as asked for, else what the first line that is no comment looks like."""
    said = FORMATS.get(name.strip().lower(), name.upper()) if name else None
    if said and source:
        return said, source
    first = rows.where(~F.col("raw_text").startswith("#")).orderBy("source", "line_no").limit(1)
    shapes = F.coalesce(*[F.when(decoders.DECODERS[d](F.col("raw_text")).isNotNull(), F.lit(i)) for i, (d, _, _) in enumerate(UNCLAIMED)], F.lit(len(UNCLAIMED)))
    seen = detect.route(first, known).select("claimed", shapes.alias("shape")).first()
    if seen is None:
        return said or "Generic", source or "Log Source"
    pack = next((p for p in known if p.id == seen["claimed"]), None)
    looks = (*UNCLAIMED, ("", *OTHER))[seen["shape"]][1:]
    if pack:
        looks = (pack.product if pack.product != "Unknown" else pack.name, pack.vendor if pack.vendor != "Generic" else pack.name)
    return said or looks[0], source or looks[1]


def human(size: float) -> str:
    for unit in ("B", "KB", "MB"):
        if size < 1024:
            return f"{size:.0f} {unit}" if unit == "B" else f"{size:.2f} {unit}"
        size /= 1024
    return f"{size:.2f} GB"


def array_file(events: DataFrame, path: str) -> None:
    """The events as one JSON array: tasks write parts beside it, which are put together piece by piece."""
    parts = f"{path}.parts"
    events.orderBy("sequence").select("event_json").write.mode("overwrite").text(parts)
    with open(path, "wb") as out:
        first = True
        out.write(b"[")
        for name in sorted(os.listdir(parts)):
            if name.startswith("part-"):
                with open(f"{parts}/{name}", "rb") as part:
                    for line in part:
                        out.write((b"\n  " if first else b",\n  ") + line.rstrip(b"\n"))
                        first = False
        out.write(b"\n]\n")


def process(args: argparse.Namespace, spark: SparkSession) -> int:
    config = packs.read_config(args.config) if args.config else {}
    source = args.file or config.get("source")
    if not source or not os.path.exists(source):
        print(f"no such file: {source}", file=sys.stderr)
        return 3
    known = packs.from_folder(args.packs or config["packs"]) if args.packs or config.get("packs") else packs.BUILT_IN
    output = args.output or config.get("output") or "output"
    began = time.time()
    rows = lines.files(spark, source)
    if rows.isEmpty():
        print("nothing to read", file=sys.stderr)
        return 4
    into = lake.Lake(spark, f"{output}/lake")
    try:
        key = vault.key_in(into, config["passphrase"]) if config.get("passphrase") else None
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    name, shown = described(rows, known, args.format, args.source)
    run = pipeline.process(rows, known, int(began * 1000), key=key, vendor_hint=args.source, **pipeline.resume(into))
    # totals are observed as the events pass on their way into the lake: no second scan
    seen = Observation("totals")
    run.events = run.events.observe(seen, *features.totals(), F.count_if(valid(F.col("event"))).alias("valid"))
    events = pipeline.commit(run, into, int(began * 1000))
    client = Client(spark, into.path, key)
    totals = features.with_rates(seen.get, time.time() - began, client.vault().agg(F.sum("clen")).first()[0])
    lake.ndjson(events, f"{output}/ndjson")
    array_file(events, f"{output}/normalized.json")
    size = sum(os.path.getsize(os.path.join(d, n)) for d, _, names in os.walk(source) for n in names) if os.path.isdir(source) else os.path.getsize(source)
    summary = {"input_file": source, "file_size_bytes": size, "file_size_human": human(size), "format": name, "source": shown, **totals, "rejected": totals["records"] - totals["valid"]}
    if not args.no_integrity:
        told = client.verify().first()
        audit = vault.audit(events.select("locator", "raw_sha256"), client.vault(), key).first()
        summary |= {"chain_ok": told["ok"], "broken_sequence": told["broken_sequence"], "records_read_back": audit["records"], "records_matching": audit["matching"]}
    summary |= {"seconds": round(time.time() - began, 3), "outputs": {"normalized": f"{output}/normalized.json", "ndjson": f"{output}/ndjson", "lake": into.path, "metadata": f"{output}/metadata.json"}}
    with open(f"{output}/metadata.json", "w", encoding="utf-8") as f:
        json.dump(summary, f, indent=2)
    print(json.dumps(summary) if args.json else "\n".join(f"{k}: {v}" for k, v in summary.items()))
    return 5 if summary.get("chain_ok") is False or summary.get("records_matching") != summary.get("records_read_back") else 0


def collect(args: argparse.Namespace, spark: SparkSession) -> int:
    from .streaming import ingest

    query = ingest.collect(spark, args.host, args.port, f"{args.output}/lake", args.journal or f"{args.output}/journal", f"{args.output}/progress", every=f"{args.every} seconds", inference=True)
    try:
        query.awaitTermination(args.seconds)
    except KeyboardInterrupt:
        pass
    query.stop()
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="logweir", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("process")
    one.add_argument("file", nargs="?")
    for options in (("--output", "-o"), ("--packs",), ("--config", "-c"), ("--format", "-f"), ("--source", "-s")):
        one.add_argument(*options)
    for option in ("--no-integrity", "--json", "--verbose"):
        one.add_argument(option, action="store_true")
    two = commands.add_parser("collect")
    two.add_argument("--output", "-o", required=True)
    two.add_argument("--host", default="127.0.0.1")
    two.add_argument("--port", type=int, default=5140)
    two.add_argument("--journal")
    two.add_argument("--every", type=int, default=5)
    two.add_argument("--seconds", type=int)
    two.add_argument("--verbose", action="store_true")
    try:
        args = parser.parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0) and 2
    spark = SparkSession.builder.appName("logweir").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("INFO" if args.verbose else "ERROR")
    return {"process": process, "collect": collect}[args.command](args, spark)


if __name__ == "__main__":
    sys.exit(main())
