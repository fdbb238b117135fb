import inspect
import json

import pytest
from pyspark.sql import functions as F

from logweir.__main__ import described, main
from logweir.client import Client
from logweir.operators import clusters, features, lake
from logweir.plans.queries import queries
from logweir.sources.lines import records

LINES = [
    "Oct 12 10:14:22 web-01 sshd[77]: Failed password for root from 198.51.100.4 port 4022 ssh2",
    "job 17 of nightly took 30 ms at 203.0.113.9 port 88",
    "temperature=81 status=ok",
]


def test_a_second_run_goes_on_from_the_first(spark, tmp_path):
    source, output = tmp_path / "in.log", tmp_path / "out"
    source.write_text("\n".join(LINES) + "\n")
    for run in (1, 2):
        assert main(["process", str(source), "--output", str(output)]) == 0
        told = json.loads((output / "metadata.json").read_text())
        assert json.loads((output / "normalized.json").read_text())[0]["raw_data"] == LINES[0] and told["compression_ratio"] > 0
        assert (told["format"], told["source"], told["valid"], told["rejected"], told["claimed"], told["salvaged"], told["file_size_bytes"]) == ("OpenSSH", "Linux", 3, 0, 1, 2, source.stat().st_size)
        assert told["chain_ok"] and told["records_read_back"] == told["records_matching"] == told["records"] == 3
        rows = lake.Lake(spark, f"{output}/lake").latest("parsed_logs").select("sequence", "event_id").collect()
        assert sorted(r["sequence"] for r in rows) == list(range(1, 3 * run + 1)) and len({r["event_id"] for r in rows}) == 3 * run


@pytest.mark.parametrize(
    ("text", "name", "source", "expected"),
    [
        (LINES[0], None, None, ("OpenSSH", "Linux")),
        ("# CEF:\na=1 b=2", None, None, ("Key-Value", "Security Device")),
        ("LEEF:1.0|V|P|1|7|a=1", None, None, ("LEEF", "Security Device")),
        ('{"a": 1}', None, "Mine", ("JSON", "Mine")),
        ("<34>Oct 11 22:14:15 m su: x", None, None, ("Syslog (RFC 3164)", "Syslog")),
        ("plain words", None, None, ("Raw / Unstructured", "Generic")),
        ("plain words", " KV ", None, ("Key-Value", "Generic")),
        ("plain words", "odd", "Mine", ("ODD", "Mine")),
        ("# only", None, None, ("Generic", "Log Source")),
    ],
)
def test_formats_and_sources_are_described(spark, text, name, source, expected):
    assert described(records(spark, text.split("\n")), name=name, source=source) == expected


def test_passphrases_of_runs_must_agree(spark, tmp_path):
    source, output, config = tmp_path / "in.log", str(tmp_path / "out"), tmp_path / "c.yaml"
    source.write_text(LINES[0] + "\n")
    for passphrase, code in (("one", 0), ("two", 1), ("one", 0)):
        config.write_text(f"passphrase: {passphrase}\nsource: {source}\n")
        assert main(["process", "--config", str(config), "--output", output, "--source", "Hinted"]) == code
    assert main(["process", str(tmp_path / "none"), "--output", output]) == 3 and main(["process", "--bad"]) == 2
    (tmp_path / "empty.log").write_text("\n \n")
    assert main(["process", str(tmp_path / "empty.log"), "--output", output]) == 4


def test_sketches_of_days_add_up(spark):
    df = spark.range(20_000).select((F.col("id") * 10_000).alias("timestamp"), (F.col("id") % 3000).alias("src_ip"))
    days = features.daily(df, "timestamp", "src_ip")
    got = features.merged(days, "src_ip").first()
    assert days.count() == 3 and (got["events"], got["first_ms"], got["last_ms"]) == (20_000, 0, 199_990_000)
    assert abs(got["src_ip"] - 3000) < 3000 * 0.04


def test_last_commit_counts_and_only_what_the_manifest_names(spark, tmp_path):
    into = lake.Lake(spark, str(tmp_path / "lake"), buckets=4)
    made = lambda rows: spark.createDataFrame(rows, "event_id string, lineage_json string")
    into.write(made([(str(i), "first") for i in range(40)]), "lineage_log", batch=7, upsert=False)
    lost = into.begin(8)
    lost.write(made([("1", "lost"), ("99", "lost")]), "lineage_log")  # its writer fails before the commit
    assert into.latest("lineage_log").where("lineage_json = 'lost'").isEmpty() and not into.committed(8)
    into.write(made([("1", "second"), ("50", "second")]), "lineage_log", batch=8)
    got = {r["event_id"]: r["lineage_json"] for r in into.latest("lineage_log").collect()}
    assert len(got) == 41 and got["1"] == got["50"] == "second" and got["2"] == "first" and into.committed(8)
    assert into.lookup("lineage_log", "1").first()["lineage_json"] == "second" and into.lookup("lineage_log", "x").isEmpty()
    with pytest.raises(Exception, match="exist"):
        lost.commit()
    assert lake.Lake(spark, into.path, buckets=9).buckets == 4
    into.compact("lineage_log")
    assert len(into.seen("lineage_log")) == 1 and into.vacuum() == 2
    assert {r["event_id"]: r["lineage_json"] for r in into.latest("lineage_log").collect()} == got


def test_lookups_read_one_bucket(spark, tmp_path):
    into = lake.Lake(spark, str(tmp_path / "lake"), buckets=8)
    into.write(spark.range(200).select(F.col("id").alias("event_id"), F.col("id").alias("sequence"), F.lit("x").alias("src_ip")), "parsed_logs", upsert=False)
    client = Client(spark, into.path)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for where in ("event_id = 7", "src_ip = 'x or y' AND event_id = 7", "event_id = 7 and sequence < 9"):
        assert "_bucket" in plan(client.query(where)).split("PartitionFilters: [")[1].split("]")[0], where
    assert client.query("event_id = 7").count() == 1
    for where in ("event_id = 7 OR sequence = 8", "event_id = 3 + 4", "NOT event_id = 7", "src_ip = 'event_id = 7'", "(event_id = 7)"):
        assert client.only(where) is None, where
    assert client.query("event_id = 7 OR sequence = 8").count() == 2 and client.query("event_id = 3 + 4").count() == 1


def test_running_sizes_go_over_stretches(spark):
    df = spark.range(300).select((F.col("id") * 1000).alias("sequence"), F.when(F.col("id") % 3 == 0, "a b").otherwise(F.concat(F.lit("c "), F.col("id").cast("string"))).alias("raw_text"))
    got = {(r["template"], r["sequence"]): r["cluster_size"] for r in clusters.assign(df).collect()}
    seen = {}
    for i in range(300):
        t = "a b" if i % 3 == 0 else "c <*>"
        seen[t] = seen.get(t, 0) + 1
        assert got[(t, i * 1000)] == seen[t]


def test_every_registered_query_takes_a_session_and_a_folder():
    for name, f in queries().items():
        assert len(inspect.signature(f).parameters) == 2, name
