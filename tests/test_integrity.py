import hashlib
import json

import pytest
from pyspark.sql import functions as F

from logweir.client import Client, aliased
from logweir.operators import chain, features, keys, lake, merkle, vault
from logweir.plans import pipeline
from logweir.sources import lines, packs
from logweir.sources.tables import written
from logweir.streaming import ingest, sources

LINES = [f"Oct 12 10:14:22 web-01 sshd[{i}]: {'Failed' if i % 3 else 'Accepted'} password for root from 10.0.0.{i} port {1000 + i} ssh2" for i in range(40)] + ['job 7 took 12 ms client="x" user=bob', "plain text 5", "the_username_x=ann flavour=plain"]


@pytest.fixture(scope="module")
def client(spark, tmp_path_factory):
    into = lake.Lake(spark, str(tmp_path_factory.mktemp("lake")))
    pipeline.commit(pipeline.process(lines.records(spark, LINES), now_ms=5), into)
    return Client(spark, into.path)


def test_lake_and_queries(client):
    rows = client.query("src_endpoint.ip = '10.0.0.7'").collect()
    assert len(rows) == 1 and rows[0]["user_name"] == "root" and rows[0]["src_port"] == 1007
    assert [r["sequence"] for r in client.query(limit=3, select="sequence, src_ip").collect()] == [1, 2, 3]
    assert client.logs().count() == len(LINES) == client.lineage().count()
    assert aliased("src_endpoint.ip = 'src_endpoint.ip'") == "src_ip = 'src_endpoint.ip'"
    assert client.latest(1).first()["sequence"] == len(LINES)
    assert sum(b.num_rows for b in client.batches(client.query(), 10)) == len(LINES)


def test_raw_bytes_come_back(client):
    row = client.query("sequence = 41").first()
    assert client.raw(row["event_id"]) == LINES[40].encode()
    assert client.raw("unknown") is None


def test_chain_and_tampering(client):
    assert client.verify().first().asDict() == {"ok": True, "events": len(LINES), "broken_sequence": None}
    assert client.verify(10, 20).first()["ok"]
    rows = client.chained()
    assert client.tamper_test(7).first()["broken_sequence"] == 7
    assert chain.verify(rows.where("sequence <> 20")).first()["broken_sequence"] == 21
    first = rows.orderBy("sequence").first()
    body = first["event_json"].replace(f'"fingerprint":"{first["fingerprint"]}",', "")
    assert hashlib.sha256(body.encode()).hexdigest() == first["fingerprint"] and first["prev_hash"] == hashlib.sha256(b"main#0").hexdigest()


def test_inference_and_review(client):
    e = {r["sequence"]: r for r in client.logs().collect()}
    assert e[41]["user_name"] == "bob"
    told = client.review_queue().where("source_key = 'the_username_x'").collect()
    assert [(r["suggested_target"], r["status"]) for r in told] == [("actor.user.name", "PENDING")] and 0.6 <= told[0]["confidence"] < 0.85
    client.approve(told[0]["review_id"])
    assert client.review_queue().where("source_key = 'the_username_x'").isEmpty() and client.lake.latest("review_queue").where("status = 'APPROVED'").count() == 1


def test_lineage_of_events_without_a_record(spark, client, tmp_path):
    into = lake.Lake(spark, str(tmp_path / "rows"))
    into.write(client.logs(), "parsed_logs", upsert=False)
    other, one = Client(spark, into.path), client.logs().where("sequence = 3").select("event_id")
    short = json.loads(other.lineage(one).first()["lineage_json"])
    assert set(short) == {"event_id", "stage_1_raw", "stage_5_normalization", "stage_6_attestation"}
    into.write(client.lake.latest("lineage_log").where("event_id <> '" + one.first()["event_id"] + "'"), "lineage_log", upsert=False)
    assert json.loads(other.lineage(one).first()["lineage_json"]) == short and other.lineage().count() == len(LINES)


def test_results_come_in_pieces_made_by_tasks(client):
    pieces = list(client.batches(client.query(select="sequence, src_ip"), 10))
    assert all(0 < p.num_rows <= 10 for p in pieces) and [x for p in pieces for x in p["sequence"].to_pylist()] == list(range(1, len(LINES) + 1))
    assert list(client.batches(client.query("sequence < 0"))) == []


def test_mapped_paths_become_members(spark, tmp_path):
    (tmp_path / "own.yaml").write_text("detection: {prefixes: ['x:']}\ndecoders: [keyvalue]\nmappings: {a: tls.version, b: src_endpoint.zone, c: tls.cipher.name, d: message.x, e: device.hostname.y, f: tls.cipher}\n")
    (tmp_path / "two.yaml").write_text("detection: {prefixes: ['y:']}\ndecoders: [keyvalue]\nmappings: {src_ip: src_endpoint.ip}\n")
    own = packs.from_folder(str(tmp_path))
    rows = pipeline.process(lines.records(spark, ["x: a=1.3 b=dmz c=aes d=4 e=5 f=6", "x: b=dmz src_ip=10.0.0.1", "y: src_ip=10.0.0.2 k=v"]), own, inference=False).events.orderBy("line_no").select("event").collect()
    one, two, three = [r["event"] for r in rows]
    assert one["tls"].asDict() == {"cipher": "6", "version": "1.3"} and one["src_endpoint"].asDict() == {"ip": None, "port": None, "zone": "dmz"}
    assert {k: one["unmapped"][k] for k in ("tls.cipher.name", "message.x", "device.hostname.y")} == {"tls.cipher.name": "aes", "message.x": "4", "device.hostname.y": "5"}
    assert two["src_endpoint"].asDict() == {"ip": "10.0.0.1", "port": None, "zone": None} and two["tls"] is None  # the line's own keys replace the object
    assert three["src_endpoint"].asDict() == {"ip": "10.0.0.2", "port": None, "zone": None} and three["unmapped"]["k"] == "v"


def brute_root(fingerprints):
    row = [hashlib.sha256(b"\0" + f.encode()).digest() for f in fingerprints]
    while len(row) > 1:
        row = [hashlib.sha256(b"\1" + row[i] + row[min(i + 1, len(row) - 1)]).digest() for i in range(0, len(row), 2)]
    return row[0].hex() if row else merkle.EMPTY


@pytest.mark.parametrize(("n", "height"), [(0, 2), (1, 2), (2, 2), (3, 2), (5, 2), (13, 2), (33, 3)])
def test_merkle_root_and_proofs(spark, n, height, monkeypatch):
    prints = [f"f{i}" for i in range(n)]
    df = written(spark.createDataFrame(list(enumerate(prints)), "i long, fp string"), "leaves")
    whole = merkle.levels
    monkeypatch.setattr(merkle, "levels", lambda *a: whole(*a, height=height))
    root = merkle.root(df, "i", "fp")
    assert root == brute_root(prints)
    for at in {0, n // 2, n - 1} & set(range(n)):
        steps = merkle.proof(df, "i", "fp", at)
        row = spark.createDataFrame([(prints[at], at, n, steps, root)], "fp string, at long, n long, steps array<struct<direction:string,hash:string>>, root string")
        assert row.select(merkle.proved(F.col("fp"), F.col("steps"), F.col("root"))).first()[0]
        assert row.select(merkle.proved_at(F.col("fp"), F.col("at"), F.col("n"), F.col("steps"), F.col("root"))).first()[0]
        assert not row.select(merkle.proved(F.lit("other"), F.col("steps"), F.col("root"))).first()[0]


def test_signed_checkpoints(spark, client):
    signer = keys.Signer(spark)
    rows = client.checkpoint(signer, size=16).orderBy("checkpoint_seq").collect()
    assert [r["checkpoint_seq"] for r in rows] == [16, 32, 43]
    prints = [r["fingerprint"] for r in client.query(limit=16).collect()]
    assert rows[0]["merkle_root"] == brute_root(prints) and rows[0]["chain_head"] == prints[-1]
    again = keys.Signer(spark, *signer.stored())
    assert all(keys.genuine(r, again) for r in rows)
    assert not keys.genuine(rows[0], keys.Signer(spark))


@pytest.mark.parametrize("key", [None, vault.key_of("secret", b"salt")])
def test_vault_round_trip(spark, key):
    data = [bytes([i % 256]) * (i % 97) + b"x" for i in range(600)]
    placed = written(vault.place(lines.records(spark, data), block_bytes=4096, segment_bytes=16384), "placed")
    table = written(vault.blocks(placed, key=key), "blocks")
    assert table.count() > 4 and table.select("seg").distinct().count() > 1
    back = vault.read(placed.select("raw_bytes", "locator"), table, key=key)
    assert back.where("raw <> raw_bytes or not intact or raw is null").isEmpty()
    bad = table.withColumn("crc", F.col("crc") + 1)
    assert vault.audit(placed, bad, key).first()["matching"] == 0
    assert vault.latest(table) == (placed.agg(F.max("seg")).first()[0], table.where(f"seg = {placed.agg(F.max('seg')).first()[0]}").agg(F.max("block")).first()[0])


def test_short_locators_and_nonsense(spark):
    df = spark.createDataFrame([("weir:raw:3:100:7",), ("nonsense",), (None,)], "l string").select(vault.parse_locator(F.col("l")).alias("p"))
    got = [r["p"] for r in df.collect()]
    assert (got[0]["seg"], got[0]["block"], got[0]["off"], got[0]["len"]) == (3, 0, 100, 7) and got[1:] == [None, None]


def test_stream_goes_on_where_the_lake_ends(spark, tmp_path):
    sources.register(spark)
    log = tmp_path / "app.log"
    into = str(tmp_path / "lake")

    def run():
        stream = spark.readStream.format("tail").option("path", str(log)).option("from", "start").load()
        query = ingest.ingest(stream, into, str(tmp_path / "cp"), processingTime="0 seconds")
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    log.write_text("\n".join(LINES[:5]) + "\n")
    run()
    with log.open("a") as f:
        f.write("\n".join(LINES[5:9]) + "\nhalf a line")
    run()
    client = Client(spark, into)
    assert client.verify().first()["events"] == 9 and client.verify().first()["ok"]
    assert [r["raw_payload"] for r in client.query().collect()] == LINES[:9]


def test_features(client):
    got = client.features("sequence").orderBy("sequence").first()
    assert (got["class_uid"], got["is_network"], got["src_port"]) == (3001.0, 0.0, 1000.0)
    text = features.prometheus({"records": 3, "salvage_rate": 0.5})
    assert "logweir_records 3" in text and "gauge" in text
