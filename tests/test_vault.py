"""The vault's reads and keys, and the stored Merkle tree."""

import hashlib

import pytest
from pyspark.sql import functions as F

from logweir.client import Client
from logweir.operators import keys, lake, merkle, vault
from logweir.plans import pipeline
from logweir.sources import lines
from logweir.sources.tables import written


def test_reads_of_any_number_open_a_block_once(spark):
    data = [f"record {i} ".encode() * (i % 9) + b"x" for i in range(400)]
    placed = written(vault.place(lines.records(spark, data), block_bytes=2048, segment_bytes=8192), "placed")
    table = written(vault.blocks(placed), "blocks")
    asked = placed.select("locator", "raw_bytes").where("line_no = 7").crossJoin(spark.range(500)).unionByName(placed.where("line_no > 390").select("locator", "raw_bytes", F.lit(-1).cast("long").alias("id")))
    back = vault.read(asked, table)
    assert back.count() == 510 and back.where("raw <> raw_bytes or not intact or raw is null").isEmpty()
    odd = spark.createDataFrame([("weir:raw:9:0:0:4",), ("nonsense",), (None,)], "locator string")
    assert [(r["raw"], r["intact"]) for r in vault.read(odd, table).collect()] == [(None, None)] * 3
    assert vault.read(odd.where("false"), table).count() == 0
    # what leaves the blocks are the bytes asked for
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "LeftSemi" in plan


def test_a_wrong_passphrase_fails(spark, tmp_path):
    one, two = lake.Lake(spark, str(tmp_path / "a")), lake.Lake(spark, str(tmp_path / "b"))
    key = vault.key_in(one, "open")
    assert vault.key_in(one, "open") == key != vault.key_in(two, "open")
    with pytest.raises(ValueError, match="passphrase"):
        vault.key_in(one, "shut")
    placed = written(vault.place(lines.records(spark, ["secret"])), "placed")
    table = written(vault.blocks(placed, key=key), "blocks")
    assert vault.audit(placed, table, key).first()["matching"] == 1
    assert vault.audit(placed, table, b"\1" * 32).first()["matching"] == 0


def brute(prints):
    """Nodes by (level, at)."""
    row, level, out = [hashlib.sha256(b"\0" + f.encode()).digest() for f in prints], 0, {}
    while True:
        out |= {(level, i): h.hex() for i, h in enumerate(row)}
        if len(row) <= 1:
            return out
        row, level = [hashlib.sha256(b"\1" + row[i] + row[min(i + 1, len(row) - 1)]).digest() for i in range(0, len(row), 2)], level + 1


@pytest.mark.parametrize("sizes", [(1, 2, 3), (5, 6, 21), (8, 16, 17, 40), (37,)])
def test_a_tree_that_grows_equals_one_built_at_once(spark, sizes):
    prints = [f"f{i}" for i in range(max(sizes))]
    leaves = spark.createDataFrame(list(enumerate(prints)), "at long, fp string").select("at", merkle.leaf(F.col("fp")).alias("hash"))
    kept, before = {}, 0
    shape = "at long, hash string"
    for n in sizes:
        stored = lambda level, a, b: spark.createDataFrame([(at, h) for (t, x, at), h in kept.items() if t == 0 and x == level and a <= at < b], shape)
        own = leaves.where((F.col("at") >= before >> 2 << 2) & (F.col("at") < n))
        new = {(r["tree"], r["level"], r["at"]): r["hash"] for r in merkle.grown(own, before, n, stored, height=2).collect()}
        assert not set(new) & set(kept)
        kept |= new
        expected, before = brute(prints[:n]), n
        assert {(x, at): h for (t, x, at), h in kept.items() if t in (0, n)} == expected
        assert kept[merkle.top_of(n)] == expected[max(expected)]
        for i in range(n):
            steps = [{"direction": d, "hash": kept[p]} for d, p in merkle.path(i, n)]
            assert merkle.climbed(prints[i], steps) == kept[merkle.top_of(n)]


def test_proofs_are_point_reads_of_stored_nodes(spark, tmp_path):
    into = lake.Lake(spark, str(tmp_path / "lake"))
    client = Client(spark, into.path)
    for n in range(2):
        pipeline.commit(pipeline.process(lines.records(spark, [f"a={i} b={n}" for i in range(9)], f"f{n}"), inference=False, **pipeline.resume(into)), into, n)
        assert client.prove(client.query(f"sequence = {9 * n + 9}").first()["event_id"]) is None  # later than the tree
        assert client.grow_tree() == client.grow_tree() == 9 * n + 9
        rows = client.query().collect()
        nodes = brute([r["fingerprint"] for r in rows])
        for r in (rows[0], rows[4], rows[-1]):
            got = client.prove(r["event_id"])
            assert got["root"] == nodes[max(nodes)] == merkle.climbed(r["fingerprint"], got["proof"]) and got["index"] == r["sequence"] - 1
    assert client.prove("unknown") is None
    plan = client.nodes([(0, 0, 3), (0, 1, 0)])._jdf.queryExecution().executedPlan().toString()
    assert "_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "EqualTo(level,0)" in plan


@pytest.mark.parametrize("n", [1, 2, 7])
def test_blocks_are_verified_alone(spark, n):
    rows = spark.range(1, n * 4 + 1).select(F.col("id").alias("sequence"), F.sha2(F.col("id").cast("string"), 256).alias("fingerprint"))
    signer, other = keys.Signer(spark), keys.Signer(spark)
    signed = written(keys.checkpoints(merkle.block_roots(rows, size=4), signer), "signed")
    told = signed.collect()
    assert len(told) == n and len({r["signature"] for r in told}) == 1
    assert all(keys.genuine(r, signer) and not keys.genuine(r, other) for r in told)
    assert not keys.genuine(told[0].asDict() | {"chain_head": "x"}, signer) and not keys.genuine(told[0].asDict() | {"run_root": "ab"}, signer)
    assert keys.verified(signed, signer).where("genuine").count() == n and keys.verified(signed, other).where("genuine").isEmpty()
    assert keys.verified(signed.withColumn("place", F.col("place") + 1), signer).where("genuine").isEmpty()
    assert keys.checkpoints(merkle.block_roots(rows.where("false"), size=4), signer).isEmpty()
