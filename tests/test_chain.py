"""The two-level chain against hashing row after row."""

import hashlib

import pytest
from pyspark.sql import functions as F

from logweir.operators import chain, lake
from logweir.plans import pipeline
from logweir.sources import lines
from logweir.sources.tables import written

SHA = lambda text: hashlib.sha256(text.encode()).hexdigest()


def events(spark, first, last):
    """Numbered events of two chains, one with three quarters of them."""
    rows = spark.range(first, last + 1).select(F.col("id").alias("sequence"), F.col("id").cast("string").alias("event_id"), F.when(F.col("id") % 4 == 0, "rare").otherwise("hot").alias("chain_id"))
    return rows.withColumn("event", F.struct(F.concat(F.lit("e"), "event_id").alias("activity_name"), F.lit('a "quoted" text').alias("raw_data")))


def brute(first, last, size):
    """{sequence: (prev_hash, fingerprint)} and the links of each chain."""
    out, links, ends = {}, {}, {}
    for s in range(first, last + 1):
        c, r = "hot" if s % 4 else "rare", (s - 1) // size
        prev = ends[c][1] if c in ends and ends[c][0] == r else SHA(f"{c}#{r}")
        out[s] = (prev, SHA(f'{{"activity_name":"e{s}","event_id":"{s}","prev_hash":"{prev}","raw_data":"a \\"quoted\\" text","sequence":{s}}}'))
        ends[c] = (r, out[s][1])
        n = links.setdefault(c, {}).get(r, (0,))[0]
        links[c][r] = (n + 1, s, out[s][1])
    told = {}
    for c, own in links.items():
        end = "0" * 64
        for r, (n, s, head) in sorted(own.items()):
            end = SHA(f"{end}:{r}:{n}:{s}:{head}")
            told[c, r] = end
    return out, told


@pytest.mark.parametrize("size", [3, 8, 1000])
def test_batches_equal_one_chain(spark, size):
    expected, links = brute(1, 60, size)
    whole = written(chain.append(events(spark, 1, 60), size=size), "whole")
    assert {r["sequence"]: (r["prev_hash"], r["fingerprint"]) for r in whole.collect()} == expected
    assert {(r["chain_id"], r["range"]): r["link"] for r in chain.linked(chain.ranges(whole, size=size)).collect()} == links
    # the second batch begins within a range, and takes over where each chain ended
    one = written(chain.append(events(spark, 1, 29), size=size), "one")
    first = written(chain.linked(chain.ranges(one, size=size)), "first-links")
    two = written(chain.append(events(spark, 30, 60), heads=chain.heads(first), size=size), "two")
    assert {r["sequence"]: (r["prev_hash"], r["fingerprint"]) for r in one.unionByName(two).collect()} == expected
    second = chain.linked(chain.ranges(two, size=size), first).collect()
    renewed = {(r["chain_id"], r["range"]): r["link"] for r in first.collect()} | {(r["chain_id"], r["range"]): r["link"] for r in second}
    assert renewed == links and sum(r["events"] for r in second if r["range"] == 29 // size) >= 1


@pytest.mark.parametrize("size", [4, 7, 1000])
def test_verification_finds_the_first_break(spark, size):
    rows = written(chain.append(events(spark, 1, 24).where("chain_id = 'hot'"), size=size), "rows")
    links = written(chain.linked(chain.ranges(rows, size=size)), "links")
    told = lambda df, *w: chain.verify(df, *w, chain="chain_id", size=size, links=links).first()["broken_sequence"]
    alone = lambda df, *w: chain.verify(df, *w, chain="chain_id", size=size).first()["broken_sequence"]
    assert told(rows) is None and alone(rows) is None
    assert told(rows, 7, 18) is None and alone(rows, 6) is None and told(rows, 30) is None
    for broken in (alone, told):
        assert broken(chain.tampered(rows, 9)) == 9
        assert broken(rows.withColumn("prev_hash", F.when(F.col("sequence") == 10, "x").otherwise(F.col("prev_hash")))) == 10
        assert broken(rows.withColumn("fingerprint", F.when(F.col("sequence") == 11, None).otherwise(F.col("fingerprint")))) == 11
    # what rows alone don't show: the end of a range, a whole range, the end of the chain
    assert told(rows.where("sequence <= 20")) is not None and alone(rows.where("sequence <= 20")) is None
    for r in range(-(-24 // size)):
        assert told(rows.where((F.col("sequence") - 1 < r * size) | (F.col("sequence") > (r + 1) * size))) is not None
    # links themselves
    for bad in (links.withColumn("link", F.when(F.col("range") == 0, "x").otherwise(F.col("link"))), links.where("range > 0"), links.withColumn("head", F.when(F.col("range") == 0, "x").otherwise(F.col("head")))):
        assert chain.verify(rows, chain="chain_id", size=size, links=bad).first()["broken_sequence"] is not None


def test_no_stage_orders_all_rows(spark):
    plan = chain.append(events(spark, 1, 60), size=8)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "hashpartitioning(_chain" in plan


def test_a_lake_of_several_chains_goes_on(spark, tmp_path):
    into = lake.Lake(spark, str(tmp_path / "lake"))
    text = [f"temp={i} status=ok" for i in range(30)]
    for n in range(3):
        rows = lines.records(spark, text[n * 10 : n * 10 + 10], f"file{n}").withColumn("source", F.concat(F.lit("s"), (F.col("line_no") % 2).cast("string")))
        pipeline.commit(pipeline.process(rows, chain_by="source", chain_size=8, inference=False, **pipeline.resume(into)), into, n, 8)
    rows = into.latest("parsed_logs", technical=True).withColumnRenamed("ocsf_json", "event_json")
    links = into.latest("chain_links")
    assert sorted(r["sequence"] for r in rows.collect()) == list(range(1, 31))
    assert links.agg(F.sum("events")).first()[0] == 30
    assert chain.verify(rows, chain="_chain", size=8, links=links).first().asDict() == {"ok": True, "events": 30, "broken_sequence": None}
    assert chain.verify(rows.where("sequence <> 17"), chain="_chain", size=8, links=links).first()["broken_sequence"] is not None
