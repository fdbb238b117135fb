"""Template mining: the parse tree against a plain one, ids and sizes over batches, vendor hints."""

import random

import pytest
from pyspark.sql import functions as F

from logweir.operators import clusters, lake
from logweir.plans import pipeline
from logweir.sources import lines
from logweir.sources.tables import written


def plain_tree(templates, similarity=0.5):
    """Each template into the cluster of its leaf that agrees in most places; all clusters are looked at."""
    leaves, out = {}, []
    for t in templates:
        own = t.split()
        lead = own[0] if own and not any(c in "0123456789<>" for c in own[0]) else "*"
        known = leaves.setdefault((len(own), lead), [])
        scored = [(sum(a == b != "<*>" for a, b in zip(c, own, strict=True)), c.count("<*>"), -i) for i, c in enumerate(known)]
        best = max(scored, default=None)
        if best and best[0] and best[0] >= similarity * len(own):
            c = known[-best[2]]
            c[:] = [a if a == b else "<*>" for a, b in zip(c, own, strict=True)]
        else:
            c = list(own)
            known.append(c)
        out.append(c)
    return [" ".join(c) for c in out]


def drawn(seed, n):
    rnd = random.Random(seed)
    shapes = [["user", "{a}", "logged", "{b}", "from", "{c}"], ["disk", "{a}", "{b}", "full"], ["user", "{a}", "{b}", "{c}", "{a}", "{b}"], ["<NUM>", "{a}", "jobs"], ["end"]]
    words = ["alpha", "beta", "gamma", "in", "out", "<IP>", "<NUM>", "<*>", "x1"]
    made = {" ".join(t.format(a=rnd.choice(words), b=rnd.choice(words), c=rnd.choice(words)) for t in rnd.choice(shapes)): None for _ in range(n)}
    return list(made)


@pytest.mark.parametrize(("seed", "similarity"), [(1, 0.5), (2, 0.5), (3, 0.7)])
def test_tree_equals_a_plain_one(spark, seed, similarity):
    templates = drawn(seed, 300)
    df = spark.createDataFrame(list(enumerate(templates, 1)), "cluster_id long, template string").repartition(3)
    got = {r["cluster_id"]: r["merged"] for r in clusters.refine(df, similarity).collect()}
    assert [got[i] for i in range(1, len(templates) + 1)] == plain_tree(templates, similarity)


def test_large_leaves_are_merged_in_groups(spark):
    """No template is lost, clusters cover their templates, and what agrees in enough places has met."""
    templates = [f"open {x} by {y} on node {z}" for x in "abcdefg" for y in "mnopq" for z in "uvwxyz"]
    df = spark.createDataFrame(list(enumerate(templates, 1)), "cluster_id long, template string")
    rows = clusters.refine(df, leaf=20).collect()
    assert len(rows) == len(templates)
    for r in rows:
        assert all(a in (b, "<*>") for a, b in zip(r["merged"].split(), r["template"].split(), strict=True))
    assert {r["merged"] for r in rows} == {"open <*> by <*> on node <*>"}
    alone = [f"open {x} {x}2 {x}3" for x in "abcdefghij"] * 1
    df = spark.createDataFrame(list(enumerate(alone, 1)), "cluster_id long, template string")
    assert {r["merged"] for r in clusters.refine(df, leaf=3).collect()} == set(alone)


def test_messages_are_mined_with_named_masks(spark):
    said = ["get 0x1F from 10.0.0.1 took 12", "get 0x2 from 10.0.0.2 took 7", "put 1 of 0f8fad5b-d9cb-469f-a165-70867728950e", "idle"]
    df = spark.createDataFrame(list(enumerate(said)), "sequence long, raw_text string")
    got = [(r["cluster_id"], r["template"], r["count"]) for r in clusters.mine(df).orderBy("cluster_id").collect()]
    assert got == [(1, "get <HEX> from <IP> took <NUM>", 2), (2, "put <NUM> of <UUID>", 1), (3, "idle", 1)]
    assert clusters.mine(df.where("false")).count() == 0


def test_ids_and_sizes_go_on_in_a_lake(spark, tmp_path):
    text = [f"work {i} done by {'abc'[i % 3]}" for i in range(12)] + ["work 1 done by d", "other 5"]
    into = lake.Lake(spark, str(tmp_path / "lake"))
    for n, some in enumerate((text[:5], text[5:9], text[9:])):
        pipeline.commit(pipeline.process(lines.records(spark, some, f"f{n}"), **pipeline.resume(into)), into, n)
    got = {r["template"]: (r["cluster_id"], r["count"], r["sample"]) for r in into.latest("clusters").collect()}
    assert got == {"work <*> done by a": (1, 4, text[0]), "work <*> done by b": (2, 4, text[1]), "work <*> done by c": (3, 4, text[2]), "work <*> done by d": (4, 1, text[12]), "other <*>": (5, 1, "other 5")}
    known = into.latest("clusters")
    more = spark.createDataFrame([(1, "work 7 done by a"), (2, "work 8 done by a"), (3, "new one")], "sequence long, raw_text string")
    sized = [(r["cluster_id"], r["cluster_size"]) for r in clusters.assign(more, known=known).orderBy("sequence").collect()]
    assert sized == [(1, 5), (1, 6), (6, 1)]


@pytest.mark.parametrize("hint", ["Acme Corp", None])
def test_vendor_hints_name_custom_fields_and_the_vendor(spark, hint):
    rows = lines.records(spark, ["zzqx=81 vvwk=ok", "Oct 12 10:14:22 web-01 sshd[77]: Failed password for root from 198.51.100.4 port 4022 ssh2"])
    events = written(pipeline.process(rows, vendor_hint=hint).events, "hinted").orderBy("line_no").collect()
    name = (hint or "unknown").lower()
    assert set(events[0]["mappings"].values()) == {f"custom.{name}.zzqx", f"custom.{name}.vvwk"}
    assert events[0]["event"]["metadata"]["product"]["vendor_name"] == (hint or "Generic")
    assert events[0]["event"]["unmapped"][f"custom.{name}.zzqx"] == "81"
    assert events[1]["event"]["metadata"]["product"]["vendor_name"] == "Linux"
