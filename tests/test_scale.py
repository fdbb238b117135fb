"""What keeps tasks short on larger tables, and fields read by name the same as by mapping."""

import dataclasses

from pyspark.sql import functions as F

from logweir.operators import chain, detect, lake, normalize
from logweir.plans import pipeline
from logweir.sources import lines
from logweir.sources.packs import BUILT_IN
from logweir.sources.tables import fresh, written


def events_of(rows, packs=BUILT_IN):
    rows = detect.extract(detect.route(rows, packs), packs).withColumns({"locator": F.lit("weir:raw:0:0:0:1"), "raw_sha256": F.lit("x")})
    return normalize.normalize(rows, packs)


def test_twice_the_rows_are_twice_the_tasks(spark):
    small, large = (lines.spread(spark.range(0, n, 1, 2)) for n in (20 * lines.SPREAD, 40 * lines.SPREAD))
    assert (small.rdd.getNumPartitions(), large.rdd.getNumPartitions()) == (20, 40)
    assert large.agg(F.sum("id")).first()[0] == sum(range(40 * lines.SPREAD))


def test_a_small_scan_still_uses_all_cores(spark):
    assert lines.spread(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == 4


def test_blank_lines_are_left_out(spark):
    got = lines.records(spark, ["", " \t ", "\n", " a ", b"\xff"]).orderBy("line_no").collect()
    assert [(r["line_no"], r["raw_text"]) for r in got] == [(4, "a"), (5, "\ufffd")]


def test_of_equal_json_members_the_last_counts(spark):
    line = '{"event_type":"a","src_ip":"1.1.1.1","src_ip":"2.2.2.2","other":"x","other":"y"}'
    row = events_of(lines.records(spark, [line])).select("event.src_endpoint.ip", F.try_element_at("event.unmapped", F.lit("other")).alias("other"), F.size("fields").alias("n")).first()
    assert tuple(row) == ("2.2.2.2", "y", 3)


def test_fields_by_name_are_those_by_inferred_mapping(spark):
    to = {"srcip": "src_endpoint.ip", "dstip": "src_endpoint.ip", "srcport": "time", "action": "activity_name.x", "devname": "message", "type": "class_uid", "proto": "a_b.c", "foo": "a.b_c", "zed": "severity_id"}
    packs = [dataclasses.replace(p, mappings=to) if p.id == "fortinet_fortios" else p for p in BUILT_IN]
    said = [
        'devname="fw" type=traffic srcip=1.2.3.4 dstip=5.6.7.8 srcport=99 action=deny proto=6 foo=1 zed=high user=bob host=h level=3 msg=hi time=12 more=1',
        'devname="fw" type=traffic dstip=5.6.7.8 srcip=1.2.3.4 srcport=abc class_uid=7 severity=high status=failed result=ok',
        "CEF:0|A|B|1|5|name|High|src=1.1.1.1 dst=2.2.2.2 spt=5 dpt=x act=deny proto=udp",
        "nothing claims this",
    ]
    rows = detect.extract(detect.route(lines.records(spark, said), packs), packs).withColumns({"locator": F.lit("weir:raw:0:0:0:1"), "raw_sha256": F.lit("x")})
    by_name = normalize.normalize(rows, packs)
    by_map = normalize.normalize(rows.withColumn("mappings", F.lit(None).cast("map<string,string>")), packs)
    told = [[r[0] for r in df.orderBy("line_no").select(F.to_json("event")).collect()] for df in (by_name, by_map)]
    assert told[0] == told[1] and '"time":99' in told[0][0] and '"time":"abc"' in told[0][1] and '"ip":"5.6.7.8"' in told[0][0] and '"ip":"1.2.3.4"' in told[0][1]


def test_events_of_one_chain_are_not_shuffled(spark):
    """Lines are dealt by ranges before they are decoded; a later batch goes on within the last range; all hold as one chain."""
    said = [f"job {i} of x took {i} ms at 10.0.0.{i % 250} port 7" for i in range(200)]
    run = pipeline.process(lines.records(spark, said[:150]), inference=False, chain_size=64)
    plan = run.events._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and plan.index("MapInArrow") < plan.index("xml_text") < plan.index("RepartitionByExpression")
    first = written(run.events.drop("lineage"), "first")
    heads = first.orderBy(F.desc("sequence")).limit(1).select("chain_id", "sequence", "fingerprint")
    rest = pipeline.process(lines.records(spark, said[150:]), inference=False, chain_size=64, start=151, heads=heads).events
    both = first.select("chain_id", "sequence", "prev_hash", "fingerprint", "event_json").unionByName(rest.select("chain_id", "sequence", "prev_hash", "fingerprint", "event_json"))
    assert tuple(chain.verify(both, chain="chain_id", size=64).first()) == (True, 200, None)


def test_a_later_batch_of_many_ranges_is_chained_in_order(spark):
    """Its lines lie in several files, and ranges reach over them; their sort isn't lost below the join with heads."""
    said = [f"job {i} of {'x' * (i * 37 % 91)} took {i} ms at 10.0.0.{i % 250} port 7" for i in range(1500)]
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "4k", "spark.sql.files.openCostInBytes": "1k"}
    known = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        heads = spark.createDataFrame([("main", 500, "f" * 64)], "chain_id string, sequence long, fingerprint string")
        rest = pipeline.process(lines.records(spark, said), inference=False, chain_size=64, start=501, heads=heads, keep=[F.col("sequence")]).events
        assert rest.columns == ["sequence", "prev_hash", "fingerprint", "event_json"]
        rest = written(rest, "rest")
    finally:
        for k, v in known.items():
            spark.conf.set(k, v)
    assert rest.where("sequence = 501").first()["prev_hash"] == "f" * 64
    assert tuple(chain.verify(rest, size=64, start=501).first()) == (True, 1500, None)


def test_rows_that_stay_in_their_tasks_are_found_by_bucket(spark):
    into = lake.Lake(spark, fresh(spark, "undealt"))
    own = into.begin(0)
    own.write(spark.range(0, 1000, 1, 7).select(F.col("id").cast("string").alias("event_id")), "lineage_log", upsert=False, dealt=False)
    own.commit()
    assert into.latest("lineage_log").count() == 1000 and into.lookup("lineage_log", "77").count() == 1


def test_only_the_columns_asked_for_are_chained(spark):
    """What is left out of events doesn't go through Python; seals, lake rows and lineage are the same."""
    said = [f"job {i} of x took {i} ms at 10.0.0.{i % 250} port 7" for i in range(30)] + ['devname="fw" type=traffic srcip=1.2.3.4 action=deny'] * 5
    whole = pipeline.process(lines.records(spark, said), inference=False, chain_size=8).events
    some = pipeline.process(lines.records(spark, said), inference=False, chain_size=8, keep=pipeline.for_lake()).events
    assert "event" not in some.columns and "fields" not in some.columns
    told = [sorted(map(str, lake.flat(df).collect())) for df in (whole, some)]
    traced = [sorted(r[0] for r in df.select(F.to_json("lineage")).collect()) for df in (whole, some)]
    assert told[0] == told[1] and traced[0] == traced[1] and len(told[0]) == 35
    slim = pipeline.process(lines.records(spark, said), inference=False, chain_size=8, keep=[F.col("sequence")]).events
    assert slim.columns == ["sequence", "prev_hash", "fingerprint", "event_json"]
    assert sorted(map(str, slim.collect())) == sorted(map(str, whole.select(*slim.columns).collect()))


def test_generated_methods_are_small_enough_to_be_compiled(spark):
    events_of(lines.records(spark, ["a=1 b=2"]))
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= detect.COMPILED
