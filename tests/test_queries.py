import datetime

import pytest

from logweir.plans.queries import queries


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder with events of which number 1 and 7 have addresses that the claiming pack can't decode."""
    at = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, datetime.datetime(2026, 1, 1, 0, i), -5 if i in (1, 7) else 20 + i, "click", 0.5, '{"k": 1}') for i in range(12)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{at}/events.parquet")
    return at


def test_lines_that_their_pack_cannot_decode_are_mined(spark, odd):
    known = queries()
    assert sorted(r["event_id"] for r in known["sal5_ports"](spark, odd).collect()) == [1, 5, 7, 11]
    assert sorted(r["event_id"] for r in known["tpl5_cluster_sizes"](spark, odd).collect()) == [1, 5, 7, 11]
    for name in ("tpl2_tpl4_templates", "tpl6_top", "tpl1_refine"):
        assert sum(r["n"] for r in known[name](spark, odd).collect()) == 4


def test_keys_are_matched_with_the_values_of_the_table(spark, odd):
    got = {(r["key"], r["confidence"]) for r in queries()["inf10_match"](spark, odd).collect()}
    assert {("src_ip", 1.0), ("dport", 1.0), ("username", 0.94), ("log-level", 0.94)} < got
    assert {k for k, c in got if c < 0.94} <= {"src_ip", "dport"}


def test_roots_of_blocks_are_computed(spark, odd):
    found = queries()["att12_blocks"](spark, odd)
    assert "aggregate(" in found._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in found.select("checkpoint_seq", "events").collect()] == [(12, 12)]
