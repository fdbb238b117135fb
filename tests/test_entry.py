import importlib

import pytest


def test_entry_imports_and_names_agree():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["dec3_keyvalue", "sal5_ports", "tpl6_top", "agg1_summary"])
def test_queries_match_duckdb(spark, name):
    import duckdb

    entry = importlib.import_module("__spark_entry__")
    at = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("events", "documents", "orders", "part"):
        con.sql(f"create view {t} as select * from '{at}/{t}.parquet'")
    got, expected = entry.queries()[name](spark, at).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    assert sorted(map(str, got[columns].values.tolist())) == sorted(map(str, expected[columns].values.tolist()))
