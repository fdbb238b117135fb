from pyspark.sql import functions as F

from logweir.operators import vault


def test_places_and_numbers_are_those_of_one_pass(spark):
    """Blocks of 100 bytes: some begin within a range, some span ranges, one record is longer than a block."""
    rows = [(s, i, bytearray(b"x" * (1 + (7 * i + len(s)) % 40 + 250 * (i == 60)))) for s in ("a", "bb") for i in range(1, 151)]
    df = spark.createDataFrame(rows, "source string, line_no long, raw_bytes binary")
    at, opened, expected = 0, {}, {}
    for n, (s, i, raw) in enumerate(sorted(rows, key=lambda r: r[:2]), 5):
        block = at // 100
        off = at - opened.setdefault(block, at)
        expected[s, i] = (n, f"weir:raw:{2 + block // 4}:{block % 4}:{off}:{len(raw)}")
        at += len(raw)
    placed = vault.place(df.orderBy(F.rand(1)), first_segment=2, block_bytes=100, segment_bytes=400, sequence=5)
    assert {(r["source"], r["line_no"]): (r["sequence"], r["locator"]) for r in placed.collect()} == expected
    assert vault.place(df.limit(0)).count() == 0
