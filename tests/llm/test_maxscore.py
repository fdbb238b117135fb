"""Exact top-k search against brute force over whole-number vectors."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweir.llm import maxscore

SCHEMA = "vec_id long, embedding array<double>, rank int, score string"


def brute(rows, k=5, of=50, scale=256):
    """A list of (rank, id, score) for each query row, in order of query ids."""
    good = []
    for i, v in rows:
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((i, [math.floor(scale * x) for x in v]))
    out = []
    for n, (i, q) in enumerate(good):
        if i is None or i % of:
            continue
        found = [(-sum(a * b for a, b in zip(q, v)), j is None, j or 0) for m, (j, v) in enumerate(good) if m != n]
        out.append((i, tuple((r, None if missing else j, -s) for r, (s, missing, j) in enumerate(sorted(found)[:k], 1))))
    return sorted(out)


def told(spark, rows, k=5, of=50, **more):
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA).repartition(3)
    got = maxscore.search(df, F.col("vec_id") % of == 0, k=k, **more).collect()
    lists, starts = [], sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got), key=lambda r: (r[0], r[1]))
    for q in sorted({r[0] for r in starts}):
        own = [r for r in starts if r[0] == q]
        times = sum(r[1] == 1 for r in own)
        ranks = {}
        for r in own:
            ranks.setdefault(r[1], []).append((r[2], r[3]))
        lists.append((q, times, {k: sorted(v, key=str) for k, v in ranks.items()}))
    return lists


def expected(rows, **more):
    lists = {}
    for q, found in brute(rows, **more):
        lists.setdefault(q, []).append(found)
    out = []
    for q in sorted(lists):
        ranks = {}
        for found in lists[q]:
            for r, i, s in found:
                ranks.setdefault(r, []).append((i, s))
        if ranks:
            out.append((q, len(ranks[1]), {k: sorted(v, key=str) for k, v in ranks.items()}))
    return out


@pytest.mark.parametrize(("kind", "seed"), [("dense", 1), ("sparse", 2), ("ties", 3), ("positive", 4)])
def test_equals_brute_force(spark, kind, seed):
    rnd = random.Random(seed)
    draw = {"dense": lambda: rnd.gauss(0, 0.2), "sparse": lambda: rnd.gauss(0, 1) if rnd.random() < 0.1 else 0.0, "ties": lambda: rnd.choice([0.0, 0.5, -0.5]), "positive": lambda: abs(rnd.gauss(0, 1)) ** 3}[kind]
    rows = [(i, [draw() for _ in range(12)]) for i in range(400)]
    assert told(spark, rows, of=20, shard=64, block=7, seeds=32) == expected(rows, of=20)
    assert told(spark, rows, of=20) == expected(rows, of=20)


def test_a_hot_vector_and_repeated_ids(spark):
    rnd = random.Random(5)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(6)]) for i in range(60)] + [(i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(100, 160)]
    rows += [(50, [0.5] * 6), (50, [0.5] * 6), (7, [2.0] * 6)]
    assert told(spark, rows, shard=16, seeds=8) == expected(rows)


def test_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (50, [-1.0, 0.001]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, []), (None, [1.0, 1.0]), (6, [0.0, 0.0]), (7, [1.0]), (100, [])]
    assert told(spark, rows) == expected(rows)


def test_large_components_leave(spark):
    rows = [(0, [1.0, 1.0]), (1, [1e300, 0.0]), (2, [2.0**22, 2.0**21]), (3, [-1.0, 5.0])]
    assert told(spark, rows) == expected([r for r in rows if r[0] != 1])


def test_few_rows(spark):
    assert told(spark, [(0, [1.0])]) == []
    assert told(spark, []) == []
    assert told(spark, [(0, [1.0]), (3, [-2.0])]) == [(0, 1, {1: [(3, -131072)]})]


def test_terms_below_the_threshold_are_not_traversed():
    x = np.array([[9, 0], [0, 1], [1, 1], [0, 0]])
    shard = maxscore.Shard(np.arange(4), np.arange(4), x)
    shard.held[0] = np.flatnonzero(x[:, 0])
    at, score = shard.best(-1, np.array([5, 1]), 2, 6)
    assert list(zip(at, score)) == [(0, 45), (2, 6)]
