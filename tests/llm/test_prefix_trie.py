"""The prefix trie against a walk over plain dictionaries."""

import hashlib
import random
import zlib

import pytest

from logweir.llm import prefix_sums, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, at int"


def brute(rows):
    convs = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append((t is not None, t or 0, role, digest, text))
    convs = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in convs.items()}
    whole = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(convs.get(c - c % 100, [])[:h] + own[h:])
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = set()
    for path, own in members.items():
        below = [p for p in members if p[: len(path)] == path]
        inner = {p[:-1] for p in members if p}
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        ids = ",".join(map(str, sorted(c for c in own if whole[c] == path)))
        out.add((min(own), len(path), min(members[path[:-1]]) if path else None, len(own), sum(p[:-1] == path for p in members if p), sum(p not in inner for p in below), saved, hashlib.sha256(ids.encode()).hexdigest()))
    return out


def told(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)
    turns = prefix_trie.numbered(df)
    got = prefix_trie.trie(prefix_trie.rebuilt(turns), turns.select("conv_id").distinct()).collect()
    assert len(got) == len({tuple(r) for r in got})
    return {tuple(r) for r in got}


def drawn(seed, convs=60, most=9):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(0, 400), convs):
        for t in range(rnd.randrange(1, most)):
            rows.append((c, t, rnd.choice(["user", "assistant"]), rnd.choice(["a", "bb", "é€", "", "longer text"])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_walk(spark, seed):
    rows = drawn(seed)
    assert told(spark, rows) == brute(rows)


def test_nulls_ties_and_repeats(spark):
    rows = [(1, None, "user", "x"), (1, 0, None, "y"), (1, 0, "user", None), (1, 0, "user", None), (None, 1, "user", "gone"), (2, 5, "b", "1"), (2, 5, "a", "2"), (0, 1, "user", "only"), (100, 1, "u", "t"), (101, None, None, None)]
    assert told(spark, rows) == brute(rows)


def test_copies_and_one_very_long_conversation(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(600, 640) for t in range(4)]
    rows += [(7, t, "user", "same" if t % 2 else "é" * 50) for t in range(900)]
    assert told(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert told(spark, []) == set()


def test_running_sums_over_many_ranges(spark):
    rnd = random.Random(3)
    rows = [(0 if rnd.random() < 0.5 else rnd.randrange(1, 40), i, rnd.randrange(-5, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "s long, i long, x long").repartition(5)
    for segment in ("s", None):
        order = ["s", "i"] if segment else ["i"]
        got = prefix_sums.running(df, order, ["x"], segment).collect()
        count, total = {}, {}
        for r in sorted(got, key=lambda r: [r[o] for o in order]):
            k = r["s"] if segment else 0
            count[k], total[k] = count.get(k, 0) + 1, total.get(k, 0) + r["x"]
            assert (r["at"], r["sum_x"]) == (count[k], total[k])
        assert len(got) == len(rows)


def test_ids_of_an_end_are_hashed_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 10)
    members = [(p, c) for p in (0, 3) for c in range(-5, 200 + p)]
    df = spark.createDataFrame(members, "place long, conv_id long").repartition(3)
    got = {r["place"]: r["ends_sha256"] for r in prefix_trie.ends(df).collect()}
    assert got == {p: hashlib.sha256(",".join(str(c) for c in range(-5, 200 + p)).encode()).hexdigest() for p in (0, 3)}
