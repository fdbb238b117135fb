"""Prefix trie of conversations in preorder-interval encoding: what shared beginnings save.

A conversation's first d turns are one node of depth d, known by a digest of 128 bits that running sums of position-keyed turn hashes give,
so a conversation of any length is many tasks' work. Distinct nodes are ranked lexicographically, the turns' digests being the alphabet: a
node's key lists the children chosen at branching nodes above it, and depth decides within a chain without branches (a path with m
branches needs m other conversations, so keys stay below the square root of the rows). In this preorder a subtree is an interval. Its end
is the last place at which one of its conversations ends, and leaves and savings are differences of prefix sums over the ranked table.

Defined cases: turns without a conversation id take no part; null role or text counts as empty; a null turn comes first; equal turn numbers
follow role and then the digest of the turn; repeated rows are turns of their own; conversations without turns are members of the root;
an empty table gives an empty table; other columns, whatever their names, are not read. Texts are hashed in place and never travel, so
their length doesn't matter. Nodes are told apart by 128 bits of SHA-256 sums: for 10^12 nodes two collide with probability 10^-15.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .prefix_sums import running

#: 32-bit words of a turn's hash.
WORDS = 4
#: Characters of a list of ids that are joined before they are hashed.
CHUNK = 1 << 16
NOTHING = hashlib.sha256(b"").hexdigest()


def numbered(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, at (from 1 in each conversation), digest and chars (code points of the text) of each turn."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(said(role)).cast("string"), F.lit(":"), said(role), said(text)).cast("binary"), 256)
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("conv_id"), F.col(turn).alias("turn"), said(role).alias("role"), digest.alias("digest"), F.char_length(said(text)).cast("long").alias("chars"))
    return running(rows, ["conv_id", "turn", "role", "digest"], segment="conv_id", name="turns").select("conv_id", "at", "digest", "chars")


def rebuilt(turns: DataFrame, family: int = 100, most: int = 6) -> DataFrame:
    """Conversations after their beginnings are made common: the first h turns come from conversation c - c % family, the rest from c.

    h is the CRC-32 of the decimal id modulo `most`. turns: as numbered() gives them.
    """
    convs = turns.groupBy("conv_id").agg(F.max("at").alias("n"))
    plan = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h"))
    bases = convs.select(F.col("conv_id").alias("base"), "n")
    plan = written(plan.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("n", F.lit(0)))).drop("n"), "plan")
    heads = turns.where((F.col("conv_id") % family == 0) & (F.col("at") < most)).select(F.col("conv_id").alias("base"), "at", "digest", "chars")
    first = plan.where("taken > 0").join(heads, "base").where("at <= taken").select("conv_id", "at", "digest", "chars")
    own = turns.join(plan.select("conv_id", "h", "taken"), "conv_id").where("at > h").select("conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("at"), "digest", "chars")
    return first.unionByName(own)


def name_of(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"))


def ends(members: DataFrame) -> DataFrame:
    """place and ends_sha256 of (place, conv_id): the digest of the decimal ids, ascending, comma-joined.

    Ranges of ids are joined to chunks side by side; only chunks meet in the task that hashes them one after another.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, first, held, size = None, None, [], 0
        out: list[tuple] = []
        for b in batches:
            for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if held and (p != place or size >= CHUNK):
                    out.append((place, first, ",".join(held)))
                    held, size = [], 0
                if not held:
                    place, first = p, c
                held.append(str(c))
                size += len(held[-1]) + 1
            if out:
                yield chunks(out)
                out = []
        if held:
            yield chunks([(place, first, ",".join(held))])

    def chunks(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["place", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, state = None, hashlib.sha256()
        for b in batches:
            done: list[tuple] = []
            for p, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if p != place:
                    if place is not None:
                        done.append((place, state.hexdigest()))
                    place, state = p, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], names=["place", "ends_sha256"])
        if place is not None:
            yield pa.RecordBatch.from_arrays([pa.array([place], pa.int64()), pa.array([state.hexdigest()], pa.string())], names=["place", "ends_sha256"])

    runs = members.select("place", "conv_id").repartitionByRange("place", "conv_id").sortWithinPartitions("place", "conv_id").mapInArrow(joined, "place long, first long, ids string")
    return runs.repartition("place").sortWithinPartitions("place", "first").mapInArrow(hashed, "place long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, at (gapless from 1), digest, chars; convs: conv_id of all conversations, each once.
    """
    spark = turns.sparkSession
    all_ = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("first")).first()
    columns = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    if not all_["n"]:
        return spark.createDataFrame([], columns)
    keyed = F.sha2(F.concat(F.col("at").cast("string"), F.lit(":"), F.col("digest")).cast("binary"), 256)
    words = [f"w{i}" for i in range(WORDS)]
    rows = turns.select("conv_id", F.col("at").alias("depth"), "chars", keyed.alias("_k")).select("conv_id", "depth", "chars", *[F.conv(F.substring("_k", 1 + 8 * i, 8), 16, 10).cast("long").alias(w) for i, w in enumerate(words)])
    rows = running(rows, ["conv_id", "depth"], words, "conv_id", "sums")
    own = name_of(F.col("depth"), *[F.col(f"sum_{w}") for w in words])
    above = name_of(F.col("depth") - 1, *[F.col(f"sum_{w}") - F.col(w) for w in words])
    rows = written(rows.select("conv_id", "depth", own.alias("node"), above.alias("parent"), "chars"), "rows")

    nodes = rows.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("chars").alias("chars"), F.count("*").alias("n_convs"))
    nodes = written(nodes, "nodes")
    below = nodes.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(below, "node", "left").na.fill(0, ["n_children"]), "nodes-children")
    tops = nodes.where("depth = 1").count()
    # the root is every top node's parent: it is stated, not joined
    first = nodes.where("depth = 1").withColumns({"parent_conv_id": F.lit(all_["first"]).cast("long"), "siblings": F.lit(tops).cast("long")})
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("siblings"))
    nodes = written(first.unionByName(nodes.where("depth > 1").join(parents, "parent")).drop("parent"), "nodes-parents")

    chosen = nodes.where("siblings > 1").select("node")
    paths = rows.select("conv_id", "depth", "node").join(chosen, "node", "left_semi").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("depth", "node"))).alias("path"))
    keys = F.array_join(F.transform(F.filter("path", lambda b: b["depth"] <= F.col("depth")), lambda b: b["node"]), "")
    ranked = nodes.join(paths, "conv_id", "left").withColumn("key", F.coalesce(keys, F.lit(""))).drop("path", "siblings")
    ranked = ranked.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("chars")})
    ranked = written(running(ranked, ["key", "depth"], ["leaf", "saved"], name="ranked").drop("key", "chars").withColumnRenamed("at", "place"), "preorder")

    last = rows.groupBy("conv_id").agg(F.max_by("node", "depth").alias("node"))
    last = written(last.join(ranked.select("node", "place", "sum_leaf", "sum_saved"), "node").drop("node"), "last")
    end = rows.select("conv_id", "node").join(last, "conv_id").groupBy("node").agg(F.max(F.struct("place", "sum_leaf", "sum_saved")).alias("end"))
    silent = convs.select("conv_id").join(last.select("conv_id"), "conv_id", "left_anti").select(F.lit(0).cast("long").alias("place"), "conv_id")
    told = written(ends(last.select("place", "conv_id").unionByName(silent)), "ends")

    whole = ranked.join(end, "node").join(told, "place", "left")
    whole = whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("end.sum_leaf") - F.col("sum_leaf") + F.col("leaf")).alias("n_leaves"), (F.col("end.sum_saved") - F.col("sum_saved") + F.col("saved")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))
    total = ranked.agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved")).first()
    own_ends = told.where("place = 0").first()
    root = spark.createDataFrame([(all_["first"], 0, None, all_["n"], tops, total["leaves"] or 1, total["saved"] or 0, own_ends["ends_sha256"] if own_ends else NOTHING)], columns)
    return root.unionByName(whole)
