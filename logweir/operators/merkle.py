"""Merkle trees over fingerprints: roots, inclusion proofs and their verification.

A leaf is sha256(00 | text of the fingerprint), a node sha256(01 | left | right); an odd node is paired with itself. Levels are folded ten
at a time inside of rows (blocks of 1024), so a tree of n leaves takes log1024(n) shuffles.

A tree that grows is kept as a table of nodes. Nodes over a whole number of leaves never change; they are written once, under tree 0. The
others, one a level at most, stand at the right edge and are written for each size of the tree, under that size. So a later size costs
its new leaves and at most 1023 nodes of each tenth level, and a proof is as many point reads as the tree has levels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMPTY = "0" * 64
HEIGHT = 10


def leaf(fingerprint: Column) -> Column:
    return F.sha2(F.concat(F.unhex(F.lit("00")), fingerprint.cast("binary")), 256)


def node(left: Column, right: Column) -> Column:
    """Parent of two hashes in hexadecimal."""
    return F.sha2(F.concat(F.unhex(F.lit("01")), F.unhex(left), F.unhex(right)), 256)


def parents(row: Column) -> Column:
    """The level above an array of hashes."""
    n = F.size(row)
    return F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 2).cast("int")), lambda i: node(F.get(row, i * 2), F.coalesce(F.get(row, i * 2 + 1), F.get(row, i * 2))))


def levels(df: DataFrame, index: str, fingerprint: str, height: int = HEIGHT) -> DataFrame:
    """All nodes: level (0: leaves), at (place from 0), hash. df has consecutive indices from 0."""
    now = df.select(F.col(index).cast("long").alias("at"), leaf(F.col(fingerprint)).alias("hash"))
    return above(now, df.count(), height)


def above(leaves: DataFrame, n: int, height: int = HEIGHT, settled: int = 0, kept: Callable[[int, int, int], DataFrame] | None = None) -> DataFrame:
    """level, at and hash of leaves (at, hash) and all nodes above, of a tree of n leaves.

    Of a tree that had `settled` leaves before, leaves holds those from the last block on, and kept(level, first, end) the earlier nodes
    of a level; the result then has the nodes that these lead to.
    """
    width, base, now, start = n, 0, leaves, settled >> height << height
    out = now.select(F.lit(0).alias("level"), "at", "hash")
    while width > 1:
        top = min(height, (width - 1).bit_length())
        block = now.groupBy(F.shiftright("at", top).alias("b")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "hash"))), lambda e: e["hash"]).alias("row"))  # 2^height entries at most
        rows = [F.col("row")]
        for i in range(top):
            block = block.withColumn(f"r{i}", parents(rows[-1]))
            rows.append(F.col(f"r{i}"))
        folded = block.select("b", F.posexplode(F.array(*rows[1:])).alias("i", "level_row")).select("b", "i", F.posexplode("level_row").alias("j", "hash"))
        # a short last block has fewer nodes a level; beyond a single node it only repeats itself up to the block's height
        placed = folded.select((F.lit(base + 1) + F.col("i")).alias("level"), F.expr(f"shiftleft(b, {top - 1} - i) + j").cast("long").alias("at"), "hash")
        out = out.unionByName(placed)
        base += top
        width = (width + (1 << top) - 1) >> top
        now = placed.where(F.col("level") == base).select("at", "hash")
        if kept is not None:
            first, end = settled >> base >> height << height, start >> top
            now = now.unionByName(kept(base, first, end)) if first < end else now
            start = first
    return out


def grown(leaves: DataFrame, before: int, n: int, kept: Callable[[int, int, int], DataFrame], height: int = HEIGHT) -> DataFrame:
    """tree, level, at and hash of the nodes to be added when a tree of `before` leaves becomes one of n.

    leaves: (at, hash) from the start of the last block of 2^height leaves on; kept: as above() wants it, from tree 0.
    """
    nodes = above(leaves, n, height, before, kept)
    end = F.expr("shiftleft(at + 1, level)")
    whole = end <= n
    return nodes.where(~whole | (end > before)).select(F.when(whole, 0).otherwise(n).cast("long").alias("tree"), "level", "at", "hash")


def path(index: int, n: int) -> list[tuple[str, tuple[int, int, int]]]:
    """(direction, (tree, level, at)) of the siblings of a leaf in a tree of n leaves, from the leaf up."""
    out, level = [], 0
    while n > 1 and -(-n >> level) > 1:
        width, own = -(-n >> level), index >> level
        other = own ^ 1 if own ^ 1 < width else own
        out.append(("left" if own & 1 else "right", (0 if (other + 1) << level <= n else n, level, other)))
        level += 1
    return out


def top_of(n: int) -> tuple[int, int, int]:
    """(tree, level, at) of the root of n leaves."""
    level = (n - 1).bit_length()
    return (0 if 1 << level == n else n, level, 0)


def climbed(text: str, steps: Iterable[Mapping[str, str]] | Sequence) -> str:
    """The root that a fingerprint's proof leads to."""
    now = hashlib.sha256(b"\0" + text.encode()).digest()
    for s in steps:
        other = bytes.fromhex(s["hash"])
        now = hashlib.sha256(b"\1" + (other + now if s["direction"] == "left" else now + other)).digest()
    return now.hex()


def root(df: DataFrame, index: str, fingerprint: str) -> str:
    """Root hash; 64 zeros for no leaves."""
    top = levels(df, index, fingerprint).groupBy("level").agg(F.count("*").alias("n"), F.first("hash").alias("hash")).where("n = 1").orderBy("level").first()
    return top["hash"] if top else EMPTY


def block_roots(df: DataFrame, sequence: str = "sequence", fingerprint: str = "fingerprint", size: int = 1000, start: int = 1) -> DataFrame:
    """A row per `size` events: checkpoint_seq (its last sequence), events, merkle_root, chain_head (its last fingerprint)."""
    leaves = F.transform(F.array_sort(F.collect_list(F.struct(F.col(sequence).alias("s"), leaf(F.col(fingerprint)).alias("h")))), lambda e: e["h"])
    rows = df.groupBy(F.floor((F.col(sequence) - start) / size).alias("block")).agg(leaves.alias("row"), F.max(sequence).alias("checkpoint_seq"), F.count("*").alias("events"), F.max_by(fingerprint, sequence).alias("chain_head"))
    folded = F.aggregate(F.sequence(F.lit(1), F.lit(max(1, (size - 1).bit_length()))), F.col("row"), lambda row, _: F.when(F.size(row) > 1, parents(row)).otherwise(row))
    return rows.select("checkpoint_seq", "events", "chain_head", F.get(folded, F.lit(0)).alias("merkle_root"))


def proof(df: DataFrame, index: str, fingerprint: str, at: int) -> list[dict[str, str]]:
    """Siblings from leaf to root, {direction, hash}; a missing sibling is the node itself, on the right. Folds the whole tree: a lake
    keeps its nodes instead (Client.grow_tree)."""
    wanted = path(at, df.count())
    if not wanted:
        return []
    condition = F.lit(False)
    for _, (_, level, place) in wanted:
        condition = condition | ((F.col("level") == level) & (F.col("at") == place))
    rows = {r["level"]: r["hash"] for r in levels(df, index, fingerprint).where(condition).collect()}  # one row a level
    return [{"direction": direction, "hash": rows[level]} for direction, (_, level, _) in wanted]


def proofs(nodes: DataFrame, n: int) -> DataFrame:
    """at and proof (array of structs direction, hash) of all leaves of one tree, from its nodes (level, at, hash)."""
    own = nodes.where("level = 0").select("at").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(max(0, (n - 1).bit_length() - 1)))))
    at = F.expr("shiftright(at, level)")
    other = F.when(at.bitwiseXOR(F.lit(1)) * F.expr("shiftleft(1L, level)") < n, at.bitwiseXOR(F.lit(1))).otherwise(at)
    asked = own.select("at", "level", other.alias("_other"), F.when(at % 2 == 1, "left").otherwise("right").alias("direction"))
    found = asked.join(nodes.select("level", F.col("at").alias("_other"), "hash"), ["level", "_other"])
    steps = found.groupBy("at").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "direction", "hash"))), lambda e: F.struct(e["direction"].alias("direction"), e["hash"].alias("hash"))).alias("proof"))  # a step a level
    if n > 1:
        return steps
    return nodes.where("level = 0").select("at", F.array().cast("array<struct<direction:string,hash:string>>").alias("proof"))


def proved(fingerprint: Column, steps: Column, expected: Column) -> Column:
    """Whether the steps (array of structs direction, hash) lead from a fingerprint to the expected root."""
    top = F.aggregate(steps, leaf(fingerprint), lambda h, s: F.when(s["direction"] == "left", node(s["hash"], h)).otherwise(node(h, s["hash"])))
    return top == expected


def proved_at(fingerprint: Column, index: Column, total: Column, steps: Column, expected: Column) -> Column:
    """As proved, but the index must lie in the tree, directions must follow from it and there must be as many steps as the tree has levels."""
    bound = F.forall(F.sequence(F.lit(1), F.size(steps)), lambda i: (F.element_at(steps, i)["direction"] == "left") == (F.pmod(F.floor(index / F.pow(F.lit(2), i - 1)), F.lit(2)) == 1))
    high = F.ceil(F.log2(F.greatest(total, F.lit(1)).cast("double")))
    return proved(fingerprint, steps, expected) & (index >= 0) & (index < total) & (F.size(steps) == high) & ((F.size(steps) == 0) | bound)
