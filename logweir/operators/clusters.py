"""Template mining over unclaimed messages: clusters, their sizes and the most frequent ones.

Masking alone is order-free and row-wise; ids and sizes go on over batches through the table of known clusters. The parse tree merges
masked templates further: a leaf (token count and leading token) takes its templates one after another, each into the cluster that agrees
with it in most places, if in enough of them, whose other places become wildcards.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.templates import WILDCARD, masked, specificity, template
from ..sources.tables import written
from .chain import sequenced

#: Bits of the order within a stretch whose messages one task counts per template.
STRETCH = 16
#: Templates of a leaf that one task merges; larger leaves are merged in groups first.
LEAF = 20_000


def summary(df: DataFrame, text: str = "raw_text", order: str = "sequence", known: DataFrame | None = None) -> DataFrame:
    """A row per template of df: cluster_id (by first appearance, from 1), template, count, specificity, sample (the first message).

    known: rows of earlier batches (template, cluster_id, count, sample). Their ids and samples stay, counts are added up, and templates
    that are new go on after the last id.
    """
    own = F.regexp_replace(F.col(text), r"^\s+|\s+$", "")
    found = df.select(template(F.col(text)).alias("template"), F.struct(F.col(order).alias("at"), own.alias("text")).alias("first"))
    found = found.groupBy("template").agg(F.count("*").alias("count"), F.min("first").alias("first")).withColumn("at", F.col("first.at"))
    columns = ["cluster_id", "template", "count", specificity(F.col("template")).alias("specificity"), "sample"]
    if known is None:
        found = sequenced(found, "at", "template")  # free text has nearly a template a message
        return found.select(F.col("sequence").alias("cluster_id"), "template", "count", F.col("first.text").alias("sample")).select(*columns)
    last = known.agg(F.max("cluster_id")).first()[0] or 0
    before = known.select("template", F.col("cluster_id").alias("_id"), F.col("count").alias("_count"), F.col("sample").alias("_sample"))
    joined = written(found.join(before, "template", "left"), "known-templates")
    old = joined.where("_id is not null").select(F.col("_id").alias("cluster_id"), "template", (F.col("count") + F.col("_count")).alias("count"), F.col("_sample").alias("sample"))
    new = sequenced(joined.where("_id is null"), "at", "template", start=last + 1).select(F.col("sequence").alias("cluster_id"), "template", "count", F.col("first.text").alias("sample"))
    return old.unionByName(new).select(*columns)


def assign(df: DataFrame, text: str = "raw_text", order: str = "sequence", known: DataFrame | None = None, told: DataFrame | None = None) -> DataFrame:
    """Adds cluster_id, template, specificity, cluster_size (so far, by order, earlier batches included) and sample to each message.

    told: summary() of the same arguments, where the caller needs it too.
    """
    told = summary(df, text, order, known) if told is None else told
    # counts so far: within stretches of the order, and a running sum over the stretches of each template
    rows = df.withColumn("template", template(F.col(text))).withColumn("_at", F.shiftright(F.col(order).cast("long"), STRETCH))
    before = Window.partitionBy("template").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("template", "_at").agg(F.count("*").alias("_n")).select("template", "_at", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    if known is not None:
        counts = counts.join(known.select("template", F.col("count").alias("_earlier")), "template", "left").select("template", "_at", (F.col("_first") + F.coalesce("_earlier", F.lit(0))).alias("_first"))
    so_far = Window.partitionBy("template", "_at").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = rows.withColumn("_own", F.count("*").over(so_far)).join(counts, ["template", "_at"]).withColumn("cluster_size", F.col("_first") + F.col("_own"))
    return sized.join(told.select("cluster_id", "template", "specificity", "sample"), "template").drop("_at", "_own", "_first")


def top(df: DataFrame, limit: int = 10, text: str = "raw_text", order: str = "sequence") -> DataFrame:
    """The most frequent templates; ties in order of first appearance."""
    return summary(df, text, order).orderBy(F.desc("count"), "cluster_id").limit(limit)


class Leaf:
    """Clusters of one leaf of the parse tree; places and tokens lead to the clusters that hold them, so that a template meets only
    clusters with a token in common."""

    def __init__(self, width: int, similarity: float):
        self.width, self.similarity = width, similarity
        self.tokens: list[list[str]] = []
        self.wild: list[int] = []
        self.holders: dict[tuple[int, str], set[int]] = defaultdict(set)

    def put(self, tokens: list[str]) -> int:
        """The cluster of a template; it is changed or made."""
        same: dict[int, int] = defaultdict(int)
        for at in enumerate(tokens):
            for c in self.holders.get(at, ()):
                same[c] += 1
        # most equal places, then most wildcards, then the first cluster; a wildcard is equal to nothing
        best = min(same, key=lambda c: (-same[c], -self.wild[c], c), default=None)
        if best is None or same[best] < self.similarity * self.width:
            best = len(self.tokens)
            self.tokens.append(list(tokens))
            self.wild.append(tokens.count(WILDCARD))
            for at in enumerate(tokens):
                if at[1] != WILDCARD:
                    self.holders[at].add(best)
            return best
        own = self.tokens[best]
        for i, (a, b) in enumerate(zip(own, tokens, strict=True)):
            if a != b and a != WILDCARD:
                self.holders[i, a].discard(best)
                own[i] = WILDCARD
                self.wild[best] += 1
        return best


def tokens_of(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def refine(df: DataFrame, similarity: float = 0.5, depth: int = 4, leaf: int = LEAF) -> DataFrame:
    """Adds `merged`, the template of each row's cluster in the parse tree, to rows with cluster_id and template, in order of cluster_id.

    Works on the summary, not on messages. A leaf of up to `leaf` templates is one task's pass. A larger one is merged in groups first:
    templates that agree in a block of places meet (two that agree in enough places agree in one block at least, as there are more blocks
    than places that may differ), groups are dealt further if they are large themselves, and clusters stand for their templates in the
    next round, which takes another block. Rounds end when the leaf is small enough or every block had its turn without a merger.
    """
    lead = max(1, depth - 3)
    tokens = tokens_of(F.col("template"))
    own = F.transform(F.slice(tokens, 1, lead), lambda t: F.when(t.rlike("[0-9<>]"), F.lit(WILDCARD)).otherwise(t))
    now = written(df.select(F.col("cluster_id").alias("id"), F.col("template").alias("merged"), F.size(tokens).alias("width"), F.array_join(own, " ").alias("lead")), "leaves")
    roots = now.select("id", F.col("id").alias("root"))

    def passed(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, texts = table["id"].to_pylist(), [t.split() for t in table["merged"].to_pylist()]
        own = Leaf(len(texts[0]), similarity)
        first: dict[int, int] = {}
        places = [own.put(t) for t in texts]
        for i, c in zip(ids, places, strict=True):
            first.setdefault(c, i)
        made = [" ".join(t) for t in own.tokens]
        return pa.table({"id": pa.array(ids, pa.int64()), "root": pa.array([first[c] for c in places], pa.int64()), "merged": pa.array([made[c] for c in places], pa.string()), "width": table["width"], "lead": table["lead"]})

    shape = "id long, root long, merged string, width int, lead string"
    blocks = F.greatest(F.col("width") - F.ceil(F.col("width") * similarity) + 1, F.lit(1))
    turn, quiet = 0, 0
    while True:
        sizes = now.groupBy("width", "lead").agg(F.count("*").alias("_size"))
        large = sizes.where(F.col("_size") > leaf)
        told = large.agg(F.count("*").alias("n"), F.max(blocks).alias("blocks")).first()
        if not told["n"] or quiet >= told["blocks"]:
            break
        some = now.join(large.drop("_size"), ["width", "lead"], "left_semi")
        part = F.concat_ws(" ", F.transform(F.filter(F.transform(tokens_of(F.col("merged")), lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda e: F.pmod(e["i"], F.col("_blocks")) == F.pmod(F.lit(turn), F.col("_blocks"))), lambda e: e["t"]))
        some = some.withColumn("_blocks", blocks).withColumn("_part", F.xxhash64(part)).drop("_blocks")
        counts = some.groupBy("width", "lead", "_part").agg(F.count("*").alias("_n"))
        dealt = some.join(counts, ["width", "lead", "_part"]).withColumn("_deal", F.pmod(F.xxhash64("id", F.lit(turn)), F.ceil(F.col("_n") / leaf)))
        done = written(dealt.groupBy("width", "lead", "_part", "_deal").applyInArrow(passed_without(passed), shape), "leaf-round")
        merged = done.where("id <> root").count()
        rest = now.join(large.drop("_size"), ["width", "lead"], "left_anti")
        now = written(rest.unionByName(done.where("id = root").select(*now.columns)), "leaves")
        moved = done.select(F.col("id").alias("root"), F.col("root").alias("_to"))
        roots = written(roots.join(moved, "root", "left").select("id", F.coalesce("_to", "root").alias("root")), "leaf-roots")
        turn, quiet = turn + 1, 0 if merged else quiet + 1
    small = now.join(sizes.where(F.col("_size") <= leaf).drop("_size"), ["width", "lead"], "left_semi")
    last = written(small.groupBy("width", "lead").applyInArrow(passed, shape).unionByName(now.join(large.drop("_size"), ["width", "lead"], "left_semi").withColumn("root", F.col("id")).select("id", "root", "merged", "width", "lead")), "leaf-last")
    found = roots.join(last.select(F.col("id").alias("root"), "merged"), "root").select(F.col("id").alias("cluster_id"), "merged")
    return df.join(found, "cluster_id")


def passed_without(f):
    """f over the columns of a leaf alone."""
    return lambda table: f(table.select(["id", "merged", "width", "lead"]))


def mine(df: DataFrame, text: str = "raw_text", order: str = "sequence", similarity: float = 0.5, depth: int = 4, leaf: int = LEAF) -> DataFrame:
    """The parse tree over messages whose addresses, hexadecimal numbers, UUIDs and numbers are masked by name: cluster_id (by first
    appearance, from 1), template, count, specificity."""
    found = df.select(masked(F.col(text)).alias("template"), F.col(order).alias("at")).groupBy("template").agg(F.count("*").alias("count"), F.min("at").alias("at"))
    numbered = sequenced(found, "at", "template").withColumnRenamed("sequence", "cluster_id")
    merged = refine(written(numbered, "masked"), similarity, depth, leaf)
    whole = merged.groupBy(F.size(tokens_of(F.col("template"))).alias("_n"), F.col("merged").alias("template")).agg(F.sum("count").alias("count"), F.min("at").alias("at"))
    return sequenced(whole, "at", "template").select(F.col("sequence").alias("cluster_id"), "template", "count", specificity(F.col("template")).alias("specificity"))


__all__ = ["assign", "mine", "refine", "summary", "top"]
