"""The batch pipeline: records in, attested events out. Everything but sequence and chain is row-wise."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import salvage
from ..operators import chain, clusters, detect, lake, matching, normalize, vault
from ..sources import lines as lines_
from ..sources.packs import BUILT_IN, Pack
from ..sources.tables import written


@dataclass
class Run:
    """What a batch yields: events (with all working columns), the block table, and review entries and clusters (None: inference was off)."""

    events: DataFrame
    blocks: DataFrame
    review: DataFrame | None
    clusters: DataFrame | None = None


def process(lines: DataFrame, packs: Sequence[Pack] = BUILT_IN, now_ms: int = 0, inference: bool = True, chain_by: str | None = None, start: int = 1, heads: DataFrame | None = None, first_segment: int = 0, key: bytes | None = None, chain_size: int = chain.RANGE, vendor_hint: str | None = None, clusters_before: DataFrame | None = None, keep: Sequence[Column] | None = None) -> Run:
    """Vault, routing, extraction, salvage and inference, normalisation, sequence, chain and lineage of records (sources.lines).

    Event ids derive from locators and the batch time is a parameter, so a rerun yields the same fingerprints. chain_by names a column
    whose values are chains of their own (None: one chain); heads are the chains' last events so far. Inference runs over salvaged rows
    only; clusters_before are the clusters of earlier batches. vendor_hint (or a column of that name) helps to name fields and the vendor
    of lines that no pack claims. keep: the columns of events that are wanted (for_lake(), lake.kept(); None: all); lineage is made if these suffice.
    """
    lines = lines if vendor_hint is None else lines.withColumn("vendor_hint", F.lit(vendor_hint))
    placed = written(vault.place(lines, first_segment=first_segment, sequence=start), "placed")
    table = vault.blocks(placed, key=key)
    # the lines of one chain are dealt by its ranges while they are short, and decoded where they are chained, so events aren't shuffled;
    # inference joins salvaged rows with others, after which rows are no longer in order
    whole = not inference and chain_by is None
    ends = heads.where("chain_id = 'main'") if whole and heads is not None else None
    rows = chain.dealt_ranges(placed.withColumn("chain_id", F.lit("main")), tasks(placed), size=chain_size, heads=ends) if whole else placed
    rows = rows.withColumn("event_id", F.sha2("locator", 256))
    rows = detect.extract(detect.route(rows, packs), packs)
    review, told = None, None
    hint = ["vendor_hint"] * ("vendor_hint" in rows.columns)
    if inference:
        rows = written(rows, "extracted")
        lost = rows.where(F.col("pack") == detect.SALVAGE)
        said = lost.select("event_id", "sequence", "raw_text")
        told = written(clusters.summary(said, known=clusters_before), "clusters")
        mined = clusters.assign(said, known=clusters_before, told=told)
        guessed = written(matching.infer(lost.select("event_id", "raw_text", *hint)), "inferred")
        review = matching.review_queue(guessed, mined, created_at=now_ms)
        some = lost.drop("fields").join(guessed.select("event_id", "mappings", "confidence"), "event_id", "left").join(mined.select("event_id", "cluster_id", "template", "specificity"), "event_id", "left")
        found = {"observables": F.to_json(salvage.observables(F.col("raw_text"))), "cluster_id": F.col("cluster_id").cast("string"), "cluster_template": F.col("template"), "specificity": F.col("specificity").cast("string")}
        own = F.map_filter(F.coalesce(matching.candidates(F.col("raw_text")), normalize.empty_map()), lambda k, v: ~k.isin(*found))
        some = some.withColumn("fields", F.map_concat(F.create_map(*[x for k, v in found.items() for x in (F.lit(k), v)]), own)).drop("cluster_id", "template", "specificity")
        none = rows.where(F.col("pack") != detect.SALVAGE).withColumns({"mappings": F.lit(None).cast("map<string,string>"), "confidence": F.lit(None).cast("double")})
        rows = none.unionByName(some)
    rows = normalize.normalize(rows, packs, now_ms)
    rows = rows.withColumn("chain_id", F.lit("main") if chain_by is None else F.col(chain_by).cast("string"))
    keep = [*keep, F.col("confidence")] if keep is not None and inference else keep
    events = chain.append(rows, heads=None if whole else heads, size=chain_size, dealt=whole, keep=keep)
    return Run(normalize.lineage(events) if traceable(events) else events, table, review, told)


def traceable(events: DataFrame) -> bool:
    return {"event", "fields"} <= {*events.columns} or {"class_uid", "field_keys", "pack", "raw_bytes", "locator"} <= {*events.columns}


def for_lake() -> list[Column]:
    """What commit() needs of events beside their seals: process() may leave out the rest."""
    return [*lake.kept(), *normalize.traced()]


def tasks(rows: DataFrame) -> int:
    """Tasks that decode written rows: by their number, which Parquet footers hold, and as many as cores at least."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // lines_.SPREAD))


def resume(into: lake.Lake) -> dict:
    """First free sequence, heads of all chains and first free segment of a lake: what process() needs to go on from it."""
    out: dict = {"start": 1, "heads": None, "first_segment": 0}
    if into.exists("chain_links"):
        out["heads"] = chain.heads(into.latest("chain_links"))
        out["start"] = out["heads"].agg(F.max("sequence")).first()[0] + 1
    if into.exists("clusters"):
        out["clusters_before"] = into.latest("clusters")
    if into.exists("vault"):
        at = vault.latest(into.appended("vault"))
        out["first_segment"] = at[0] + 1 if at else 0
    return out


def commit(run: Run, into: lake.Lake, batch: int = 0, chain_size: int = chain.RANGE) -> DataFrame:
    """Blocks, lineage, review entries, links and events as one commit of the lake; returns the events, which are computed once."""
    # lineage follows from the other columns, so it isn't kept twice
    events = normalize.lineage(written(run.events.drop("lineage"), "events"))
    # a large batch is written by the tasks that read it, as its splits fill files of all buckets
    dealt = events.rdd.getNumPartitions() <= into.buckets
    before = into.latest("chain_links") if into.exists("chain_links") else None
    own = into.begin(batch)
    own.write(run.blocks, "vault", upsert=False, by="seg")
    own.write(events.select("event_id", F.to_json("lineage").alias("lineage_json")), "lineage_log", upsert=False, dealt=dealt)
    if run.review is not None:
        own.write(run.review, "review_queue", upsert=False)
    if run.clusters is not None:
        own.write(run.clusters, "clusters")
    own.write(chain.linked(chain.ranges(events, size=chain_size), before), "chain_links", upsert=before is not None)
    own.write(lake.flat(events), "parsed_logs", upsert=False, dealt=dealt)
    own.commit()
    return events
