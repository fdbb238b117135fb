"""The hash chain in two levels, so that producing and verifying it are both many tasks' work.

Sequence numbers are cut into ranges of fixed size. Within a range each event names the fingerprint of the one before; the first names
the range's anchor, a digest of the chain's name and the range's number. Ranges are chained side by side. Their heads (last fingerprints)
form a second chain, one link a range, which holds the ranges together: an event can't be changed, added or left out without breaking its
range, and no range, nor the end of one, without breaking the links. A later batch goes on within the last range, whose link it renews.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import digest, without
from .order import before, dealt, number

#: What the first link follows.
GENESIS = "0" * 64
MEMBER, SEAL = "prev_hash", "fingerprint"
#: Sequence numbers of a range: the events that are chained one after another. 10^12 events have 1.2 x 10^8 links.
RANGE = 1 << 13


def sequenced(df: DataFrame, *order: str, start: int = 1, parts: int | None = None) -> DataFrame:
    """Adds sequence: consecutive numbers by `order`, without a single-task sort: places within ranges after the counts of earlier ones."""
    ranged = dealt(df, *order, parts=parts)
    return ranged.join(F.broadcast(before(ranged, _rows=F.lit(1))), "_range").withColumn("sequence", number(F.col("_rows"), start)).drop("_range", "_at", "_rows")


def parts(event: Column, members: list[str], more: Mapping[str, Column]) -> list[Column]:
    """Canonical JSON of an event before, between and after the places of fingerprint and prev_hash, without braces; each may be empty."""
    all_ = {**{m: event[m] for m in members}, **more}

    def text(keep) -> Column:
        json = F.to_json(F.struct(*[all_[k].alias(k) for k in sorted(all_) if keep(k)]))
        return F.substring(json, F.lit(2), F.length(json) - 2)

    return [text(lambda k: k < SEAL), text(lambda k: SEAL < k < MEMBER), text(lambda k: k > MEMBER)]


def around(first: Column, middle: Column, last: Column) -> list[Column]:
    """parts() with the braces, and the commas that fit where one is empty."""
    comma = lambda c: F.when(c != "", F.lit(",")).otherwise(F.lit(""))
    return [F.concat(F.lit("{"), first, comma(first)), F.concat(middle, comma(middle)), F.concat(comma(last), last, F.lit("}"))]


def range_of(sequence: Column, size: int = RANGE) -> Column:
    return F.floor((sequence - 1) / size)


def anchor(chain: Column, range_: Column) -> Column:
    """What the first event of a range names as its predecessor."""
    return digest(F.concat(F.coalesce(chain, F.lit("")), F.lit("#"), range_.cast("string")))


def opened(heads: DataFrame, size: int = RANGE) -> DataFrame:
    """_chain, _range and _open: the ranges within which chains go on, and the fingerprints that they go on from. A row a chain."""
    return heads.select(F.coalesce(F.col("chain_id").cast("string"), F.lit("")).alias("_chain"), range_of(F.col("sequence"), size).alias("_range"), F.col("fingerprint").alias("_open"))


def dealt_ranges(df: DataFrame, tasks: int, chain: str = "chain_id", size: int = RANGE, heads: DataFrame | None = None) -> DataFrame:
    """df with each range of a chain in one task, in order, and with heads the column _open: what append() takes as dealt.

    Heads are joined before rows are sorted, as Spark leaves out a sort whose rows go into a join.
    """
    keys = [F.coalesce(F.col(chain).cast("string"), F.lit("")), range_of(F.col("sequence"), size)]
    if heads is not None:
        df = df.withColumns(dict(zip(("_chain", "_range"), keys, strict=True))).join(F.broadcast(opened(heads, size)), ["_chain", "_range"], "left").drop("_chain", "_range")
    return df.repartition(tasks, *keys).sortWithinPartitions(*keys, "sequence")


def append(df: DataFrame, chain: str = "chain_id", heads: DataFrame | None = None, size: int = RANGE, dealt: bool = False, keep: Sequence[Column | str] | None = None) -> DataFrame:
    """Adds prev_hash, fingerprint and event_json (canonical) to rows with chain, sequence, event and event_id.

    A range of a chain is one ordered pass over its rows, `size` at most; ranges run side by side. heads: chain_id, sequence and
    fingerprint of each chain's last event so far (links() has them), where a chain goes on within a range. dealt: rows come as
    dealt_ranges(), which then takes the heads, has left them, by row-wise steps only, so they aren't moved again. keep: the columns that
    are wanted beside these three (None: all of df); all that is kept goes through Python, where nothing that a reader leaves out later
    can be left out.
    """
    first, middle, last = parts(F.col("event"), df.schema["event"].dataType.names, {"event_id": F.col("event_id"), "sequence": F.col("sequence")})
    if dealt and heads is not None:
        raise ValueError("heads of dealt rows belong to dealt_ranges()")
    joined = dealt and "_open" in df.columns
    wanted = keep if keep is not None else [c for c in df.columns if c != "_open"] if joined else df.columns
    kept = df.select(*wanted)
    columns, texts = kept.columns, [c.alias(k) for k, c in zip(("_a", "_b", "_c"), around(first, middle, last), strict=True)]
    # where events stay out, their texts are made before rows are moved
    early = [] if keep is None else texts
    name = F.coalesce(F.col(chain).cast("string"), F.lit(""))
    rows = df.select(*wanted, name.alias("_chain"), range_of(F.col("sequence"), size).alias("_range"), F.col("sequence").alias("_at"), *["_open"] * joined, *early)
    if heads is not None:
        rows = rows.join(opened(heads, size), ["_chain", "_range"], "left")
    elif not joined:
        rows = rows.withColumn("_open", F.lit(None).cast("string"))
    rows = rows if dealt else rows.repartition("_chain", "_range").sortWithinPartitions("_chain", "_range", "_at")
    rows = rows.select(*columns, "_chain", "_range", F.coalesce("_open", anchor(F.col("_chain"), F.col("_range"))).alias("_open"), *(["_a", "_b", "_c"] if early else texts))
    n = len(columns)

    def sealed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, end = None, ""
        for b in batches:
            prev, own, texts = [], [], []
            for c, r, start, x, y, z in zip(*[b.column(i).to_pylist() for i in range(n, n + 6)], strict=True):
                if (c, r) != now:
                    now, end = (c, r), start
                prev.append(end)
                rest = f'{y}"{MEMBER}":"{end}"{z}'
                end = hashlib.sha256(f"{x}{rest}".encode()).hexdigest()
                own.append(end)
                texts.append(f'{x}"{SEAL}":"{end}",{rest}')
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *(pa.array(a, pa.string()) for a in (prev, own, texts))], names=[*b.schema.names[:n], MEMBER, SEAL, "event_json"])

    schema = T.StructType([*kept.schema.fields, *(T.StructField(c, T.StringType()) for c in (MEMBER, SEAL, "event_json"))])
    return rows.mapInArrow(sealed, schema)


def ranges(df: DataFrame, chain: str = "chain_id", size: int = RANGE) -> DataFrame:
    """chain_id, range, events, first, last and head of the ranges of rows with chain, sequence and fingerprint."""
    rows = df.select(F.coalesce(F.col(chain).cast("string"), F.lit("")).alias("chain_id"), range_of(F.col("sequence"), size).alias("range"), "sequence", SEAL)
    return rows.groupBy("chain_id", "range").agg(F.count("*").alias("events"), F.min("sequence").alias("first"), F.max("sequence").alias("last"), F.max_by(F.coalesce(SEAL, F.lit("")), "sequence").alias("head"))


LINK = "chain_id string, range long, events long, first long, last long, head string, prev_link string, link string"


def linked(ends: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Links of ranges: each digests the link before, the range, its number of events, its last sequence number and its head.

    A chain's links are one pass over a row a range. before: links made earlier (all, or each chain's last ones); a range that is there
    already is renewed: its events are added up and its link follows the one that it followed.
    """
    if before is not None:
        old = before.join(ends.select("chain_id", "range"), ["chain_id", "range"], "left_semi").select("chain_id", "range", F.col("events").alias("_events"), F.col("first").alias("_first"))
        ends = ends.join(old, ["chain_id", "range"], "left").withColumns({"events": F.col("events") + F.coalesce("_events", F.lit(0)), "first": F.coalesce("_first", "first")}).drop("_events", "_first")
        start = ends.groupBy("chain_id").agg(F.min("range").alias("_from"))
        last = before.join(start, "chain_id").where("range < _from").groupBy("chain_id").agg(F.max_by("link", "range").alias("prev_link"))
        ends = ends.join(last, "chain_id", "left")
    else:
        ends = ends.withColumn("prev_link", F.lit(None).cast("string"))
    rows = ends.select("chain_id", "range", "events", "first", "last", "head", "prev_link").repartition("chain_id").sortWithinPartitions("chain_id", "range")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, end = None, GENESIS
        for b in batches:
            prev, own = [], []
            for c, r, events, last_, head, start_ in zip(*[b.column(i).to_pylist() for i in (0, 1, 2, 4, 5, 6)], strict=True):
                if c != now:
                    now, end = c, start_ or GENESIS
                prev.append(end)
                end = hashlib.sha256(f"{end}:{r}:{events}:{last_}:{head}".encode()).hexdigest()
                own.append(end)
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(prev, pa.string()), pa.array(own, pa.string())], names=[*b.schema.names[:6], "prev_link", "link"])

    return rows.mapInArrow(made, LINK)


def recomputed(text: Column, fingerprint: Column, prev: Column) -> Column:
    """Fingerprint of canonical event JSON that holds its own fingerprint and prev_hash; prev replaces the latter.

    No member that sorts before prev_hash holds one of that name, so the first is the event's own.
    """
    body, mark = without(text, SEAL, fingerprint), f'"{MEMBER}":"'
    at = F.instr(body, mark) + len(mark)
    rest = F.substring(body, at, F.length(body))
    return digest(F.concat(F.substring(body, F.lit(1), at - 1), prev, F.substring(rest, F.instr(rest, '"'), F.length(rest))))


def checked(df: DataFrame, chain: str | None = None, size: int = RANGE, start: int | None = None) -> DataFrame:
    """Adds broken to rows with sequence, prev_hash, fingerprint, event_json: no fingerprint, a wrong link, or another content.

    Ranges are checked apart. The first row of a range must name its anchor, unless the range begins before `start`: then nothing is
    known of its predecessor, so parts of a chain can be verified apart.
    """
    name = F.lit("main") if chain is None else F.coalesce(F.col(chain).cast("string"), F.lit(""))
    keys = [chain] if chain else []
    # the row's own hash needs no order: it is computed before the window's exchange, which then carries keys only
    slim = df.select(*keys, "sequence", MEMBER, SEAL, (recomputed(F.col("event_json"), F.col(SEAL), F.col(MEMBER)) == F.col(SEAL)).alias("_same"))
    slim = slim.withColumns({"_name": name, "_range": range_of(F.col("sequence"), size)})
    rows = slim.withColumn("_before", F.lag(F.coalesce(SEAL, F.lit(""))).over(Window.partitionBy("_name", "_range").orderBy("sequence")))
    known = F.lit(True) if start is None else F.col("_range") * size + 1 >= start
    expected = F.coalesce("_before", F.when(known, anchor(F.col("_name"), F.col("_range"))))
    wrong = F.col(SEAL).isNull() | (F.col(SEAL) == "") | ~F.coalesce("_same", F.lit(False)) | (expected.isNotNull() & ~F.col(MEMBER).eqNullSafe(expected))
    return rows.withColumn("broken", wrong).drop("_name", "_range", "_before", "_same")


def unlinked(df: DataFrame, links: DataFrame, chain: str | None = None, size: int = RANGE, start: int | None = None, end: int | None = None) -> DataFrame:
    """chain_id, range and last of the links that don't hold: recorded ranges that lie within start and end, but whose events, last
    sequence number or head differ from what is there; links that don't follow from the one before; ranges without a link."""
    named = df.withColumn("chain_id", F.lit("main") if chain is None else F.col(chain))
    there = ranges(named, size=size).select("chain_id", "range", *[F.col(c).alias(f"_{c}") for c in ("events", "first", "last", "head")])
    order = Window.partitionBy("chain_id").orderBy("range")  # a row a range
    own = F.sha2(F.concat_ws(":", "prev_link", F.col("range").cast("string"), F.col("events").cast("string"), F.col("last").cast("string"), "head").cast("binary"), 256)
    told = links.withColumn("_loose", (own != F.col("link")) | (F.col("prev_link") != F.coalesce(F.lag("link").over(order), F.lit(GENESIS)))).withColumn("_linked", F.lit(True))
    both = told.join(there, ["chain_id", "range"], "full")
    low, high = F.coalesce("first", "_first"), F.coalesce("last", "_last")
    within = F.lit(True)
    if start is not None:
        within = within & (low >= start)
    if end is not None:
        within = within & (high <= end)
    wrong = F.col("_loose") | F.col("_linked").isNull() | ~F.col("events").eqNullSafe(F.col("_events")) | ~F.col("last").eqNullSafe(F.col("_last")) | ~F.col("head").eqNullSafe(F.col("_head"))
    return both.where(within & wrong).select("chain_id", "range", high.alias("last"))


def verify(df: DataFrame, start: int | None = None, end: int | None = None, chain: str | None = None, size: int = RANGE, links: DataFrame | None = None) -> DataFrame:
    """One row: ok, events, broken_sequence (the first one, else null). With links, both levels are verified; a link that doesn't hold
    counts as broken at its range's last sequence number."""
    some = df
    if start is not None:
        some = some.where(F.col("sequence") >= start)
    if end is not None:
        some = some.where(F.col("sequence") <= end)
    told = checked(some, chain, size, start).agg(F.count("*").alias("events"), F.min(F.when(F.col("broken"), F.col("sequence"))).alias("broken_sequence"))
    if links is not None:
        loose = unlinked(some, links, chain, size, start, end).agg(F.min("last").alias("_last"))
        told = told.crossJoin(loose).withColumn("broken_sequence", F.least("broken_sequence", "_last"))  # one row each
    return told.select(F.col("broken_sequence").isNull().alias("ok"), "events", "broken_sequence")


def heads(links: DataFrame) -> DataFrame:
    """Last sequence and fingerprint of each chain: where the next batch goes on. links: as linked() makes them."""
    return links.groupBy("chain_id").agg(F.max("last").alias("sequence"), F.max_by("head", "range").alias("fingerprint"))


def tampered(df: DataFrame, sequence: int, member: str = "raw_data", value: str = "forged", column: str | None = None) -> DataFrame:
    """df with a text member of one row's event (and its flat column, if named) changed: what verify must find."""
    hit = F.col("sequence") == sequence
    changed = F.regexp_replace("event_json", rf'"{member}":"(?:[^"\\]|\\.)*"', f'"{member}":"{value}"')
    out = df.withColumn("event_json", F.when(hit, changed).otherwise(F.col("event_json")))
    return out if column is None else out.withColumn(column, F.when(hit, F.lit(value)).otherwise(F.col(column)))
