"""N-gram Jaccard join by vertical partitioning.

A document is the set of its distinct word shingles. Shingles have one global order: a class of how full their bucket in a count of all
shingles is, rare first, then their hash. A set's prefix in this order must meet the prefix of every set it links with, so postings
(shingle, set) of prefixes give the candidates. For candidates the order is cut into fragments: each fragment counts the overlap of a
pair apart, and the counts are summed per pair and compared with the exact threshold.

Equal sets are one node from the start. Pairs are enumerated across components only. In each round nodes that share a least shingle
under some hash form a group, and its members meet the group's leader: of the pairs between two components the one is verified whose
least shingles agree most, so a group of near copies of any size costs a pair per member and round, and each round leaves a share of
the one before. Rounds only save work: afterwards every posting list that still holds several components is enumerated, the members of
its most frequent component against the others, under bounds that lose no link (lengths, and a least number of shared shingles
within prefixes that follow from both lengths), and verified: first a sample of that component's members, then, where components are still apart, all. The components are
exact.

Defined cases: null, empty and blank texts have no shingle and link with nothing; fewer words than `words` are one shingle; repeated
rows share a component; an empty table gives an empty table; null ids count as larger than all others; further columns are ignored.
A text of any length is hashed in pieces of bounded size; its shingles (8 bytes each) are held at once. Shingles are told apart by 60
bits of hash within a pair of sets, equal sets by 128 bits and their size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, discard, freed, mix64, sized_broadcast, slices, small_batches, take_over, text_bytes, word_spans, written

WORDS, PERCENT = 5, 75
#: Buckets that count shingles, as a power of two: more only make the order sharper.
BUCKET_BITS = 16
CLASS_SHIFT = 60
FRAGMENTS = 8
SALTS = 64
#: Least shingles kept of each node, and those by which nodes meet in each round.
KEYS, ROUNDS = 32, ((0, 1), (2, 3, 4), (5, 6, 7, 8))
#: Share of the prefix shingles that links must have in common which a node and its leader must have by their least shingles' estimate.
LIKELY = 0.7
#: One of so many members of each list's most frequent component meets the other members first; then all do.
SHARES = (8, 1)
#: Share of the prefix shingles that links must have in common by which pairs are found: less of it shortens both prefixes.
FIRST = 0.5
#: A round that links fewer of its pairs is the last one before all pairs are enumerated.
WORTH = 0.05
BASE = 0x5851F42D4C957F2D
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


@lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    make = lambda b: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)]))
    return make(BASE), make(pow(BASE, -1, 1 << 64))


def word_hashes(raw: np.ndarray, off: np.ndarray, piece: int = SLICE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, rows) of all lower-cased words. Bytes are read piece by piece; a word that goes over an edge is put together."""
    up, down = powers(SLICE_BYTES)
    values, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    length, last = 0, -1  # of the word that the piece before ended in: its length so far, its row (-1: none)
    for at in range(0, len(raw), piece):
        part = LOWER[raw[at : at + piece]]
        lo, hi = int(np.searchsorted(off, at, side="right")) - 1, int(np.searchsorted(off, at + len(part), side="left"))
        starts, stops, row = word_spans(part, np.clip(off[lo : hi + 1] - at, 0, len(part)))
        if not len(starts):
            last = -1
            continue
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)])])
        value, row = (total[stops] - total[starts]) * down[starts], (row + lo).astype(np.int32)
        ends, own = int(stops[-1]) == len(part), int(stops[-1] - starts[-1])
        if last == row[0] and starts[0] == 0:
            values[-1][-1:] += value[:1] * np.uint64(pow(BASE, length, 1 << 64))
            own += length * (len(starts) == 1)
            value, row = value[1:], row[1:]
        length, last = (own, int(row[-1]) if len(row) else last) if ends else (0, -1)
        values.append(value) if len(value) else None
        rows.append(row) if len(row) else None
    return mix64(np.concatenate(values)), np.concatenate(rows)


def shingles(raw: np.ndarray, off: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, edges of each text's): all shingles of some texts, repeats included."""
    w, row = word_hashes(raw, off)
    counts = np.bincount(row, minlength=len(off) - 1)
    made = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    edges, first = np.concatenate([[0], np.cumsum(made)]), np.cumsum(counts) - counts
    h = np.zeros(edges[-1], np.uint64)
    if len(w) >= words:
        whole = np.flatnonzero(row[: len(w) - words + 1] == row[words - 1 :])
        sums = np.zeros(len(w) - words + 1, np.uint64)
        for k in range(words):
            sums += w[k : len(w) - words + 1 + k] * (ODD[k % len(ODD)] * np.uint64(2 * (k // len(ODD)) + 1))
        h[whole + (edges[:-1] - first)[row[whole]]] = sums[whole]
    few = np.flatnonzero((counts > 0) & (counts < words))
    if len(few):
        short = counts[few].astype(np.uint64) * ODD[-1]
        for k in range(words - 1):
            has = counts[few] > k
            short[has] += w[first[few[has]] + k] * ODD[k % len(ODD)]
        h[edges[few]] = short
    return mix64(h), edges


def sets(raw: np.ndarray, off: np.ndarray, words: int, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens as signed integers, edges of each text's): distinct ones, ascending; the top bits of a token are its class."""
    token, edges = shingles(raw, off, words)
    bits = int(len(levels)).bit_length() - 1
    level = levels[(token >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64) << np.uint64(CLASS_SHIFT)
    token >>= np.uint64(64 - CLASS_SHIFT)
    token |= level
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a > 1:
            token[a:b].sort()
    new = np.ones(len(token), bool)
    new[1:] = token[1:] != token[:-1]
    new[edges[:-1][np.diff(edges) > 0]] = True
    return token[new].view(np.int64), np.concatenate([[0], np.cumsum(new)])[edges]


def classes(counts: np.ndarray, mean: float) -> np.ndarray:
    """Class of each bucket, 0 to 7: how far its count stands above what an even spread explains, in powers of four."""
    above = counts - mean - 6 * np.sqrt(mean) - 32
    return np.where(above > 0, np.minimum(7, 1 + np.floor(np.log(1 + np.maximum(above, 0) / 64) / np.log(4))), 0).astype(np.uint8)


def bucket_classes(docs: DataFrame, words: int) -> np.ndarray:
    """Class of each bucket, from the count of all shingles of all documents."""
    bits = BUCKET_BITS

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over()
        total = np.zeros(1 << bits, np.int64)
        for b in batches:
            raw, off = text_bytes(b.column(0))
            for i, j in slices(off):
                h, _ = shingles(raw[off[i] : off[j]], off[i : j + 1] - off[i], words)
                total += np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["bucket", "n"])

    counts = written(docs.select("t").mapInArrow(freed(counted), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")), "buckets")
    mean = (counts.agg(F.sum("n")).first()[0] or 0) / (1 << bits)
    out = np.zeros(1 << bits, np.int64)
    for r in counts.where(F.col("n") > mean).toLocalIterator():  # some of the buckets, whose number is bounded
        out[r["bucket"]] = r["n"]
    return classes(out, mean)


def signatures(tokens: np.ndarray, edges: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of each set: mixed sums of its mixed tokens and its size."""
    out = []
    for a, b in ((ODD[1], ODD[2]), (ODD[3], ODD[4])):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(tokens.view(np.uint64) * (a | np.uint64(1)) + b))])
        out.append(mix64(sums[edges[1:]] - sums[edges[:-1]] + np.diff(edges).astype(np.uint64) * b).view(np.int64))
    return out


def required(a: Column, b: Column, percent: int) -> Column:
    """Least overlap of linked sets of sizes a and b."""
    return F.ceil((a + b) * F.lit(percent) / F.lit(100.0 + percent) - 1e-9).cast("long")


def close(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def prefix_length(n: Column, percent: int) -> Column:
    return n - F.ceil(n * F.lit(percent) / F.lit(100.0) - 1e-9).cast("long") + 1


def support(a: Column, b: Column, percent: int) -> Column:
    """Least number of shingles that the prefixes of linked sets share."""
    o = required(a, b, percent)
    return F.greatest(F.lit(1), F.least(prefix_length(a, percent) - (a - o), prefix_length(b, percent) - (b - o)))


def components(edges: DataFrame) -> DataFrame:
    """(u, label): the least node that each node of the edges (u, v) reaches, by alternating large and small stars."""
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: neighbours above u hang on the least one around
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        # small star: neighbours below u, and u itself, hang on the least of them
        small = large.join(below, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(below.select("u", F.col("m").alias("v")))
        before, edges = edges, written(small.distinct(), "stars")
        discard(before)
        now = tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())
        if now == state:
            return edges.select("u", F.col("v").alias("label"))
        state = now


class Join:
    """One join over the texts of df: what its steps share."""

    def __init__(self, df: DataFrame, key: str, text: str, words: int, percent: int, fragments: int):
        self.spark = df.sparkSession
        small_batches(self.spark)
        self.docs = df.select(F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("t"))
        self.kind = dict(self.docs.dtypes)["k"]
        self.words, self.percent, self.fragments = words, percent, fragments
        self.levels = self.spark.sparkContext.broadcast(bucket_classes(self.docs, words))
        #: (u, label) of each node that isn't its component's least
        self.labels: DataFrame | None = None

    def signed(self) -> DataFrame:
        """k, h, n, both signatures and prefix of each document."""
        words, percent, levels = self.words, self.percent, self.levels

        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                raw, off = text_bytes(b.column(2))
                sizes, first, second, values, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
                for i, j in slices(off):
                    token, edges = sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], words, levels.value)
                    n = np.diff(edges)
                    keep = np.where(n > 0, n - -(-n * percent // 100) + 1, 0)
                    take = np.arange(len(token)) - np.repeat(edges[:-1], n) < np.repeat(keep, n)
                    one, two = signatures(token, edges)
                    for to, what in ((sizes, n), (first, one), (second, two), (values, token[take]), (ends, ends[-1][-1] + np.cumsum(keep))):
                        to.append(what)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(ends), pa.int32()), pa.array(np.concatenate(values)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(np.concatenate(x)) for x in (sizes, first, second)), lists], names=["k", "h", "n", "one", "two", "prefix"])

        return self.docs.mapInArrow(freed(made), f"k {self.kind}, h long, n long, one long, two long, prefix array<long>")

    def segments(self, nodes: DataFrame, short: bool) -> DataFrame:
        """node, fragment and segment (the node's tokens there; 16 bits of each if `short`) of nodes (id, k, h), from their texts."""
        words, levels, fragments = self.words, self.levels, self.fragments
        asked = sized_broadcast(nodes.select("id", F.col("k").alias("k2"), F.col("h").alias("h2")), 80)
        texts = self.docs.join(asked, (F.col("h") == F.col("h2")) & F.col("k").eqNullSafe(F.col("k2"))).select("id", "t")

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # rare shingles are dealt evenly; those of higher classes share the last fragment
            edges_of = np.append(np.arange(1, fragments - 1) * (1 << CLASS_SHIFT) // max(1, fragments - 1), 1 << CLASS_SHIFT).astype(np.int64)
            for b in batches:
                raw, off = text_bytes(b.column(1))
                ids = b.column(0).to_numpy()
                for i, j in slices(off):
                    token, edges = sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], words, levels.value)
                    part = np.repeat(np.arange(j - i), np.diff(edges)) * fragments + np.searchsorted(edges_of, token, side="right")
                    at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
                    segment = pa.ListArray.from_arrays(pa.array(np.append(at, len(part)), pa.int32()), pa.array(token.astype(np.uint16).view(np.int16) if short else token))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][part[at] // fragments]), pa.array((part[at] % fragments).astype(np.int32)), segment], names=["node", "fragment", "segment"])

        out = texts.mapInArrow(freed(cut), f"node long, fragment int, segment array<{'smallint' if short else 'long'}>")
        return out.dropDuplicates(["node", "fragment"]) if self.repeats else out

    def prepare(self) -> DataFrame:
        """The postings (w, id, n, at) that several nodes share; sets up rows (of documents) and nodes (of distinct sets)."""
        signed = written(self.signed().withColumn("rid", F.monotonically_increasing_id()), "signed")
        first = F.min(F.struct(F.col("k").isNull().alias("z"), "k", "h", "rid"))
        for seed in count():  # anew if different sets have one number
            self.rows = signed.withColumn("id", F.xxhash64("one", "two", "n", F.lit(seed)))
            nodes = self.rows.where("n > 0").groupBy("id", "one", "two", "n").agg(first.alias("f"), F.count("*").alias("copies"))
            self.nodes = written(nodes.select("id", "n", "f.k", "f.h", "f.rid", "copies"), "nodes")
            if self.nodes.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
                break
        # only one row of each set posts; most sets have one row, so that few are looked up
        copied = self.nodes.where("copies > 1").select("id", F.col("rid").alias("own"))
        # equal rows give a set's segments several times
        self.repeats = not self.rows.join(sized_broadcast(copied, 64), "id").groupBy("id", "k", "h").count().where("count > 1").isEmpty()
        posting = self.rows.where("n > 0").select("id", "n", "rid", "prefix").join(sized_broadcast(copied, 64), "id", "left").where("own is null or own = rid")
        posted = posting.select("id", "n", F.posexplode("prefix").alias("at", "w"))
        # rare shingles meet in short lists; lists of frequent ones are counted first, as they can be of any length
        near = Window.partitionBy("w").orderBy("id")
        rare = posted.where(F.col("w") < 1 << CLASS_SHIFT).withColumns({"before": F.lag("id").over(near), "after": F.lead("id").over(near)})
        often = posted.where(F.col("w") >= 1 << CLASS_SHIFT)
        shared = often.groupBy("w").agg(F.count("*").alias("c")).where("c > 1").select("w")
        return written(rare.where("before is not null or after is not null").select("w", "id", "n", "at").unionByName(often.join(shared, "w", "left_semi").select("w", "id", "n", "at")), "postings")

    def labelled(self, df: DataFrame) -> DataFrame:
        """df with the label of each id."""
        if self.labels is None:
            return df.withColumn("label", F.col("id"))
        return df.join(sized_broadcast(self.labels.withColumnRenamed("u", "id"), 48), "id", "left").withColumn("label", F.coalesce("label", "id"))

    def merge(self, links: DataFrame) -> None:
        """Takes in links (lu, lv) between labels."""
        more = components(links.select(F.col("lu").alias("u"), F.col("lv").alias("v")))
        if self.labels is None:
            self.labels = more
            return
        moved = self.labels.join(sized_broadcast(more.select(F.col("u").alias("label"), F.col("label").alias("to")), 48), "label", "left")
        self.labels = written(moved.select("u", F.coalesce("to", "label").alias("label")).unionByName(more), "labels")

    def linked(self, pairs: DataFrame, screen: bool) -> DataFrame:
        """The (written) pairs (u, nu, lu, v, nv, lv) whose overlap, summed over fragments, reaches the threshold."""
        if not screen:
            return self.overlaps(pairs, False, lambda a, b: F.size(F.array_intersect(a, b)))
        # 16 bits of each token never count too little: what isn't among b's is surely not shared
        near = self.overlaps(pairs, True, lambda a, b: F.size(a) - F.size(F.array_except(a, b)))
        out = self.linked(near, False)
        discard(near)
        return out

    def overlaps(self, pairs: DataFrame, short: bool, counted: Callable[[Column, Column], Column]) -> DataFrame:
        """The pairs whose counts, summed over fragments, reach the threshold."""
        ends = pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))).distinct()
        cut = written(self.segments(self.nodes.join(ends, "id", "left_semi"), short), "segments")
        # pairs are slim: where they are few they go to the segments, so that those of u move once and those of v only to their pairs
        left = cut.select(F.col("node").alias("u"), "fragment", F.col("segment").alias("a")).join(sized_broadcast(pairs, 96), "u")
        asked = sized_broadcast(pairs.select(F.col("v").alias("node")).distinct(), 40)
        right = cut.join(asked, "node", "left_semi").select(F.col("node").alias("v"), "fragment", F.col("segment").alias("b"))
        partial = left.join(right, ["v", "fragment"]).select(*pairs.columns, counted(F.col("a"), F.col("b")).cast("long").alias("overlap"))
        whole = partial.groupBy(*pairs.columns).agg(F.sum("overlap").alias("o"))
        out = written(whole.where(F.col("o") * 100 >= (F.col("nu") + F.col("nv") - F.col("o")) * self.percent).drop("o"), "overlaps")
        discard(cut)
        return out

    def rounds(self, shared: DataFrame) -> None:
        """Links between nodes and the leaders of the groups that share a least shingle."""
        own = shared.select("id", "n", "w").repartition("id").groupBy("id", "n")
        keys = own.agg(F.count("*").alias("posts"), F.array(*[F.min(F.xxhash64("w", F.lit(h))) for h in range(KEYS)]).alias("keys"))
        # eighths of the prefix that no other set has: copies with few changes of their own lead
        keys = written(keys.withColumn("own", F.floor(8 - 8 * F.col("posts") / prefix_length(F.col("n"), self.percent))), "keys")
        bits = F.transform("keys", lambda k: (k % 32_768).cast("short"))
        for some in ROUNDS:
            chosen = F.explode(F.array(*[F.struct(F.lit(h).alias("no"), F.col("keys")[h].alias("key")) for h in some]))
            met = self.labelled(keys).select("id", "n", "label", "own", chosen.alias("g")).select("id", "n", "label", "own", "g.no", "g.key")
            lead = met.groupBy("no", "key").agg(F.min(F.struct("own", F.xxhash64("id", "no").alias("first"), "id", "n", "label")).alias("lead"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
            pairs = met.join(lead.select("no", "key", "lead"), ["no", "key"]).where((F.col("label") != F.col("lead.label")) & close(F.col("n"), F.col("lead.n"), self.percent))
            pairs = written(pairs.select(F.col("id").alias("u"), F.col("n").alias("nu"), F.col("label").alias("lu"), F.col("lead.id").alias("v"), F.col("lead.n").alias("nv"), F.col("lead.label").alias("lv")).distinct(), "met")
            marks = lambda end, x, p: keys.select(F.col("id").alias(end), bits.alias(x), F.col("posts").alias(p))
            alike = pairs.join(marks("u", "x", "pu"), "u").join(marks("v", "y", "pv"), "v")
            equal = F.size(F.filter(F.arrays_zip("x", "y"), lambda k: k["x"] == k["y"]))
            # of equal least shingles follows how many posted shingles both have
            alike = alike.select(*pairs.columns, (equal * (F.col("pu") + F.col("pv")) / (equal + KEYS)).alias("c")).where(F.col("c") >= LIKELY * support(F.col("nu"), F.col("nv"), self.percent))
            tried, found = self.best(alike)
            discard(pairs)
            if found < WORTH * tried:
                break
        discard(keys)

    def best(self, pairs: DataFrame) -> tuple[int, int]:
        """Verifies the pair of each two components whose c is highest, and takes in its link: (pairs, links)."""
        columns = ["u", "nu", "lu", "v", "nv", "lv"]
        ends = F.least("lu", "lv").alias("x"), F.greatest("lu", "lv").alias("y")
        top = written(pairs.groupBy(*ends).agg(F.max(F.struct("c", *columns)).alias("p")).select("p.*").select(*columns), "best-pairs")
        tried, found = top.count(), 0
        if tried:
            links = self.linked(top, False)
            found = links.count()
            if found:
                self.merge(links)
            discard(links)
        discard(top)
        return tried, found

    def rest(self, shared: DataFrame) -> None:
        """Links between all other nodes of different components that share a list; some members of large components go first."""
        for share in SHARES:
            marked = written(self.labelled(shared), "marked")
            by_label = marked.groupBy("w", "label").agg(F.count("*").alias("c"))
            open_ = by_label.groupBy("w").agg(F.max(F.struct("c", "label"))["label"].alias("most"), F.count("*").alias("labels")).where("labels > 1").select("w", "most")
            open_ = written(marked.join(open_, "w").select("w", "id", "n", "at", "label", (F.col("label") == F.col("most")).alias("main")), "open-lists")
            a = open_.where("not main").select("w", F.col("id").alias("a"), F.col("n").alias("na"), F.col("at").alias("pa"), F.col("label").alias("la"))
            b = open_.select("w", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("at").alias("pb"), F.col("label").alias("lb"), "main")
            if share > 1:
                b = b.where(F.col("main") & (F.pmod(F.xxhash64("b"), F.lit(share)) == 0))
            # the first c shingles that linked sets share have at most n - o others before them in either set
            least = lambda x, y: F.ceil(support(F.col(x), F.col(y), self.percent) * F.lit(FIRST)).cast("long")
            room = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
            fits = room + least("na", "nb") > required(F.col("na"), F.col("nb"), self.percent)
            once = F.col("main") | (F.col("a") < F.col("b"))
            met = a.join(b, "w").where(once & (F.col("la") != F.col("lb")) & close(F.col("na"), F.col("nb"), self.percent) & fits)
            turned = F.col("a") > F.col("b")
            ends = [F.when(turned, F.col(y)).otherwise(F.col(x)).alias(name) for x, y, name in (("a", "b", "u"), ("na", "nb", "nu"), ("la", "lb", "lu"), ("b", "a", "v"), ("nb", "na", "nv"), ("lb", "la", "lv"))]
            pairs = met.select(*ends).groupBy("u", "nu", "lu", "v", "nv", "lv").agg(F.count("*").alias("c")).where(F.col("c") >= least("nu", "nv")).drop("c")
            pairs = written(pairs, "pairs")
            discard(marked, open_)
            if not pairs.isEmpty():
                links = self.linked(pairs, True)
                self.merge(links)
                discard(links)
            discard(pairs)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, fragments: int = FRAGMENTS) -> DataFrame:
    """One row per row of df: key, n_shingles, component_id (the least key reachable by links of Jaccard >= percent / 100)."""
    join = Join(df, key, text, words, percent, fragments)
    shared = join.prepare()
    join.rounds(shared)
    join.rest(shared)

    # least key of each component, then of each document's set; hot labels and sets are spread by salt
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int").alias("salt")
    own = join.nodes.select("id", "k")
    if join.labels is not None:
        known = join.labels.unionByName(join.labels.select(F.col("label").alias("u"), "label").distinct()).withColumnRenamed("u", "id")
        marked = written(own.join(known, "id", "left").withColumn("salt", salt("id")), "components")
        some = marked.where("label is not null")
        least = some.groupBy("label", "salt").agg(F.min("k").alias("k")).groupBy("label").agg(F.min("k").alias("component"))
        told = some.select("label", "salt").distinct().join(least, "label")
        own = marked.where("label is null").select("id", F.col("k").alias("component")).unionByName(some.join(told, ["label", "salt"]).select("id", "component"))
    else:
        own = own.withColumnRenamed("k", "component")
    rows = join.rows.select("k", "n", "id", salt("rid"))
    parts = rows.where("n > 0").select("id", "salt").distinct().join(own, "id")
    out = rows.join(parts, ["id", "salt"], "left")
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "k").alias("component_id"))
