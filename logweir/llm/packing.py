"""Best-fit packing by the configuration linear program over the histogram of piece lengths.

Texts become token ids and end with an end id; only documents longer than a sequence are cut. The histogram has at most `capacity`
entries whatever the corpus, so the program is solved on the driver: multiplicative weights hold a price per length, which falls with
the share of that length that is covered; a knapsack dynamic program finds the configurations (lengths that share a sequence) worth
most, and each is used until one of its lengths runs out. Prices also give a dual bound: no packing needs fewer sequences. Rounds go on
until every length is covered or no configuration without waste is left; if primal and dual are further apart than `GAP`, prices are
renewed more often. Rounding down leaves less than one copy per configuration, and there are no more configurations than lengths; that
remnant is placed best-fit by decreasing length, in runs of equal lengths. Each piece then needs only its rank among the pieces of its
length to know its sequence and offset; ranks come from counts per bucket.

Defined cases: null and empty texts are a piece with the end id alone; rows that share an id are documents of their own; an empty table
gives an empty table; further columns are ignored. Words are cut at ASCII white space, which the tokenizer drops as well, so that a
distinct word is tokenized once and then looked up.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import freed, small_batches, take_over, worker_cache, written

CAPACITY = 2048
END_ID = 0
#: Distinct words of odd texts, and pieces of the others, that a worker keeps between batches.
CACHED_WORDS, CACHED_PIECES = 40_000, 150_000
#: Words that the tokenizer gets at once; its results take about a kilobyte each. Characters of a text that are cut into pieces at once.
ENCODED, SLICE = 2_000, 1 << 16
#: Rows ranked by one task at most, on average.
BUCKET_ROWS = 1_000
#: How much a price falls as its length is covered, the power of the length in its price; lengths per configuration used before prices are renewed; primal over dual that is
#: good enough.
STEP, SKEW, USED, GAP = 0.5, 1.6, (256, 1024), 0.002
#: Tokens of 2048 that a configuration may waste, tried in turn when none without waste is left.
WASTE = (0, 1, 2, 4, 8)

#: A configuration: (length, copies of it in a sequence), long to short.
Config = tuple[tuple[int, int], ...]


# fixed values: how the word vocabulary cuts lower-cased texts of ASCII and Latin-1 letters, and what such texts don't hold
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^\\t-\\r a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
ODD = re.compile("[^\\t-\\r -~\u00c0-\u00ff]|<\\|")
WHITE = re.compile("[\\t-\\r ]+")


def slices(text: str) -> Iterator[str]:
    """Parts of a text, cut at white space; longer than SLICE only where there is none."""
    at = 0
    while at < len(text):
        white = WHITE.search(text, at + SLICE)
        end = white.end() if white else len(text)
        yield text[at:end]
        at = end


def byte_letters() -> dict[int, str]:
    """The vocabulary's letter for each byte: itself if it is printable in Latin-1, else the next one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in set(printable))
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordTokens:
    """Token ids of texts as little-endian bytes.

    Texts of ASCII and Latin-1 letters are cut into the vocabulary's pieces, whose ids are kept, as texts repeat them. Other texts, and
    those that could hold special tokens, are cut at ASCII white space and the tokenizer itself reads the words.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = byte_letters()
        self.words: dict[str, bytes] = {"": b""}
        self.pieces: dict[str, bytes] = {}

    def piece(self, text: str) -> bytes:
        own = text if text.isascii() else text.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(own)]).tobytes()

    def odd(self, text: str) -> bytes:
        words = WHITE.split(text)
        fresh = [w for w in set(words) if w not in self.words]
        for at in range(0, len(fresh), ENCODED):
            some = fresh[at : at + ENCODED]
            for word, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.words[word] = array("I", e.ids).tobytes()
        out = b"".join(map(self.words.__getitem__, words))
        if len(self.words) > CACHED_WORDS:
            self.words = {"": b""}
        return out

    def plain(self, text: str) -> bytes:
        cut = PIECES.findall(text.lower())
        for piece in set(cut):
            if piece not in self.pieces:
                self.pieces[piece] = self.piece(piece)
        out = b"".join(map(self.pieces.__getitem__, cut))
        if len(self.pieces) > CACHED_PIECES:
            self.pieces = {}
        return out

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            own = self.odd if ODD.search(text) else self.plain
            yield own(text) if len(text) <= SLICE else b"".join(map(own, slices(text)))


_tokens: dict[str, WordTokens] = worker_cache()


def tokens_of(path: str) -> WordTokens:
    """The worker's tokenizer, kept from task to task."""
    take_over(_tokens)
    if path not in _tokens:
        _tokens.clear()
        _tokens[path] = WordTokens(path)
    return _tokens[path]


def best_values(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the best value of each capacity and the index of a length that it uses (-1: none)."""
    value, item = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    for c in range(int(lengths[0]) if len(lengths) else capacity + 1, capacity + 1):
        n = int(np.searchsorted(lengths, c, side="right"))
        with_item = value[c - lengths[:n]] + prices[:n]
        k = int(with_item.argmax())
        if with_item[k] > value[c - 1]:
            value[c], item[c] = with_item[k], k
        else:
            value[c], item[c] = value[c - 1], -2  # leaves a token free
    return value, item


def configuration(first: int, item: np.ndarray, lengths: np.ndarray, left: np.ndarray, capacity: int) -> dict[int, int]:
    """Index -> copies of the priced configuration around one length; a length that has run out is passed over."""
    out, room = {first: 1}, capacity - int(lengths[first])
    while room > 0 and item[room] != -1:
        k = int(item[room])
        if k == -2 or left[k] <= 0:
            room -= 1
            continue
        out[k] = out.get(k, 0) + 1
        room -= int(lengths[k])
    return out


def covered(counts: dict[int, int], capacity: int, used: int) -> tuple[dict[Config, float], float]:
    """(fractional copies of each configuration, dual bound) with prices renewed after `used` configurations at most."""
    out: dict[Config, float] = defaultdict(float)
    lengths = np.array(sorted(counts), np.int64)
    total = np.array([counts[n] for n in lengths.tolist()], float)
    left, bound, waste = total.copy(), float((lengths * total).sum()) / capacity, 0
    while waste < len(WASTE):
        live = np.flatnonzero(left > 0)
        if not len(live):
            break
        own, rest = lengths[live], left[live]
        # multiplicative weights: each covered share of a length divides its price by the same factor
        prices = (own / capacity) ** SKEW * np.exp(STEP * rest / total[live])
        value, item = best_values(prices, own, capacity)
        # prices that make no configuration worth more than 1 bound any packing from below
        bound = max(bound, float((total[live] * prices).sum()) / value[capacity])
        worth, taken = prices + value[capacity - own], 0
        for first in np.argsort(-(worth + 1e-9 * own), kind="stable").tolist():
            if taken == used:
                break
            if rest[first] <= 0:
                continue
            config = configuration(first, item, own, rest, capacity)
            if capacity - sum(int(own[k]) * a for k, a in config.items()) > WASTE[waste] * capacity // 2048:
                continue
            copies = min(rest[k] / a for k, a in config.items())
            for k, a in config.items():
                rest[k] = rest[k] - copies * a if rest[k] - copies * a > 1e-9 * total[live[k]] else 0.0
            out[tuple(sorted(((int(own[k]), a) for k, a in config.items()), reverse=True))] += copies
            taken += 1
        left[live] = rest
        waste += not taken
    return out, bound


def linear_program(counts: dict[int, int], capacity: int) -> tuple[dict[Config, float], float]:
    """(fractional copies of each configuration, dual bound); what they don't cover is less than the stated gap, or full of waste."""
    best: tuple[float, dict[Config, float], float] | None = None
    for used in USED:
        out, bound = covered(counts, capacity, max(1, len(counts) // used))
        over = sum(n * c for n, c in counts.items()) - sum(x * n * a for config, x in out.items() for n, a in config)
        primal = sum(out.values()) + max(0.0, over) / capacity
        bound = max(bound, best[2] if best else 0.0)
        if best is None or primal < best[0]:
            best = (primal, out, bound)
        best = (*best[:2], bound)
        if best[0] <= (1 + GAP) * bound + 1:
            break
    return best[1:] if best else ({}, 0.0)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Config, int]]:
    """Best-fit decreasing over runs of equal lengths: (configuration, sequences)."""
    free: dict[int, list[tuple[Config, int]]] = defaultdict(list)
    sizes: list[int] = []  # the free sizes in use, ascending

    def put(room: int, config: Config, n: int) -> None:
        if room not in free or not free[room]:
            insort(sizes, room)
        free[room].append((config, n))

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n > 0:
            at = bisect_left(sizes, length)
            if at == len(sizes):
                each = capacity // length
                config, room, have = (), capacity, -(-n // each)
            else:
                room = sizes[at]
                config, have = free[room].pop()
                if not free[room]:
                    sizes.pop(at)
            each = room // length
            full = min(have, n // each)
            if full:
                put(room - each * length, (*config, (length, each)), full)
                n, have = n - full * each, have - full
            if have and n:
                put(room - n * length, (*config, (length, n)), 1)
                n, have = 0, have - 1
            if have:
                put(room, config, have)
    return [x for room in free.values() for x in room if x[0]]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Config, int]]:
    """(configuration, sequences) that hold exactly the counted pieces."""
    rest = {n: c for n, c in counts.items() if c > 0 and n < capacity}
    out: list[tuple[Config, int]] = [(((capacity, 1),), counts[capacity])] if counts.get(capacity) else []
    for config, copies in sorted(linear_program(rest, capacity)[0].items(), key=lambda x: (-x[1], x[0])):
        whole = int(copies + 1e-9)
        whole = min([whole, *(rest[n] // a for n, a in config)])
        if whole:
            out.append((config, whole))
            for n, a in config:
                rest[n] -= a * whole
    return out + best_fit({n: c for n, c in rest.items() if c}, capacity)


def runs(planned: list[tuple[Config, int]], capacity: int) -> dict[str, np.ndarray]:
    """Per run of equal pieces: key (length and first rank in one number, ascending), first sequence, pieces a sequence, offset."""
    rank: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for config, n in planned:
        offset = 0
        for length, a in config:
            rows.append((length, rank[length], sequence, a, offset))
            rank[length] += n * a
            offset += length * a
        sequence += n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return {"length": table[:, 0], "rank": table[:, 1], "sequence": table[:, 2], "each": table[:, 3], "offset": table[:, 4]}


def place(length: np.ndarray, rank: np.ndarray, table: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces by length and rank."""
    key = table["length"].astype(np.int64) << 48 | table["rank"]
    at = np.searchsorted(key, length.astype(np.int64) << 48 | rank, side="right") - 1
    step = rank - table["rank"][at]
    each = table["each"][at]
    return table["sequence"][at] + step // each, table["offset"][at] + step % each * length


def pieces(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """key, piece, start, length, ids_crc32 (and ids) of each document's pieces."""
    small_batches(df.sparkSession)
    width = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = tokens_of(vocabulary), np.array([end_id], "<u4").tobytes()
        for b in batches:
            row, out = [], []
            for i, data in enumerate(tokens.ids([t or "" for t in b.column(1).to_pylist()])):
                data += end
                for k, at in enumerate(range(0, len(data), width)):
                    part = data[at : at + width]
                    row.append(i)
                    out.append((k, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else b""))
            n, start, length, crc, ids = zip(*out, strict=True) if out else ((),) * 5
            columns = [b.column(0).take(pa.array(row, pa.int64())), pa.array(n, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * with_ids, names=["k", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    source = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return source.mapInArrow(freed(cut), f"k {dict(source.dtypes)['k']}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids).withColumnRenamed("k", key)


def pack(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The pieces with sequence_id and offset; sorted by these, their ids are the sequences."""
    spark = df.sparkSession
    cut = written(pieces(df, vocabulary, key, text, capacity, end_id, with_ids), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    table = spark.sparkContext.broadcast(runs(plan(counts, capacity), capacity))
    buckets = spark.createDataFrame([(n, -(-c // bucket_rows)) for n, c in sorted(counts.items())] or [(0, 1)], "length long, buckets long")
    rows = cut.join(F.broadcast(buckets), "length").withColumn("hash", F.xxhash64(key, "piece", "ids_crc32")).withColumn("bucket", F.pmod("hash", "buckets"))
    first = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = first.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "bucket").orderBy("hash", key, "piece")
    ranked = rows.withColumn("r", F.row_number().over(within) - 1).join(first, ["length", "bucket"])
    ranked = ranked.select(key, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, (F.col("first") + F.col("r")).cast("long").alias("rank"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = place(b.column("length").to_numpy(), b.column("rank").to_numpy(), table.value)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*b.schema.names[:-1], "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields[:-1])
    return ranked.mapInArrow(freed(placed), f"{schema}, sequence_id long, offset long")
