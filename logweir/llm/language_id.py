"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built; a text is parsed greedily into the longest phrases that occur in that
text. The language that needs the fewest phrases, each weighing log2 of its training length, wins. The automaton is laid out as a table
(state, byte) -> next state, with the phrase ends as flags, so numpy steps many blocks of text at once. Blocks begin in the state that
the block before ends in: they are parsed from the root first, and again from the right state until all of them agree, which takes few
passes as parses fall into step soon. So phrases are the longest matches of the whole text, whatever its length.

Training reads labelled rows only, a sample bounded by `train_bytes` of normalised text per language and `table_bytes` for all tables
(documented limits of the fit; every text is predicted whole). Distinct texts are sampled by their hash, so copies neither crowd a
language out nor count twice.

Defined cases: null, empty and letterless texts are "und" with score 0; ties go to the language first by name; without labelled rows
every text is "und"; an empty table gives an empty table; copies get equal predictions; other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import freed, slices, small_batches, take_over, text_bytes, worker_cache

TRAIN_BYTES = 32_768
TABLE_BYTES = 200_000_000
#: Distinct labelled texts gathered per language, before the limit in bytes.
TRAIN_ROWS = 400
#: Bytes of a block, and of a piece of a long text.
BLOCK, PIECE_BYTES = 256, 4 << 20
MARK = 1 << 30
UNDETERMINED = "und"


def letters(text: str) -> Column:
    """Lower-cased letters; each run of anything else is one space."""
    return F.lower(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[^\p{L}]+", " "))


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Edges of the suffix automaton, state 0 being the root."""
    edges: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(edges)
                edges.append(dict(edges[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return edges


class Parser:
    """Tables of all languages over one alphabet of bytes; its last code is padding, the one before it any unseen byte."""

    def __init__(self, training: dict[str, bytes]):
        self.names = sorted(training)
        used = sorted(set().union(*training.values())) if training else []
        self.width = len(used) + 2
        self.code = np.full(256, len(used), np.uint8)
        self.code[used] = np.arange(len(used))
        self.pad = self.width - 1
        self.bits = np.array([math.log2(max(2, len(training[n]))) for n in self.names])
        self.tables = [self.table(training[n]) for n in self.names]

    def table(self, text: bytes) -> np.ndarray:
        edges = suffix_automaton(text)
        alone = len(edges)  # after a byte that the language's text doesn't hold, which is a phrase of its own
        root = np.full(self.width, alone, np.int32)
        for c, to in edges[0].items():
            root[self.code[c]] = to
        out = np.empty((alone + 1, self.width), np.int32)
        out[:] = root | MARK  # a phrase ends; the next begins with this byte
        out[0] = root
        for s, e in enumerate(edges[1:], 1):
            for c, to in e.items():
                out[s, self.code[c]] = to
        out[:, self.pad] = np.arange(alone + 1)
        return out.ravel()

    def steps(self, table: np.ndarray, codes: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end states, phrases ended) of blocks (columns of codes) that begin in given states."""
        state, ends = state.copy(), np.zeros(len(state), np.int32)
        for line in codes:
            state *= self.width
            state += line
            state = table[state]
            ends += state >> 30
            state &= MARK - 1
        return state, ends

    def phrases(self, raw: np.ndarray, off: np.ndarray, piece: int = PIECE_BYTES) -> np.ndarray:
        """Phrases per text and language. A single long text is read in pieces."""
        n = np.diff(off)
        if len(n) == 1 and n[0] > piece:
            ends, states = np.zeros((1, len(self.names))), None
            for at in range(0, len(raw), piece):
                part = raw[at : at + piece]
                more, states = self.parsed(part, np.array([0, len(part)]), states)
                ends += more
            return ends + 1
        return self.parsed(raw, off, None)[0] + (n > 0)[:, None]

    def parsed(self, raw: np.ndarray, off: np.ndarray, begin: list[int] | None) -> tuple[np.ndarray, list[int]]:
        """(phrases that end within each text, end state of the last text), per language; texts begin in given states (None: roots)."""
        n = np.diff(off)
        lanes = -(-n // BLOCK)
        first = np.concatenate([[0], np.cumsum(lanes)])
        row = np.repeat(np.arange(len(n)), lanes)
        place = np.arange(len(raw)) - np.repeat(off[:-1], n) + np.repeat(first[:-1] * BLOCK, n)
        codes = np.full(int(first[-1]) * BLOCK, self.pad, np.uint8)
        codes[place] = self.code[raw]
        codes = np.ascontiguousarray(codes.reshape(-1, BLOCK).T).astype(np.int32)
        heads = np.zeros(codes.shape[1], bool)
        heads[first[:-1][lanes > 0]] = True
        out, last = np.zeros((len(n), len(self.names))), []
        for k, table in enumerate(self.tables):
            start = np.zeros(codes.shape[1], np.int32)
            start[heads] = begin[k] if begin else 0
            state, ends = self.steps(table, codes, start)
            while True:
                due = np.where(heads, start, np.concatenate([[0], state[:-1]]).astype(np.int32))
                wrong = np.flatnonzero(due != start)
                if not len(wrong):
                    break
                start[wrong] = due[wrong]
                state[wrong], ends[wrong] = self.steps(table, np.ascontiguousarray(codes[:, wrong]), due[wrong])
            out[:, k] = np.bincount(row, ends, minlength=len(n))
            last.append(int(state[-1]) if len(state) else 0)
        return out, last


def sample(df: DataFrame, text: str, lang: str, rows: int, most: int) -> dict[str, bytes]:
    """Normalised labelled text by language: whole texts in the order of their hashes, up to `most` bytes (one text at least)."""
    labelled = df.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("l"), F.xxhash64(text).alias("h"), F.col(text).alias("x"))
    counts = labelled.select("l", "h").distinct().groupBy("l").agg(F.count("*").alias("n"), F.min("h").alias("least")).collect()
    if not counts:
        return {}
    share = F.coalesce(*[F.when(F.col("l") == r["l"], min(1.0, rows / r["n"])) for r in counts])
    least = F.coalesce(*[F.when(F.col("l") == r["l"], r["least"]) for r in counts])
    some = labelled.where((F.pmod(F.shiftrightunsigned("h", 11), F.lit(1 << 30)) < share * float(1 << 30)) | (F.col("h") == least))
    some = some.dropDuplicates(["l", "h"]).select("l", "h", F.trim(letters("x")).alias("x"))
    before = F.coalesce(F.sum(F.octet_length("x") + 1).over(Window.partitionBy("l").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    some = some.withColumn("before", before).where(F.col("before") < most).select("l", "h", F.substring("x", 1, most).alias("x"))
    out: dict[str, list[bytes]] = {}
    for r in some.orderBy("l", "h").collect():
        out.setdefault(r["l"], []).append(r["x"].encode())
    return {name: (b" " + b" ".join(parts) + b" ")[:most] for name, parts in out.items()}


_parsers: dict[int, Parser] = worker_cache()


def identify(df: DataFrame, train: DataFrame | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang", train_bytes: int = TRAIN_BYTES, train_rows: int = TRAIN_ROWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of df: key, lang_pred, score and the columns of `keep`. train (default: df) holds the labelled rows."""
    spark = df.sparkSession
    small_batches(spark)
    training = sample(df if train is None else train, text, lang, train_rows, train_bytes)
    # a table has up to two states a byte and four bytes for each of about 64 codes
    fits = max(1024, TABLE_BYTES // (2 * 4 * 64 * max(1, len(training))))
    training = {name: t[:fits] for name, t in training.items()}
    shared = spark.sparkContext.broadcast(training)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = hash(tuple(sorted(shared.value.items())))
        take_over(_parsers)
        if mark not in _parsers:
            _parsers.clear()
            _parsers[mark] = Parser(shared.value)
        parser = _parsers[mark]
        for b in batches:
            raw, off = text_bytes(b.column(b.num_columns - 1))
            names, scores = [], []
            for i, j in slices(off):
                own, at = raw[off[i] : off[j]], off[i : j + 1] - off[i]
                n = np.diff(at)
                known = (n > 1) & (len(parser.names) > 0)
                if not parser.names:
                    names += [UNDETERMINED] * (j - i)
                    scores += [0.0] * (j - i)
                    continue
                cost = parser.phrases(own, at) * parser.bits
                best = cost.argmin(1)
                odds = np.exp2(-np.minimum(60, cost - cost.min(1, keepdims=True)))
                sure = 1 / odds.sum(1)
                names += [parser.names[x] if k else UNDETERMINED for x, k in zip(best, known, strict=True)]
                scores += np.where(known, sure, 0.0).tolist()
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names[:-1], "lang_pred", "score"])

    # one space on both sides marks word ends; a text of one space has no letter
    source = df.select(key, *keep, F.when(F.trim(letters(text)) == "", F.lit("")).otherwise(F.concat(F.lit(" "), F.trim(letters(text)), F.lit(" "))).alias("_letters"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(freed(predicted), f"{schema}, lang_pred string, score double")
