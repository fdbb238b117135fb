"""Source divergence audit: how far the vocabulary of each source lies from those of the other sources of its language.

An inverted index of kept terms holds, for each term, the sources that use it. A pair of sources starts at V times the divergence of two
zero counts (V: kept terms of the language), and postings emit corrections only: a source's term corrects all its pairs as if the other
side had a zero count, which depends on the count alone and is summed by distinct counts first, and two postings of one term correct their
pair by what the two one-sided corrections miss. So no pair looks at a term that neither side uses. Terms are ranked by windows.

Shares are whole numbers of 10^-9 and all arithmetic is exact (decimals where products pass 64 bits).

Defined cases: null text, language and source count as ''; repeated rows are documents of their own; a source without terms is a source
like others; a language without kept terms has pairs of value 0 and no terms; texts of any length are read in pieces of a mebibyte,
cut between terms; other columns, whatever their names, are not read; an empty table gives an empty table. A term that fills a whole
text is held whole. Bytes that are no UTF-8 belong to terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sized_broadcast, small_batches, text_bytes, written

#: Documents of a language that must hold a term, parts of a whole share, ranks of the terms told.
LEAST, WHOLE, RANKS = 10, 1_000_000_000, 10
#: Terms that a task counts before it passes the counts on, and bytes of a long text that it cuts at once.
HELD, PIECE = 200_000, 1 << 20
#: Bytes of terms: ASCII letters, the capitals made small, and all of other characters; the rest separates.
SMALL = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in lists of about PIECE bytes."""
    at, text = 0, text.translate(SMALL)
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of some documents, pre-aggregated; a row with an empty term tells that the group occurs."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def told() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = [b"", *n]
            counts = [pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[t] for t in n)], pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.binary()), *counts], names=["lang", "source", "term", "n", "docs"])
        held.clear()

    size = 0
    for b in batches:
        raw, off = text_bytes(b.column(2))
        for i, group in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            n, docs = held.setdefault(group, (Counter(), Counter()))
            before, own = len(n), set()
            for some in words(raw[off[i] : off[i + 1]].tobytes()):
                n.update(some)
                own.update(some)
            docs.update(own)
            size += len(n) - before
            if size >= HELD:
                yield from told()
                size = 0
    yield from told()


def gap(p: str, q: str) -> str:
    """SQL of the divergence of two shares, both at least 1."""
    return f"((({p}) - ({q})) * (({p}) - ({q}))) div (({p}) + ({q}))"


def share(count: str, total: str, v: str = "v") -> str:
    """SQL of a count's smoothed share of `total` occurrences of `v` terms; null if there are no terms."""
    return f"1 + ({WHOLE} * (cast({count} as decimal(20,0)) + 2)) div nullif(cast({total} as decimal(20,0)) + 2 * cast({v} as decimal(20,0)), 0)"


def audit(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, ranks: int = RANKS) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank (from 1 for each group and part)."""
    small_batches(df.sparkSession)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    found = df.select(empty(lang).alias("lang"), empty(source).alias("source"), empty(text).alias("text")).mapInArrow(counted, "lang string, source string, term binary, n long, docs long")
    index = written(found.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms")

    term = Window.partitionBy("lang", "term")
    kept = index.where("term <> ''").withColumns({"in_docs": F.sum("docs").over(term), "in_lang": F.sum("n").over(term), "k": F.row_number().over(term.orderBy("source"))})
    kept = written(kept.where(F.col("in_docs") >= least).drop("docs", "in_docs"), "kept")  # a row for each posting
    whole = kept.groupBy("lang").agg(F.sum("n").alias("of_lang"), F.count_if(F.col("k") == 1).alias("v"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = index.where("term = ''").select("lang", "source").join(own, ["lang", "source"], "left").join(whole, "lang", "left").na.fill(0, ["total", "of_lang", "v"])
    groups = written(groups.withColumn("p0", F.expr(share("0", "total"))), "groups")
    n = groups.count()
    small = lambda g: sized_broadcast(g, 200, n)

    others = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    start = groups.join(small(others), "lang").where("source <> item").select("lang", "source", "item", F.expr(f"coalesce(v * ({gap('p0', 'q0')}), 0)").alias("value"))
    # one-sided: as many terms as share a count, against each other source's zero count
    alike = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("terms")).join(small(groups), ["lang", "source"]).withColumn("p", F.expr(share("n", "total")))
    one = alike.join(small(others), "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.expr(f"terms * (({gap('p', 'q0')}) - ({gap('p0', 'q0')}))")).alias("value"))
    # two-sided: what both one-sided corrections miss where a term has two postings
    postings = kept.join(small(groups), ["lang", "source"]).select("lang", "source", "term", F.expr(share("n", "total")).alias("p"), "p0")
    right = postings.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    missed = F.expr(f"({gap('p', 'q')}) - ({gap('p', 'q0')}) - ({gap('p0', 'q')}) + ({gap('p0', 'q0')})")
    two = postings.join(right, ["lang", "term"]).where("source < item").select("lang", "source", "item", missed.alias("value")).where("value <> 0").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    turned = lambda d: d.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    two = written(two, "two-sided")
    one = written(one, "one-sided")
    pairs = start.unionByName(one).unionByName(turned(one)).unionByName(two).unionByName(turned(two)).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))

    terms = kept.join(small(groups), ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), F.expr(share("n", "total")).alias("p"), F.expr(share("in_lang", "of_lang")).alias("q"))
    terms = terms.where("p > q").select("lang", "source", "item", F.expr(gap("p", "q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda d, part: d.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(terms, "term").where(F.col("rank") <= ranks))
