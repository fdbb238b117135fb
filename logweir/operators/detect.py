"""Routing: the first pack that claims a line, and the fields its decoders yield."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import decoders
from ..sources.packs import BUILT_IN, Pack

SALVAGE = "salvage"


def claims(pack: Pack, text: Column) -> Column:
    """Cheap substring tests come before patterns; a pack without any criterion claims nothing."""
    tests: list[Column] = []
    if pack.contains:
        low = F.lower(text)
        for word in pack.contains:
            tests.append(low.contains(word.lower()))
    for some in ([text.startswith(p) for p in pack.prefixes], [text.rlike(p) for p in pack.patterns]):
        if some:
            any_ = some[0]
            for test in some[1:]:
                any_ = any_ | test
            tests.append(any_)
    if not tests:
        return F.lit(False)
    out = tests[0]
    for test in tests[1:]:
        out = out & test
    return out


def by_pack(pack: Column, packs: Sequence[Pack], value: Callable[[Pack], Column], default: Column) -> Column:
    """value(p) of the row's pack."""
    out = F
    for p in packs:
        out = out.when(pack == p.id, value(p))
    return out.otherwise(default) if packs else default


def route(df: DataFrame, packs: Sequence[Pack] = BUILT_IN, text: str = "raw_text") -> DataFrame:
    """Adds claimed: id of the first claiming pack, in order; null if none does."""
    out = F
    for p in packs:
        out = out.when(claims(p, F.col(text)), F.lit(p.id))
    return df.withColumn("claimed", out.otherwise(F.lit(None).cast("string")) if packs else F.lit(None).cast("string"))


#: Bytes of code beyond which HotSpot interprets a method for ever.
COMPILED = 8000


def compilable(df: DataFrame) -> None:
    """Decoders and events of all packs in one generated method are more than the JVM compiles; beyond this limit Spark makes many small
    ones instead. For the session."""
    conf, name = df.sparkSession.conf, "spark.sql.codegen.hugeMethodLimit"
    if int(conf.get(name)) > COMPILED:
        conf.set(name, str(COMPILED))


def extract(df: DataFrame, packs: Sequence[Pack] = BUILT_IN, text: str = "raw_text") -> DataFrame:
    """Adds fields, decoder and pack. A line whose pack can't decode it is salvaged: fields null, decoder and pack "salvage".

    Every decoder is a column of its own, fed only with the lines of packs that use it (so only XML lines reach a Python worker with
    content); a row then takes its pack's first filled column.
    """
    compilable(df)
    columns: dict[tuple[str, str | None], str] = {}
    for p in packs:
        for name in p.decoders:
            if name in decoders.DECODERS or (name == "regex" and p.regex):
                columns.setdefault((name, p.regex if name == "regex" else None), f"_d{len(columns)}")
    made = {}
    for (name, pattern), column in columns.items():
        users = [p.id for p in packs if name in p.decoders and (name != "regex" or p.regex == pattern)]
        claimed = F.col("claimed").isin(users)
        own = F.when(claimed, F.col(text))
        found = decoders.groups(own, pattern) if name == "regex" else decoders.DECODERS[name](own)
        # a decoder isn't evaluated at all for lines of other packs
        made[column] = F.when(claimed, decoders.let(found, lambda m: F.when(F.size(m) > 0, m)))
    none = F.lit(None).cast(decoders.STRINGS)

    def steps(p: Pack) -> list[tuple[str, Column]]:
        keys = [(n, p.regex if n == "regex" else None) for n in p.decoders]
        return [(k[0], F.col(columns[k])) for k in keys if k in columns]

    def fields(p: Pack) -> Column:
        return F.coalesce(*[c for _, c in steps(p)], none)

    def decoder(p: Pack) -> Column:
        return F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in steps(p)], F.lit(None).cast("string"))

    out = df.withColumns(made) if made else df
    out = out.withColumns({"fields": by_pack(F.col("claimed"), packs, fields, none), "decoder": by_pack(F.col("claimed"), packs, decoder, F.lit(None).cast("string"))})
    done = F.col("fields").isNotNull()
    out = out.withColumns({"decoder": F.when(done, F.col("decoder")).otherwise(SALVAGE), "pack": F.when(done, F.col("claimed")).otherwise(SALVAGE)})
    return out.drop(*made)
