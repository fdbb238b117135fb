"""The lake: flat event rows, lineage, checkpoints and review entries as Parquet, and the sinks beside it."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import CODEC


def members(event: Column) -> list[Column]:
    """The columns of the lake that come from the event; what is missing is empty text, or null for ports."""
    e, text = event, lambda c: F.coalesce(c, F.lit(""))
    return [
        e["time"].alias("timestamp"), e["class_uid"].alias("class_uid"), e["category_uid"].alias("category_uid"),
        e["metadata"]["product"]["vendor_name"].alias("vendor"), e["metadata"]["product"]["name"].alias("product"), text(e["activity_name"]).alias("activity_name"),
        text(e["src_endpoint"]["ip"]).alias("src_ip"), e["src_endpoint"]["port"].alias("src_port"), text(e["dst_endpoint"]["ip"]).alias("dst_ip"), e["dst_endpoint"]["port"].alias("dst_port"),
        text(e["actor"]["user"]["name"]).alias("user_name"), text(e["device"]["hostname"]).alias("hostname"), e["raw_data"].alias("raw_payload"),
    ]


MEMBERS = ("timestamp", "class_uid", "category_uid", "vendor", "product", "activity_name", "src_ip", "src_port", "dst_ip", "dst_port", "user_name", "hostname", "raw_payload")


def kept() -> list[Column]:
    """What flat() needs of events beside their seals, for chain.append: far less than the events."""
    return [F.col("event_id"), F.col("sequence"), F.col("chain_id"), F.col("locator"), *members(F.col("event"))]


def flat(df: DataFrame) -> DataFrame:
    """Chained events, or what kept() leaves of them, as the lake's 19 columns. Where events have a chain_id, the column _chain keeps it
    for verification; readers don't see it."""
    *told, raw = members(F.col("event")) if "event" in df.columns else [F.col(c) for c in MEMBERS]
    return df.select(
        "event_id", F.col("sequence").cast("long").alias("sequence"), *told, "fingerprint", "prev_hash", F.col("locator").alias("raw_locator"), raw, F.col("event_json").alias("ocsf_json"),
        *[F.col("chain_id").alias("_chain")] * ("chain_id" in df.columns),
    )


class Batch:
    """Tables of one commit: written beside what readers see, until commit() names them in the manifest all at once."""

    def __init__(self, lake: Lake, batch: int):
        self.lake, self.batch, self.n, self.tables = lake, batch, lake.last() + 1, {}

    def write(self, df: DataFrame, table: str, upsert: bool = True, replaces: bool = False, by: str | None = None, dealt: bool = True) -> None:
        """Rows dealt by the bucket of their key, or by the column `by`. upsert=False declares that none of the keys was written before.
        dealt=False leaves rows in their tasks, each of which writes a file a bucket: for tables whose buckets would be tasks too large."""
        keys = Lake.KEYS.get(table)
        place = by or "_bucket"
        rows = df if by else df.withColumn("_bucket", self.lake.bucket(*keys))
        # a bucket's rows meet in a few files, and their keys' order lets a lookup skip row groups
        rows = rows.repartition("_bucket") if dealt and not by else rows
        rows = rows if by else rows.sortWithinPartitions("_bucket", *keys)
        rows.write.mode("overwrite").option("compression", CODEC).partitionBy(place).parquet(f"{self.lake.path}/{table}/_n={self.n}")
        self.tables[table] = {"upsert": upsert, "replaces": replaces, "schema": rows.schema.jsonValue()}

    def commit(self) -> int:
        """Makes the tables visible; fails if another writer has committed the same number."""
        entry = {"n": self.n, "batch": self.batch, "buckets": self.lake.buckets, "tables": self.tables}
        fs, at = self.lake.located(f"{self.lake.path}/_manifest/{self.n:020d}.json")
        _, draft = self.lake.located(f"{self.lake.path}/_manifest/.{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(entry).encode()))
        finally:
            out.close()
        # readers see whole entries only: a draft gets its name when it is complete
        if fs.exists(at) or not fs.rename(draft, at):
            fs.delete(draft, False)
            raise FileExistsError(f"commit {self.n} exists already")
        return self.n


class Lake:
    """Tables under one path, for one writer at a time and any number of readers.

    A commit is a folder `_n=<number>` in each of its tables and one manifest entry that names them; folders that no entry names (of a
    writer that failed) are not read, and overwritten by the next commit of that number. Rows lie in buckets of their keys' hash, so a
    lookup reads one bucket. Of rows with one key the last committed counts; as commits declare whether they may replace rows, tables
    that were only added to are scanned as they are.
    """

    KEYS = {"parsed_logs": ("event_id",), "lineage_log": ("event_id",), "checkpoints": ("checkpoint_seq",), "review_queue": ("review_id",), "chain_links": ("chain_id", "range"), "nodes": ("tree", "level", "at"), "trees": ("leaves",), "clusters": ("template",)}
    BUCKETS = 16

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        """buckets: of a new lake; one that exists keeps its own."""
        self.spark, self.path = spark, path.rstrip("/")
        self.entries: dict[str, dict] = {}  # entries never change
        known = self.manifest()
        self.buckets = known[0]["buckets"] if known else buckets

    def located(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def manifest(self) -> list[dict]:
        """Entries in order of commits."""
        fs, at = self.located(f"{self.path}/_manifest")
        if not fs.exists(at):
            return []
        read = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils
        for f in fs.listStatus(at):
            name = f.getPath().getName()
            if name in self.entries or not name.endswith(".json"):
                continue
            stream = fs.open(f.getPath())
            try:
                self.entries[name] = json.loads(read.toString(stream, "UTF-8"))
            finally:
                stream.close()
        return [self.entries[name] for name in sorted(self.entries)]

    def last(self) -> int:
        return max((e["n"] for e in self.manifest()), default=0)

    def committed(self, batch: int) -> bool:
        return any(e["batch"] == batch for e in self.manifest())

    def begin(self, batch: int = 0) -> Batch:
        return Batch(self, batch)

    def write(self, df: DataFrame, table: str, batch: int = 0, upsert: bool = True) -> None:
        """A commit of one table."""
        own = self.begin(batch)
        own.write(df, table, upsert)
        own.commit()

    def seen(self, table: str) -> list[dict]:
        """Manifest entries with the table, from the last one on that replaces all before."""
        found = [e for e in self.manifest() if table in e["tables"]]
        start = max((i for i, e in enumerate(found) if e["tables"][table]["replaces"]), default=0)
        return found[start:]

    def exists(self, table: str) -> bool:
        return bool(self.seen(table))

    def bucket(self, *keys: str | Column) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k) if isinstance(k, str) else k for k in keys]), F.lit(self.buckets)).cast("int")

    def appended(self, table: str, technical: bool = False) -> DataFrame:
        """All rows as written, also those that were replaced later: filters and columns reach the scan."""
        seen = self.seen(table)
        schema = T.StructType.fromJson(seen[-1]["tables"][table]["schema"]).add("_n", T.IntegerType())
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").parquet(*[f"{self.path}/{table}/_n={e['n']}" for e in seen])
        return rows if technical else rows.drop(*[c for c in rows.columns if c.startswith("_")])

    def latest(self, table: str, technical: bool = False, within: Column | None = None) -> DataFrame:
        """Each key's last row. Columns whose names begin with an underscore are for the lake itself. within: a condition on keys and
        buckets, which reaches the scan."""
        rows = self.appended(table, technical=True)
        rows = rows if within is None else rows.where(within)
        if any(e["tables"][table]["upsert"] for e in self.seen(table)[1:]):
            keys = list(self.KEYS[table])
            rest = [c for c in rows.columns if c not in (*keys, "_n", "_bucket")]
            last = rows.groupBy(*keys, "_bucket").agg(F.max_by(F.struct(*rest), "_n").alias("r"))
            rows = last.select(*keys, "_bucket", *[F.col(f"r.{c}").alias(c) for c in rest]).select(*[c for c in rows.columns if c != "_n"])
        return rows if technical else rows.drop(*[c for c in rows.columns if c.startswith("_")])

    def lookup(self, table: str, *key) -> DataFrame:
        """The rows of a key, from one bucket."""
        return self.lookups(table, [key])

    def lookups(self, table: str, keys: Sequence[tuple]) -> DataFrame:
        """The rows of a few keys, from their buckets."""
        kinds = dict(self.appended(table, technical=True).dtypes)
        buckets, rows = F.lit(False), F.lit(False)
        for key in keys:
            values = [F.lit(v).cast(kinds[k]) for k, v in zip(self.KEYS[table], key, strict=True)]
            buckets = buckets | (F.col("_bucket") == self.bucket(*values))
            own = F.lit(True)
            for k, v in zip(self.KEYS[table], values, strict=True):
                own = own & (F.col(k) == v)
            rows = rows | own
        return self.latest(table, within=buckets & rows)

    def compact(self, table: str) -> None:
        """Writes the last rows of a keyed table as one commit that replaces all before; vacuum() then removes the old folders."""
        own = self.begin(-1)
        own.write(self.latest(table, technical=True).drop("_n", "_bucket"), table, upsert=False, replaces=True)
        own.commit()

    def vacuum(self) -> int:
        """Removes folders that readers don't see any more; the number removed. Not while a batch is being written."""
        removed = 0
        for table in {t for e in self.manifest() for t in e["tables"]}:
            kept = {f"_n={e['n']}" for e in self.seen(table)}
            fs, at = self.located(f"{self.path}/{table}")
            for f in fs.listStatus(at):
                if f.getPath().getName().startswith("_n=") and f.getPath().getName() not in kept:
                    removed += bool(fs.delete(f.getPath(), True))
        return removed


def ndjson(df: DataFrame, path: str, committed: Column | None = None) -> None:
    """Events as JSON lines under year=/month=/day= of the commit time (UTC)."""
    at = F.current_timestamp() if committed is None else committed
    days = df.select(F.col("event_json").alias("value"), F.date_format(at, "yyyy").alias("year"), F.date_format(at, "MM").alias("month"), F.date_format(at, "dd").alias("day"))
    days.write.mode("append").partitionBy("year", "month", "day").text(path)


def parquet(df: DataFrame, path: str, committed: Column | None = None) -> None:
    """Rows as Parquet under year=/month=/day= of the commit time (UTC)."""
    at = F.current_timestamp() if committed is None else committed
    df.withColumns({"year": F.date_format(at, "yyyy"), "month": F.date_format(at, "MM"), "day": F.date_format(at, "dd")}).write.mode("append").partitionBy("year", "month", "day").parquet(path)
