"""The query side: filters, lookups, integrity and features over a lake, as lazy DataFrames."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import chain, features, keys, lake, matching, merkle, vault
from .sources.tables import written

# fixed values: nested names that queries may use for flat columns
ALIASES = {"src_endpoint.ip": "src_ip", "dst_endpoint.ip": "dst_ip", "src_endpoint.port": "src_port", "dst_endpoint.port": "dst_port", "actor.user.name": "user_name", "device.hostname": "hostname"}


def aliased(text: str) -> str:
    """An SQL condition with nested names replaced by columns, outside of quoted strings."""
    names = re.compile("|".join(re.escape(a) for a in ALIASES))
    return "".join(p if i % 2 else names.sub(lambda m: ALIASES[m[0]], p) for i, p in enumerate(re.split(r"('(?:[^'\\]|\\.|'')*')", text)))


class Client:
    """Queries over the tables that plans.pipeline.commit wrote."""

    def __init__(self, spark: SparkSession, path: str, key: bytes | None = None):
        self.spark, self.lake, self.key = spark, lake.Lake(spark, path), key

    def logs(self) -> DataFrame:
        return self.lake.latest("parsed_logs")

    def vault(self) -> DataFrame:
        return self.lake.appended("vault")

    def only(self, where: str) -> Column | None:
        """The bucket that a condition needs, if one of its parts, all joined by AND, asks for a single event_id."""
        plain = re.split(r"('(?:[^'\\]|\\.|'')*')", where)
        if re.search(r"(?i)\b(or|not|case)\b", " ".join(plain[::2])) or "(" in "".join(plain[::2]):
            return None
        asked = re.search(r"(?i)(?:^|\band)\s*event_id\s*=\s*('(?:[^'\\]|\\.|'')*'|\d+)\s*(?=$|\band\b)", where)
        kind = dict(self.lake.appended("parsed_logs").dtypes)["event_id"]
        return F.col("_bucket") == self.lake.bucket(F.expr(asked[1]).cast(kind)) if asked else None

    def query(self, where: str | None = None, select: str = "*", limit: int | None = None) -> DataFrame:
        """Rows in order of sequence; conditions and columns reach the Parquet scan. limit 0 or None: all."""
        df = self.lake.latest("parsed_logs", within=self.only(where) if where else None)
        df = df.where(aliased(where)) if where else df
        df = df.orderBy("sequence")
        df = df.limit(limit) if limit else df
        return df if select.strip() == "*" else df.selectExpr(*[c for c in re.split(r",(?![^(]*\))", aliased(select))])

    def latest(self, limit: int = 50) -> DataFrame:
        """The last rows, with the columns of an overview."""
        columns = ["event_id", "sequence", "timestamp", "class_uid", "vendor", "product", "activity_name", "src_ip", "dst_ip", "user_name", "fingerprint", "raw_payload"]
        return self.logs().orderBy(F.desc("sequence")).limit(limit).select(*columns)

    @staticmethod
    def batches(df: DataFrame, rows: int = 1000) -> Iterator[pa.Table]:
        """A result piece by piece, of `rows` rows at most, a partition ahead at most. Tasks make the pieces; they come here as bytes."""

        def packed(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in found:
                for at in range(0, b.num_rows, rows):
                    out = pa.BufferOutputStream()
                    with pa.ipc.new_stream(out, b.schema) as stream:
                        stream.write_batch(b.slice(at, rows))
                    yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["piece"])

        for r in df.mapInArrow(packed, "piece binary").toLocalIterator(prefetchPartitions=True):
            yield pa.ipc.open_stream(pa.py_buffer(r["piece"])).read_all()

    def raw(self, event_id: str) -> bytes | None:
        """The bytes that an event came from; None if it is unknown or its block is damaged."""
        asked = self.lake.lookup("parsed_logs", event_id).select(F.col("raw_locator").alias("locator"))
        row = vault.read(asked, self.vault(), key=self.key).select("raw", "intact").first()
        return bytes(row["raw"]) if row and row["intact"] else None

    def lineage(self, event_ids: DataFrame | None = None) -> DataFrame:
        """event_id and lineage_json; events without a record get one of the stages that their row shows."""
        rows = self.logs() if event_ids is None else self.logs().join(event_ids, "event_id", "left_semi")
        short = F.to_json(F.struct("event_id", F.struct(F.col("raw_locator").alias("locator")).alias("stage_1_raw"), F.struct("class_uid").alias("stage_5_normalization"), F.struct("fingerprint", "prev_hash").alias("stage_6_attestation")))
        if not self.lake.exists("lineage_log"):
            return rows.select("event_id", short.alias("lineage_json"))
        return rows.join(self.lake.latest("lineage_log"), "event_id", "left").select("event_id", F.coalesce("lineage_json", short).alias("lineage_json"))

    def chained(self) -> DataFrame:
        """The rows as chain.verify wants them."""
        rows = self.lake.latest("parsed_logs", technical=True).withColumnRenamed("ocsf_json", "event_json")
        return rows if "_chain" in rows.columns else rows.withColumn("_chain", F.lit("main"))

    def links(self) -> DataFrame | None:
        return self.lake.latest("chain_links") if self.lake.exists("chain_links") else None

    def verify(self, start: int | None = None, end: int | None = None, size: int = chain.RANGE) -> DataFrame:
        """Both levels of all chains, or what of them lies between two sequence numbers."""
        return chain.verify(self.chained(), start, end, "_chain", size, self.links())

    def grow_tree(self, batch: int = 0) -> int:
        """Brings the stored tree over all fingerprints up to the lake's last sequence number; returns its number of leaves. Only new
        leaves and a bounded number of nodes are read."""
        before = self.tree()
        end = self.logs().agg(F.max("sequence")).first()[0] or 0
        if end == before:
            return end
        first = before >> merkle.HEIGHT << merkle.HEIGHT
        leaves = self.logs().where(F.col("sequence") > first).select((F.col("sequence") - 1).alias("at"), merkle.leaf(F.col("fingerprint")).alias("hash"))

        def kept(level: int, start: int, stop: int) -> DataFrame:
            return self.lake.appended("nodes").where((F.col("tree") == 0) & (F.col("level") == level) & F.col("at").between(start, stop - 1)).select("at", "hash")

        own = self.lake.begin(batch)
        own.write(merkle.grown(leaves, before, end, kept), "nodes", upsert=False)
        own.write(self.spark.createDataFrame([(end,)], "leaves long"), "trees", upsert=False)
        own.commit()
        return end

    def tree(self) -> int:
        """Leaves of the stored tree, 0 if there is none."""
        return self.lake.appended("trees").agg(F.max("leaves")).first()[0] if self.lake.exists("trees") else 0

    def nodes(self, places: list[tuple[int, int, int]]) -> DataFrame:
        """Stored nodes by tree, level and place."""
        return self.lake.lookups("nodes", places)

    def prove(self, event_id: str) -> dict | None:
        """Inclusion proof of an event in the stored tree (None: unknown, or later than the tree): point reads of an event, and of a node
        a level."""
        row = self.lake.lookup("parsed_logs", event_id).select("sequence", "fingerprint").first()
        n = self.tree()
        if row is None or row["sequence"] > n:
            return None
        at = row["sequence"] - 1
        wanted = merkle.path(at, n)
        rows = {(r["tree"], r["level"], r["at"]): r["hash"] for r in self.nodes([p for _, p in wanted] + [merkle.top_of(n)]).collect()}  # a row a level
        return {"event_id": event_id, "index": at, "leaves": n, "fingerprint": row["fingerprint"], "root": rows[merkle.top_of(n)], "proof": [{"direction": d, "hash": rows[p]} for d, p in wanted]}

    def tamper_test(self, sequence: int, member: str = "raw_data", value: str = "forged") -> DataFrame:
        """What verify says after one row has been changed (in memory only)."""
        return chain.verify(chain.tampered(self.chained(), sequence, member, value), chain="_chain", links=self.links())

    def checkpoint(self, signer: keys.Signer, size: int = 1000, timestamp: int = 0) -> DataFrame:
        signed = written(keys.checkpoints(merkle.block_roots(self.logs(), size=size), signer, timestamp), "signed")
        self.lake.write(signed, "checkpoints", timestamp)
        return signed

    def features(self, *keep: str) -> DataFrame:
        return features.rows(self.logs(), *keep)

    def review_queue(self) -> DataFrame:
        return matching.pending(self.lake.latest("review_queue"))

    def approve(self, review_id: str, batch: int = 1) -> None:
        """Marks an entry as approved: its row is written again and counts from now on."""
        self.lake.write(self.lake.latest("review_queue").where(F.col("review_id") == review_id).withColumn("status", F.lit("APPROVED")), "review_queue", batch)
