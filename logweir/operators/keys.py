"""Signed checkpoints: Ed25519 through the JVM's own provider.

The roots of a run's blocks are leaves of one more tree, whose root alone is signed, on the driver. Each block carries its proof, so that
it can be verified without the others, and no list of blocks passes the driver.
"""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import written
from . import merkle
from .chain import sequenced

ALGORITHM = "Ed25519"


class Signer:
    """A key pair; both halves can be stored as text and loaded again."""

    def __init__(self, spark: SparkSession, private: str | None = None, public: str | None = None):
        self.jvm = spark.sparkContext._jvm
        if private and public:
            factory = self.jvm.java.security.KeyFactory.getInstance(ALGORITHM)
            self.private = factory.generatePrivate(self.jvm.java.security.spec.PKCS8EncodedKeySpec(base64.b64decode(private)))
            self.public = factory.generatePublic(self.jvm.java.security.spec.X509EncodedKeySpec(base64.b64decode(public)))
        else:
            pair = self.jvm.java.security.KeyPairGenerator.getInstance(ALGORITHM).generateKeyPair()
            self.private, self.public = pair.getPrivate(), pair.getPublic()

    def encoded(self, key, spec: str) -> bytes:
        """A key's bytes, through its specification (the key's own class isn't public)."""
        factory = self.jvm.java.security.KeyFactory.getInstance(ALGORITHM)
        return bytes(factory.getKeySpec(key, self.jvm.java.lang.Class.forName(f"java.security.spec.{spec}")).getEncoded())

    def stored(self) -> tuple[str, str]:
        """(private, public) as base64."""
        return base64.b64encode(self.encoded(self.private, "PKCS8EncodedKeySpec")).decode(), base64.b64encode(self.encoded(self.public, "X509EncodedKeySpec")).decode()

    def public_hex(self) -> str:
        return self.encoded(self.public, "X509EncodedKeySpec")[-32:].hex()

    def sign(self, message: str) -> str:
        own = self.jvm.java.security.Signature.getInstance(ALGORITHM)
        own.initSign(self.private)
        own.update(bytearray(message.encode()))
        return bytes(own.sign()).hex()

    def verify(self, message: str, signature: str) -> bool:
        own = self.jvm.java.security.Signature.getInstance(ALGORITHM)
        own.initVerify(self.public)
        own.update(bytearray(message.encode()))
        try:
            return bool(own.verify(bytearray(bytes.fromhex(signature))))
        except Exception:  # a malformed signature is an invalid one
            return False


def message(seq: int, head: str, root: str) -> str:
    return f"checkpoint_seq:{seq}:{head}:{root}"


def seal_of(blocks: int, root: str) -> str:
    return f"checkpoints:{blocks}:{root}"


def checkpoints(blocks: DataFrame, signer: Signer, timestamp: int = 0) -> DataFrame:
    """Signed rows for block roots (checkpoint_seq, chain_head, merkle_root): with the run's signature, its root, its number of blocks,
    and the block's place and proof in it."""
    spark = blocks.sparkSession
    text = F.concat_ws(":", F.lit("checkpoint_seq"), F.col("checkpoint_seq").cast("string"), "chain_head", "merkle_root")
    rows = sequenced(blocks.select("checkpoint_seq", "chain_head", "merkle_root"), "checkpoint_seq", start=0)
    rows = written(rows.withColumnRenamed("sequence", "place").withColumn("_text", text), "blocks-placed")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], ROW)
    nodes = written(merkle.levels(rows, "place", "_text"), "blocks-nodes")
    root = nodes.where(F.col("level") == (n - 1).bit_length()).first()["hash"]
    signature = signer.sign(seal_of(n, root))
    steps = merkle.proofs(nodes, n).withColumnRenamed("at", "place")
    return rows.join(steps, "place").select(
        "checkpoint_seq", "chain_head", "merkle_root", F.lit(signature).alias("signature"), F.lit(signer.public_hex()).alias("signer_pubkey"), F.lit(ALGORITHM).alias("algorithm"), F.lit(timestamp).cast("long").alias("timestamp"),
        "place", F.lit(n).cast("long").alias("blocks"), F.lit(root).alias("run_root"), "proof",
    )


ROW = "checkpoint_seq long, chain_head string, merkle_root string, signature string, signer_pubkey string, algorithm string, timestamp long, place long, blocks long, run_root string, proof array<struct<direction:string,hash:string>>"


def genuine(row, signer: Signer) -> bool:
    """Whether a block was signed by this very key (not merely by the one that it names), as far as this row alone tells."""
    if row["signer_pubkey"] != signer.public_hex() or not signer.verify(seal_of(row["blocks"], row["run_root"]), row["signature"]):
        return False
    return merkle.climbed(message(row["checkpoint_seq"], row["chain_head"], row["merkle_root"]), row["proof"]) == row["run_root"]


def verified(rows: DataFrame, signer: Signer) -> DataFrame:
    """rows of checkpoints() with genuine. Signatures are verified on the driver, one a run; proofs where the rows are, places included."""
    runs = rows.select("blocks", "run_root", "signature", "signer_pubkey").distinct().collect()  # a row a run
    good = [(r["blocks"], r["run_root"], r["signature"]) for r in runs if r["signer_pubkey"] == signer.public_hex() and signer.verify(seal_of(r["blocks"], r["run_root"]), r["signature"])]
    known = rows.sparkSession.createDataFrame(good, "blocks long, run_root string, signature string").withColumn("_good", F.lit(True))
    text = F.concat_ws(":", F.lit("checkpoint_seq"), F.col("checkpoint_seq").cast("string"), "chain_head", "merkle_root")
    proved = merkle.proved_at(text, F.col("place"), F.col("blocks"), F.col("proof"), F.col("run_root"))
    joined = rows.join(F.broadcast(known), ["blocks", "run_root", "signature"], "left")
    return joined.select(*rows.columns, (F.coalesce("_good", F.lit(False)) & (F.col("signer_pubkey") == signer.public_hex()) & F.coalesce(proved, F.lit(False))).alias("genuine"))
