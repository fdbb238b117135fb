"""From documents to packed sequences: language ID, exact and near deduplication, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return the columns of documents. Near duplicates
are decided row by row: of linked rows the one with the smallest doc_id stays (nulls count as largest; of equal ids the one whose text
has the smaller hash), so rows that share an id don't answer for each other. Further columns are left out. Empty tables pass through
every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.llm import exact_dedup, language_id, mixing, ngram_join, packing
from logweir.llm.common import ARROW_BYTES, sized_broadcast, written
from logweir.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def bounded(spark: SparkSession) -> None:
    """Batches of a quarter of what an operator alone takes: the stages' workers and the JVM's buffers share an executor's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES // 4))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter go; a missing language is filled in."""
    bounded(spark)
    docs = docs.select(*COLUMNS)
    known = language_id.identify(docs, keep=tuple(COLUMNS[1:]))
    return known.where(F.col("lang_pred") != language_id.UNDETERMINED).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    return exact_dedup.kept_rows(docs.select(*COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked rows the one with the smallest doc_id stays."""
    bounded(spark)
    docs = docs.select(*COLUMNS)
    row = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))
    found = ngram_join.near_duplicates(docs.select(row.alias("row"), "text"), key="row")
    gone = written(found.where(F.col("row") != F.col("component_id")).select("row.id", "row.h").distinct(), "near-copies")
    gone = sized_broadcast(gone, 64)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["id"]) & (F.xxhash64("text") == gone["h"]), "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words drawn for the mix: a row for each document and pass that takes part."""
    mixed = mixing.mix(docs, keep=["text", "lang", "source"])
    return mixing.mixed_texts(mixed).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in sequences of 2048 tokens."""
    bounded(spark)
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither the predictions nor the draws nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each one's rows written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
