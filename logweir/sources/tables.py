"""Tables in the shared folder, for steps that must see the same rows twice."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


#: Of all tables: digests are hexadecimal text, which Snappy can't shorten and Zstandard halves.
CODEC = "zstd"


def fresh(spark: SparkSession, name: str) -> str:
    """A path that nothing uses yet, in the folder that spark.checkpoint.dir names; in the warehouse, which is shared too, where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    return f"{at.rstrip('/')}/logweir-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet, read again."""
    path = fresh(df.sparkSession, name)
    df.write.option("compression", CODEC).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
