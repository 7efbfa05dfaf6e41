"""What the operators share: column hygiene and size-checked broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodespark.sources.shared import cut

__all__ = ["BATCH_BYTES", "BROADCAST_BYTES", "cut", "docs_of", "free_name", "small"]

BROADCAST_BYTES = 48 << 20
BATCH_BYTES = 4 << 20


def docs_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text under those very names, without other columns; rows without a doc_id go.

    Texts are long, so the session's Arrow batches are held to BATCH_BYTES, if they may be larger: a batch is in memory
    several times over, in the JVM and in each of an executor's Python workers.
    """
    spark, key = docs.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more).filter(F.col("doc_id").isNotNull())


def small(df: DataFrame, rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if rows * row_bytes is within the limit; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores after it if df has such a column."""
    have = {c.lower() for c in df.columns}
    while any(c.startswith(name.lower()) for c in have):
        name += "_"
    return name
