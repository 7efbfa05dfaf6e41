"""Resumable, periodically saved work: in batches, and as a stream with checkpoints."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespark.sources.shared import shared_dir


def resume_batch(spark: SparkSession, source: DataFrame, target: str, work: Callable[[DataFrame], DataFrame], key: str) -> int:
    """Does the rows of source that target has no result without error for, and appends the results; how many it did.
    Running it again does only what failed or is new."""
    from lodespark.sources.tables import append_parquet

    try:
        done = spark.read.parquet(target)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = None
    todo = source
    if done is not None:
        ok = done.filter(F.col("error").isNull()) if "error" in done.columns else done
        todo = source.join(ok.select(key).distinct(), key, "left_anti")
    n = todo.count()
    if n:
        append_parquet(work(todo), target)
    return n


def resume_stream(spark: SparkSession, folder: str, schema: str, target: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], files: int = 1) -> None:
    """Works off the new Parquet files of a folder, files at a time, saving after each micro-batch; then stops. The
    checkpoint knows what is done, so a run that was broken off goes on where it was."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    q = work(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def windowed_counts(events: DataFrame, ts: str, by: list[str], size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """window start, by, n, total of value: on a stream or a table. Events later than late after the newest are lost to
    a stream in append mode."""
    e = events.withColumn("__ts", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        e = e.withWatermark("__ts", late)
    return e.groupBy(F.window("__ts", size), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *by, "n", "total")


def run_windowed_counts(spark: SparkSession, folder: str, schema: str, glob: str, by: list[str], name: str) -> DataFrame:
    """windowed_counts of a folder's files as a stream, run to its end in complete mode into the table name."""
    stream = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)
    q = windowed_counts(stream, "ts", by).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
