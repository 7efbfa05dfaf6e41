"""Tables cut from their lineage, in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a local master, as in tests, gets a
    temporary one; on a cluster, whose machines share no such folder, that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lodespark-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def drop_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files that nothing refers to. What the last query wrote may still be referred to just
    after it, so before a step that writes much, some time after that query, another call can free more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: later steps don't recompute it and survive lost executors. The
    table is deleted when the application ends, or before that by drop_cuts()."""
    spark, schema = df.sparkSession, df.schema
    home = f"{shared_dir(spark)}/cuts-{spark.sparkContext.applicationId}"
    path = f"{home}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _delete_at_exit(spark, home)
    del df
    drop_shuffles(spark)
    return spark.read.schema(schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """df, which ends in a repartition, for several queries that all read the files of one shuffle: none is written twice.
    Spark keeps them as long as df is referred to, and makes those of a lost executor again."""
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(df._jdf.queryExecution().toRdd(), df._jdf.schema(), False), spark)


def drop_cuts(spark: SparkSession) -> None:
    """Deletes the tables that this application has cut; what is still to be computed from them can't be any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/cuts-{spark.sparkContext.applicationId}")
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
