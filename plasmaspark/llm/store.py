"""Tables that are written once in the cluster's shared folder and read again.

A written table cuts the lineage: a lost executor costs no more than the tasks
that it ran, and nothing upstream is computed twice.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where that is unset in a local session."""
    if not (folder := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.gettempdir()}/checkpoints/{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """df, written as Parquet (zstd) in the shared folder and read again.

    The files stay until ``forget`` or until the owner of the shared folder
    clears it, since the returned plan reads them lazily.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sampled(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """About `rows` rows of df at most, those whose key (a hash, as a long) is least; all if there are no more. The bound is of 64 bits, so that it holds for any number of rows."""
    n = df.count()
    return df if n <= rows else df.where(key < int(rows / n * (1 << 64)) - (1 << 63))


def forget(spark: SparkSession) -> None:
    """Delete this application's written tables; call it when no result that reads them is needed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
