"""Fragments that arrive file by file: running size channels per tile. All states are sums, so that any order of arrival gives the same table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from plasmaspark.operators.coverage import fsc_tiles

SCHEMA = StructType().add("chrom", "string").add("start", "long").add("end", "long").add("length", "long").add("gc_pct", "integer")


def read_fragments(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(folder)


def running_tiles(fragments: DataFrame, size: int = 100_000) -> DataFrame:
    """For output mode update or complete; the state is a row per tile."""
    return fsc_tiles(fragments, size)
