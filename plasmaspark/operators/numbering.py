"""Consecutive numbers over a global order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, order: list[str], name: str, first: int = 1) -> DataFrame:
    """df with the place of each row in a global order.

    The rows are range-partitioned and numbered within partitions; the
    partitions' sizes (one row each) give the offsets. Rows must differ in
    order, or places of equal rows aren't determined.
    """
    by = [F.col(c) for c in order]
    parted = df.repartitionByRange(*by).withColumn("__part", F.spark_partition_id())
    own = parted.withColumn("__own", F.row_number().over(Window.partitionBy("__part").orderBy(*by)))
    sizes = own.groupBy("__part").agg(F.max("__own").alias("__n"))
    before = sizes.select(F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return own.join(F.broadcast(before), F.col("__part") == F.col("__p")).withColumn(name, (F.col("__before") + F.col("__own") - 1 + first).cast("bigint")).select(*df.columns, name)
