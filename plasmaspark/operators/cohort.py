"""Cohort baselines over samples, and normalisation against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plasmaspark.functions.expressions import zscore


def baseline(values: DataFrame, by: list[str], value: str, population: bool = False, single: float = 0.1, floor: float = 0.0, least: int = 1) -> DataFrame:
    """mean and std of value per key over samples: the sample deviation or the population's, `single` for fewer than two samples, at least `floor`; keys with fewer than `least` samples are left out."""
    std = F.stddev_pop(value) if population else F.stddev_samp(value)
    out = values.groupBy(*by).agg(F.count(value).alias("n_samples"), F.avg(value).alias("mean"), std.alias("std"))
    shown = F.when(F.col("n_samples") < 2, single).otherwise(F.greatest(F.col("std"), F.lit(floor)))
    return out.where(F.col("n_samples") >= least).withColumn("std", shown)


def vector_baseline(values: DataFrame, key: str, vector: str, floor: float = 0.01, single: float = 0.1) -> DataFrame:
    """(key, pos, mean, std): element-wise over samples' vectors."""
    each = values.select(key, F.posexplode(vector).alias("pos", "v"))
    return baseline(each, [key, "pos"], "v", single=single, floor=floor)


def normalised(values: DataFrame, base: DataFrame, by: list[str], value: str, least: float = 0.0, missing: float | None = None) -> DataFrame:
    """values with z against base; the baseline's size decides how Spark joins it."""
    return values.join(base.select(*by, "mean", "std"), by, "left").withColumn("z", zscore(F.col(value), F.col("mean"), F.col("std"), least, missing)).drop("mean", "std")


def shape_score(a: Column, b: Column, n: int) -> Column:
    """Pearson correlation of two arrays of n elements; 0 where either is flat."""
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / n
    dev = lambda x: F.transform(x, lambda v: v - mean(x))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    da, db = dev(a), dev(b)
    sa, sb = F.sqrt(dot(da, da)), F.sqrt(dot(db, db))
    return F.when((sa < 1e-6) | (sb < 1e-6), 0.0).otherwise(dot(da, db) / (sa * sb))


def union_tables(**tables: DataFrame) -> DataFrame:
    """One table of many kinds, told apart by `table`; columns that a kind lacks are null."""
    out = None
    for name, df in tables.items():
        named = df.withColumn("table", F.lit(name))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out
