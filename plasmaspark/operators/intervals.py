"""Interval joins by genomic bucket.

Half-open intervals [start, end) overlap if a.start < b.end and a.end > b.start.
The left side (fragments, reads) has rows of bounded length; it keeps one row
per interval, keyed by the bucket of its start. The right side is filed under
every bucket in which the start of a row that overlaps it may lie. So a pair
meets in exactly one bucket, nothing has to be de-duplicated, the left side
isn't multiplied, and the join is an equi-join on (chrom, bucket) that Spark
broadcasts or shuffles by size and splits where a bucket is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET = 4096
#: Longest left interval; fragments are at most 1000.
LONGEST = 1000


def _filed(right: DataFrame, longest: int, slack: int, bucket: int) -> DataFrame:
    first, last = f"greatest(0, r_start - {slack} - {longest} + 1)", f"greatest(0, r_end + {slack} - 1)"
    return right.withColumn("r_bucket", F.explode(F.expr(f"sequence(cast(floor({first} / {bucket}) as bigint), cast(floor({last} / {bucket}) as bigint))")))


def as_right(regions: DataFrame, **renamed: str) -> DataFrame:
    """Regions with the columns r_chrom, r_start, r_end that the joins below expect; empty intervals become the point at their start."""
    kept = [c for c in regions.columns if c not in ("chrom", "start", "end")]
    end = F.when(F.col("end") <= F.col("start"), F.col("start") + 1).otherwise(F.col("end"))
    return regions.select(F.col("chrom").alias("r_chrom"), F.col("start").alias("r_start"), end.alias("r_end"), *[F.col(c).alias(renamed.get(c, c)) for c in kept])


def overlap(left: DataFrame, right: DataFrame, how: str = "inner", slack: int = 0, longest: int = LONGEST, bucket: int = BUCKET) -> DataFrame:
    """Join left (chrom, start, end) to right (r_chrom, r_start, r_end), widened by slack on both sides.

    how: inner, left_semi or left_anti. Left rows longer than `longest` would
    be missed and fail the plan instead.
    """
    length = F.col("end") - F.col("start")
    keyed = left.withColumn("l_bucket", F.when(length <= longest, F.expr(f"cast(floor(start / {bucket}) as bigint)")).otherwise(F.raise_error(F.lit("an interval is longer than the join allows")).cast("bigint")))
    on = (F.col("chrom") == F.col("r_chrom")) & (F.col("l_bucket") == F.col("r_bucket")) & (F.col("start") < F.col("r_end") + slack) & (F.col("end") > F.col("r_start") - slack)
    joined = keyed.join(_filed(right, longest, slack, bucket), on, how)
    return joined.drop("l_bucket", "r_bucket", "r_chrom")


def contains_point(points: DataFrame, right: DataFrame, point: Column, how: str = "inner", bucket: int = BUCKET) -> DataFrame:
    """Join each row's point to the right intervals that hold it."""
    keyed = points.withColumn("l_point", point.cast("bigint")).withColumn("l_bucket", F.expr(f"cast(floor(l_point / {bucket}) as bigint)"))
    on = (F.col("chrom") == F.col("r_chrom")) & (F.col("l_bucket") == F.col("r_bucket")) & (F.col("l_point") >= F.col("r_start")) & (F.col("l_point") < F.col("r_end"))
    return keyed.join(_filed(right, 1, 0, bucket), on, how).drop("l_bucket", "r_bucket", "r_chrom", "l_point")


def tiles(left: DataFrame, size: int) -> DataFrame:
    """left with a row per regular tile that it overlaps; no join is needed."""
    return left.withColumn("tile", F.explode(F.expr(f"sequence(cast(floor(start / {size}) as bigint), cast(floor((end - 1) / {size}) as bigint))")))
