"""GC bias: observations, correction factors, local regression, cohort curves."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plasmaspark.functions.expressions import length_bin

#: When a length bin is fitted and how.
LEAST_COUNT, LEAST_POINTS, FRACTION, ROUNDS = 50, 10, 0.3, 3


def observations(fragments: DataFrame, by: tuple[str, ...] = (), longest: int = 1000) -> DataFrame:
    """(by, length_bin, gc_pct, n) of the fragments from 60 bp to below longest (400 for the 68 bins of an extraction)."""
    kept = fragments.where((F.col("length") >= 60) & (F.col("length") < longest))
    return kept.groupBy(*by, length_bin(F.col("length")).alias("length_bin"), F.col("gc_pct").cast("int").alias("gc_pct")).agg(F.count("*").alias("n"))


def observed_expected(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """Both counts over every (length_bin, gc_pct) that either has."""
    joined = observed.withColumnRenamed("n", "observed").join(expected.withColumnRenamed("n", "expected"), ["length_bin", "gc_pct"], "full_outer")
    return joined.fillna(0, ["observed", "expected"])


def reference_counts(stored: DataFrame) -> DataFrame:
    """(length_bin, gc_pct, n) of a stored GC reference: as it is written here, or by length_bin_min, gc_percent and expected_count."""
    if "length_bin" in stored.columns:
        return stored.select("length_bin", "gc_pct", "n")
    number = F.expr("(cast(length_bin_min as int) - 60) div 5").cast("int")
    rows = stored.where("length_bin_min >= 60").select(number.alias("length_bin"), F.col("gc_percent").cast("int").alias("gc_pct"), F.col("expected_count").cast("bigint").alias("n"))
    return rows.where("length_bin < 188")


def factor_rows(both: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """correction_factors() in the six columns of a factors file."""
    low = 60 + 5 * F.col("length_bin")
    points = both.join(correction_factors(both, least_count), ["length_bin", "gc_pct"])  # both: 188 x 101 rows at most
    return points.select(low.cast("int").alias("length_bin_min"), (low + 4).cast("int").alias("length_bin_max"), F.col("gc_pct").cast("int").alias("gc_pct"), "observed", "expected", "factor")


def lowess(x: np.ndarray, y: np.ndarray, fraction: float = FRACTION, rounds: int = ROUNDS) -> np.ndarray:
    """Robust locally weighted linear regression at each x (ascending): tricube weights, bisquare robustness."""
    n = len(x)
    k = min(n, max(2, int(fraction * n + 1e-10)))
    fit, robust = np.zeros(n), np.ones(n)
    for _ in range(rounds + 1):
        for i in range(n):
            away = np.abs(x - x[i])
            reach = np.partition(away, k - 1)[k - 1]
            w = robust * np.where(away <= 0.001 * reach, 1.0, np.where(away >= 0.999 * reach, 0.0, (1 - (away / max(reach, 1e-300)) ** 3) ** 3))
            if w.sum() <= 0:
                fit[i] = y[i]
                continue
            w = w / w.sum()
            mean = (w * x).sum()
            spread = (w * (x - mean) ** 2).sum()
            if np.sqrt(spread) > 0.001 * (x[-1] - x[0]):
                w = w * (1 + (x[i] - mean) * (x - mean) / spread)
            fit[i] = (w * y).sum()
        left = np.abs(y - fit)
        scale = 6 * np.median(left)
        if scale < 1e-12:
            break
        robust = np.where(left <= 0.001 * scale, 1.0, np.where(left >= 0.999 * scale, 0.0, (1 - (left / scale) ** 2) ** 2))
    return fit


def _factors(points: pd.DataFrame) -> pd.DataFrame:
    points = points.sort_values("gc_pct")
    ratio = (points.observed / points.expected).to_numpy(float)
    if len(ratio) < LEAST_POINTS:
        return pd.DataFrame({"length_bin": pd.Series(dtype="int32"), "gc_pct": pd.Series(dtype="int32"), "factor": pd.Series(dtype=float)})
    fit = lowess(points.gc_pct.to_numpy(float) / 100, ratio)
    return pd.DataFrame({"length_bin": points.length_bin, "gc_pct": points.gc_pct, "factor": np.where(fit > 1e-4, ratio.mean() / np.where(fit > 1e-4, fit, 1), 1.0)})


def correction_factors(both: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """(length_bin, gc_pct, factor) at the points with enough counts of both; a group has 101 points at most."""
    enough = both.where((F.col("observed") > least_count) & (F.col("expected") > least_count)).select("length_bin", "gc_pct", "observed", "expected")
    return enough.groupBy("length_bin").applyInPandas(_factors, "length_bin int, gc_pct int, factor double")


def corrected_counts(points: pd.DataFrame) -> pd.DataFrame:
    """Counts over a fit of count on gc, scaled to the fit's mean; left alone below 15 points."""
    points = points.sort_values("gc")
    count = points["count"].to_numpy(float)
    if len(count) < 15:
        return points.assign(corrected=count)
    fit = lowess(points.gc.to_numpy(float), count)
    return points.assign(corrected=np.where(fit > 1e-4, count * fit.mean() / np.where(fit > 1e-4, fit, 1), count))


def cohort_curve(points: DataFrame) -> DataFrame:
    """Per GC bin of 0.02 from 0.25: median and spread over samples of coverage relative to the sample's mean. points: sample_id, gc, coverage."""
    mean = F.avg("coverage").over(Window.partitionBy("sample_id"))
    relative = points.withColumn("rel", F.col("coverage") / mean).withColumn("gc_bin", F.floor((F.col("gc") - 0.25) / 0.02 + 1e-9).cast("int"))
    inside = relative.where(F.col("gc_bin").between(0, 24))
    return inside.groupBy("gc_bin").agg(F.percentile("rel", F.lit(0.5)).alias("median"), F.when(F.count("*") < 2, 0.1).otherwise(F.stddev_samp("rel")).alias("std"))


def interpolate(x: Column, xs: list[float], ys: list[float]) -> Column:
    """Piecewise linear interpolation over a short ascending grid, flat beyond its ends."""
    out = F.when(x <= xs[0], ys[0])
    for x0, x1, y0, y1 in zip(xs, xs[1:], ys, ys[1:], strict=False):
        out = out.when(x <= x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0)))
    return out.otherwise(ys[-1])
