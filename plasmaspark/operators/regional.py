"""Labelled regions: orientation-aware fragmentation and entropy of fragment sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plasmaspark.operators.coverage import weight_of
from plasmaspark.operators.intervals import as_right, overlap


def ocf_positions(fragments: DataFrame, regions: DataFrame, weight: Column | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, label, side, pos, n): weights (counts without one) of fragment starts (left) and ends (right, one further) in the 2000 positions of their regions; totals count those further out."""
    hits = overlap(fragments.withColumn("w", weight_of(weight)), as_right(regions).withColumn("rs", F.col("r_start")).withColumn("re", F.col("r_end")))
    ends = F.array(
        F.struct(F.lit("left").alias("side"), F.when(F.col("start") >= F.col("rs"), F.col("start") - F.col("rs")).alias("pos")),
        F.struct(F.lit("right").alias("side"), F.when(F.col("end") <= F.col("re"), F.col("end") - F.col("rs") + 1).alias("pos")),
    )
    each = hits.select(*by, "label", "w", F.explode(ends).alias("e")).select(*by, "label", "w", "e.side", "e.pos").where("pos IS NOT NULL")
    return each.groupBy(*by, "label", "side", F.least("pos", F.lit(2000)).cast("bigint").alias("pos")).agg(F.sum("w").alias("n"))


def ocf_score(positions: DataFrame) -> DataFrame:
    """Per label: right minus left around -60, plus left minus right around +60, each side per 10,000 of its total."""
    totals = positions.withColumn("total", F.sum("n").over(Window.partitionBy("label", "side")))  # 2001 positions a label and side at most
    per = F.when(F.col("total") > 0, F.col("total") / 10000).otherwise(1.0)
    at = F.col("pos") - 1000
    sign = F.when(at.between(-70, -50), F.when(F.col("side") == "right", 1).otherwise(-1)).when(at.between(50, 70), F.when(F.col("side") == "left", 1).otherwise(-1)).otherwise(0)
    value = F.when(F.col("pos") < 2000, sign * F.col("n") / per).otherwise(0.0)
    return totals.groupBy("label").agg(F.sum(value).alias("ocf"))


def size_histogram(fragments: DataFrame, regions: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
    """(by, size, n): weights (counts without one) of the fragments that overlap each label; sizes over 1000 count as 1000."""
    hits = overlap(fragments.withColumn("w", weight_of(weight)), as_right(regions))
    return hits.groupBy(*by, F.least("length", F.lit(1000)).cast("bigint").alias("size")).agg(F.sum("w").alias("n"))


def routed(fragments: DataFrame, regions: DataFrame, weight: Column | None = None, weight_on: Column | None = None) -> DataFrame:
    """(label, part, size, n): size histograms of all fragments, and of those on and off target (on_target of fragments). On-target ones weigh weight_on in their own part."""
    both = fragments.withColumn("w", weight_of(weight)).withColumn("w_on", weight_of(weight_on if weight_on is not None else weight))
    hits = overlap(both, as_right(regions)).select("label", "on_target", F.least("length", F.lit(1000)).cast("bigint").alias("size"), "w", "w_on")
    sums = hits.groupBy("label", "on_target", "size").agg(F.sum("w").alias("w"), F.sum("w_on").alias("w_on"))
    part = lambda name, n: F.struct(F.lit(name).alias("part"), n.alias("n"))
    parts = F.array(part("all", F.col("w")), F.when(F.col("on_target"), part("on", F.col("w_on"))).otherwise(part("off", F.col("w"))))
    return sums.select("label", "size", F.explode(parts).alias("p")).groupBy("label", "p.part", "size").agg(F.sum("p.n").alias("n"))


def entropy(histogram: DataFrame, by: list[str]) -> DataFrame:
    """Count, mean size and Shannon entropy (bits) of each label's sizes."""
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*by))
    with_share = histogram.withColumn("share", share)
    return with_share.groupBy(*by).agg(F.sum("n").alias("count"), (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean_size"), F.sum(-F.col("share") * F.log2("share")).alias("entropy"))


def proportions(histogram: DataFrame, by: list[str]) -> DataFrame:
    return histogram.withColumn("proportion", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))
