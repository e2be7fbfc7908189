"""Fragment-size coverage of bins and genes, size ratios, and size histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plasmaspark.functions.expressions import CHANNELS, gene_channel, size_channel
from plasmaspark.operators.intervals import as_right, contains_point, overlap, tiles

SIX = (*[c for c, _ in CHANNELS], "ultra_long")
FIVE = ("ultra_short", "core_short", "mono_nucl", "di_nucl", "long")


def with_factors(fragments: DataFrame, factors: DataFrame, default: float = 1.0, name: str = "weight") -> DataFrame:
    """fragments with a weight: the factor of their (length_bin, gc_pct), else the default.

    One factor of each point of the 188 x 101 grid is broadcast, the greatest
    if several are given; points beyond the grid can't match a fragment.
    """
    from plasmaspark.functions.expressions import length_bin

    grid = factors.where(F.col("length_bin").between(0, 187) & F.col("gc_pct").between(0, 100)).groupBy("length_bin", "gc_pct").agg(F.max("factor").alias("factor"))
    keyed = fragments.withColumn("length_bin", length_bin(F.col("length")))
    return keyed.join(F.broadcast(grid), ["length_bin", "gc_pct"], "left").withColumn(name, F.coalesce("factor", F.lit(default))).drop("factor", "length_bin")


def flag_on_target(fragments: DataFrame, targets: DataFrame) -> DataFrame:
    """fragments with on_target: whether any target overlaps.

    A semi-join and its anti-join, which share the fragments' exchange; with
    few targets nothing is shuffled.
    """
    right = as_right(targets.select("chrom", "start", "end"))
    hit, miss = (overlap(fragments, right, how).withColumn("on_target", F.lit(how == "left_semi")) for how in ("left_semi", "left_anti"))
    return hit.unionByName(miss)


def weight_of(weight: Column | None) -> Column:
    """The weight, or 1 as a long, so that sums of it are counts."""
    return weight if weight is not None else F.lit(1).cast("bigint")


def _channel_sums(channel: Column, names: tuple[str, ...], weight: Column) -> list[Column]:
    return [F.sum(F.when(channel == n, weight).otherwise(F.lit(0))).alias(n) for n in names]


def fsc_tiles(fragments: DataFrame, size: int, weight: Column | None = None) -> DataFrame:
    """Size channels per regular tile of the fragments in 65 to 1000 bp; a fragment counts in every tile that it touches."""
    kept = fragments.where(F.col("length").between(65, 1000)).withColumn("w", weight_of(weight))
    return tiles(kept, size).groupBy("chrom", "tile").agg(*_channel_sums(size_channel(F.col("length")), SIX, F.col("w")), F.sum("w").alias("total"), F.sum(F.col("gc_pct") * F.col("w")).alias("gc_sum"))


def fsc_bins(fragments: DataFrame, bins: DataFrame, key: str, weight: Column | None = None, bucket: int = 1 << 16) -> DataFrame:
    """Size channels of every bin, those without fragments included (with zeros); mean_gc is 0 there. bucket should be about a bin's size."""
    kept = fragments.where(F.col("length").between(65, 1000)).withColumn("w", weight_of(weight))
    sums = overlap(kept, as_right(bins.select(key, "chrom", "start", "end")), bucket=bucket).groupBy(key).agg(*_channel_sums(size_channel(F.col("length")), SIX, F.col("w")), F.sum("w").alias("total"), F.sum(F.col("gc_pct") * F.col("w")).alias("gc_sum"))
    filled = bins.join(sums, key, "left").fillna(0, [*SIX, "total", "gc_sum"])
    return filled.withColumn("mean_gc", F.when(F.col("total") > 0, F.col("gc_sum") / F.col("total") / 100).otherwise(0.0)).drop("gc_sum")


def fsc_genes(fragments: DataFrame, genes: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
    """Five channels per gene (or region) by the fragment's midpoint, channel ratios, and depth per kilobase and million fragments (these unweighted)."""
    kept = fragments.where(F.col("length").between(65, 1000)).withColumn("w", weight_of(weight))
    hits = contains_point(kept, as_right(genes), F.expr("(start + end) div 2"))
    sums = hits.groupBy(*by).agg(*_channel_sums(gene_channel(F.col("length")), FIVE, F.col("w")), F.sum("w").alias("total"))
    sizes = genes.groupBy(*by).agg(F.sum(F.col("end") - F.col("start")).alias("bp"))
    n = kept.agg(F.count("*").alias("n"))  # one row
    joined = sizes.join(sums, by, "left").fillna(0, [*FIVE, "total"]).join(F.broadcast(n))
    ratios = [(F.col(c) / F.greatest(F.col("total"), F.lit(1e-9))).alias(f"{c}_ratio") for c in FIVE]
    return joined.select(*by, *FIVE, "total", *ratios, F.when((F.col("bp") > 0) & (F.col("n") > 0), F.col("total") * 1e9 / (F.col("bp") * F.col("n"))).otherwise(0.0).alias("depth"))


def first_exons(regions: DataFrame, order: list[str], by: str = "gene") -> DataFrame:
    """Each gene's region with the least start (ties by the other order columns)."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return regions.withColumn("rank", rank).where("rank = 1").drop("rank")


def roll_up(bins: DataFrame, index: str, sums: tuple[str, ...], n: int = 50) -> DataFrame:
    """Windows of n consecutive bins per chromosome in file order; an incomplete last window is dropped."""
    row = F.row_number().over(Window.partitionBy("chrom").orderBy(index))
    grouped = bins.withColumn("win", F.floor((row - 1) / n).cast("bigint")).groupBy("chrom", "win")
    rolled = grouped.agg(F.count("*").alias("bins"), F.min_by("start", index).alias("start"), F.max_by("end", index).alias("end"), *[F.sum(c).alias(c) for c in sums])
    return rolled.where(F.col("bins") == n).drop("bins")


def size_ratios(sums: DataFrame) -> DataFrame:
    """Short (ultra and core short) against long (di-nucleosomal and long) fragments: ratio (short alone if there are no long), log2, fractions."""
    short, long = F.col("ultra_short") + F.col("core_short"), F.col("di_nucl") + F.col("long")
    ratio = F.when(long > 0, short / long).otherwise(short.cast("double"))
    both = F.greatest(F.col("total"), F.lit(1))
    return sums.select("*", short.alias("short_n"), long.alias("long_n"), ratio.alias("ratio"), F.when(ratio > 0, F.log2(ratio)).otherwise(0.0).alias("log_ratio"), (short / both).alias("short_share"), (long / both).alias("long_share"))


def fsd_long(fragments: DataFrame, arms: DataFrame, key: str, by: tuple[str, ...] = (), weight: Column | None = None, bucket: int = 1 << 20) -> DataFrame:
    """(arm, by, size_bin, n): weights of 5-bp length bins from 65 to 400 bp, 67 of them, counts without a weight; by: columns of fragments, such as on_target."""
    kept = fragments.where((F.col("length") >= 65) & (F.col("length") < 400)).withColumn("w", weight_of(weight))
    # arms are long: filed by large buckets they are a few thousand rows, and no chromosome is a key of its own
    hits = overlap(kept.select("chrom", "start", "end", "length", "w", *by), as_right(arms.select(key, "chrom", "start", "end")), bucket=bucket)
    return hits.groupBy(key, *by, F.floor((F.col("length") - 65) / 5).cast("int").alias("size_bin")).agg(F.sum("w").alias("n"))


def fsd_wide(histogram: DataFrame, key: str | list[str]) -> DataFrame:
    """One row per arm (or several keys), a column per bin (lo-hi) and their total."""
    names = [f"{65 + 5 * i}-{69 + 5 * i}" for i in range(67)]
    labelled = histogram.withColumn("name", F.concat_ws("-", 65 + 5 * F.col("size_bin"), 69 + 5 * F.col("size_bin")))
    wide = labelled.groupBy(*([key] if isinstance(key, str) else key)).pivot("name", names).agg(F.sum("n")).fillna(0)
    return wide.withColumn("total", sum((F.col(f"`{n}`") for n in names), F.lit(0)))


def log_ratio(x: Column, expected: Column) -> Column:
    """log2((x + 1) / (expected + 1)); 0 without an expectation."""
    return F.when(expected > 0, F.log2((x + 1) / (expected + 1))).otherwise(0.0)
