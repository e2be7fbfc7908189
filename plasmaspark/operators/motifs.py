"""Fragment-end motifs and their diversity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plasmaspark.functions.expressions import reverse_complement


def end_motifs(reads: DataFrame, k: int = 4) -> DataFrame:
    """(kmer, n): the first k bases of plus reads, the reverse complement of the last k of minus reads; only A, C, G, T."""
    kmer = F.when(F.col("plus"), F.substring(F.upper("seq"), 1, k)).otherwise(reverse_complement(F.substring("seq", -k, k)))
    return reads.where(F.length("seq") >= k).select(kmer.alias("kmer")).where(F.col("kmer").rlike(f"^[ACGT]{{{k}}}$")).groupBy("kmer").agg(F.count("*").alias("n"))


def all_kmers(spark: SparkSession, k: int) -> DataFrame:
    letters = spark.range(4).select(F.substring(F.lit("ACGT"), F.col("id").cast("int") + 1, F.lit(1)).alias("kmer"))
    out = letters
    for i in range(k - 1):
        out = out.crossJoin(letters.withColumnRenamed("kmer", f"x{i}")).select(F.concat("kmer", f"x{i}").alias("kmer"))  # 4^k rows, k is small and fixed
    return out


def dense(counts: DataFrame, k: int = 4) -> DataFrame:
    """Every k-mer with its count (0 if unseen) and share of all."""
    filled = F.broadcast(all_kmers(counts.sparkSession, k)).join(counts, "kmer", "left").fillna(0, ["n"])
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return filled.withColumn("share", F.when(total > 0, F.col("n") / total).otherwise(0.0))


def diversity(share: Column, k: int = 4, epsilon: float = 1e-12) -> Column:
    """Entropy over its maximum, as an aggregate; epsilon stands in the logarithm (0: exact)."""
    term = F.when(share > 0, -share * F.log2(share + epsilon)).otherwise(0.0)
    return F.sum(term) / (2 * k)


def first_base(counts: DataFrame) -> DataFrame:
    """1-mer shares of motif counts, and how far C lies over a quarter."""
    one = counts.groupBy(F.substring("kmer", 1, 1).alias("base")).agg(F.sum("n").alias("n"))
    return one.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def exon_diversity(motifs: DataFrame) -> DataFrame:
    """MDS of each exon from rows (gene, exon, start, kmer); exact entropy over 8 bits."""
    counts = motifs.groupBy("gene", "exon", "start", "kmer").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("gene", "exon", "start"))
    return counts.withColumn("share", share).groupBy("gene", "exon", "start").agg(F.sum("n").alias("n_fragments"), diversity(F.col("share"), 4, 0.0).alias("mds"))


def gene_diversity(exons: DataFrame, regions: DataFrame) -> DataFrame:
    """Per gene with data: all its exons (rows of regions), fragments, and of the exons with data the mean and population deviation of the MDS, and that of the first."""
    found = exons.groupBy("gene").agg(F.sum("n_fragments").alias("n_fragments"), F.avg("mds").alias("mds_mean"), F.stddev_pop("mds").alias("mds_std"), F.min_by("mds", F.struct("start", "exon")).alias("mds_e1"))
    return regions.groupBy("gene").agg(F.count("*").alias("n_exons")).join(found, "gene")


def end_fractions(counts: DataFrame) -> DataFrame:
    """One row: the shares of motifs that begin with each base, their entropy, and how far C lies over a quarter; zeros without motifs."""
    sums = counts.agg(F.sum("n").alias("total"), *[F.sum(F.when(F.substring("kmer", 1, 1) == b, F.col("n")).otherwise(0)).alias(b) for b in "ACGT"])
    share = {b: F.when(F.col("total") > 0, F.col(b) / F.col("total")).otherwise(0.0) for b in "ACGT"}
    entropy = sum((-share[b] * F.log2(share[b] + 1e-12) for b in "ACGT"), F.lit(0.0))
    none = F.coalesce(F.col("total"), F.lit(0)) == 0
    return sums.select(*[share[b].alias(f"{b.lower()}_fraction") for b in "ACGT"], F.when(none, 0.0).otherwise(entropy).alias("entropy"), F.when(none, 0.0).otherwise(share["C"] - 0.25).alias("c_bias"))
