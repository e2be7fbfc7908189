"""Fragment sizes by allele, and methylation states of marker regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plasmaspark.functions.expressions import log_likelihood_ratio

CLASSES = ("REF", "ALT", "NonREF", "N")


def best_evidence(calls: DataFrame, by: list[str], quality: str, order: str) -> DataFrame:
    """One call per (variant, read name): the highest base quality, the first on ties."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(quality).desc(), order))
    return calls.withColumn("rank", rank).where("rank = 1").drop("rank")


def allele_class(base: Column, ref: Column, alt: Column) -> Column:
    return F.when(base == "N", "N").when(base == ref, "REF").when(base == alt, "ALT").otherwise("NonREF")


def class_sizes(evidence: DataFrame) -> DataFrame:
    """(variant_id, class, size, n)."""
    return evidence.groupBy("variant_id", "class", F.col("length").alias("size")).agg(F.count("*").alias("n"))


def summary(evidence: DataFrame) -> DataFrame:
    """Per variant: counts and mean sizes of the four classes, summed log-likelihood ratios, and the derived rates."""
    n = {c: F.count_if(F.col("class") == c) for c in CLASSES}
    mean = {c: F.avg(F.when(F.col("class") == c, F.col("length"))) for c in CLASSES}
    llr = {c: F.sum(F.when(F.col("class") == c, log_likelihood_ratio(F.col("length")))) for c in ("REF", "ALT")}
    out = evidence.groupBy("variant_id").agg(*[n[c].alias(f"n_{c.lower()}") for c in CLASSES], *[mean[c].alias(f"mean_{c.lower()}") for c in CLASSES], *[F.coalesce(v, F.lit(0.0)).alias(f"llr_{c.lower()}") for c, v in llr.items()])
    total = F.col("n_ref") + F.col("n_alt") + F.col("n_nonref") + F.col("n_n")
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = out.withColumn("vaf", rate(F.col("n_alt"), F.col("n_alt") + F.col("n_ref"))).withColumn("error_rate", rate(F.col("n_nonref"), total)).withColumn("n_rate", rate(F.col("n_n"), total))
    out = out.withColumn("size_ratio", F.when(F.col("mean_ref") > 0, F.col("mean_alt") / F.col("mean_ref"))).withColumn("quality", 1 - F.col("n_rate") - F.col("error_rate"))
    return out.withColumn("confidence", F.when(F.col("n_alt") >= 5, "HIGH").when(F.col("n_alt") >= 1, "LOW").otherwise("NONE"))


#: The classes whose sizes are compared, in the order of the output.
PAIRS = (("ALT", "REF"), ("ALT", "NonREF"), ("REF", "NonREF"), ("ALT", "N"), ("REF", "N"), ("NonREF", "N"))


def ks(sizes: DataFrame, a: str, b: str) -> DataFrame:
    """Kolmogorov-Smirnov distance and p-value of two classes' sizes per variant; null and 1 with fewer than two of either."""
    one = F.when(F.col("class") == a, F.col("n")).otherwise(0)
    two = F.when(F.col("class") == b, F.col("n")).otherwise(0)
    tested = _ks(sizes.where(F.col("class").isin(a, b)).select("variant_id", "size", one.alias("a"), two.alias("b")), ["variant_id"])
    return sizes.select("variant_id").distinct().join(tested, "variant_id", "left").fillna(1.0, ["p_value"])


def ks_pairs(sizes: DataFrame) -> DataFrame:
    """(variant_id, and ks_ and p_ of each of PAIRS), all pairs in one shuffle; null and 1 with fewer than two of either class."""
    each = F.explode(F.array(*[F.struct(F.lit(f"{a}_{b}".lower()).alias("pair"), F.lit(a).alias("one"), F.lit(b).alias("two")) for a, b in PAIRS]))
    named = sizes.select("*", each.alias("p")).where((F.col("class") == F.col("p.one")) | (F.col("class") == F.col("p.two")))
    sides = [F.when(F.col("class") == F.col(f"p.{c}"), F.col("n")).otherwise(0).alias(n) for c, n in (("one", "a"), ("two", "b"))]
    tested = _ks(named.select("variant_id", "p.pair", "size", *sides), ["variant_id", "pair"])
    wide = tested.groupBy("variant_id").agg(*[F.max(F.when(F.col("pair") == f"{a}_{b}".lower(), F.col(c))).alias(f"{n}_{a}_{b}".lower()) for a, b in PAIRS for c, n in (("ks", "ks"), ("p_value", "p"))])
    return sizes.select("variant_id").distinct().join(wide, "variant_id", "left").fillna(1.0, [f"p_{a}_{b}".lower() for a, b in PAIRS])


def _ks(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by, ks, p_value) from rows (by, size, a, b) of both classes' counts, where each has two or more.

    Steps are taken pairwise where sizes tie, so that the largest distance is
    looked for both before and after the pairs of a tied size.
    """
    per = counts.groupBy(*by, "size").agg(F.sum("a").alias("ca"), F.sum("b").alias("cb"))
    whole = Window.partitionBy(*by)
    upto = whole.orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    run = per.select(*by, "ca", "cb", F.sum("ca").over(upto).alias("sa"), F.sum("cb").over(upto).alias("sb"), F.sum("ca").over(whole).alias("na"), F.sum("cb").over(whole).alias("nb"))
    m = F.least("ca", "cb")
    before = F.abs((F.col("sa") - F.col("ca") + m) / F.col("na") - (F.col("sb") - F.col("cb") + m) / F.col("nb"))
    after = F.abs(F.col("sa") / F.col("na") - F.col("sb") / F.col("nb"))
    d = run.where("na >= 2 AND nb >= 2").groupBy(*by, "na", "nb").agg(F.max(F.greatest(before, after)).alias("ks"))
    root = F.sqrt(F.col("na") * F.col("nb") / (F.col("na") + F.col("nb")))
    lam = (root + 0.12 + 0.11 / root) * F.col("ks")
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * lam * lam))
    return d.select(*by, "ks", F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)).alias("p_value"))


def with_deltas(table: DataFrame) -> DataFrame:
    """A summary with the difference of mean sizes for each of PAIRS; null where a class has none."""
    return table.select("*", *[(F.col(f"mean_{a.lower()}") - F.col(f"mean_{b.lower()}")).alias(f"delta_{a}_{b}".lower()) for a, b in PAIRS])


def methylation(reads: DataFrame, by: list[str], least_sites: int = 1, high: float = 0.5, low: float = 0.5) -> DataFrame:
    """Shares of reads unmethylated (U), mixed (X) and methylated (M) by their XM strings; reads with too few sites don't count."""
    z = lambda c: F.length("xm") - F.length(F.replace("xm", F.lit(c), F.lit("")))
    sites = reads.withColumn("m", z("Z")).withColumn("u", z("z")).where(F.col("m") + F.col("u") >= least_sites)
    ratio = F.col("m") / (F.col("m") + F.col("u"))
    state = F.when(ratio >= high, "M").when(ratio <= low, "U").otherwise("X")
    n = F.count("*")
    return sites.withColumn("state", state).groupBy(*by).agg(*[(F.count_if(F.col("state") == s) / n).alias(s.lower()) for s in "UXM"], n.alias("n"))
