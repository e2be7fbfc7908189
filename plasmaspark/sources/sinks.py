"""Writers: tables in several formats, sorted fragments, unions of baselines, feature documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plasmaspark.functions.expressions import natural_order

_ENDINGS = (".tsv.gz", ".parquet", ".tsv", ".csv", ".gz")


def stem(path: str) -> str:
    for ending in _ENDINGS:
        if path.endswith(ending):
            return path[: -len(ending)]
    return path


def write_table(df: DataFrame, path: str, form: str = "tsv", compress: bool = False, decimals: int | None = None) -> list[str]:
    """df as a tsv folder, a Parquet folder or both; a known ending of path is replaced. Doubles are rounded for tsv if decimals are given."""
    written = []
    if form in ("tsv", "both"):
        shown = df if decimals is None else df.select([F.format_string(f"%.{decimals}f", c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
        written.append(f"{stem(path)}.tsv" + ".gz" * compress)
        shown.write.mode("overwrite").option("sep", "\t").option("header", True).option("compression", "gzip" if compress else "none").csv(written[-1])
    if form in ("parquet", "both"):
        written.append(f"{stem(path)}.parquet")
        df.write.mode("overwrite").parquet(written[-1])
    if not written:
        raise ValueError(f"no such format: {form}")
    return written


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The table at path's stem: Parquet first, then tsv, then compressed tsv."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for ending in (".parquet", ".tsv", ".tsv.gz"):
        at = hadoop(stem(path) + ending)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return spark.read.parquet(stem(path) + ending) if ending == ".parquet" else spark.read.option("sep", "\t").option("header", True).option("inferSchema", True).csv(stem(path) + ending)
    raise FileNotFoundError(path)


def write_fragments(fragments: DataFrame, path: str) -> None:
    """Fragments by chromosome, ordered by start within files, so that ranges are pruned by folder and row group."""
    fragments.repartitionByRange("chrom", "start").sortWithinPartitions("chrom", "start").write.mode("overwrite").partitionBy("chrom").parquet(path)


def write_baselines(path: str, **tables: DataFrame) -> None:
    """All baselines in one folder, partitioned by table; a reader of one kind opens its files alone."""
    from plasmaspark.operators.cohort import union_tables

    union_tables(**tables).write.mode("overwrite").partitionBy("table").parquet(path)


def read_baseline(spark: SparkSession, path: str, table: str) -> DataFrame:
    found = spark.read.parquet(path).where(F.col("table") == table).drop("table")
    filled = found.agg(*[F.count(c).alias(c) for c in found.columns]).first().asDict()
    return found.select([c for c in found.columns if filled[c]])


def metadata(fragments: DataFrame, sample, genome: str = "hg19", assay: str | None = None, targets: str | None = None, mapq: int = 20, shortest: int = 65, longest: int = 1000, corrected: bool = False) -> DataFrame:
    """One row per sample: its fragments and how they were made. sample: a column."""
    from plasmaspark.sources.assets import GENOMES

    facts = {"genome": GENOMES[genome.lower()], "assay": assay or "", "panel_mode": bool(targets), "target_regions": targets or ""}
    filters = {"filters_mapq": mapq, "filters_min_length": shortest, "filters_max_length": longest, "gc_correction_computed": corrected}
    rows = fragments.groupBy(sample.alias("sample_id")).agg(F.count("*").alias("total_fragments"), F.avg("length").alias("mean_length"))
    fixed = lambda d: [F.lit(v).alias(k) for k, v in d.items()]
    return rows.select("sample_id", "total_fragments", *fixed(facts), "mean_length", *fixed(filters), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"))


def in_natural_order(regions: DataFrame) -> DataFrame:
    return regions.orderBy(*natural_order(F.col("chrom")), "start", "end")


def feature_document(key: str, **features: DataFrame) -> DataFrame:
    """(key, document): one JSON document per sample with a list of rows for each feature; NaN becomes null."""
    out = None
    for name, df in features.items():
        rest = [F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c != key]
        rows = df.select(key, F.struct(*rest).alias("r")).groupBy(key).agg(F.sort_array(F.collect_list("r")).alias(name))
        out = rows if out is None else out.join(rows, key, "full_outer")
    return out.select(key, F.to_json(F.struct(*features)).alias("document"))
