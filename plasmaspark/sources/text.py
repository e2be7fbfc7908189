"""Parsers of line formats: DataFrames with a string column `value` in, typed rows out.

Rows that don't parse are left out rather than given zeros. Read files with
``spark.read.text`` (plain, gzip and blocked gzip alike).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plasmaspark.functions.expressions import gene_probe, main_chromosome, strip_chr, valid_allele


def lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a file with their order (index), gzip or plain; a file's order survives since a gzip file is one split."""
    return spark.read.text(path).withColumn("index", F.monotonically_increasing_id())


def _fields(df: DataFrame, least: int, kept: tuple[str, ...] = ("index",)) -> DataFrame:
    fields = F.split("value", "\t")
    rows = df.where(~F.col("value").rlike(r"^\s*(#|$|track|browser)"))
    return rows.select(fields.alias("f"), *[c for c in kept if c in df.columns]).where(F.size("f") >= least)


def _f(i: int) -> Column:
    return F.get("f", F.lit(i))


def _long(i: int) -> Column:
    return F.trim(_f(i)).try_cast("bigint")


def _interval(df: DataFrame) -> DataFrame:
    return df.select(strip_chr(_f(0)).alias("chrom"), _long(1).alias("start"), _long(2).alias("end"), "*").where("start IS NOT NULL AND `end` IS NOT NULL")


def fragments(df: DataFrame) -> DataFrame:
    """chrom, start, end, length, gc: four columns at least; a bad gc counts as 0."""
    out = _interval(_fields(df, 4))
    return out.select("chrom", "start", "end", F.greatest(F.col("end") - F.col("start"), F.lit(0)).alias("length"), F.coalesce(F.trim(_f(3)).try_cast("double"), F.lit(0.0)).alias("gc"))


def regions(df: DataFrame) -> DataFrame:
    """index, chrom, start, end of BED3 lines."""
    return _interval(_fields(df, 3)).select("index", "chrom", "start", "end")


def gene_regions(df: DataFrame) -> DataFrame:
    """chrom, start, end, gene, name (the gene where there is none)."""
    return _interval(_fields(df, 4)).select("index", "chrom", "start", "end", _f(3).alias("gene"), F.coalesce(F.nullif(_f(4), F.lit("")), _f(3)).alias("name"))


def exon_regions(df: DataFrame) -> DataFrame:
    """Exons by number of columns: eight (chrom, start, end, gene, exon, strand ...) name themselves gene:exonN, five or others are panel rows."""
    eight = F.size("f") >= 8
    name = F.when(eight, F.concat(_f(3), F.lit(":exon"), _f(4))).otherwise(F.coalesce(_f(4), _f(3)))
    strand = F.when(eight, _f(5)).otherwise(F.lit("."))
    return _interval(_fields(df, 4)).select("index", "chrom", "start", "end", _f(3).alias("gene"), name.alias("name"), strand.alias("strand"))


# How panel target names carry genes.
PANEL_FORMS = {"v1": r"^exon_([A-Za-z0-9.-]+)_", "v2": r"^([A-Za-z0-9.-]+)_target_[0-9]+$"}


def panel_version(df: DataFrame, sample: int = 100) -> str:
    """The form that most of the first lines' names have; parsed if none has."""
    names = df.orderBy("index").limit(sample).select(F.get(F.split("value", "\t"), F.lit(3)).alias("name"))
    votes = names.agg(*[F.count_if(F.col("name").rlike(p)).alias(v) for v, p in PANEL_FORMS.items()]).first().asDict()
    best = max(votes, key=lambda v: votes[v] or 0)
    return best if votes[best] else "parsed"


def panel_targets(df: DataFrame, version: str) -> DataFrame:
    """Targets with their genes; fingerprint and instability probes are left out."""
    rows = _interval(_fields(df, 4)).withColumn("name", _f(3)).where(gene_probe(F.col("name")))
    gene = F.nullif(F.regexp_extract("name", PANEL_FORMS[version], 1), F.lit("")) if version in PANEL_FORMS else F.col("name")
    return rows.select("index", "chrom", "start", "end", gene.alias("gene"), "name").where("gene IS NOT NULL")


def anchors(df: DataFrame, around: int = 1000) -> DataFrame:
    """Windows around the centres of BED6 anchors on the main chromosomes."""
    rows = _interval(_fields(df, 3)).where(main_chromosome(F.col("chrom"))).withColumn("center", F.expr("(start + end) div 2"))
    return rows.select("index", "chrom", F.greatest(F.col("center") - around, F.lit(0)).alias("start"), (F.col("center") + around).alias("end"), "center", F.coalesce(_f(3), F.lit(".")).alias("region_id"), F.coalesce(_f(5), F.lit("+")).alias("strand"))


def transcripts(df: DataFrame, around: int = 1000) -> DataFrame:
    """The older five columns (id, chrom, start, end, strand); starts below 1 are left out."""
    rows = _fields(df, 5).select("index", _f(0).alias("region_id"), strip_chr(_f(1)).alias("chrom"), _long(2).alias("s"), _long(3).alias("e"), _f(4).alias("strand")).where("s >= 1 AND e IS NOT NULL")
    return rows.where(main_chromosome(F.col("chrom"))).withColumn("center", F.expr("(s + e) div 2")).select("index", "chrom", F.greatest(F.col("center") - around, F.lit(0)).alias("start"), (F.col("center") + around).alias("end"), "center", "region_id", "strand")


def elements(df: DataFrame) -> DataFrame:
    """Repeat elements of BED7: chrom, start, end, name, score, strand, family."""
    return _interval(_fields(df, 7)).select("index", "chrom", "start", "end", (_f(5) != "-").alias("plus"), _f(6).alias("family"))


def labelled(df: DataFrame) -> DataFrame:
    return _interval(_fields(df, 4)).select("index", "chrom", "start", "end", _f(3).alias("label"))


def vcf(df: DataFrame, each: bool = False) -> DataFrame:
    """Variant rows from VCF lines; pos is 0-based. ALT is taken as it stands, lists and symbols included; with each, every plain allele of it is a row."""
    alt = F.upper(_f(4))
    rows = _fields(df, 5).select("index", strip_chr(_f(0)).alias("chrom"), (_long(1) - 1).alias("pos"), F.upper(_f(3)).alias("ref"), F.explode(F.split(alt, ",")).alias("alt") if each else alt.alias("alt")).where("pos >= 0")
    return rows.where(valid_allele(F.col("ref")) & valid_allele(F.col("alt"))) if each else rows


def maf(df: DataFrame) -> DataFrame:
    """Variant rows from a MAF table that was read with its header; columns go by name, `-` alleles become empty."""
    allele = lambda c: F.when(F.col(c) == "-", "").otherwise(F.upper(c))
    rows = df.where(valid_allele(F.col("Reference_Allele")) & valid_allele(F.col("Tumor_Seq_Allele2")))
    return rows.select(strip_chr(F.col("Chromosome").cast("string")).alias("chrom"), (F.col("Start_Position").try_cast("bigint") - 1).alias("pos"), allele("Reference_Allele").alias("ref"), allele("Tumor_Seq_Allele2").alias("alt")).where("pos >= 0")


def maf_of_sample(df: DataFrame, sample: str, column: str = "Tumor_Sample_Barcode") -> DataFrame:
    """The rows whose barcode holds sample in any case; all rows where there is no such column."""
    return df.where(F.instr(F.lower(column), sample.lower()) > 0) if column in df.columns else df


def factors(df: DataFrame) -> DataFrame:
    """GC factors of six columns, tab or comma separated, with a header."""
    f = F.split("value", "[\t,]")
    rows = df.select(f.alias("f")).where(F.size("f") >= 6)
    out = rows.select(_long(0).cast("int").alias("length_bin_min"), _long(1).cast("int").alias("length_bin_max"), _long(2).cast("int").alias("gc_pct"), F.trim(_f(5)).try_cast("double").alias("factor"))
    return out.where("length_bin_min IS NOT NULL AND factor IS NOT NULL")


def checks(schema: str) -> tuple[int, Column]:
    """(least columns, validity of a line) of a schema, by name."""
    coordinates = (_long(1) >= 0) & (_long(2) > _long(1))
    return {
        "bed3": (3, coordinates),
        "gene": (4, coordinates & (F.length(_f(3)) > 0)),
        "arms": (4, coordinates & _f(3).rlike("^(chr)?([0-9]{1,2}|X|Y)[pq]$")),
        "anchors": (6, coordinates & _f(5).isin("+", "-", ".")),
        "region": (4, coordinates & (F.length(_f(3)) > 0)),
        "factors": (6, _long(2).between(0, 100) & (F.trim(_f(5)).try_cast("double") > 0)),
        "targets": (3, coordinates),
    }[schema]


def invalid_lines(df: DataFrame, schema: str, first: int | None = 10) -> DataFrame:
    """The lines that break a schema, of the first `first` lines by order (None: of all)."""
    least, valid = checks(schema)
    rows = df if first is None else df.orderBy("index").limit(first)
    fields = rows.where(~F.col("value").rlike(r"^\s*(#|$)")).withColumn("f", F.split("value", "\t"))
    return fields.where(~F.coalesce((F.size("f") >= least) & valid, F.lit(False))).drop("f")


def pass_rate(reads: DataFrame, kept: Column, sample: int = 10_000) -> DataFrame:
    """One row: how many of the first reads there are and what share the filter keeps."""
    return reads.limit(sample).agg(F.count("*").alias("reads"), F.avg(kept.cast("int")).alias("rate"))
