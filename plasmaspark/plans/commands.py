"""The user-facing commands: files in, feature tables out.

Each command is a lazy plan over DataFrames of the readers in
``plasmaspark.sources``; ``run_all`` extracts the fragments once and derives all
features from the one written table. ``python -m plasmaspark COMMAND --help``.
"""

from __future__ import annotations

import argparse
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plasmaspark.functions import expressions as X
from plasmaspark.operators import cohort, coverage, gc, motifs, protection, reference, regional, variants
from plasmaspark.operators.intervals import as_right, overlap
from plasmaspark.sources import bam, sinks, text


def lines(spark: SparkSession, path: str) -> DataFrame:
    return text.lines(spark, path)


def fragments_of(spark: SparkSession, path: str) -> DataFrame:
    """Fragments from a written table or from BED lines, with an id, gc_pct and a unit weight."""
    table = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else text.fragments(lines(spark, path))
    if "gc_pct" not in table.columns:
        table = table.withColumn("gc_pct", F.round(F.col("gc") * 100).cast("int"))
    return table.withColumn("chrom", X.strip_chr(F.col("chrom")))


def extract(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Fragments of the proper first mates: true interval (whichever strand the mate is on), GC over the reference, blacklisted ones left out."""
    reads = bam.read_bam(spark, a.input)
    kept = reads.where(X.read_filter(F.col("flag"), F.col("mapq"), F.abs("tlen"), a.mapq, a.minlen, a.maxlen, not a.keep_duplicates) & (F.col("flag").bitwiseAND(F.lit(X.MATE1)) != 0))
    minus = F.col("flag").bitwiseAND(F.lit(0x10)) != 0
    covered = F.aggregate(F.filter("cigar", lambda c: c["op"].isin("M", "D", "N", "=", "X")), F.lit(0).cast("bigint"), lambda s, c: s + c["len"])
    start = F.when(minus, F.col("pos") + covered - F.abs("tlen")).otherwise(F.col("pos"))
    out = kept.select(F.monotonically_increasing_id().alias("frag_id"), X.strip_chr(F.col("chrom")).alias("chrom"), start.alias("start"), (start + F.abs("tlen")).alias("end"), F.abs("tlen").alias("length"), (~minus).alias("plus"), "seq")
    if a.blacklist:
        out = overlap(out, as_right(text.regions(lines(spark, a.blacklist)).drop("index")), "left_anti", longest=max(a.maxlen, 1000))
    if a.reference:
        fetched = bam.fetch(out.select("frag_id", "chrom", "start", "end"), bam.read_fasta(spark, a.reference), ["frag_id"])
        share = fetched.select("frag_id", F.round(X.gc_fraction(F.col("seq")) * 100).cast("int").alias("gc_pct"))
        out = out.join(share, "frag_id", "left")
    else:
        out = out.withColumn("gc_pct", F.round(X.gc_fraction(F.col("seq")) * 100).cast("int"))
    return out.fillna(0, ["gc_pct"])


def gc_factors(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """GC factors of the fragments (with targets: of those off target) against a GC reference, in the form that --factors takes."""
    f = fragments_of(spark, a.input)
    if a.targets:
        f = coverage.flag_on_target(f, text.regions(lines(spark, a.targets))).where("NOT on_target")
    stored = gc.reference_counts(spark.read.parquet(a.gc_reference))
    return gc.factor_rows(gc.observed_expected(gc.observations(f), stored), a.least_count)


def factors_of(spark: SparkSession, a: argparse.Namespace) -> DataFrame | None:
    """The factors that are given, else those written beside the input, else those that the GC reference gives, else none."""
    if a.no_gc:
        return None
    if a.factors:
        return spark.read.parquet(a.factors) if a.factors.rstrip("/").endswith(".parquet") else text.factors(lines(spark, a.factors))
    try:
        return sinks.read_table(spark, sinks.stem(a.input.rstrip("/")) + ".factors")
    except FileNotFoundError:
        return gc_factors(spark, a) if a.gc_reference else None


def weighted(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The command's fragments with their GC weights (1 without factors)."""
    f, found = fragments_of(spark, a.input), factors_of(spark, a)
    if found is None:
        return f.withColumn("weight", F.lit(1.0))
    return coverage.with_factors(f, found.select(((F.col("length_bin_min") - 60) / 5).cast("int").alias("length_bin"), F.col("gc_pct").cast("int"), "factor"))


def targeted(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """weighted(), with on_target where targets are given."""
    f = weighted(spark, a)
    return coverage.flag_on_target(f, text.regions(lines(spark, a.targets))) if a.targets else f


def motif(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    """End motifs, with their diversity and the shares of first bases; with a reference also the motifs over breakpoints. With targets each is made of
    the fragments off target, and once more (.ontarget) of the others."""
    reads = spark.read.parquet(a.input)
    parts = {"": reads}
    if a.targets:
        flagged = coverage.flag_on_target(reads, text.regions(lines(spark, a.targets)))
        parts = {"": flagged.where("NOT on_target"), ".ontarget": flagged.where("on_target")}
    made = {}
    for part, rows in parts.items():
        counts = motifs.end_motifs(rows, a.k)
        made[f"motif{part}"] = motifs.dense(counts, a.k)
        made[f"motif.mds{part}"] = made[f"motif{part}"].agg(F.sum("n").alias("fragments"), motifs.diversity(F.col("share"), a.k).alias("mds"))
        made[f"motif.first{part}"] = motifs.end_fractions(counts)
        if a.reference:
            made[f"motif.breakpoint{part}"] = motifs.dense(_breakpoints(rows, bam.read_fasta(spark, a.reference), a.k), a.k)
    return made


def _breakpoints(reads: DataFrame, tiles: DataFrame, k: int) -> DataFrame:
    """Motifs over the fragments' 5' ends: half of the reference before them, half of the read."""
    half = (k + 1) // 2
    low = F.when(F.col("plus"), F.col("start") - half).otherwise(F.col("end"))
    outside = reads.select("frag_id", "chrom", low.alias("start"), (low + half).alias("end")).where("start >= 0")
    bases = bam.fetch(outside, tiles, ["frag_id"]).where(F.length("seq") == half).select("frag_id", F.col("seq").alias("before"))
    return reference.breakpoint_motifs(reads.select("frag_id", "plus", F.col("seq").alias("after")).join(bases, "frag_id").where(F.length("after") >= half), k)


def metadata(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The sample's row: how many fragments, from which filters, when."""
    return sinks.metadata(fragments_of(spark, a.input), F.lit(a.sample), a.genome, a.assay, a.targets, a.mapq, a.minlen, a.maxlen, factors_of(spark, a) is not None)


def document(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """One JSON document of the tables that run-all has written to the input folder, a list of rows for each."""
    found = {}
    for name in SECTIONS:
        try:
            found[name.replace("-", "_").replace(".", "_")] = sinks.read_table(spark, f"{a.input.rstrip('/')}/{name}").withColumn("sample", F.lit(a.sample))
        except FileNotFoundError:
            continue
    return sinks.feature_document("sample", **found)


def _split(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    """The weighted fragments by the endings of what is made of them: with targets those off target have none."""
    if not a.targets:
        return {"": weighted(spark, a)}
    f = targeted(spark, a)
    return {"": f.where("NOT on_target"), ".ontarget": f.where("on_target")}


def _fsc(spark: SparkSession, a: argparse.Namespace, f: DataFrame) -> DataFrame:
    bins = coverage.fsc_bins(f, text.regions(lines(spark, a.regions)), "index", F.col("weight"))
    if not a.pon:
        return bins
    mean = bins.agg(F.avg(F.when(F.col("total") > 0, F.col("total"))).alias("bins_mean"))  # one row
    base = sinks.read_baseline(spark, a.pon, "fsc_baseline").select("index", F.col("mean").alias("expected"), "std")
    share = bins.join(F.broadcast(mean)).withColumn("share", F.col("total") / F.col("bins_mean")).join(base, "index", "left")
    return share.withColumn("log_ratio", F.log2(F.col("share") / F.col("expected") + 1e-9)).withColumn("reliability", 1 / (F.col("std") * F.col("std") + 0.01)).drop("bins_mean", "std")


def fsc(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    """Size channels of bins; against a cohort also the total relative to the bins' mean, and its log2 ratio to the cohort's."""
    return {f"fsc{part}": _fsc(spark, a, f) for part, f in _split(spark, a).items()}


def fsr(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    made = {}
    for part, f in _split(spark, a).items():
        bins = _fsc(spark, a, f)
        if a.windows > 1:
            bins = coverage.roll_up(bins, "index", (*coverage.SIX, "total"), a.windows)
        made[f"fsr{part}"] = coverage.size_ratios(bins)
    return made


def fsd(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    arms = text.labelled(lines(spark, a.regions)).withColumn("arm", F.concat(F.col("chrom"), F.lit(":"), F.col("start"), F.lit("-"), F.col("end"))).select("arm", "chrom", "start", "end")
    by = ("on_target",) if a.targets else ()
    return coverage.fsd_wide(coverage.fsd_long(targeted(spark, a), arms, "arm", by, F.col("weight")), ["arm", *by])


def genes(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return coverage.fsc_genes(weighted(spark, a), text.gene_regions(lines(spark, a.regions)).drop("index"), ["gene"], F.col("weight"))


def wps(spark: SparkSession, a: argparse.Namespace) -> DataFrame | dict[str, DataFrame]:
    """Per anchor: 200 bins of protection and protected fraction; minus anchors run the other way; the score is smoothed after that. With targets bins
    outside them aren't reliable. --positions adds the table of both kinds at every position."""
    found = text.anchors(lines(spark, a.regions)).select(F.col("index").alias("region_idx"), "region_id", "chrom", "start", "end", (F.col("strand") != "-").alias("plus"))
    f = weighted(spark, a)
    baits = text.regions(lines(spark, a.targets)) if a.targets else None
    bins = protection.binned(protection.ranges(f, found.drop("region_id"), a.kind, F.col("weight")))
    made = protection.oriented(bins, found, 200, baits)
    closed = found.withColumn("end", F.col("end") + 1)
    return {"wps": made, "wps.positions": protection.position_table(f, closed, F.col("weight"), baits)} if a.positions else made


def ocf(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    """Orientation scores of all fragments; with targets also of those on and those off target."""
    found = text.labelled(lines(spark, a.regions)).drop("index")
    parts = {"": weighted(spark, a)}
    if a.targets:
        flagged = targeted(spark, a)
        parts.update({".ontarget": flagged.where("on_target"), ".offtarget": flagged.where("NOT on_target")})
    return {f"ocf{part}": _scored(regional.ocf_score(regional.ocf_positions(f, found, F.col("weight"))), spark, a, "ocf_baseline", ["label"], "ocf") for part, f in parts.items()}


def region_entropy(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Entropy of each label's sizes; with targets for all, on- and off-target fragments."""
    found, f = text.labelled(lines(spark, a.regions)).drop("index"), targeted(spark, a)
    if not a.targets:
        return _scored(regional.entropy(regional.size_histogram(f, found, ["label"], F.col("weight")), ["label"]), spark, a, "region_entropy", ["label"], "entropy")
    return regional.entropy(regional.routed(f, found, F.col("weight")), ["label", "part"])


def region_mds(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    exons = text.exon_regions(lines(spark, a.regions)).select("gene", F.col("name").alias("exon"), F.col("start").alias("exon_start"), "chrom", "start", "end")
    hits = overlap(spark.read.parquet(a.input).withColumn("end", F.col("end") + 1), as_right(exons), longest=1001)
    kmer = F.when(F.col("plus"), F.substring("seq", 1, 4)).otherwise(X.reverse_complement(F.expr("right(seq, 4)")))
    ends = hits.where("length(seq) >= 4").select("gene", "exon", F.col("exon_start").alias("start"), kmer.alias("kmer")).where(F.col("kmer").rlike("^[ACGT]{4}$"))
    return motifs.gene_diversity(motifs.exon_diversity(ends), exons)


def mfsd(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    if a.regions.endswith((".vcf", ".vcf.gz")):
        sites = text.vcf(lines(spark, a.regions)).drop("index")
    else:
        sites = text.maf(spark.read.option("sep", "\t").option("header", True).option("comment", "#").csv(a.regions))
    sites = sites.withColumn("variant_id", F.concat_ws(":", "chrom", F.col("pos") + 1, "ref", "alt"))
    reads = bam.read_bam(spark, a.input).where(X.read_filter(F.col("flag"), F.col("mapq"), F.abs("tlen"), a.mapq, a.minlen, a.maxlen, check_qc=False, proper=False))
    covered = F.aggregate(F.filter("cigar", lambda c: c["op"].isin("M", "D", "N", "=", "X")), F.lit(0).cast("bigint"), lambda s, c: s + c["len"])
    placed = reads.select("qname", X.strip_chr(F.col("chrom")).alias("chrom"), F.col("pos").alias("start"), (F.col("pos") + covered).alias("end"), "pos", "cigar", "seq", "qual", "cd", F.abs("tlen").alias("length"))
    points = sites.select("variant_id", "chrom", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), F.col("pos").alias("v_pos"), "ref", "alt")
    pairs = overlap(placed, as_right(points), longest=a.longest)
    calls = reference.classify_calls(pairs).where(F.col("bq") >= a.baseq)
    best = variants.best_evidence(calls, ["variant_id", "qname"], "bq", "pos")
    summary, sizes = variants.summary(best), variants.class_sizes(best)
    depth = best.groupBy("variant_id").agg(*[F.round(F.sum(F.when(F.col("class") == c, X.duplex_weight(F.col("cd"), F.col("qname")))), 4).alias(f"weight_{c.lower()}") for c in variants.CLASSES])
    return sites.select("variant_id").distinct().join(variants.with_deltas(summary), "variant_id", "left").join(variants.ks_pairs(sizes), "variant_id", "left").join(depth, "variant_id", "left")


def uxm(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    marks = text.regions(lines(spark, a.regions)).select(F.col("index").alias("marker"), "chrom", "start", "end")
    reads = bam.read_bam(spark, a.input).where(X.read_filter(F.col("flag"), F.col("mapq"), F.length("seq"), a.mapq, 1, a.longest, check_qc=False, proper=False) & F.col("xm").isNotNull())
    placed = reads.select(X.strip_chr(F.col("chrom")).alias("chrom"), F.col("pos").alias("start"), (F.col("pos") + F.length("seq")).alias("end"), "xm")
    found = variants.methylation(overlap(placed, as_right(marks), longest=a.longest), ["marker"])
    return marks.select("marker", "chrom", "start", "end").join(found, "marker", "left").fillna(0)


def _scored(values: DataFrame, spark: SparkSession, a: argparse.Namespace, kind: str, by: list[str], value: str) -> DataFrame:
    """values with z against the cohort's baseline of a kind, where one is given."""
    return cohort.normalised(values, sinks.read_baseline(spark, a.pon, kind), by, value, 1e-9) if a.pon else values


def build_pon(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Baselines over a list of fragment tables, of each kind whose regions are given: the samples are one more grouping key of the same plans."""
    paths = [r.value.strip() for r in spark.read.text(a.input).collect() if r.value.strip()]  # one line per sample
    every = None
    for path in paths:
        one = fragments_of(spark, path).withColumn("sample_id", F.lit(path)).select("sample_id", "chrom", "start", "end", "length", "gc_pct")
        every = one if every is None else every.unionByName(one)
    kinds = {"gc_bias": gc.cohort_curve(every.groupBy("sample_id", (F.col("gc_pct") / 100).alias("gc")).agg(F.count("*").cast("double").alias("coverage")))}
    if arms_file := a.arms or a.regions:
        arms = text.labelled(lines(spark, arms_file)).select(F.col("label").alias("arm"), "chrom", "start", "end")
        sizes = coverage.fsd_long(every, arms, "arm", ("sample_id",))
        share = sizes.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("sample_id", "arm")))
        kinds["fsd_baseline"] = cohort.baseline(share, ["arm", "size_bin"], "share")
    if a.labels:
        found = text.labelled(lines(spark, a.labels)).drop("index")
        by = ["label", "sample_id"]
        spread = regional.entropy(regional.size_histogram(every, found, by), by)
        kinds["region_entropy"] = cohort.baseline(spread, ["label"], "entropy", single=0.0)
        positions = regional.ocf_positions(every.withColumnRenamed("sample_id", "s"), found, by=("s",)).withColumn("label", F.struct("s", "label"))
        scores = regional.ocf_score(positions).select(F.col("label.s").alias("sample_id"), F.col("label.label").alias("label"), "ocf")
        kinds["ocf_baseline"] = cohort.baseline(scores, ["label"], "ocf", single=0.001)
    if a.bins:
        bins = text.regions(lines(spark, a.bins))
        hits = overlap(every.where(F.col("length").between(65, 1000)), as_right(bins.select("index", "chrom", "start", "end")), bucket=1 << 16)
        counts = hits.groupBy("index", "sample_id").agg(F.count("*").cast("double").alias("total"))
        share = counts.withColumn("share", F.col("total") / F.avg("total").over(Window.partitionBy("sample_id")))
        kinds["fsc_baseline"] = cohort.baseline(share, ["index"], "share", population=True, single=0.001, floor=0.001)
    if a.anchors:
        found = text.anchors(lines(spark, a.anchors)).select("index", "chrom", "start", "end", (F.col("strand") != "-").alias("plus"))
        # an anchor of a sample is a region of its own
        parts = protection.ranges(every, found.withColumnRenamed("index", "region_idx"), a.kind, keep=("sample_id",)).withColumn("region_idx", F.struct("sample_id", "region_idx"))
        values = protection.binned(parts).select("region_idx.sample_id", F.col("region_idx.region_idx").alias("index"), "bin", "wps")
        kinds["wps_baseline"] = cohort.baseline(values, ["index", "bin"], "wps", floor=0.01)
    return cohort.union_tables(**kinds)


def build_gc_reference(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Theoretical GC counts of all 188 length bins, over whole tiles that no blacklisted interval touches; fragments may end in the next tile."""
    size = 100_000
    tiles = bam.read_fasta(spark, a.input, size, 1000).withColumn("start", F.col("tile") * size).withColumn("end", (F.col("tile") + 1) * size)
    if a.blacklist:
        tiles = overlap(tiles, as_right(text.regions(lines(spark, a.blacklist)).drop("index")), "left_anti", longest=size, bucket=size)
    return reference.theoretical_gc(tiles.select("seq"), [62 + 5 * i for i in range(188)], owned=size)


def validate(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return text.invalid_lines(lines(spark, a.input), a.schema, a.first or None)


COMMANDS: dict[str, Callable[[SparkSession, argparse.Namespace], DataFrame | dict[str, DataFrame]]] = {
    "extract": extract, "motif": motif, "fsc": fsc, "fsc-genes": genes, "fsr": fsr, "fsd": fsd, "wps": wps, "ocf": ocf, "region-entropy": region_entropy,
    "region-mds": region_mds, "mfsd": mfsd, "uxm": uxm, "build-pon": build_pon, "build-gc-reference": build_gc_reference, "validate": validate,
    "gc-factors": gc_factors, "metadata": metadata, "document": document,
}

#: The tables of a document.
SECTIONS = ("fsc", "fsc.ontarget", "fsr", "fsr.ontarget", "fsd", "fsc-genes", "wps", "ocf", "ocf.ontarget", "ocf.offtarget", "region-entropy", "region-mds", "mfsd", "uxm", "fragments.factors", "metadata", *(f"motif{t}{p}" for t in ("", ".mds", ".first", ".breakpoint") for p in ("", ".ontarget")))


def write(made: DataFrame | dict[str, DataFrame], out: str, name: str, form: str) -> dict[str, list[str]]:
    """Write what a command gives: a table, or several by their names."""
    return {n: sinks.write_table(df, f"{out.rstrip('/')}/{n}", form) for n, df in (made if isinstance(made, dict) else {name: made}).items()}


def run_all(spark: SparkSession, a: argparse.Namespace) -> dict[str, list[str]]:
    """Extract once, then the GC factors, every feature whose regions are given, the metadata and the document."""
    out, reads = a.output.rstrip("/"), a.input
    wanted = {"fsc": a.bins, "fsr": a.bins, "fsd": a.arms, "wps": a.anchors, "ocf": a.labels, "region-entropy": a.labels, "fsc-genes": a.genes, "region-mds": a.genes}
    made = {"extract": sinks.write_table(extract(spark, a), f"{out}/fragments", "parquet")}
    a = argparse.Namespace(**{**vars(a), "input": made["extract"][0]})
    if a.gc_reference and not a.factors and not a.no_gc:
        made["gc-factors"] = sinks.write_table(gc_factors(spark, a), f"{out}/fragments.factors", "parquet")
    for name, regions in {"motif": "-", **wanted}.items():
        if regions:
            a.regions = regions
            made.update(write(COMMANDS[name](spark, a), out, name, a.format))
    for name, regions in {"mfsd": a.variants, "uxm": a.markers}.items():
        if regions:
            a.regions = regions
            made.update(write(COMMANDS[name](spark, argparse.Namespace(**{**vars(a), "input": reads})), out, name, a.format))
    made.update(write(metadata(spark, a), out, "metadata", a.format))
    if a.json:
        a.input = out
        document(spark, a).select("document").write.mode("overwrite").text(f"{out}/features.json")
        made["document"] = [f"{out}/features.json"]
    return made


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="plasmaspark", description=__doc__.split("\n")[0])
    p.add_argument("command", choices=[*COMMANDS, "run-all"])
    p.add_argument("-i", "--input", required=True)
    p.add_argument("-o", "--output", required=True)
    p.add_argument("-r", "--regions", help="the command's region, variant or arm file")
    for name in ("bins", "arms", "anchors", "labels", "genes", "blacklist", "reference", "factors", "targets", "pon", "gc-reference", "variants", "markers", "assay"):
        p.add_argument(f"--{name}")
    p.add_argument("--format", choices=("tsv", "parquet", "both"), default="tsv")
    p.add_argument("--kind", choices=tuple(protection.KINDS), default="nuc")
    p.add_argument("--schema", default="bed3")
    for name, default in (("mapq", 20), ("minlen", 65), ("maxlen", 1000), ("baseq", 20), ("longest", 1000), ("k", 4), ("windows", 50), ("first", 10), ("least-count", gc.LEAST_COUNT)):
        p.add_argument(f"--{name}", type=int, default=default)
    p.add_argument("--genome", default="hg19")
    p.add_argument("--sample", default="sample")
    for name, what in (("keep-duplicates", "count them too"), ("no-gc", "no GC weights, whatever factors there are"), ("positions", "wps: a table of every position too"), ("json", "run-all: one document of all tables")):
        p.add_argument(f"--{name}", action="store_true", help=what)
    return p


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> dict[str, list[str]]:
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName(f"plasmaspark {a.command}").getOrCreate()
    if a.command == "run-all":
        return run_all(spark, a)
    return write(COMMANDS[a.command](spark, a), a.output, a.command, a.format)
