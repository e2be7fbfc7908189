"""Queries: GC bias, motifs, protection scores, variant-level sizes, methylation, cohort baselines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from plasmaspark.functions import expressions as X
from plasmaspark.operators import cohort as H
from plasmaspark.operators import coverage as C
from plasmaspark.operators import gc as G
from plasmaspark.operators import motifs as M
from plasmaspark.operators import protection as P
from plasmaspark.operators import variants as V
from plasmaspark.plans.coverage_queries import FSD_SQL, HIST_SQL, HIT, OCF_SQL, arms, frags, genes, targets
from plasmaspark.plans.register import query
from plasmaspark.operators.regional import entropy, ocf_positions, ocf_score, size_histogram
from plasmaspark.sources.adapters import adapted, cte, table, with_sql

LBIN = "CAST(greatest(0, least(187, (length - 60) // 5)) AS INT)"
ALPHABET, BASES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ("ACGT" * 7)[:26]
SEQ_SQL = f"reads AS (SELECT doc_id, doc_id % 2 = 0 AS plus, lang, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{ALPHABET}', '{BASES}') AS seq FROM documents)"
MOTIF_SQL = f"WITH {SEQ_SQL} SELECT kmer, count(*) AS n FROM (SELECT CASE WHEN plus THEN seq[1:4] ELSE reverse(translate(right(seq, 4), 'ACGT', 'TGCA')) END AS kmer FROM reads WHERE length(seq) >= 4) GROUP BY kmer"


def reads(spark, d):
    seq = F.translate(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), ALPHABET, BASES)
    return table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 2 == 0).alias("plus"), "lang", seq.alias("seq"))


def ends_of_reads(spark, d):
    """reads whose seq is the first four letters and the last four of those with four or more: all that end motifs look at, from anchored patterns."""
    four = lambda text: F.regexp_replace(F.regexp_extract(text, "^(?:[^A-Za-z]*+[A-Za-z]){4}", 0), "[^A-Za-z]", "")
    seq = F.translate(F.upper(F.concat(four("text"), F.reverse(four(F.reverse("text"))))), ALPHABET, BASES)
    return table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 2 == 0).alias("plus"), "lang", seq.alias("seq"))


# ---- GC ----


@query(with_sql("fragments", body=f"SELECT {LBIN} AS length_bin, CAST(gc_pct AS INT) AS gc_pct, count(*) AS n FROM fragments WHERE length >= 60 AND length < 1000 GROUP BY ALL"))
def a12_gc_observations(spark, d):
    return G.observations(frags(spark, d))


@query(with_sql("fragments", "genes", body=f"SELECT {LBIN} AS length_bin, CAST(gc_pct AS INT) AS gc_pct, count(*) AS n FROM fragments f WHERE length >= 60 AND length < 1000 AND EXISTS (SELECT 1 FROM genes r WHERE {HIT}) GROUP BY ALL"))
def a13_gc_observations_valid(spark, d):
    from plasmaspark.operators.intervals import as_right, overlap

    return G.observations(overlap(frags(spark, d), as_right(genes(spark, d)), "left_semi"))


def factor_table(spark):
    return spark.range(188).crossJoin(spark.range(101).withColumnRenamed("id", "g")).select(F.col("id").cast("int").alias("length_bin"), F.col("g").alias("gc_pct"), (1 + ((F.col("id") * 7 + F.col("g")) % 11) / 10.0).alias("factor")).where("(length_bin + gc_pct) % 13 != 0")


WEIGHTED = with_sql("fragments", body=f"SELECT *, CASE WHEN ({LBIN} + gc_pct) % 13 = 0 THEN 1.0 ELSE 1 + (({LBIN} * 7 + gc_pct) % 11) / 10.0 END AS w FROM fragments")


@query(f"SELECT chrom, round(CAST(sum(w) AS DOUBLE), 4) AS weighted, count(*) AS n FROM ({WEIGHTED}) GROUP BY chrom")
def j14_factor_lookup(spark, d):
    weighted = C.with_factors(frags(spark, d).withColumn("gc_pct", F.col("gc_pct").cast("bigint")), factor_table(spark))
    return weighted.groupBy("chrom").agg(F.round(F.sum("weight"), 4).alias("weighted"), F.count("*").alias("n"))


@query(f"SELECT chrom, t AS tile, round(CAST(sum(w) AS DOUBLE), 4) AS total FROM (SELECT *, unnest(generate_series(\"start\" // 100000, (\"end\" - 1) // 100000)) AS t FROM ({WEIGHTED}) WHERE length BETWEEN 65 AND 1000) GROUP BY ALL")
def a1_fsc_weighted(spark, d):
    weighted = C.with_factors(frags(spark, d).withColumn("gc_pct", F.col("gc_pct").cast("bigint")), factor_table(spark))
    return C.fsc_tiles(weighted, 100000, F.col("weight")).select("chrom", "tile", F.round("total", 4).alias("total"))


GC_BOTH = with_sql("fragments", body=f"SELECT length_bin, gc_pct, count(*) FILTER (sample_id < 4) AS observed, count(*) FILTER (sample_id >= 4) AS expected FROM (SELECT sample_id, {LBIN} AS length_bin, CAST(gc_pct AS INT) AS gc_pct FROM fragments WHERE length >= 60 AND length < 1000) GROUP BY ALL")


def gc_both(spark, d):
    f = frags(spark, d)
    return G.observed_expected(G.observations(f.where("sample_id < 4")), G.observations(f.where("sample_id >= 4")))


@query(GC_BOTH)
def j15_observed_expected(spark, d):
    return gc_both(spark, d)


@query()
def n1_gc_factors(spark, d):
    return G.correction_factors(gc_both(spark, d), least_count=5)


@query()
def n2_loess_counts(spark, d):
    counts = C.fsc_tiles(frags(spark, d), 100000).select("chrom", "tile", (F.col("gc_sum") / F.col("total") / 100).alias("gc"), F.col("total").cast("double").alias("count"))
    return counts.groupBy("chrom").applyInPandas(G.corrected_counts, "chrom string, tile long, gc double, count double, corrected double")


@query("SELECT gc_bin, round(median(rel), 4) AS median, round(CASE WHEN count(*) < 2 THEN 0.1 ELSE stddev_samp(rel) END, 4) AS std FROM (SELECT CAST(floor((gc - 0.25) / 0.02 + 1e-9) AS INT) AS gc_bin, coverage / avg(coverage) OVER (PARTITION BY sample_id) AS rel FROM (SELECT sample_id, gc_pct / 100.0 AS gc, CAST(count(*) AS DOUBLE) AS coverage FROM (" + with_sql("fragments", body="SELECT * FROM fragments") + ") GROUP BY ALL)) WHERE gc_bin BETWEEN 0 AND 24 GROUP BY gc_bin")
def a25_gc_curve(spark, d):
    points = frags(spark, d).groupBy("sample_id", (F.col("gc_pct") / 100).alias("gc")).agg(F.count("*").cast("double").alias("coverage"))
    out = G.cohort_curve(points)
    return out.select("gc_bin", F.round("median", 4).alias("median"), F.round("std", 4).alias("std"))


@query("SELECT p_partkey AS id, round(CASE WHEN x <= 0.3 THEN 0.8 WHEN x <= 0.4 THEN 0.8 + (x - 0.3) * 2 WHEN x <= 0.5 THEN 1.0 - (x - 0.4) * 2 ELSE 0.8 END, 4) AS expected, round(10 / CASE WHEN x <= 0.3 THEN 0.8 WHEN x <= 0.4 THEN 0.8 + (x - 0.3) * 2 WHEN x <= 0.5 THEN 1.0 - (x - 0.4) * 2 ELSE 0.8 END, 4) AS corrected FROM (SELECT p_partkey, CAST(p_partkey % 80 AS DOUBLE) / 100 AS x FROM part)")
def n21_interpolation(spark, d):
    x = (F.col("p_partkey") % 80).cast("double") / 100
    y = G.interpolate(x, [0.3, 0.4, 0.5], [0.8, 1.0, 0.8])
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(y, 4).alias("expected"), F.round(10 / y, 4).alias("corrected"))


# ---- motifs ----


@query(MOTIF_SQL)
def a10_end_motifs(spark, d):
    return M.end_motifs(ends_of_reads(spark, d))


KMERS = "(SELECT a || b || c || e AS kmer FROM (VALUES ('A'),('C'),('G'),('T')) t1(a), (VALUES ('A'),('C'),('G'),('T')) t2(b), (VALUES ('A'),('C'),('G'),('T')) t3(c), (VALUES ('A'),('C'),('G'),('T')) t4(e))"
DENSE_SQL = f"SELECT k.kmer, coalesce(m.n, 0) AS n, coalesce(m.n, 0) / sum(coalesce(m.n, 0)) OVER () AS share FROM {KMERS} k LEFT JOIN ({MOTIF_SQL}) m USING (kmer)"


@query(f"SELECT kmer, n, round(share, 6) AS share FROM ({DENSE_SQL})")
def a14_dense_kmers(spark, d):
    return M.dense(M.end_motifs(ends_of_reads(spark, d))).withColumn("share", F.round("share", 6))


@query(f"SELECT round(sum(CASE WHEN share > 0 THEN -share * log2(share + 1e-12) ELSE 0 END) / 8, 4) AS mds, round(sum(CASE WHEN share > 0 THEN -share * log2(share) ELSE 0 END) / 8, 4) AS mds_exact FROM ({DENSE_SQL})")
def a15_motif_diversity(spark, d):
    return M.dense(M.end_motifs(ends_of_reads(spark, d))).agg(F.round(M.diversity(F.col("share")), 4).alias("mds"), F.round(M.diversity(F.col("share"), 4, 0.0), 4).alias("mds_exact"))


@query(f"SELECT kmer[1:1] AS base, CAST(sum(n) AS BIGINT) AS n, round(sum(n) / sum(sum(n)) OVER (), 4) AS share FROM ({MOTIF_SQL}) GROUP BY ALL")
def a17_first_base(spark, d):
    return M.first_base(M.end_motifs(ends_of_reads(spark, d))).withColumn("share", F.round("share", 4))


EXON_SQL = f"""WITH {SEQ_SQL}, {cte('genes')}, motifs AS (SELECT gene, gene_idx AS exon, "start", seq[1:4] AS kmer FROM reads r JOIN genes g ON g.gene_idx = r.doc_id % 100 WHERE length(seq) >= 4),
 exons AS (SELECT gene, exon, "start", CAST(sum(n) AS BIGINT) AS n_fragments, -sum(n / t * log2(n / t)) / 8 AS mds FROM (SELECT *, sum(n) OVER (PARTITION BY gene, exon, "start") AS t FROM (SELECT gene, exon, "start", kmer, count(*) AS n FROM motifs GROUP BY ALL)) GROUP BY ALL)"""


def exons(spark, d):
    g = genes(spark, d).select("gene", F.col("gene_idx").alias("exon"), "start")
    r = ends_of_reads(spark, d).where(F.length("seq") >= 4).select((F.col("doc_id") % 100).alias("exon"), F.substring("seq", 1, 4).alias("kmer"))
    return M.exon_diversity(r.join(g, "exon"))


@query(f"{EXON_SQL} SELECT gene, exon, n_fragments, round(mds, 4) AS mds FROM exons")
def a18_exon_diversity(spark, d):
    return exons(spark, d).select("gene", "exon", "n_fragments", F.round("mds", 4).alias("mds"))


@query(f"{EXON_SQL} SELECT gene, any_value(a.n_exons) AS n_exons, CAST(sum(n_fragments) AS BIGINT) AS n_fragments, round(avg(mds), 4) AS mds_mean, round(stddev_pop(mds), 4) AS mds_std, round(arg_min(mds, (\"start\", exon)), 4) AS mds_e1 FROM exons JOIN (SELECT gene, count(*) AS n_exons FROM genes GROUP BY gene) a USING (gene) GROUP BY gene")
def a19_gene_diversity(spark, d):
    return M.gene_diversity(exons(spark, d), genes(spark, d)).select("gene", "n_exons", "n_fragments", *[F.round(c, 4).alias(c) for c in ("mds_mean", "mds_std", "mds_e1")])


MOTIF_BY_LANG = f"WITH {SEQ_SQL}, m AS (SELECT lang, seq[1:4] AS kmer, count(*) AS n FROM reads WHERE length(seq) >= 4 GROUP BY ALL) SELECT lang, kmer, n / sum(n) OVER (PARTITION BY lang) AS share FROM m"


@query(f"SELECT lang, kmer, round(z, 4) AS z FROM (SELECT lang, kmer, CASE WHEN std > 0 THEN (share - mean) / std ELSE 0 END AS z FROM (SELECT *, avg(share) OVER (PARTITION BY kmer) AS mean, CASE WHEN count(*) OVER (PARTITION BY kmer) < 2 THEN 0.001 ELSE stddev_pop(share) OVER (PARTITION BY kmer) END AS std FROM ({MOTIF_BY_LANG}))) WHERE abs(z) > 1.2")
def f16_aberrant_kmers(spark, d):
    m = ends_of_reads(spark, d).where(F.length("seq") >= 4).groupBy("lang", F.substring("seq", 1, 4).alias("kmer")).agg(F.count("*").alias("n"))
    share = m.select("lang", "kmer", (F.col("n") / F.sum("n").over(Window.partitionBy("lang"))).alias("share"))
    base = H.baseline(share, ["kmer"], "share", population=True, single=0.001)
    return H.normalised(share, base, ["kmer"], "share").where("abs(z) > 1.2").select("lang", "kmer", F.round("z", 4).alias("z"))


@query(f"WITH {SEQ_SQL} SELECT doc_id, round(CASE WHEN length(regexp_replace(seq, '[^ACGT]', '', 'g')) = 0 THEN 0 ELSE length(regexp_replace(seq, '[^GC]', '', 'g')) / length(seq) END, 4) AS gc, CASE WHEN length(seq) >= 4 THEN reverse(translate(seq[1:4], 'ACGT', 'TGCA')) END AS rc, CASE WHEN length(seq) >= 2 THEN (instr('ACGT', seq[1:1]) - 1) * 4 + instr('ACGT', seq[2:2]) - 1 END AS idx FROM reads")
def fn_sequence(spark, d):
    r = reads(spark, d)
    long = F.length("seq") >= 4
    return r.select("doc_id", F.round(X.gc_fraction(F.col("seq")), 4).alias("gc"), F.when(long, X.reverse_complement(F.substring("seq", 1, 4))).alias("rc"), X.kmer_index(F.substring("seq", 1, 2), 2).cast("bigint").alias("idx"))


# ---- protection scores ----



def _ranges(p: int, weight: str, low: int, high: int) -> str:
    return with_sql("fragments", "regions", body=f"""SELECT region_idx, plus, size, w, what, greatest(0, low) AS low, least(size, high) AS high FROM (SELECT region_idx, plus, size, w, unnest([{{'what': 'cov', 'low': s, 'high': e}}, {{'what': 'span', 'low': s + {p}, 'high': e - {p - 1}}}, {{'what': 'end', 'low': s - {p}, 'high': s + {p}}}, {{'what': 'end', 'low': e - {p - 1}, 'high': e + {p + 1}}}], recursive := true)
 FROM (SELECT r.region_idx, r.plus, r."end" - r."start" AS size, f."start" + 1 - r."start" AS s, f."end" - r."start" AS e, {weight} AS w FROM fragments f JOIN regions r ON f.chrom = r.chrom AND f."start" < r."end" + 60 AND f."end" > r."start" - 60 WHERE f.length BETWEEN {low} AND {high})) WHERE greatest(0, low) < least(size, high)""")


RANGES, RANGES_TF = _ranges(60, "CASE WHEN f.length BETWEEN 160 AND 175 THEN 1.0 ELSE 0.5 END", 120, 180), _ranges(8, "1.0", 35, 80)
WPS_SQL = f"""SELECT region_idx, bin, sum(CASE WHEN what = 'cov' THEN c ELSE 0 END) AS cov, sum(CASE WHEN what = 'span' THEN c ELSE 0 END) AS span, sum(CASE WHEN what = 'end' THEN c ELSE 0 END) AS ends FROM (SELECT region_idx, what, bin, CAST(w * (least(high, (bin + 1) * 10) - greatest(low, bin * 10)) AS DOUBLE) / 10 AS c FROM (SELECT *, unnest(generate_series(low // 10, (high - 1) // 10)) AS bin FROM ({RANGES}))) GROUP BY ALL"""


def wps(spark, d):
    return P.ranges(frags(spark, d), adapted(spark, d, "regions"))


@query(f"SELECT region_idx, bin, round(cov, 4) AS cov, round(span - ends, 4) AS wps, round(CASE WHEN span + ends > 0 THEN span / (span + ends) ELSE 0 END, 4) AS prot_frac FROM ({WPS_SQL})")
def n3_wps_bins(spark, d):
    return P.binned(wps(spark, d)).select("region_idx", "bin", F.round("cov", 4).alias("cov"), F.round("wps", 4).alias("wps"), F.round("prot_frac", 4).alias("prot_frac"))


@query(with_sql("fragments", body="SELECT round(CAST(sum(CASE WHEN length BETWEEN 160 AND 175 THEN 1.0 WHEN length BETWEEN 120 AND 180 THEN 0.5 ELSE 0 END) AS DOUBLE), 4) AS nuc, CAST(count(*) FILTER (length BETWEEN 35 AND 80) AS DOUBLE) AS tf FROM fragments"))
def n4_length_weights(spark, d):
    return frags(spark, d).agg(F.round(F.sum(P.length_weight(F.col("length"), "nuc")), 4).alias("nuc"), F.sum(P.length_weight(F.col("length"), "tf")).alias("tf"))


@query(f"SELECT region_idx, pos, round(CAST(sum(d) OVER (PARTITION BY region_idx ORDER BY pos) AS DOUBLE), 4) AS value FROM (SELECT region_idx, pos, sum(d) AS d FROM (SELECT region_idx, low AS pos, w AS d FROM ({RANGES}) WHERE what = 'span' UNION ALL SELECT region_idx, high, -w FROM ({RANGES}) WHERE what = 'span') GROUP BY ALL)")
def owin4_running_positions(spark, d):
    return P.positions(wps(spark, d)).select("region_idx", "pos", F.round("value", 4).alias("value"))


@query("SELECT bin_id, v, round(coalesce((-2 * a3 + 3 * a2 + 6 * a1 + 7 * v + 6 * b1 + 3 * b2 - 2 * b3) / 21, v), 4) AS smooth FROM (SELECT bin_id, v, lag(v, 3) OVER w AS a3, lag(v, 2) OVER w AS a2, lag(v, 1) OVER w AS a1, lead(v, 1) OVER w AS b1, lead(v, 2) OVER w AS b2, lead(v, 3) OVER w AS b3 FROM (SELECT k, bin_id, CAST(count(*) AS DOUBLE) AS v FROM (" + with_sql("fragments", body='SELECT chrom AS k, chrom || \':\' || CAST("start" // 50000 AS VARCHAR) AS bin_id, "start" // 50000 AS b FROM fragments') + ") GROUP BY ALL) WINDOW w AS (PARTITION BY k ORDER BY CAST(split_part(bin_id, ':', 2) AS BIGINT)))")
def owin5_smoothing(spark, d):
    v = frags(spark, d).groupBy(F.col("chrom").alias("k"), F.expr("start div 50000").alias("b")).agg(F.count("*").cast("double").alias("v"))
    return P.smoothed(v, 7, "k", "b", "v").select(F.concat_ws(":", "k", "b").alias("bin_id"), "v", F.round("smooth", 4).alias("smooth"))


ALU = "elements AS (SELECT *, split_part(label, ' ', 1) AS family FROM regions)"


@query(with_sql("fragments", "regions", body=f""", {ALU} SELECT grp, pos, round(CAST(sum(nuc) AS DOUBLE), 4) AS nuc, round(CAST(sum(tf) AS DOUBLE), 4) AS tf FROM (SELECT nuc, tf, CASE WHEN plus THEN p ELSE 299 - p END AS pos, unnest(['Global_All', 'Family_' || family, 'Chr' || chrom || '_All']) AS grp FROM (SELECT r.family, r.chrom, r.plus, CASE WHEN f.length BETWEEN 160 AND 175 THEN 1.0 WHEN f.length BETWEEN 120 AND 180 THEN 0.5 ELSE 0.0 END AS nuc, CASE WHEN f.length BETWEEN 35 AND 80 THEN 1.0 ELSE 0.0 END AS tf, unnest(generate_series(greatest(0, f."start" + 61 - r."start"), least(299, f."end" - 60 - r."start"))) AS p FROM fragments f JOIN elements r ON f.chrom = r.chrom AND f."start" < r."end" + 1 AND f."end" > r."start" WHERE f.length BETWEEN 120 AND 180 OR f.length BETWEEN 35 AND 80)) GROUP BY ALL""").replace(" , elements", ", elements"))
def a21_stacking(spark, d):
    elements = adapted(spark, d, "regions").withColumn("family", F.split_part("label", F.lit(" "), F.lit(1)))
    return P.stacking(frags(spark, d), elements).withColumn("nuc", F.round("nuc", 4)).withColumn("tf", F.round("tf", 4))


@query()
def n8_periodicity(spark, d):
    elements = adapted(spark, d, "regions").withColumn("family", F.split_part("label", F.lit(" "), F.lit(1)))
    profile = P.stacking(frags(spark, d), elements).groupBy("grp", F.expr("pos div 10").alias("bin")).agg(F.avg("nuc").alias("nuc"))

    def score(rows: pd.DataFrame) -> pd.DataFrame:  # 30 bins of one group
        values = np.zeros(30)
        values[rows.bin.to_numpy()] = rows.nuc.to_numpy()
        return pd.DataFrame([{"grp": rows.grp.iloc[0], **P.periodicity(values)}])

    return profile.groupBy("grp").applyInPandas(score, "grp string, nrl double, snr double, score double, deviation double, adjusted double")


@query(with_sql("variants", "genes", body='SELECT variant_id, coalesce(bool_or(v.pos - r."start" >= least(50, (r."end" - r."start") // 4) AND r."end" - v.pos >= least(50, (r."end" - r."start") // 4)), false) AS reliable FROM variants v LEFT JOIN genes r ON v.chrom = r.chrom AND v.pos >= r."start" AND v.pos < r."end" GROUP BY variant_id'))
def n7_bait_mask(spark, d):
    points = adapted(spark, d, "variants").select("variant_id", "chrom", "pos")
    return P.reliable(points, genes(spark, d).select("chrom", "start", "end")).select("variant_id", "reliable")


# ---- variants and methylation ----

EVIDENCE = with_sql("fragments", body="SELECT frag_id % 400 AS variant_id, frag_id, length, gc_pct, CASE evidence WHEN 'A' THEN 'ALT' WHEN 'N' THEN 'REF' ELSE CASE WHEN frag_id % 3 = 0 THEN 'N' ELSE 'NonREF' END END AS class FROM fragments")


def evidence(spark, d):
    kind = F.when(F.col("evidence") == "A", "ALT").when(F.col("evidence") == "N", "REF").when(F.col("frag_id") % 3 == 0, "N").otherwise("NonREF")
    return frags(spark, d).select((F.col("frag_id") % 400).alias("variant_id"), "frag_id", "length", "gc_pct", kind.alias("class"))


_LLR = "(ln(greatest(exp(-0.5 * ((length - 145) / 35.0) ** 2) / (35e0 * 2.5066282746310002e0), 1e-15)) - ln(greatest(exp(-0.5 * ((length - 167) / 30.0) ** 2) / (30e0 * 2.5066282746310002e0), 1e-15)))"


@query(f"""SELECT variant_id, n_ref, n_alt, n_nonref, n_n, round(mean_ref, 4) AS mean_ref, round(mean_alt, 4) AS mean_alt, round(llr_alt, 2) AS llr_alt, round(CASE WHEN n_alt + n_ref > 0 THEN n_alt / (n_alt + n_ref) ELSE 0 END, 4) AS vaf, round(n_nonref / t, 4) AS error_rate, round(n_n / t, 4) AS n_rate, round(CASE WHEN mean_ref > 0 THEN mean_alt / mean_ref END, 4) AS size_ratio, CASE WHEN n_alt >= 5 THEN 'HIGH' WHEN n_alt >= 1 THEN 'LOW' ELSE 'NONE' END AS confidence
 FROM (SELECT variant_id, count(*) AS t, count(*) FILTER (class = 'REF') AS n_ref, count(*) FILTER (class = 'ALT') AS n_alt, count(*) FILTER (class = 'NonREF') AS n_nonref, count(*) FILTER (class = 'N') AS n_n, avg(length) FILTER (class = 'REF') AS mean_ref, avg(length) FILTER (class = 'ALT') AS mean_alt, coalesce(sum({_LLR}) FILTER (class = 'ALT'), 0) AS llr_alt FROM ({EVIDENCE}) GROUP BY variant_id)""")
def a22_mfsd(spark, d):
    out = V.summary(evidence(spark, d))
    return out.select("variant_id", "n_ref", "n_alt", "n_nonref", "n_n", *[F.round(c, 4).alias(c) for c in ("mean_ref", "mean_alt", "vaf", "error_rate", "n_rate", "size_ratio")], F.round("llr_alt", 2).alias("llr_alt"), "confidence")


@query(f"SELECT variant_id, class, length AS size, count(*) AS n FROM ({EVIDENCE}) GROUP BY ALL")
def a23_class_sizes(spark, d):
    return V.class_sizes(evidence(spark, d))


@query(f"""WITH e AS ({EVIDENCE}), p AS (SELECT variant_id, length AS size, count(*) FILTER (class = 'ALT') AS ca, count(*) FILTER (class = 'REF') AS cb FROM e WHERE class IN ('ALT', 'REF') GROUP BY ALL),
 r AS (SELECT *, sum(ca) OVER (PARTITION BY variant_id ORDER BY size) AS sa, sum(cb) OVER (PARTITION BY variant_id ORDER BY size) AS sb, sum(ca) OVER (PARTITION BY variant_id) AS na, sum(cb) OVER (PARTITION BY variant_id) AS nb FROM p),
 k AS (SELECT variant_id, na, nb, max(greatest(abs((sa - ca + least(ca, cb)) / na - (sb - cb + least(ca, cb)) / nb), abs(sa / na - sb / nb))) AS ks FROM r WHERE na >= 2 AND nb >= 2 GROUP BY ALL),
 l AS (SELECT *, (sqrt(na * nb / (na + nb)) + 0.12 + 0.11 / sqrt(na * nb / (na + nb))) * ks AS lam FROM k),
 s AS (SELECT variant_id, ks, greatest(0, least(1, sum(CASE WHEN i % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * i * i * lam * lam)))) AS p_value FROM l, generate_series(1, 100) g(i) GROUP BY ALL)
 SELECT v.variant_id, round(ks, 4) AS ks, round(coalesce(p_value, 1.0), 4) AS p_value FROM (SELECT DISTINCT variant_id FROM e) v LEFT JOIN s USING (variant_id)""")
def n13_ks(spark, d):
    return V.ks(V.class_sizes(evidence(spark, d)), "ALT", "REF").select("variant_id", F.round("ks", 4).alias("ks"), F.round("p_value", 4).alias("p_value"))


@query(f"SELECT frag_id, round({_LLR}, 4) AS llr FROM ({EVIDENCE})")
def n12_llr(spark, d):
    return evidence(spark, d).select("frag_id", F.round(X.log_likelihood_ratio(F.col("length")), 4).alias("llr"))


@query(with_sql("variants", body="SELECT variant_id, CASE WHEN length(ref) = 1 AND length(alt) = 1 THEN 'SNV' WHEN length(ref) = length(alt) THEN 'MNV' WHEN length(ref) < length(alt) AND starts_with(alt, ref) THEN 'INS' WHEN length(ref) > length(alt) AND starts_with(ref, alt) THEN 'DEL' ELSE 'COMPLEX' END AS kind FROM variants"))
def n9_variant_type(spark, d):
    return adapted(spark, d, "variants").select("variant_id", X.variant_type(F.col("ref"), F.col("alt")).alias("kind"))


@query("SELECT o_orderkey AS id, CASE b WHEN 'N' THEN 'N' WHEN 'A' THEN 'REF' WHEN 'T' THEN 'ALT' ELSE 'NonREF' END AS class FROM (SELECT o_orderkey, ('ACGTN')[1 + o_custkey % 5] AS b FROM orders)")
def n11_allele_class(spark, d):
    base = F.substring(F.lit("ACGTN"), (1 + F.col("o_custkey") % 5).cast("int"), F.lit(1))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), V.allele_class(base, F.lit("A"), F.lit("T")).alias("class"))


@query("SELECT o_orderkey AS id, round(CASE WHEN dep IS NULL OR dep < 1 THEN 1.0 ELSE greatest(ln(dep), 1.0) END, 4) AS weight FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 40 WHEN o_orderkey % 3 = 1 THEN o_custkey % 20 + 3 END AS dep FROM orders)")
def n15_duplex_weight(spark, d):
    k = F.col("o_orderkey") % 3
    depth = F.when(k == 0, F.col("o_custkey") % 40)
    name = F.when(k == 1, F.concat_ws(":", F.lit("M"), F.lit("AC"), F.lit("GT"), F.lit("3"), (F.col("o_custkey") % 20).cast("string"))).otherwise("plain")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.round(X.duplex_weight(depth, name), 4).alias("weight"))


@query("SELECT l_partkey % 500 AS variant_id, qname, l_linenumber AS read_no, bq FROM (SELECT *, l_suppkey % 10 AS qname, l_quantity AS bq, row_number() OVER (PARTITION BY l_partkey % 500, l_suppkey % 10 ORDER BY l_quantity DESC, l_orderkey * 10 + l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn = 1")
def owin6_best_evidence(spark, d):
    calls = table(spark, d, "lineitem").selectExpr("l_partkey % 500 as variant_id", "l_suppkey % 10 as qname", "l_linenumber as read_no", "l_quantity as bq", "struct(l_orderkey * 10 + l_linenumber, l_partkey) as at")
    return V.best_evidence(calls, ["variant_id", "qname"], "bq", "at").drop("at")


@query("""SELECT marker, round(count(*) FILTER (r <= 0.25) / count(*), 4) AS u, round(count(*) FILTER (r > 0.25 AND r < 0.75) / count(*), 4) AS x, round(count(*) FILTER (r >= 0.75) / count(*), 4) AS m, count(*) AS n FROM (SELECT marker, zm / (zm + zu) AS r FROM (SELECT l_suppkey % 50 AS marker, l_quantity % 7 AS zm, l_linenumber % 4 AS zu FROM lineitem) WHERE zm + zu >= 3) GROUP BY marker""")
def a24_uxm(spark, d):
    xm = F.concat(F.repeat(F.lit("Z"), (F.col("l_quantity") % 7).cast("int")), F.repeat(F.lit("."), F.lit(2)), F.repeat(F.lit("z"), F.col("l_linenumber") % 4))
    calls = table(spark, d, "lineitem").select((F.col("l_suppkey") % 50).alias("marker"), xm.alias("xm"))
    return V.methylation(calls, ["marker"], 3, 0.75, 0.25).select("marker", *[F.round(c, 4).alias(c) for c in "uxm"], "n")


# ---- cohort ----

SAMPLE_FSD = FSD_SQL.replace("SELECT r.arm,", "SELECT f.sample_id, r.arm,")


def fsd_by_sample(spark, d):
    return C.fsd_long(frags(spark, d), arms(spark, d), "arm", ("sample_id",))


def _baseline_sql(values: str, by: str, value: str, std: str = "stddev_samp", single: str = "0.1", floor: str = "0", having: str = "") -> str:
    return f"SELECT {by}, count({value}) AS n_samples, avg({value}) AS mean, CASE WHEN count({value}) < 2 THEN {single} ELSE greatest({std}({value}), {floor}) END AS std FROM ({values}) GROUP BY {by} {having}"


def _rounded(sql: str, by: str) -> str:
    return f"SELECT {by}, n_samples, round(mean, 4) AS mean, round(std, 4) AS std FROM ({sql})"


def _round(df, *by):
    return df.select(*by, "n_samples", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


FSD_BASE = _baseline_sql(SAMPLE_FSD, "arm, size_bin", "n")


@query(_rounded(FSD_BASE, "arm, size_bin"))
def a26_fsd_baseline(spark, d):
    return _round(H.baseline(fsd_by_sample(spark, d), ["arm", "size_bin"], "n"), "arm", "size_bin")


@query(f"SELECT sample_id, arm, size_bin, round(CASE WHEN b.mean > 0 THEN log2((n + 1) / (b.mean + 1)) ELSE 0 END, 4) AS logratio FROM ({SAMPLE_FSD}) LEFT JOIN ({FSD_BASE}) b USING (arm, size_bin)")
def j18_fsd_against_baseline(spark, d):
    values = fsd_by_sample(spark, d)
    base = H.baseline(values, ["arm", "size_bin"], "n")
    return values.join(base, ["arm", "size_bin"], "left").select("sample_id", "arm", "size_bin", F.round(C.log_ratio(F.col("n"), F.coalesce("mean", F.lit(0.0))), 4).alias("logratio"))


WPS_VECTORS = f"SELECT region_idx % 8 AS sample_id, region_idx // 8 AS region, bin, span - ends AS v FROM ({WPS_SQL})"


@query(_rounded(_baseline_sql(WPS_VECTORS, "region, bin", "v", floor="0.01"), "region, bin"))
def a27_wps_baseline(spark, d):
    values = P.binned(wps(spark, d)).select((F.col("region_idx") % 8).alias("sample_id"), F.expr("region_idx div 8").alias("region"), "bin", F.col("wps").alias("v"))
    return _round(H.baseline(values, ["region", "bin"], "v", floor=0.01), "region", "bin")


MDS_SAMPLES = f"{EXON_SQL} SELECT gene, exon, mds AS v FROM exons WHERE mds > 0"


@query(_rounded(_baseline_sql(MDS_SAMPLES, "gene", "v"), "gene"))
def a28_region_mds_baseline(spark, d):
    return _round(H.baseline(exons(spark, d).where("mds > 0"), ["gene"], "mds"), "gene")


OCF_SAMPLES = """SELECT label, split_part(label, ' ', 1) AS family, ocf AS v FROM (SELECT label, sum(CASE WHEN pos >= 2000 THEN 0 WHEN pos - 1000 BETWEEN -70 AND -50 THEN CASE side WHEN 'right' THEN n ELSE -n END WHEN pos - 1000 BETWEEN 50 AND 70 THEN CASE side WHEN 'left' THEN n ELSE -n END ELSE 0 END / (t / 10000.0)) AS ocf FROM (SELECT *, sum(n) OVER (PARTITION BY label, side) AS t FROM (""" + OCF_SQL + ")) GROUP BY label)"


def ocf_samples(spark, d):
    score = ocf_score(ocf_positions(frags(spark, d), adapted(spark, d, "regions")))
    return score.select("label", F.split_part("label", F.lit(" "), F.lit(1)).alias("family"), F.col("ocf").alias("v"))


@query(_rounded(_baseline_sql(OCF_SAMPLES, "family", "v", single="0.001"), "family"))
def a29_ocf_baseline(spark, d):
    return _round(H.baseline(ocf_samples(spark, d), ["family"], "v", single=0.001), "family")


@query(f"SELECT label, round(CASE WHEN b.std > 1e-9 THEN (v - b.mean) / b.std ELSE 0 END, 4) AS z FROM ({OCF_SAMPLES}) LEFT JOIN ({_baseline_sql(OCF_SAMPLES, 'family', 'v', single='0.001')}) b USING (family)")
def j16_ocf_zscore(spark, d):
    values = ocf_samples(spark, d)
    return H.normalised(values, H.baseline(values, ["family"], "v", single=0.001), ["family"], "v", 1e-9).select("label", F.round("z", 4).alias("z"))


@query(_rounded(_baseline_sql(f"SELECT lang, kmer, share AS v FROM ({MOTIF_BY_LANG})", "kmer", "v", "stddev_pop", "0.001"), "kmer"))
def a30_kmer_baseline(spark, d):
    m = ends_of_reads(spark, d).where(F.length("seq") >= 4).groupBy("lang", F.substring("seq", 1, 4).alias("kmer")).agg(F.count("*").alias("n"))
    share = m.select("kmer", (F.col("n") / F.sum("n").over(Window.partitionBy("lang"))).alias("v"))
    return _round(H.baseline(share, ["kmer"], "v", population=True, single=0.001), "kmer")


TILE_SAMPLES = with_sql("fragments", body='SELECT sample_id, chrom, "start" // 200000 AS tile, CAST(count(*) AS DOUBLE) AS v FROM fragments WHERE length BETWEEN 65 AND 1000 GROUP BY ALL')


def tile_samples(spark, d):
    return frags(spark, d).where("length BETWEEN 65 AND 1000").groupBy("sample_id", "chrom", F.expr("start div 200000").alias("tile")).agg(F.count("*").cast("double").alias("v"))


@query(_rounded(_baseline_sql(TILE_SAMPLES, "chrom", "v", single="0.1", floor="0.01"), "chrom"))
def a31_background_baseline(spark, d):
    return _round(H.baseline(tile_samples(spark, d), ["chrom"], "v", floor=0.01), "chrom")


TILE_BASE = _baseline_sql(TILE_SAMPLES, "chrom, tile", "v", "stddev_pop", "0.001", "0.001", "HAVING count(v) >= 3")


@query(_rounded(TILE_BASE, "chrom, tile"))
def a32_fsc_baseline(spark, d):
    return _round(H.baseline(tile_samples(spark, d), ["chrom", "tile"], "v", population=True, single=0.001, floor=0.001, least=3), "chrom", "tile")


@query(f"SELECT sample_id, chrom, tile, round(CASE WHEN b.mean IS NULL THEN NULL WHEN b.std > 0 THEN (v - b.mean) / b.std ELSE 0 END, 4) AS z FROM ({TILE_SAMPLES}) LEFT JOIN ({TILE_BASE}) b USING (chrom, tile)")
def j20_fsc_zscore(spark, d):
    values = tile_samples(spark, d)
    base = H.baseline(values, ["chrom", "tile"], "v", population=True, single=0.001, floor=0.001, least=3)
    return H.normalised(values, base, ["chrom", "tile"], "v").select("sample_id", "chrom", "tile", F.round("z", 4).alias("z"))


ENTROPY_SAMPLES = HIST_SQL.replace("SELECT label,", "SELECT label, f.sample_id,")
ENTROPY_SAMPLES = f"SELECT label, sample_id, -sum(n / t * log2(n / t)) AS v FROM (SELECT *, sum(n) OVER (PARTITION BY label, sample_id) AS t FROM ({ENTROPY_SAMPLES})) GROUP BY ALL"


def entropy_samples(spark, d):
    by = ["label", "sample_id"]
    return entropy(size_histogram(frags(spark, d), adapted(spark, d, "regions"), by), by).select("label", "sample_id", F.col("entropy").alias("v"))


@query(_rounded(_baseline_sql(ENTROPY_SAMPLES, "label", "v", single="0"), "label"))
def a33_entropy_baseline(spark, d):
    return _round(H.baseline(entropy_samples(spark, d), ["label"], "v", single=0.0), "label")


@query(f"SELECT label, sample_id, round(CASE WHEN b.std > 1e-9 THEN (v - b.mean) / b.std ELSE 0 END, 4) AS z FROM ({ENTROPY_SAMPLES}) LEFT JOIN ({_baseline_sql(ENTROPY_SAMPLES, 'label', 'v', single='0')}) b USING (label)")
def j17_entropy_zscore(spark, d):
    values = entropy_samples(spark, d)
    return H.normalised(values, H.baseline(values, ["label"], "v", single=0.0), ["label"], "v", 1e-9).select("label", "sample_id", F.round("z", 4).alias("z"))


@query(f"SELECT sample_id, round(CASE WHEN s > 1e-10 THEN (v - m) / s ELSE 0 END, 4) AS z FROM (SELECT sample_id, v, avg(v) OVER () AS m, stddev_pop(v) OVER () AS s FROM (SELECT sample_id, avg(v) AS v FROM ({TILE_SAMPLES}) GROUP BY sample_id))")
def j22_scalar_baseline(spark, d):
    values = tile_samples(spark, d).groupBy("sample_id").agg(F.avg("v").alias("v"))
    one = values.agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))  # one row
    return values.join(F.broadcast(one)).select("sample_id", F.round(X.zscore(F.col("v"), F.col("mean"), F.col("std"), 1e-10), 4).alias("z"))


@query(f"SELECT sample_id, chrom, tile, round(log2(v / b.mean + 1e-9), 4) AS log_ratio, round(1 / (b.std * b.std + 0.01), 4) AS reliability FROM ({TILE_SAMPLES}) JOIN ({TILE_BASE}) b USING (chrom, tile)")
def n16_fsc_log_ratio(spark, d):
    values = tile_samples(spark, d)
    base = H.baseline(values, ["chrom", "tile"], "v", population=True, single=0.001, floor=0.001, least=3)
    return values.join(base, ["chrom", "tile"]).select("sample_id", "chrom", "tile", F.round(F.log2(F.col("v") / F.col("mean") + 1e-9), 4).alias("log_ratio"), F.round(1 / (F.col("std") * F.col("std") + 0.01), 4).alias("reliability"))


@query("SELECT p_partkey AS id, round(CASE WHEN s > 0 THEN (p_retailprice - m) / s ELSE 0 END, 4) AS z FROM (SELECT p_partkey, p_retailprice, CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_size END AS s, 1000 AS m FROM part)")
def n19_zscore(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(X.zscore(F.col("p_retailprice"), F.lit(1000), F.when(F.col("p_size") % 3 == 0, 0).otherwise(F.col("p_size"))), 4).alias("z"))


@query("SELECT vec_id, round(CASE WHEN sa < 1e-6 OR sb < 1e-6 THEN 0 ELSE dot / (sa * sb) END, 4) AS shape FROM (SELECT vec_id, sqrt(sum((x - mx) ** 2)) AS sa, sqrt(sum((y - my) ** 2)) AS sb, sum((x - mx) * (y - my)) AS dot FROM (SELECT *, avg(x) OVER (PARTITION BY vec_id) AS mx, avg(y) OVER (PARTITION BY vec_id) AS my FROM (SELECT vec_id, CAST(unnest(embedding[1:8]) AS DOUBLE) AS x, CAST(unnest(embedding[9:16]) AS DOUBLE) AS y FROM embeddings)) GROUP BY vec_id)")
def n20_shape_score(spark, d):
    part = lambda a: F.slice("embedding", a, 8).cast("array<double>")
    return table(spark, d, "embeddings").select("vec_id", F.round(H.shape_score(part(1), part(9), 8), 4).alias("shape"))


@query(f"SELECT 'fsd' AS \"table\", arm, CAST(NULL AS VARCHAR) AS chrom, count(*) AS n FROM ({FSD_BASE}) GROUP BY arm UNION ALL SELECT 'fsc', NULL, chrom, count(*) FROM ({TILE_BASE}) GROUP BY chrom")
def t5_union_tables(spark, d):
    fsd = H.baseline(fsd_by_sample(spark, d), ["arm", "size_bin"], "n").groupBy("arm").agg(F.count("*").alias("n"))
    fsc = H.baseline(tile_samples(spark, d), ["chrom", "tile"], "v", population=True, single=0.001, floor=0.001, least=3).groupBy("chrom").agg(F.count("*").alias("n"))
    return H.union_tables(fsd=fsd, fsc=fsc).select("table", "arm", "chrom", "n")
