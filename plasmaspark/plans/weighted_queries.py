"""Queries: the features under GC weights, with on- and off-target parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from plasmaspark.functions import expressions as X
from plasmaspark.operators import coverage as C
from plasmaspark.operators import gc as G
from plasmaspark.operators import motifs as M
from plasmaspark.operators import protection as P
from plasmaspark.operators import regional as R
from plasmaspark.operators import variants as V
from plasmaspark.plans.coverage_queries import ARMS, GCHAN, HIT, TARGETS, arms, frags, genes, targets
from plasmaspark.plans.feature_queries import EVIDENCE, LBIN, MOTIF_SQL, RANGES, ends_of_reads, evidence, factor_table
from plasmaspark.plans.register import query
from plasmaspark.sources.adapters import adapted, with_sql

_W = f"CASE WHEN ({LBIN} + gc_pct) % 13 = 0 THEN 1.0 ELSE 1 + (({LBIN} * 7 + gc_pct) % 11) / 10.0 END"
_W_ON = f"CASE WHEN ({LBIN} + gc_pct) % 13 = 0 THEN 1.0 ELSE 1 + (({LBIN} * 3 + gc_pct) % 7) / 10.0 END"
WF = f"wf AS (SELECT *, CAST({_W} AS DOUBLE) AS w, CAST({_W_ON} AS DOUBLE) AS w_on FROM fragments)"
ON = 'EXISTS (SELECT 1 FROM targets t WHERE f.chrom = t.chrom AND f."start" < t."end" AND f."end" > t."start")'


def _sql(*names: str, ctes: tuple[str, ...] = (), body: str) -> str:
    return with_sql("fragments", *names, body=body).replace(f" {body}", "".join(f", {c}" for c in (WF, *ctes)) + f" {body}")


def factors_on(spark):
    return factor_table(spark).withColumn("factor", 1 + ((F.col("length_bin") * 3 + F.col("gc_pct")) % 7) / 10.0)


def weighted(spark, d):
    """Fragments with w by the factors, and w_on by those of on-target fragments."""
    f = frags(spark, d).withColumn("gc_pct", F.col("gc_pct").cast("bigint"))
    return C.with_factors(C.with_factors(f, factor_table(spark), name="weight"), factors_on(spark), name="weight_on")


@query(_sql("genes", body=f"""SELECT g.gene, {', '.join(f'round(coalesce(s.{c}, 0), 3) AS {c}' for c in C.FIVE)}, round(coalesce(s.total, 0), 3) AS total, {', '.join(f'round(coalesce(s.{c}, 0) / greatest(coalesce(s.total, 0), 1e-9), 4) AS {c}_ratio' for c in C.FIVE)}, round(coalesce(s.total, 0) * 1e9 / (g.bp * n.n), 3) AS depth
 FROM (SELECT gene, sum("end" - "start") AS bp FROM genes GROUP BY gene) g LEFT JOIN (SELECT r.gene, {', '.join(f"sum(CASE WHEN {GCHAN} = '{c}' THEN w ELSE 0 END) AS {c}" for c in C.FIVE)}, sum(w) AS total FROM wf f JOIN genes r ON f.chrom = r.chrom AND (f."start" + f."end") // 2 >= r."start" AND (f."start" + f."end") // 2 < r."end" WHERE length BETWEEN 65 AND 1000 GROUP BY r.gene) s USING (gene), (SELECT count(*) AS n FROM fragments WHERE length BETWEEN 65 AND 1000) n"""))
def a3_fsc_genes_weighted(spark, d):
    out = C.fsc_genes(weighted(spark, d), genes(spark, d), ["gene"], F.col("weight"))
    return out.select("gene", *[F.round(c, 3).alias(c) for c in (*C.FIVE, "total")], *[F.round(f"{c}_ratio", 4).alias(f"{c}_ratio") for c in C.FIVE], F.round("depth", 3).alias("depth"))


@query(_sql("genes", ctes=(TARGETS, ARMS), body=f"SELECT r.arm, f.on_target, CAST((length - 65) // 5 AS INT) AS size_bin, round(sum(w), 3) AS n FROM (SELECT *, {ON} AS on_target FROM wf f) f JOIN arms r ON {HIT} WHERE length >= 65 AND length < 400 GROUP BY ALL"))
def a4_fsd_weighted(spark, d):
    f = C.flag_on_target(weighted(spark, d), targets(spark, d))
    return C.fsd_long(f, arms(spark, d), "arm", ("on_target",), F.col("weight")).withColumn("n", F.round("n", 3))


@query(_sql("regions", body=f"""SELECT label, side, least(pos, 2000) AS pos, round(sum(w), 3) AS n FROM (SELECT label, w, 'left' AS side, f."start" - r."start" AS pos FROM wf f JOIN regions r ON {HIT} WHERE f."start" >= r."start" UNION ALL SELECT label, w, 'right', f."end" - r."start" + 1 FROM wf f JOIN regions r ON {HIT} WHERE f."end" <= r."end") GROUP BY ALL"""))
def a5_ocf_weighted(spark, d):
    return R.ocf_positions(weighted(spark, d), adapted(spark, d, "regions"), F.col("weight")).withColumn("n", F.round("n", 3))


@query(_sql("regions", body=f"SELECT label, round(sum(n), 3) AS \"count\", round(sum(size * n) / sum(n), 4) AS mean_size, round(-sum(n / t * log2(n / t)), 4) AS entropy FROM (SELECT *, sum(n) OVER (PARTITION BY label) AS t FROM (SELECT label, least(f.length, 1000) AS size, sum(w) AS n FROM wf f JOIN regions r ON {HIT} GROUP BY ALL)) GROUP BY label"))
def a7_region_entropy_weighted(spark, d):
    h = R.size_histogram(weighted(spark, d), adapted(spark, d, "regions"), ["label"], F.col("weight"))
    return R.entropy(h, ["label"]).select("label", F.round("count", 3).alias("count"), F.round("mean_size", 4).alias("mean_size"), F.round("entropy", 4).alias("entropy"))


@query(_sql("genes", "regions", ctes=(TARGETS, f"h AS (SELECT r.label, least(f.length, 1000) AS size, {ON} AS on_target, w, w_on FROM wf f JOIN regions r ON {HIT})"), body="SELECT label, 'all' AS part, size, round(sum(w), 3) AS n FROM h GROUP BY ALL UNION ALL SELECT label, CASE WHEN on_target THEN 'on' ELSE 'off' END, size, round(sum(CASE WHEN on_target THEN w_on ELSE w END), 3) FROM h GROUP BY ALL"))
def a9_triple_weighted(spark, d):
    f = C.flag_on_target(weighted(spark, d), targets(spark, d))
    return R.routed(f, adapted(spark, d, "regions"), F.col("weight"), F.col("weight_on")).withColumn("n", F.round("n", 3))


@query(f"""SELECT region_idx, bin, round(sum(CASE WHEN what = 'cov' THEN c ELSE 0 END), 3) AS cov, round(sum(CASE WHEN what = 'span' THEN c WHEN what = 'end' THEN -c ELSE 0 END), 3) AS wps FROM (SELECT region_idx, what, bin, CAST(w * (least(high, (bin + 1) * 10) - greatest(low, bin * 10)) AS DOUBLE) / 10 AS c FROM (SELECT *, unnest(generate_series(low // 10, (high - 1) // 10)) AS bin FROM ({RANGES.replace("THEN 1.0 ELSE 0.5 END AS w FROM", f"THEN 1.0 ELSE 0.5 END * {_W.replace('length', 'f.length')} AS w FROM")}))) GROUP BY ALL""")
def n3_wps_weighted(spark, d):
    bins = P.binned(P.ranges(weighted(spark, d), adapted(spark, d, "regions"), weight=F.col("weight")))
    return bins.select("region_idx", "bin", F.round("cov", 3).alias("cov"), F.round("wps", 3).alias("wps"))


@query(_sql("genes", ctes=(TARGETS,), body=f"SELECT on_target, {LBIN} AS length_bin, CAST(gc_pct AS INT) AS gc_pct, count(*) AS n FROM (SELECT *, {ON} AS on_target FROM fragments f) WHERE length >= 60 AND length < 400 GROUP BY ALL"))
def a12_gc_observations_split(spark, d):
    return G.observations(C.flag_on_target(frags(spark, d), targets(spark, d)), ("on_target",), 400)


@query(f"SELECT round(a / t, 4) AS a_fraction, round(c / t, 4) AS c_fraction, round(g / t, 4) AS g_fraction, round(u / t, 4) AS t_fraction, round(-(a / t * log2(a / t + 1e-12) + c / t * log2(c / t + 1e-12) + g / t * log2(g / t + 1e-12) + u / t * log2(u / t + 1e-12)), 4) AS entropy, round(c / t - 0.25, 4) AS c_bias FROM (SELECT sum(n) AS t, sum(n) FILTER (kmer[1:1] = 'A') AS a, sum(n) FILTER (kmer[1:1] = 'C') AS c, sum(n) FILTER (kmer[1:1] = 'G') AS g, sum(n) FILTER (kmer[1:1] = 'T') AS u FROM ({MOTIF_SQL}))")
def a17_end_fractions(spark, d):
    out = M.end_fractions(M.end_motifs(ends_of_reads(spark, d)))
    return out.select(*[F.round(c, 4).alias(c) for c in out.columns])


@query(with_sql("fragments", "regions", body=f"""SELECT grp, count(*) AS overlaps, count_if(length BETWEEN 120 AND 180) AS n_nuc, count_if(length BETWEEN 35 AND 80) AS n_tf FROM (SELECT f.length, unnest(['Global_All', 'Family_' || split_part(r.label, ' ', 1), 'Chr' || r.chrom || '_All']) AS grp FROM fragments f JOIN regions r ON f.chrom = r.chrom AND f."start" < r."end" + 1 AND f."end" > r."start" WHERE length BETWEEN 120 AND 180 OR length BETWEEN 35 AND 80) GROUP BY ALL"""))
def a21_stacking_counts(spark, d):
    return P.stacking_counts(frags(spark, d), adapted(spark, d, "regions").withColumn("family", F.split_part("label", F.lit(" "), F.lit(1))))


def _llr(tumour: float, healthy: float, spread: float, calm: float) -> str:
    return f"(ln(greatest(exp(-0.5 * ((length - {tumour}) / {spread}) ** 2) / ({spread} * 2.5066282746310002e0), 1e-15)) - ln(greatest(exp(-0.5 * ((length - {healthy}) / {calm}) ** 2) / ({calm} * 2.5066282746310002e0), 1e-15)))"


@query(with_sql("fragments", body=f"SELECT frag_id, round({_llr(130, 153, 30e0, 25e0)}, 4) AS canine, round({_llr(135, 157, 35e0, 30e0)}, 4) AS ssdna FROM fragments"))
def n12_llr_presets(spark, d):
    return evidence(spark, d).select("frag_id", *[F.round(X.log_likelihood_ratio(F.col("length"), p), 4).alias(p) for p in ("canine", "ssdna")])


@query(f"""WITH e AS ({EVIDENCE}), q AS (SELECT * FROM (VALUES {', '.join(f"('{a}_{b}', '{a}', '{b}')" for a, b in V.PAIRS)}) t(pair, one, two)),
 p AS (SELECT variant_id, pair, length AS size, count(*) FILTER (class = one) AS ca, count(*) FILTER (class = two) AS cb FROM e, q WHERE class IN (one, two) GROUP BY ALL),
 r AS (SELECT *, sum(ca) OVER w AS sa, sum(cb) OVER w AS sb, sum(ca) OVER g AS na, sum(cb) OVER g AS nb FROM p WINDOW w AS (PARTITION BY variant_id, pair ORDER BY size), g AS (PARTITION BY variant_id, pair)),
 k AS (SELECT variant_id, pair, na, nb, max(greatest(abs((sa - ca + least(ca, cb)) / na - (sb - cb + least(ca, cb)) / nb), abs(sa / na - sb / nb))) AS ks FROM r WHERE na >= 2 AND nb >= 2 GROUP BY ALL),
 l AS (SELECT *, (sqrt(na * nb / (na + nb)) + 0.12 + 0.11 / sqrt(na * nb / (na + nb))) * ks AS lam FROM k),
 s AS (SELECT variant_id, pair, ks, greatest(0, least(1, sum(CASE WHEN i % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * i * i * lam * lam)))) AS p_value FROM l, generate_series(1, 100) g(i) GROUP BY ALL)
 SELECT variant_id, {', '.join(f"round(max(ks) FILTER (pair = '{a}_{b}'), 4) AS ks_{a.lower()}_{b.lower()}, round(coalesce(max(p_value) FILTER (pair = '{a}_{b}'), 1.0), 4) AS p_{a.lower()}_{b.lower()}" for a, b in V.PAIRS)} FROM (SELECT DISTINCT variant_id FROM e) v LEFT JOIN s USING (variant_id) GROUP BY variant_id""")
def n13_ks_pairs(spark, d):
    out = V.ks_pairs(V.class_sizes(evidence(spark, d)))
    return out.select("variant_id", *[F.round(c, 4).alias(c) for c in out.columns[1:]])
