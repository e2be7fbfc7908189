"""Queries: the remaining joins against baselines, windows, orderings and derived values."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plasmaspark.functions import expressions as X
from plasmaspark.operators import cohort as H
from plasmaspark.operators import protection as P
from plasmaspark.operators.intervals import as_right, overlap
from plasmaspark.operators.regional import ocf_positions, ocf_score
from plasmaspark.plans.coverage_queries import ARMS, HIT, TARGETS, arms, frags, genes, targets
from plasmaspark.plans.feature_queries import EVIDENCE, EXON_SQL, MDS_SAMPLES, RANGES, RANGES_TF, TILE_SAMPLES, WPS_SQL, WPS_VECTORS, _baseline_sql, evidence, exons, tile_samples, wps
from plasmaspark.operators.numbering import numbered
from plasmaspark.plans.register import query
from plasmaspark.sources.adapters import adapted, table, with_sql


@query(with_sql("fragments", body=f", {ARMS} SELECT r.arm, count(*) AS n, CAST(sum(length) AS BIGINT) AS bp FROM fragments f JOIN arms r ON {HIT} GROUP BY ALL").replace(" , arms", ", arms"))
def j2_arm_join(spark, d):
    return overlap(frags(spark, d), as_right(arms(spark, d)), bucket=1 << 20).groupBy("arm").agg(F.count("*").alias("n"), F.sum("length").alias("bp"))


@query(with_sql("fragments", "regions", body=f"SELECT frag_id, region_idx FROM fragments f JOIN regions r ON {HIT}"))
def j3_region_join(spark, d):
    return overlap(frags(spark, d), as_right(adapted(spark, d, "regions"))).select("frag_id", "region_idx")


@query(with_sql("fragments", "variants", body='SELECT variant_id % 10 AS label, count(*) AS n FROM fragments f JOIN variants v ON f.chrom = v.chrom AND f."start" < v.pos + 200 AND f."end" > v.pos GROUP BY ALL'))
def j4_large_region_join(spark, d):
    sites = adapted(spark, d, "variants").select((F.col("variant_id") % 10).alias("label"), "chrom", F.col("pos").alias("start"), (F.col("pos") + 200).alias("end"))
    # both sides are large: the hint makes the bucketed shuffle explicit
    return overlap(frags(spark, d), as_right(sites).hint("merge")).groupBy("label").agg(F.count("*").alias("n"))


@query(with_sql("fragments", "genes", body=f", {TARGETS} SELECT chrom, count(*) AS n FROM fragments f WHERE EXISTS (SELECT 1 FROM targets r WHERE {HIT}) GROUP BY chrom").replace(" , targets", ", targets"))
def j9_semi_overlap(spark, d):
    return overlap(frags(spark, d), as_right(targets(spark, d)), "left_semi").groupBy("chrom").agg(F.count("*").alias("n"))


@query(with_sql("genes", "blacklist", body=f"SELECT gene_idx FROM genes f WHERE NOT EXISTS (SELECT 1 FROM blacklist r WHERE {HIT})"))
def j10_anti_overlap(spark, d):
    return overlap(genes(spark, d), as_right(adapted(spark, d, "blacklist")), "left_anti").select("gene_idx")


@query(f"SELECT region_idx, v.bin, round(CASE WHEN b.std > 0 THEN (v - b.mean) / b.std ELSE 0 END, 4) AS z FROM (SELECT region_idx, region_idx // 8 AS region, bin, span - ends AS v FROM ({WPS_SQL})) v LEFT JOIN ({_baseline_sql(WPS_VECTORS, 'region, bin', 'v', floor='0.01')}) b ON v.region = b.region AND v.bin = b.bin")
def j19_wps_zscore(spark, d):
    values = P.binned(wps(spark, d)).select("region_idx", F.expr("region_idx div 8").alias("region"), "bin", F.col("wps").alias("v"))
    return H.normalised(values, H.baseline(values, ["region", "bin"], "v", floor=0.01), ["region", "bin"], "v").select("region_idx", "bin", F.round("z", 4).alias("z"))


_SIDE = """SELECT label, round(sum(CASE WHEN pos >= 2000 THEN 0 WHEN pos - 1000 BETWEEN -70 AND -50 THEN CASE side WHEN 'right' THEN n ELSE -n END WHEN pos - 1000 BETWEEN 50 AND 70 THEN CASE side WHEN 'left' THEN n ELSE -n END ELSE 0 END / (t / 10000.0)), 4) AS ocf FROM (SELECT *, sum(n) OVER (PARTITION BY label, side) AS t FROM (SELECT label, side, least(pos, 2000) AS pos, count(*) AS n FROM (SELECT label, 'left' AS side, f."start" - r."start" AS pos FROM off f JOIN regions r ON {hit} WHERE f."start" >= r."start" UNION ALL SELECT label, 'right', f."end" - r."start" + 1 FROM off f JOIN regions r ON {hit} WHERE f."end" <= r."end") GROUP BY ALL)) GROUP BY label"""


@query(with_sql("fragments", "genes", "regions", body=f", {TARGETS}, off AS (SELECT * FROM fragments f WHERE NOT EXISTS (SELECT 1 FROM targets r WHERE {HIT})) {_SIDE.format(hit=HIT)}").replace(" , targets", ", targets"))
def j21_off_target_ocf(spark, d):
    off = overlap(frags(spark, d), as_right(targets(spark, d).select("chrom", "start", "end")), "left_anti")
    return ocf_score(ocf_positions(off, adapted(spark, d, "regions"))).select("label", F.round("ocf", 4).alias("ocf"))


@query(f"{EXON_SQL} SELECT round(avg(mds), 4) AS mean, round(stddev_pop(mds), 4) AS std, count(*) AS n FROM exons")
def a38_exon_summary(spark, d):
    return exons(spark, d).agg(F.round(F.avg("mds"), 4).alias("mean"), F.round(F.stddev_pop("mds"), 4).alias("std"), F.count("*").alias("n"))


@query(f"SELECT gene, exon, round(CASE WHEN b.std > 1e-9 THEN (v - b.mean) / b.std ELSE 0 END, 4) AS z FROM ({MDS_SAMPLES}) LEFT JOIN ({_baseline_sql(MDS_SAMPLES, 'gene', 'v')}) b USING (gene)")
def j20_mds_zscore(spark, d):
    values = exons(spark, d).where("mds > 0")
    return H.normalised(values, H.baseline(values, ["gene"], "mds"), ["gene"], "mds", 1e-9).select("gene", "exon", F.round("z", 4).alias("z"))


@query(f"SELECT w.region_idx, CASE WHEN r.p_size % 2 = 0 THEN bin ELSE 99 - bin END AS bin, round(span - ends, 4) AS wps FROM ({WPS_SQL}) w JOIN part r ON w.region_idx = r.p_partkey")
def n5_strand_bins(spark, d):
    bins = P.binned(wps(spark, d)).join(adapted(spark, d, "regions").select("region_idx", "plus"), "region_idx")
    return bins.select("region_idx", F.when(F.col("plus"), F.col("bin")).otherwise(99 - F.col("bin")).alias("bin"), F.round("wps", 4).alias("wps"))


_MASK = """SELECT region_idx, bin FROM (SELECT g.region_idx, g.bin, unnest(generate_series(greatest(g.s, b."start" + least(50, (b."end" - b."start") // 4)), least(g.s + 9, b."end" - least(50, (b."end" - b."start") // 4), b."end" - 1))) AS place FROM grid g JOIN genes b ON g.chrom = b.chrom AND g.s < b."end" AND g.s + 10 > b."start") GROUP BY ALL HAVING count(DISTINCT place) = 10"""
_SMOOTH = "(" + " + ".join(f"{c} * {f'lag(wps, {5 - i}) OVER o' if i < 5 else f'lead(wps, {i - 5}) OVER o' if i > 5 else 'wps'}" for i, c in enumerate(P.SMOOTH[11][0])) + f") / {P.SMOOTH[11][1]}.0"


@query(with_sql("regions", "genes", body=f""", bins AS ({WPS_SQL}), grid AS (SELECT region_idx, plus, chrom, bin, "start" + bin * 10 AS s FROM regions, generate_series(0, 99) g(bin) WHERE region_idx IN (SELECT region_idx FROM bins)), mask AS ({_MASK})
 SELECT region_idx, bin, round(cov, 4) + 0.0 AS cov, round(wps, 4) + 0.0 AS wps, round(coalesce({_SMOOTH}, wps), 3) + 0.0 AS smooth, reliable FROM (SELECT g.region_idx, CASE WHEN plus THEN g.bin ELSE 99 - g.bin END AS bin, coalesce(b.cov, 0) AS cov, coalesce(b.span - b.ends, 0) AS wps, m.bin IS NOT NULL AS reliable FROM grid g LEFT JOIN bins b USING (region_idx, bin) LEFT JOIN mask m USING (region_idx, bin)) WINDOW o AS (PARTITION BY region_idx ORDER BY bin)""").replace(" , bins", ", bins"))
def n5_oriented_bins(spark, d):
    regions = adapted(spark, d, "regions").select("region_idx", "plus", "chrom", "start", "end")
    out = P.oriented(P.binned(wps(spark, d)), regions, 100, genes(spark, d).select("chrom", "start", "end"))
    shown = lambda c, n: (F.round(c, n) + 0.0).alias(c)
    return out.select("region_idx", "bin", shown("cov", 4), shown("wps", 4), shown("smooth", 3), "reliable")


_STATE = ", ".join(f"sum(CASE WHEN kind = '{k}' AND what = '{what}' THEN w ELSE 0e0 END) AS {what}_{k}" for k in ("long", "short") for what in ("cov", "span", "end"))


@query(with_sql("fragments", "regions", "genes", body=f""", steps AS (SELECT region_idx, what, kind, w, unnest(generate_series(low, high - 1)) AS place FROM (SELECT region_idx, what, 'long' AS kind, CAST(w AS DOUBLE) AS w, low, high FROM ({RANGES}) UNION ALL SELECT region_idx, what, 'short', CAST(w AS DOUBLE), low, high FROM ({RANGES_TF}))),
 s AS (SELECT region_idx, place, {_STATE} FROM steps GROUP BY ALL), grid AS (SELECT region_idx, label, chrom, "start", "end", plus, unnest(generate_series(0, "end" - "start" - 1)) AS place FROM regions WHERE region_idx IN (SELECT region_idx FROM steps)),
 p AS (SELECT g.*, g."start" + g.place AS pos, {', '.join(f'coalesce({w}_{k}, 0) AS {w}_{k}' for k in ('long', 'short') for w in ('cov', 'span', 'end'))} FROM grid g LEFT JOIN s USING (region_idx, place)),
 q AS (SELECT *, span_long - end_long AS wl, span_short - end_short AS ws FROM p), r AS (SELECT *, CASE WHEN abs(ws) > 1e-9 THEN wl / abs(ws) ELSE wl END AS ratio FROM q), n AS (SELECT count(*) / 1e6 AS million FROM fragments)
 SELECT region_idx, CASE WHEN plus THEN place ELSE "end" - "start" - 1 - place END AS "row", label AS region_id, r.chrom, pos, CASE WHEN plus THEN '+' ELSE '-' END AS strand, 'OTHER' AS region_type, CAST(EXISTS (SELECT 1 FROM genes b WHERE b.chrom = r.chrom AND pos < b."end" AND pos - b."start" >= least(50, (b."end" - b."start") // 4) AND b."end" - pos >= least(50, (b."end" - b."start") // 4)) AS INT) AS capture_mask,
 round(cov_long, 4) + 0.0 AS cov_long, round(cov_short, 4) + 0.0 AS cov_short, round(wl, 4) + 0.0 AS wps_long, round(ws, 4) + 0.0 AS wps_short, round(ratio, 4) + 0.0 AS wps_ratio, round(wl / million, 2) + 0.0 AS wps_long_norm, round(ws / million, 2) + 0.0 AS wps_short_norm, round(ratio / million, 2) + 0.0 AS wps_ratio_norm, round(CASE WHEN span_long + end_long > 1e-9 THEN span_long / (span_long + end_long) ELSE 0 END, 4) AS prot_frac_nuc, round(CASE WHEN span_short + end_short > 1e-9 THEN span_short / (span_short + end_short) ELSE 0 END, 4) AS prot_frac_tf FROM r, n""").replace(" , steps", ", steps"))
def n6_position_table(spark, d):
    regions = adapted(spark, d, "regions").select("region_idx", F.col("label").alias("region_id"), "plus", "chrom", "start", "end")
    shown = lambda n, c: F.round(c, 2 if n.endswith("_norm") else 4) + 0.0
    return P.position_table(frags(spark, d), regions, baits=genes(spark, d).select("chrom", "start", "end"), shown=shown)


@query(f"SELECT region_idx, round(sum(cov) * 1e6 / (SELECT count(*) FROM lineitem), 4) AS per_million, round(sum(CASE WHEN cov > 0 THEN (span - ends) / cov ELSE 0 END), 3) AS ratio FROM ({WPS_SQL}) GROUP BY region_idx")
def n6_per_million(spark, d):
    n = table(spark, d, "lineitem").agg(F.count("*").alias("total"))
    bins = P.binned(wps(spark, d)).groupBy("region_idx").agg(F.sum("cov").alias("cov"), F.sum(F.when(F.col("cov") > 0, F.col("wps") / F.col("cov")).otherwise(0.0)).alias("ratio"))
    return bins.join(F.broadcast(n)).select("region_idx", F.round(F.col("cov") * 1e6 / F.col("total"), 4).alias("per_million"), F.round("ratio", 3).alias("ratio"))


@query(f"SELECT variant_id, class, round(n / sum(n) OVER (PARTITION BY variant_id), 4) AS share FROM (SELECT variant_id, class, count(*) AS n FROM ({EVIDENCE}) GROUP BY ALL)")
def owin7_partition_share(spark, d):
    n = evidence(spark, d).groupBy("variant_id", "class").agg(F.count("*").alias("n"))
    return n.select("variant_id", "class", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("variant_id")), 4).alias("share"))


@query(f"SELECT variant_id, size, round(sum(n) OVER (PARTITION BY variant_id ORDER BY size) / sum(n) OVER (PARTITION BY variant_id), 4) AS ecdf FROM (SELECT variant_id, length AS size, count(*) AS n FROM ({EVIDENCE}) GROUP BY ALL)")
def owin8_distribution(spark, d):
    n = evidence(spark, d).groupBy("variant_id", F.col("length").alias("size")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy("variant_id")
    run = F.sum("n").over(whole.orderBy("size").rowsBetween(Window.unboundedPreceding, 0))
    return n.select("variant_id", "size", F.round(run / F.sum("n").over(whole), 4).alias("ecdf"))


@query(with_sql("genes", body='SELECT gene, arg_min(CASE WHEN nation % 3 = 0 THEN NULL ELSE nation END, ("start", gene_idx)) FILTER (nation % 3 <> 0) AS first_nation, min("start") AS s FROM genes GROUP BY gene'))
def owin3_first_present(spark, d):
    at = Window.partitionBy("gene").orderBy("start", "gene_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    value = F.when(F.col("nation") % 3 != 0, F.col("nation"))
    filled = genes(spark, d).select("gene", F.first(value, ignorenulls=True).over(at).alias("first_nation"), F.first("start").over(at).alias("s"))
    return filled.distinct()


@query(with_sql("fragments", body='SELECT frag_id, round(v / CASE WHEN g <= 0.45 THEN 0.9 + (g - 0.3) / 1.5 ELSE 1.0 - (g - 0.45) / 2.5 END, 4) AS corrected FROM (SELECT frag_id, CAST(length AS DOUBLE) AS v, gc_pct / 100.0 AS g FROM fragments)'))
def n22_gc_corrected(spark, d):
    g = F.col("gc_pct") / 100
    expected = F.when(g <= 0.45, 0.9 + (g - 0.3) / 1.5).otherwise(1.0 - (g - 0.45) / 2.5)
    return frags(spark, d).select("frag_id", F.round(F.col("length") / expected, 4).alias("corrected"))


@query(f"SELECT chrom, round(CASE WHEN greatest(s, 0.01) > 0 THEN (m - 200) / greatest(s, 0.01) ELSE 0 END, 4) AS z FROM (SELECT chrom, avg(v) AS m, stddev_samp(v) AS s FROM ({TILE_SAMPLES}) GROUP BY chrom)")
def n23_repeat_length_z(spark, d):
    stats = tile_samples(spark, d).groupBy("chrom").agg(F.avg("v").alias("m"), F.greatest(F.stddev_samp("v"), F.lit(0.01)).alias("s"))
    return stats.select("chrom", F.round(X.zscore(F.col("m"), F.lit(200.0), F.col("s")), 4).alias("z"))


@query("SELECT o_orderkey AS id, round(CASE WHEN a + r > 0 THEN a / (a + r) ELSE 0 END, 4) AS vaf, CASE WHEN a >= 5 THEN 'HIGH' WHEN a >= 1 THEN 'LOW' ELSE 'NONE' END AS confidence, a >= 2 AND r >= 2 AS ks_valid FROM (SELECT o_orderkey, o_custkey % 9 AS a, o_orderkey % 4 AS r FROM orders)")
def n14_derived(spark, d):
    a, r = F.col("o_custkey") % 9, F.col("o_orderkey") % 4
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.round(F.when(a + r > 0, a / (a + r)).otherwise(0.0), 4).alias("vaf"), F.when(a >= 5, "HIGH").when(a >= 1, "LOW").otherwise("NONE").alias("confidence"), ((a >= 2) & (r >= 2)).alias("ks_valid"))


@query(with_sql("genes", body="SELECT gene, row_number() OVER (ORDER BY gene) AS place FROM (SELECT DISTINCT gene FROM genes)"))
def t1_sorted_labels(spark, d):
    names = genes(spark, d).select("gene").distinct()
    return numbered(names, ["gene"], "place")


@query(with_sql("fragments", body='SELECT frag_id, length FROM fragments ORDER BY length DESC, frag_id, "start" LIMIT 100'))
def t3_first_rows(spark, d):
    return frags(spark, d).orderBy(F.col("length").desc(), "frag_id", "start").limit(100).select("frag_id", "length")


@query(with_sql("fragments", body="SELECT sample_id, 'low' AS part, count(*) AS n FROM fragments WHERE gc_pct < 50 GROUP BY ALL UNION ALL SELECT sample_id, 'high', count(*) FROM fragments WHERE gc_pct >= 50 GROUP BY ALL"))
def t6_union_samples(spark, d):
    part = lambda name, cond: frags(spark, d).where(cond).groupBy("sample_id").agg(F.count("*").alias("n")).select("sample_id", F.lit(name).alias("part"), "n")
    return part("low", "gc_pct < 50").unionByName(part("high", "gc_pct >= 50"))


@query(with_sql("genes", "regions", body="SELECT chrom FROM genes WHERE nation < 10 INTERSECT SELECT chrom FROM regions"))
def t9_intersection(spark, d):
    return genes(spark, d).where("nation < 10").select("chrom").intersect(adapted(spark, d, "regions").select("chrom"))


@query(f"{EXON_SQL} SELECT gene, round(avg(mds), 4) AS mds FROM exons WHERE n_fragments > 1 GROUP BY gene")
def a16_exact_diversity(spark, d):
    return exons(spark, d).where("n_fragments > 1").groupBy("gene").agg(F.round(F.avg("mds"), 4).alias("mds"))


@query(f"SELECT region_idx, {', '.join(f'array_to_string(list(CAST(CAST(round({e}, 1) * 10 AS BIGINT) AS VARCHAR) ORDER BY bin), chr(44)) AS {n}' for n, e in (('wps', 'span - ends'), ('cov', 'cov'), ('prot_frac', 'CASE WHEN span + ends > 0 THEN span / (span + ends) ELSE 0 END')))}, CAST(count(*) AS BIGINT) AS bins FROM ({WPS_SQL}) GROUP BY region_idx")
def k6_vectors(spark, d):
    vectors = P.binned(wps(spark, d)).groupBy("region_idx").agg(F.sort_array(F.collect_list(F.struct("bin", "wps", "cov", "prot_frac"))).alias("v"))  # 200 bins at most
    tenths = lambda c: F.concat_ws(",", F.transform("v", lambda x: F.round(x[c] * 10).cast("bigint").cast("string"))).alias(c)
    return vectors.select("region_idx", tenths("wps"), tenths("cov"), tenths("prot_frac"), F.size("v").cast("bigint").alias("bins"))
