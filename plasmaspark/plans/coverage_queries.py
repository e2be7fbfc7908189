"""Queries: read and fragment filters, interval joins, coverage, size histograms, labelled regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from plasmaspark.functions import expressions as X
from plasmaspark.operators import coverage as C
from plasmaspark.operators import regional as R
from plasmaspark.operators.intervals import as_right, contains_point, overlap
from plasmaspark.plans.register import query
from plasmaspark.sources.adapters import adapted, table, with_sql

TARGETS = 'targets AS (SELECT * FROM genes WHERE nation < 5)'
ARMS = "arms AS (SELECT DISTINCT chrom || arm AS arm, chrom, CASE arm WHEN 'p' THEN 0 ELSE 1000000 END AS \"start\", CASE arm WHEN 'p' THEN 1000000 ELSE 2001000 END AS \"end\" FROM fragments, (VALUES ('p'), ('q')) a(arm))"
CHAN = "CASE WHEN length <= 100 THEN 'ultra_short' WHEN length <= 149 THEN 'core_short' WHEN length <= 220 THEN 'mono_nucl' WHEN length <= 260 THEN 'di_nucl' WHEN length <= 400 THEN 'long' ELSE 'ultra_long' END"
GCHAN = "CASE WHEN length < 100 THEN 'ultra_short' WHEN length < 150 THEN 'core_short' WHEN length < 260 THEN 'mono_nucl' WHEN length < 400 THEN 'di_nucl' ELSE 'long' END"
HIT = 'f.chrom = r.chrom AND f."start" < r."end" AND f."end" > r."start"'


def counts(expr: str, names, what: str = "1") -> str:
    return ", ".join(f"CAST(coalesce(sum(CASE WHEN {expr} = '{n}' THEN {what} ELSE 0 END), 0) AS BIGINT) AS {n}" for n in names)


def frags(spark, d):
    return adapted(spark, d, "fragments")


def genes(spark, d):
    return adapted(spark, d, "genes")


def targets(spark, d):
    return genes(spark, d).where("nation < 5")


def chromosomes(spark, d):
    """The fragments' chromosomes, from the table that their keys refer to."""
    return table(spark, d, "supplier").select((1 + F.col("s_suppkey") % 22).cast("string").alias("chrom")).distinct()


def arms(spark, d):
    chroms = chromosomes(spark, d)
    arm = F.explode(F.array(F.struct(F.lit("p").alias("a"), F.lit(0).alias("start"), F.lit(1000000).alias("end")), F.struct(F.lit("q").alias("a"), F.lit(1000000).alias("start"), F.lit(2001000).alias("end"))))
    return chroms.select("chrom", arm.alias("x")).select(F.concat("chrom", "x.a").alias("arm"), "chrom", "x.start", "x.end")


BINS = """bins AS (SELECT row_number() OVER (ORDER BY CAST(c.chrom AS INT), b.i) AS bin_id, c.chrom, b.i * 50000 AS "start", (b.i + 1) * 50000 AS "end"
 FROM (SELECT DISTINCT chrom FROM fragments) c, (SELECT unnest(generate_series(0, 40)) AS i) b)"""


def bins(spark, d):
    chroms = chromosomes(spark, d)
    each = chroms.select("chrom", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(40).cast("bigint"))).alias("i"))
    # 41 bins per chromosome: the numbering follows from the chromosome's rank
    rank = chroms.select("chrom", (F.dense_rank().over(C.Window.orderBy(F.col("chrom").cast("int"))) - 1).cast("bigint").alias("rank"))
    return each.join(F.broadcast(rank), "chrom").select((F.col("rank") * 41 + F.col("i") + 1).alias("bin_id"), "chrom", (F.col("i") * 50000).alias("start"), ((F.col("i") + 1) * 50000).alias("end"))


FSC_SQL = with_sql("fragments", body=f"""SELECT b.bin_id, b.chrom, b."start", b."end", {counts(f"CASE WHEN length IS NULL THEN NULL ELSE {CHAN} END", C.SIX)},
 count(f.frag_id) AS total, round(coalesce(sum(gc_pct) / nullif(count(f.frag_id), 0) / 100.0, 0), 6) AS mean_gc
 FROM bins b LEFT JOIN (SELECT * FROM fragments WHERE length BETWEEN 65 AND 1000) f ON f.chrom = b.chrom AND f."start" < b."end" AND f."end" > b."start" GROUP BY ALL""").replace(" SELECT b.bin_id", f", {BINS} SELECT b.bin_id", 1)


@query(FSC_SQL)
def a1_fsc_bins(spark, d):
    return C.fsc_bins(frags(spark, d), bins(spark, d), "bin_id").withColumn("mean_gc", F.round("mean_gc", 6))


@query(with_sql("fragments", body=f"""SELECT chrom, t AS tile, {counts(CHAN, C.SIX)}, count(*) AS total FROM (SELECT *, unnest(generate_series("start" // 100000, ("end" - 1) // 100000)) AS t FROM fragments WHERE length BETWEEN 65 AND 1000) GROUP BY ALL"""))
def j1_fsc_tiles(spark, d):
    return C.fsc_tiles(frags(spark, d), 100000).drop("gc_sum")


@query(with_sql("fragments", body=f"SELECT {CHAN} AS channel, count(*) AS n FROM fragments GROUP BY ALL"))
def f8_size_channel(spark, d):
    return frags(spark, d).groupBy(X.size_channel(F.col("length")).alias("channel")).agg(F.count("*").alias("n"))


@query(with_sql("fragments", body=f"SELECT {GCHAN} AS channel, count(*) AS n FROM fragments GROUP BY ALL"))
def f9_gene_channel(spark, d):
    return frags(spark, d).groupBy(X.gene_channel(F.col("length")).alias("channel")).agg(F.count("*").alias("n"))


@query(with_sql("fragments", body="SELECT CASE WHEN length BETWEEN 65 AND 150 THEN 'short' WHEN length BETWEEN 151 AND 260 THEN 'intermediate' WHEN length BETWEEN 261 AND 400 THEN 'long' END AS channel, count(*) AS n FROM fragments GROUP BY ALL"))
def f10_legacy_channel(spark, d):
    return frags(spark, d).groupBy(X.legacy_channel(F.col("length")).alias("channel")).agg(F.count("*").alias("n"))


def _read_sql(bits: int, extra: str = "") -> str:
    return with_sql("fragments", body=f"SELECT chrom, count(*) AS n FROM fragments WHERE (flag & {bits}) = 0 AND mapq >= 20 AND length BETWEEN 65 AND 1000 {extra} GROUP BY ALL")


@query(_read_sql(0x4 | 0x100 | 0x800 | 0x200 | 0x400, "AND (flag & 3) = 3"))
def f1_read_filter(spark, d):
    return frags(spark, d).where(X.read_filter(F.col("flag"), F.col("mapq"), F.col("length"))).groupBy("chrom").agg(F.count("*").alias("n"))


@query(_read_sql(0x4 | 0x100 | 0x800 | 0x200 | 0x400, "AND (flag & 64) = 64"))
def f2_mds_read_filter(spark, d):
    kept = X.read_filter(F.col("flag"), F.col("mapq"), F.col("length"), proper=False) & (F.col("flag").bitwiseAND(F.lit(X.MATE1)) != 0)
    return frags(spark, d).where(kept).groupBy("chrom").agg(F.count("*").alias("n"))


@query(_read_sql(0x4 | 0x100 | 0x800 | 0x400))
def f2_uxm_read_filter(spark, d):
    kept = X.read_filter(F.col("flag"), F.col("mapq"), F.col("length"), proper=False, check_qc=False)
    return frags(spark, d).where(kept).groupBy("chrom").agg(F.count("*").alias("n"))


@query(with_sql("fragments", body='SELECT frag_id, "start" AS s, "start" + abs(length) AS e FROM fragments WHERE (flag & 64) = 64'))
def f3_fragment_projection(spark, d):
    return frags(spark, d).where(F.col("flag").bitwiseAND(F.lit(X.MATE1)) != 0).select("frag_id", F.col("start").alias("s"), (F.col("start") + F.abs("length")).alias("e"))


@query(with_sql("fragments", "blacklist", body=f"SELECT frag_id FROM fragments f WHERE NOT EXISTS (SELECT 1 FROM blacklist r WHERE {HIT})"))
def f4_blacklist_anti(spark, d):
    return overlap(frags(spark, d), as_right(adapted(spark, d, "blacklist")), "left_anti").select("frag_id")


@query(with_sql("fragments", "genes", body=f", {TARGETS} SELECT on_target, count(*) AS n, CAST(sum(length) AS BIGINT) AS bp FROM (SELECT length, EXISTS (SELECT 1 FROM targets r WHERE {HIT}) AS on_target FROM fragments f) GROUP BY ALL").replace(" , targets", ", targets"))
def f5_on_target(spark, d):
    return C.flag_on_target(frags(spark, d), targets(spark, d)).groupBy("on_target").agg(F.count("*").alias("n"), F.sum("length").alias("bp"))


@query(with_sql("fragments", "genes", body=f", {TARGETS} SELECT frag_id FROM fragments f WHERE EXISTS (SELECT 1 FROM targets r WHERE {HIT})").replace(" , targets", ", targets"))
def f6_valid_regions_semi(spark, d):
    return overlap(frags(spark, d), as_right(targets(spark, d)), "left_semi").select("frag_id")


@query(with_sql("fragments", body="SELECT count_if(length BETWEEN 65 AND 1000) AS fsc, count_if(length >= 65 AND length < 400) AS fsd, count_if(length >= 60 AND length < 1000) AS gc FROM fragments"))
def f7_length_windows(spark, d):
    n = F.col("length")
    return frags(spark, d).agg(F.count_if(n.between(65, 1000)).alias("fsc"), F.count_if((n >= 65) & (n < 400)).alias("fsd"), F.count_if((n >= 60) & (n < 1000)).alias("gc"))


@query("SELECT c_custkey AS id FROM customer WHERE CASE c_custkey % 27 WHEN 23 THEN 'X' WHEN 24 THEN 'Y' WHEN 25 THEN 'M' WHEN 26 THEN 'Un' ELSE CAST(c_custkey % 27 AS VARCHAR) END IN ('1','2','3','4','5','6','7','8','9','10','11','12','13','14','15','16','17','18','19','20','21','22','X','Y')")
def f11_chrom_whitelist(spark, d):
    k = F.col("c_custkey") % 27
    chrom = F.concat(F.lit("chr"), F.when(k == 23, "X").when(k == 24, "Y").when(k == 25, "M").when(k == 26, "Un").otherwise(k.cast("string")))
    return table(spark, d, "customer").where(X.main_chromosome(chrom)).select(F.col("c_custkey").alias("id"))


@query("SELECT p_partkey AS id FROM part WHERE NOT regexp_matches(lower(CASE p_size % 5 WHEN 0 THEN 'FP_' WHEN 1 THEN 'MSI_' WHEN 2 THEN 'BAT-' ELSE 'exon_' END || p_name), '^(fp_|snp_fp_|msi_|bat-)')")
def f12_gene_probe(spark, d):
    k = F.col("p_size") % 5
    name = F.concat(F.when(k == 0, "FP_").when(k == 1, "MSI_").when(k == 2, "BAT-").otherwise("exon_"), "p_name")
    return table(spark, d, "part").where(X.gene_probe(name)).select(F.col("p_partkey").alias("id"))


@query("SELECT c_custkey AS id FROM customer WHERE instr(lower(c_name), lower('#00000001')) > 0")
def f13_maf_sample_filter(spark, d):
    return table(spark, d, "customer").where(F.instr(F.lower("c_name"), "#00000001") > 0).select(F.col("c_custkey").alias("id"))


@query(with_sql("variants", body="SELECT variant_id FROM variants WHERE regexp_matches(CASE WHEN variant_id % 11 = 0 THEN alt || '<' ELSE alt END, '^[ACGTNacgtn-]+$')"))
def f14_valid_allele(spark, d):
    alt = F.when(F.col("variant_id") % 11 == 0, F.concat("alt", F.lit("<"))).otherwise(F.col("alt"))
    return adapted(spark, d, "variants").where(X.valid_allele(alt)).select("variant_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 20")
def f15_base_quality_gate(spark, d):
    return table(spark, d, "lineitem").where("l_quantity >= 20").select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey AS id, CASE WHEN p_name LIKE 'a%' THEN 'AluY' ELSE 'AluS' END AS family FROM part WHERE 200 + p_partkey % 200 BETWEEN 280 AND 320")
def f17_alu_filter(spark, d):
    size = 200 + F.col("p_partkey") % 200
    return table(spark, d, "part").where(size.between(280, 320)).select(F.col("p_partkey").alias("id"), F.when(F.col("p_name").startswith("a"), "AluY").otherwise("AluS").alias("family"))


@query(with_sql("fragments", "genes", body=f"""SELECT g.gene, {', '.join(f'coalesce(s.{c}, 0) AS {c}' for c in C.FIVE)}, coalesce(s.total, 0) AS total, {', '.join(f'round(coalesce(s.{c}, 0) / greatest(coalesce(s.total, 0), 1e-9), 4) AS {c}_ratio' for c in C.FIVE)}, round(coalesce(s.total, 0) * 1e9 / (g.bp * n.n), 4) AS depth
 FROM (SELECT gene, sum("end" - "start") AS bp FROM genes GROUP BY gene) g LEFT JOIN (SELECT r.gene, {counts(GCHAN, C.FIVE)}, count(*) AS total FROM fragments f JOIN genes r ON f.chrom = r.chrom AND (f."start" + f."end") // 2 >= r."start" AND (f."start" + f."end") // 2 < r."end" WHERE length BETWEEN 65 AND 1000 GROUP BY r.gene) s USING (gene), (SELECT count(*) AS n FROM fragments WHERE length BETWEEN 65 AND 1000) n"""))
def a3_fsc_genes(spark, d):
    out = C.fsc_genes(frags(spark, d), genes(spark, d), ["gene"])
    return out.select("gene", *C.FIVE, "total", *[F.round(f"{c}_ratio", 4).alias(f"{c}_ratio") for c in C.FIVE], F.round("depth", 4).alias("depth"))


@query(with_sql("fragments", "genes", body='SELECT frag_id, gene_idx FROM fragments f JOIN genes r ON f.chrom = r.chrom AND (f."start" + f."end") // 2 >= r."start" AND (f."start" + f."end") // 2 < r."end"'))
def j7_midpoint_join(spark, d):
    return contains_point(frags(spark, d), as_right(genes(spark, d)), F.expr("(start + end) div 2")).select("frag_id", "gene_idx")


@query(with_sql("fragments", "genes", body='SELECT frag_id, gene_idx FROM fragments f JOIN genes r ON f.chrom = r.chrom AND f."start" < r."end" AND f."end" + 1 > r."start" WHERE (flag & 64) = 64'))
def j8_closed_end_join(spark, d):
    reads = frags(spark, d).where("(flag & 64) = 64").withColumn("end", F.col("end") + 1)
    return overlap(reads, as_right(genes(spark, d)), longest=1001).select("frag_id", "gene_idx")


@query(with_sql("genes", "regions", body=f", {TARGETS} SELECT region_idx FROM regions f WHERE EXISTS (SELECT 1 FROM targets r WHERE {HIT})").replace(" , targets", ", targets"))
def j11_regions_on_target(spark, d):
    return overlap(adapted(spark, d, "regions"), as_right(targets(spark, d)), "left_semi").select("region_idx")


@query(with_sql("fragments", "variants", body='SELECT variant_id, frag_id FROM fragments f JOIN variants v ON f.chrom = v.chrom AND f."start" <= v.pos AND f."end" > v.pos'))
def j12_point_in_read(spark, d):
    sites = adapted(spark, d, "variants").select("variant_id", "chrom", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"))
    return overlap(frags(spark, d), as_right(sites)).select("variant_id", "frag_id")


@query(with_sql("fragments", "regions", body=f'SELECT r.region_idx, count(f.frag_id) AS n FROM regions r LEFT JOIN fragments f ON {HIT} GROUP BY ALL'))
def j13_markers_left_outer(spark, d):
    marks = adapted(spark, d, "regions")
    n = overlap(frags(spark, d), as_right(marks)).groupBy("region_idx").agg(F.count("*").alias("n"))
    return marks.select("region_idx").join(n, "region_idx", "left").fillna(0, ["n"])


@query(with_sql("fragments", "regions", body='SELECT frag_id, region_idx FROM fragments f JOIN regions r ON f.chrom = r.chrom AND f."start" < r."end" + 60 AND f."end" > r."start" - 60'))
def j5_slack_join(spark, d):
    return overlap(frags(spark, d), as_right(adapted(spark, d, "regions")), slack=60).select("frag_id", "region_idx")


@query(with_sql("fragments", "regions", body=f"""SELECT grp, count(*) AS n FROM (SELECT unnest(['Global_All', 'Family_' || split_part(r.label, ' ', 1), 'Chr' || r.chrom || '_All']) AS grp FROM fragments f JOIN regions r ON {HIT}) GROUP BY ALL"""))
def j6_alu_fan_out(spark, d):
    hits = overlap(frags(spark, d), as_right(adapted(spark, d, "regions")).withColumn("c", F.col("r_chrom")))
    groups = F.array(F.lit("Global_All"), F.concat(F.lit("Family_"), F.split_part("label", F.lit(" "), F.lit(1))), F.concat(F.lit("Chr"), "c", F.lit("_All")))
    return hits.select(F.explode(groups).alias("grp")).groupBy("grp").agg(F.count("*").alias("n"))


@query(with_sql("genes", body='SELECT gene, gene_idx, "start" AS s FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY "start", gene_idx) AS rn FROM genes) WHERE rn = 1'))
def owin2_first_exon(spark, d):
    return C.first_exons(genes(spark, d), ["start", "gene_idx"]).select("gene", "gene_idx", F.col("start").alias("s"))


@query(with_sql("fragments", body=f"""SELECT chrom, win, min("start") AS s, max("end") AS e, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in (*C.SIX, 'total'))} FROM (SELECT *, (row_number() OVER (PARTITION BY chrom ORDER BY bin_id) - 1) // 10 AS win FROM ({FSC_SQL})) GROUP BY ALL HAVING count(*) = 10"""))
def owin1_window_roll_up(spark, d):
    rolled = C.roll_up(C.fsc_bins(frags(spark, d), bins(spark, d), "bin_id"), "bin_id", (*C.SIX, "total"), 10)
    return rolled.withColumnsRenamed({"start": "s", "end": "e"})


@query(f"""SELECT bin_id, short_n, long_n, round(ratio, 4) AS ratio, round(CASE WHEN ratio > 0 THEN log2(ratio) ELSE 0 END, 4) AS log_ratio, round(short_n / greatest(total, 1), 4) AS short_share, round(long_n / greatest(total, 1), 4) AS long_share FROM (SELECT *, CASE WHEN long_n > 0 THEN short_n / long_n ELSE short_n END AS ratio FROM (SELECT bin_id, total, ultra_short + core_short AS short_n, di_nucl + "long" AS long_n FROM ({FSC_SQL})))""")
def n17_fsr(spark, d):
    out = C.size_ratios(C.fsc_bins(frags(spark, d), bins(spark, d), "bin_id"))
    return out.select("bin_id", "short_n", "long_n", *[F.round(c, 4).alias(c) for c in ("ratio", "log_ratio", "short_share", "long_share")])


FSD_SQL = with_sql("fragments", body=f", {ARMS} SELECT r.arm, CAST((length - 65) // 5 AS INT) AS size_bin, count(*) AS n FROM fragments f JOIN arms r ON {HIT} WHERE length >= 65 AND length < 400 GROUP BY ALL").replace(" , arms", ", arms")


@query(FSD_SQL)
def a4_fsd_histogram(spark, d):
    return C.fsd_long(frags(spark, d), arms(spark, d), "arm")


@query(f"SELECT arm, {', '.join(f'CAST(coalesce(sum(n) FILTER (size_bin = {i}), 0) AS BIGINT) AS \"{65 + 5 * i}-{69 + 5 * i}\"' for i in range(67))}, CAST(sum(n) AS BIGINT) AS total FROM ({FSD_SQL}) GROUP BY arm")
def k5_fsd_wide(spark, d):
    return C.fsd_wide(C.fsd_long(frags(spark, d), arms(spark, d), "arm"), "arm")


@query(f"SELECT arm, size_bin, round(CASE WHEN e > 0 THEN log2((n + 1) / (e + 1)) ELSE 0 END, 4) AS logratio FROM (SELECT *, avg(n) OVER (PARTITION BY size_bin) AS e FROM ({FSD_SQL}))")
def n18_fsd_log_ratio(spark, d):
    h = C.fsd_long(frags(spark, d), arms(spark, d), "arm")
    base = h.groupBy("size_bin").agg(F.avg("n").alias("e"))
    return h.join(base, "size_bin").select("arm", "size_bin", F.round(C.log_ratio(F.col("n"), F.col("e")), 4).alias("logratio"))


OCF_SQL = with_sql("fragments", "regions", body=f"""SELECT label, side, least(pos, 2000) AS pos, count(*) AS n FROM (SELECT label, 'left' AS side, f."start" - r."start" AS pos FROM fragments f JOIN regions r ON {HIT} WHERE f."start" >= r."start" UNION ALL SELECT label, 'right', f."end" - r."start" + 1 FROM fragments f JOIN regions r ON {HIT} WHERE f."end" <= r."end") GROUP BY ALL""")


@query(OCF_SQL)
def a5_ocf_positions(spark, d):
    return R.ocf_positions(frags(spark, d), adapted(spark, d, "regions"))


@query(f"""SELECT label, round(sum(CASE WHEN pos >= 2000 THEN 0 WHEN pos - 1000 BETWEEN -70 AND -50 THEN CASE side WHEN 'right' THEN n ELSE -n END WHEN pos - 1000 BETWEEN 50 AND 70 THEN CASE side WHEN 'left' THEN n ELSE -n END ELSE 0 END / (t / 10000.0)), 4) AS ocf FROM (SELECT *, sum(n) OVER (PARTITION BY label, side) AS t FROM ({OCF_SQL})) GROUP BY label""")
def a6_ocf_score(spark, d):
    # positions of the adapter's regions (200 to 1000 bp) end below 1001; the sums around +60 need regions of 2000
    return R.ocf_score(R.ocf_positions(frags(spark, d), adapted(spark, d, "regions"))).select("label", F.round("ocf", 4).alias("ocf"))


HIST_SQL = with_sql("fragments", "regions", body=f"SELECT label, least(f.length, 1000) AS size, count(*) AS n FROM fragments f JOIN regions r ON {HIT} GROUP BY ALL")


@query(f"SELECT label, CAST(sum(n) AS BIGINT) AS \"count\", round(sum(size * n) / sum(n), 4) AS mean_size, round(-sum(n / t * log2(n / t)), 4) AS entropy FROM (SELECT *, sum(n) OVER (PARTITION BY label) AS t FROM ({HIST_SQL})) GROUP BY label")
def a7_region_entropy(spark, d):
    h = R.size_histogram(frags(spark, d), adapted(spark, d, "regions"), ["label"])
    return R.entropy(h, ["label"]).select("label", "count", F.round("mean_size", 4).alias("mean_size"), F.round("entropy", 4).alias("entropy"))


@query(f"SELECT label, size, n, round(n / sum(n) OVER (PARTITION BY label), 6) AS proportion FROM ({HIST_SQL})")
def a8_entropy_sync(spark, d):
    h = R.size_histogram(frags(spark, d), adapted(spark, d, "regions"), ["label"])
    return R.proportions(h, ["label"]).withColumn("proportion", F.round("proportion", 6))


@query(with_sql("fragments", "genes", "regions", body=f", {TARGETS}, h AS (SELECT label, on_target, least(length, 1000) AS size FROM (SELECT r.label, f.length, EXISTS (SELECT 1 FROM targets t WHERE f.chrom = t.chrom AND f.\"start\" < t.\"end\" AND f.\"end\" > t.\"start\") AS on_target FROM fragments f JOIN regions r ON {HIT})) SELECT label, CASE WHEN grouping(on_target) = 1 THEN 'all' WHEN on_target THEN 'on' ELSE 'off' END AS part, size, count(*) AS n FROM h GROUP BY GROUPING SETS ((label, size), (label, on_target, size))").replace(" , targets", ", targets"))
def a9_triple_routing(spark, d):
    f = C.flag_on_target(frags(spark, d), targets(spark, d))
    hits = overlap(f, as_right(adapted(spark, d, "regions"))).select("label", "on_target", F.least("length", F.lit(1000)).alias("size"))
    part = F.when(F.grouping("on_target") == 1, "all").when(F.col("on_target"), "on").otherwise("off")
    sets = hits.groupingSets([[F.col("label"), F.col("size")], [F.col("label"), F.col("on_target"), F.col("size")]], F.col("label"), F.col("on_target"), F.col("size"))
    return sets.agg(part.alias("part"), F.count("*").alias("n")).select("label", "part", "size", "n")
