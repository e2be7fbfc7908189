"""Queries: line formats, sinks' shapes, reference work and ordering, on lines made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plasmaspark.functions import expressions as X
from plasmaspark.operators import coverage as C
from plasmaspark.operators import gc as G
from plasmaspark.operators import motifs as M
from plasmaspark.operators import reference as E
from plasmaspark.operators.intervals import as_right, contains_point
from plasmaspark.plans.coverage_queries import CHAN, TARGETS, frags, genes, targets
from plasmaspark.plans.feature_queries import DENSE_SQL, SEQ_SQL, reads
from plasmaspark.plans.register import query
from plasmaspark.sources import sinks, text
from plasmaspark.sources.adapters import adapted, table, with_sql


def gene_lines(spark, d, *columns: str):
    """BED lines of the genes; every seventh has a bad start, every eleventh is a comment."""
    value = F.when(F.col("gene_idx") % 11 == 0, "# comment").otherwise(F.concat_ws("\t", F.concat(F.lit("chr"), "chrom"), F.when(F.col("gene_idx") % 7 == 0, "x").otherwise(F.col("start").cast("string")), F.col("end").cast("string"), *[F.expr(c) for c in columns]))
    return genes(spark, d).select(value.alias("value"), F.col("gene_idx").alias("index"))


OK = "gene_idx % 11 <> 0 AND gene_idx % 7 <> 0"


@query(with_sql("genes", body=f"SELECT chrom, \"start\" AS s, \"end\" AS e, \"end\" - \"start\" AS length, CASE WHEN gene_idx % 5 = 0 THEN 0.0 ELSE CAST(nation AS DOUBLE) END AS gc FROM genes WHERE {OK}"))
def s2_fragment_scan(spark, d):
    found = text.fragments(gene_lines(spark, d, "if(gene_idx % 5 = 0, 'bad', cast(nation as string))"))
    return found.withColumnsRenamed({"start": "s", "end": "e"})


@query(with_sql("genes", body=f'SELECT gene_idx AS "index", chrom, "start" AS s, "end" AS e FROM genes WHERE {OK}'))
def s3_region_scan(spark, d):
    return text.regions(gene_lines(spark, d)).withColumnsRenamed({"start": "s", "end": "e"})


@query(with_sql("genes", body=f"SELECT gene_idx, gene, CASE WHEN gene_idx % 2 = 0 THEN 'n' || CAST(gene_idx AS VARCHAR) ELSE gene END AS name FROM genes WHERE {OK}"))
def s5_gene_scan(spark, d):
    found = text.gene_regions(gene_lines(spark, d, "gene", "if(gene_idx % 2 = 0, concat('n', gene_idx), null)"))
    return found.select(F.col("index").alias("gene_idx"), "gene", "name")


@query(with_sql("genes", body=f"SELECT gene_idx, gene, CASE WHEN gene_idx % 2 = 0 THEN gene || ':exon' || CAST(nation AS VARCHAR) ELSE 'p' END AS name, CASE WHEN gene_idx % 2 = 0 THEN '-' ELSE '.' END AS strand FROM genes WHERE {OK}"))
def s6_exon_scan(spark, d):
    found = text.exon_regions(gene_lines(spark, d, "gene", "if(gene_idx % 2 = 0, cast(nation as string), 'p')", "if(gene_idx % 2 = 0, '-', null)", "if(gene_idx % 2 = 0, '0', null)", "if(gene_idx % 2 = 0, '0', null)"))
    return found.select(F.col("index").alias("gene_idx"), "gene", "name", "strand")


@query(with_sql("genes", body=f"SELECT gene_idx, gene FROM genes WHERE {OK} AND nation % 5 <> 0"))
def s7_panel_scan(spark, d):
    lines = gene_lines(spark, d, "if(nation % 5 = 0, 'FP_1', concat('exon_', gene, '_1'))")
    return text.panel_targets(lines, text.panel_version(lines)).select(F.col("index").alias("gene_idx"), "gene")


@query(with_sql("genes", body=f"SELECT gene_idx, chrom, greatest((\"start\" + \"end\") // 2 - 1000, 0) AS s, (\"start\" + \"end\") // 2 + 1000 AS e, CASE WHEN gene_idx % 2 = 0 THEN '-' ELSE '+' END AS strand FROM genes WHERE {OK}"))
def s8_anchor_scan(spark, d):
    found = text.anchors(gene_lines(spark, d, "gene", "'0'", "if(gene_idx % 2 = 0, '-', '+')"))
    return found.select(F.col("index").alias("gene_idx"), "chrom", F.col("start").alias("s"), F.col("end").alias("e"), "strand")


@query(with_sql("genes", body=f"SELECT gene_idx, gene_idx % 2 <> 0 AS plus, gene AS family FROM genes WHERE {OK}"))
def s9_element_scan(spark, d):
    found = text.elements(gene_lines(spark, d, "'n'", "'0'", "if(gene_idx % 2 = 0, '-', '+')", "gene"))
    return found.select(F.col("index").alias("gene_idx"), "plus", "family")


@query(with_sql("genes", body=f"SELECT gene AS label, count(*) AS n FROM genes WHERE {OK} GROUP BY gene"))
def s10_labelled_scan(spark, d):
    return text.labelled(gene_lines(spark, d, "gene")).groupBy("label").agg(F.count("*").alias("n"))


def _vcf_lines(spark, d):
    v = adapted(spark, d, "variants")
    alts = F.when(F.col("variant_id") % 4 == 0, F.concat("alt", F.lit(",C"))).otherwise(F.col("alt"))
    lines = v.select(F.concat_ws("\t", "chrom", (F.col("pos") + 1).cast("string"), F.lit("."), "ref", alts, F.lit("."), F.lit("PASS")).alias("value"), F.col("variant_id").alias("index"))
    return lines


@query(with_sql("variants", body="SELECT chrom, pos, ref, CASE WHEN variant_id % 4 = 0 THEN alt || ',C' ELSE alt END AS alt FROM variants"))
def s14_vcf_scan(spark, d):
    return text.vcf(_vcf_lines(spark, d)).select("chrom", "pos", "ref", "alt")


@query(with_sql("variants", body="SELECT chrom, pos, ref, alt FROM variants UNION ALL SELECT chrom, pos, ref, 'C' FROM variants WHERE variant_id % 4 = 0"))
def s14_vcf_alleles(spark, d):
    return text.vcf(_vcf_lines(spark, d), each=True).select("chrom", "pos", "ref", "alt")


@query(with_sql("variants", body="SELECT chrom, pos, ref, CASE WHEN variant_id % 5 = 0 THEN '' ELSE alt END AS alt FROM variants WHERE variant_id % 7 <> 0"))
def s15_maf_scan(spark, d):
    v = adapted(spark, d, "variants")
    alt = F.when(F.col("variant_id") % 7 == 0, "<DUP>").when(F.col("variant_id") % 5 == 0, "-").otherwise(F.col("alt"))
    rows = v.select(F.concat(F.lit("chr"), "chrom").alias("Chromosome"), (F.col("pos") + 1).cast("string").alias("Start_Position"), F.col("ref").alias("Reference_Allele"), alt.alias("Tumor_Seq_Allele2"))
    return text.maf(rows)


@query("SELECT CAST(p_partkey AS INT) AS length_bin_min, CAST(p_partkey + 4 AS INT) AS length_bin_max, CAST(p_size AS INT) AS gc_pct, CAST(p_size AS DOUBLE) / 4 AS factor FROM part")
def s17_factor_scan(spark, d):
    lines = table(spark, d, "part").select(F.concat_ws("\t", "p_partkey", F.col("p_partkey") + 4, "p_size", F.lit(1), F.lit(1), F.col("p_size") / 4).alias("value"))
    return text.factors(lines)


@query(with_sql("genes", body="SELECT gene_idx FROM genes WHERE gene_idx % 11 <> 0 AND gene_idx % 7 = 0"))
def s24_invalid_lines(spark, d):
    return text.invalid_lines(gene_lines(spark, d, "gene"), "gene", None).select(F.col("index").alias("gene_idx"))


@query(with_sql("fragments", body="SELECT count(*) AS reads, round(avg(CASE WHEN (flag & 3844) = 0 AND mapq >= 20 AND length BETWEEN 65 AND 1000 AND (flag & 3) = 3 THEN 1 ELSE 0 END), 4) AS rate FROM fragments"))
def s25_pass_rate(spark, d):
    f = frags(spark, d)
    out = text.pass_rate(f, X.read_filter(F.col("flag"), F.col("mapq"), F.col("length")), sample=2_000_000_000)
    return out.select("reads", F.round("rate", 4).alias("rate"))


# ---- reference ----


@query(with_sql("blacklist", body="""SELECT chrom, i * 100000 AS s, (i + 1) * 100000 AS e FROM (SELECT CAST(1 + g.i AS VARCHAR) AS chrom FROM generate_series(0, 21) g(i)) c, generate_series(0, 18) t(i) WHERE NOT EXISTS (SELECT 1 FROM blacklist b WHERE b.chrom = c.chrom AND b."start" < (t.i + 1) * 100000 AND b."end" > t.i * 100000)"""))
def a35_valid_regions(spark, d):
    chroms = spark.range(22).select((F.col("id") + 1).cast("string").alias("chrom"), F.lit(1_990_000).cast("bigint").alias("length"))
    return E.valid_regions(chroms, adapted(spark, d, "blacklist")).withColumnsRenamed({"start": "s", "end": "e"})


@query(f"WITH {SEQ_SQL} SELECT CAST((L.l - 60) // 5 AS INT) AS length_bin, CAST(round(length(regexp_replace(part, '[^GC]', '', 'g')) / L.l * 100) AS INT) AS gc_pct, count(*) AS n FROM (VALUES (62), (167)) L(l), LATERAL (SELECT seq[i + 1:i + L.l] AS part FROM (SELECT seq, unnest(generate_series(0, length(seq) - L.l, 100)) AS i FROM reads WHERE length(seq) >= L.l)) GROUP BY ALL")
def a34_theoretical_gc(spark, d):
    return E.theoretical_gc(reads(spark, d).select("seq"), [62, 167])


@query(f"WITH {SEQ_SQL} SELECT kmer, count(*) AS n FROM (SELECT CASE WHEN plus THEN seq[7:8] || seq[9:10] ELSE reverse(translate(seq[15:16] || seq[1:2], 'ACGT', 'TGCA')) END AS kmer FROM reads WHERE length(seq) >= 16) GROUP BY kmer")
def a11_breakpoint_motifs(spark, d):
    r = reads(spark, d).where(F.length("seq") >= 16)
    return E.breakpoint_motifs(r.select("plus", F.substring("seq", 1, 8).alias("before"), F.substring("seq", 9, 8).alias("after")))


@query(with_sql("fragments", "genes", body=f", {TARGETS} SELECT round(avg(CASE WHEN EXISTS (SELECT 1 FROM targets r WHERE f.chrom = r.chrom AND (f.\"start\" + f.\"end\") // 2 >= r.\"start\" AND (f.\"start\" + f.\"end\") // 2 < r.\"end\") THEN 1.0 ELSE 0.0 END), 6) AS rate FROM fragments f").replace(" , targets", ", targets"))
def a36_on_target_rate(spark, d):
    f = frags(spark, d)
    hits = contains_point(f, as_right(targets(spark, d).select("chrom", "start", "end")), F.expr("(start + end) div 2"), "left_semi").agg(F.count("*").alias("hits"))
    return f.agg(F.count("*").alias("n")).join(F.broadcast(hits)).select(F.round(F.col("hits") / F.col("n"), 6).alias("rate"))


@query(with_sql("genes", body="SELECT gene, count(*) AS regions FROM genes GROUP BY gene"))
def a37_gene_counts(spark, d):
    return genes(spark, d).groupBy("gene").agg(F.count("*").alias("regions"))


CALLS = "SELECT o_orderkey AS id, o_orderkey % 3 AS k, 100 + o_custkey % 60 AS v_pos, CASE o_orderkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'AC' WHEN 2 THEN 'A' ELSE 'ACG' END AS ref, CASE o_orderkey % 4 WHEN 0 THEN 'C' WHEN 1 THEN 'GT' WHEN 2 THEN 'AC' ELSE 'A' END AS alt FROM orders"


@query(f"""SELECT id, CASE WHEN k = 1 THEN CASE WHEN p < 20 THEN p WHEN p < 50 THEN p + 2 END WHEN k = 2 THEN CASE WHEN p < 20 THEN p WHEN p >= 22 AND p < 52 THEN p - 2 END ELSE CASE WHEN p < 50 THEN p + 3 END END AS at, CASE WHEN k = 1 AND p = 19 THEN 2 ELSE 0 END AS ins, CASE WHEN k = 2 AND p = 19 THEN 2 ELSE 0 END AS del FROM (SELECT *, v_pos - 100 AS p FROM ({CALLS}))""")
def n10_cigar_walk(spark, d):
    ops = lambda s: F.array(*[F.struct(F.lit(o).alias("op"), F.lit(n).alias("len")) for o, n in s])
    k = F.col("o_orderkey") % 3
    cigar = F.when(k == 1, ops([("M", 20), ("I", 2), ("M", 30)])).when(k == 2, ops([("M", 20), ("D", 2), ("M", 30)])).otherwise(ops([("S", 3), ("M", 50)]))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), cigar.alias("cigar"), F.lit(100).alias("pos"), (100 + F.col("o_custkey") % 60).alias("v"))
    c, p, v = F.col("cigar"), F.col("pos"), F.col("v")
    return rows.select("id", E.read_offset(c, p, v).alias("at"), E.indel_after(c, p, v, "I").cast("int").alias("ins"), E.indel_after(c, p, v, "D").cast("int").alias("del"))


_READ_AT = lambda p: f"CASE WHEN k = 1 THEN CASE WHEN {p} < 20 THEN {p} WHEN {p} < 50 THEN {p} + 2 END WHEN k = 2 THEN CASE WHEN {p} < 20 THEN {p} WHEN {p} >= 22 AND {p} < 52 THEN {p} - 2 END ELSE CASE WHEN {p} < 50 THEN {p} + 3 END END"


@query(f"""SELECT id, CASE WHEN form = 2 THEN CASE WHEN k = 1 AND abs(19 - p) <= 5 THEN 'ALT' ELSE 'REF' END WHEN form = 3 AND k = 2 AND abs(19 - p) <= 5 THEN 'ALT' WHEN block = ref THEN 'REF' WHEN block = alt THEN 'ALT' ELSE 'NonREF' END AS class
 FROM (SELECT *, CASE WHEN form = 0 THEN b0 WHEN form = 1 THEN b0 || b1 WHEN form = 2 THEN CASE WHEN k = 1 AND abs(19 - p) <= 5 THEN 'ACG' ELSE b0 END WHEN k = 2 AND abs(19 - p) <= 5 THEN 'A' ELSE b0 || b1 || b2 END AS block
 FROM (SELECT *, {', '.join(f"('CGTA')[1 + ({_READ_AT(f'(p + {i})')}) % 4] AS b{i}" for i in range(3))} FROM (SELECT o_orderkey AS id, o_orderkey % 3 AS k, o_orderkey % 4 AS form, o_custkey % 60 AS p, (['A', 'AC', 'A', 'ACG'])[1 + o_orderkey % 4] AS ref, (['C', 'GT', 'ACG', 'A'])[1 + o_orderkey % 4] AS alt FROM orders))) WHERE block IS NOT NULL""")
def n10_calls(spark, d):
    ops = lambda s: F.array(*[F.struct(F.lit(o).alias("op"), F.lit(n).alias("len")) for o, n in s])
    k, form = F.col("o_orderkey") % 3, (F.col("o_orderkey") % 4).cast("int")
    cigar = F.when(k == 1, ops([("M", 20), ("I", 2), ("M", 30)])).when(k == 2, ops([("M", 20), ("D", 2), ("M", 30)])).otherwise(ops([("S", 3), ("M", 50)]))
    allele = lambda *names: F.get(F.array(*map(F.lit, names)), form)
    reads = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), cigar.alias("cigar"), F.lit(100).alias("pos"), F.lit("CGTA" * 14).alias("seq"), (100 + F.col("o_custkey") % 60).alias("v_pos"), allele("A", "AC", "A", "ACG").alias("ref"), allele("C", "GT", "ACG", "A").alias("alt"))
    return E.classify_calls(reads).select("id", "class")


# ---- shapes of sinks, ordering ----


@query(with_sql("genes", body='SELECT gene_idx, row_number() OVER (ORDER BY CAST(chrom AS INT), "start", "end", gene_idx) AS place FROM genes'))
def t2_natural_order(spark, d):
    from pyspark.sql import Window

    return genes(spark, d).select("gene_idx", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*X.natural_order(F.col("chrom")), "start", "end", "gene_idx")).cast("bigint").alias("place"))


@query(with_sql("genes", "regions", body="SELECT name, min(src) AS src FROM (SELECT gene AS name, 'a' AS src FROM genes UNION ALL SELECT label, 'b' FROM regions) GROUP BY name"))
def t7_union_distinct(spark, d):
    both = genes(spark, d).select(F.col("gene").alias("name"), F.lit("a").alias("src")).unionAll(adapted(spark, d, "regions").select(F.col("label").alias("name"), F.lit("b").alias("src")))
    return both.groupBy("name").agg(F.min("src").alias("src"))


@query(with_sql("fragments", body="SELECT sample_id, count(DISTINCT length) AS sizes FROM fragments GROUP BY sample_id"))
def t8_key_union(spark, d):
    return frags(spark, d).groupBy("sample_id").agg(F.count_distinct("length").alias("sizes"))


@query(f"SELECT CAST(count(*) AS BIGINT) AS n, round(sum(share), 4) AS total FROM ({DENSE_SQL})")
def k1_dense_table(spark, d):
    return M.dense(M.end_motifs(reads(spark, d))).agg(F.count("*").alias("n"), F.round(F.sum("share"), 4).alias("total"))


@query()
def k8_feature_document(spark, d):
    by_sample = frags(spark, d).groupBy("sample_id", X.size_channel(F.col("length")).alias("channel")).agg(F.count("*").alias("n"))
    size = frags(spark, d).groupBy("sample_id").agg(F.avg("length").alias("mean_size"))
    return sinks.feature_document("sample_id", fsc=by_sample, size=size)


@query(with_sql("fragments", body="SELECT CAST(sample_id AS VARCHAR) AS sample_id, count(*) AS total_fragments, 'hg19' AS genome, '' AS assay, false AS panel_mode, '' AS target_regions, round(avg(length), 4) AS mean_length, 20 AS filters_mapq, 65 AS filters_min_length, 1000 AS filters_max_length, false AS gc_correction_computed FROM fragments GROUP BY sample_id"))
def k9_sample_metadata(spark, d):
    """The metadata rows but for the time at which they are made."""
    rows = sinks.metadata(frags(spark, d).withColumn("sample_id", F.col("sample_id").cast("string")), F.col("sample_id"), genome="GRCh37")
    return rows.withColumn("mean_length", F.round("mean_length", 4)).drop("timestamp")


@query("SELECT CAST((p_partkey % 1000 - 60) // 5 AS INT) AS length_bin, CAST(p_size AS INT) AS gc_pct, CAST(max(p_partkey) AS BIGINT) AS n FROM part WHERE p_partkey % 1000 >= 60 GROUP BY ALL")
def s16_gc_reference_scan(spark, d):
    stored = table(spark, d, "part").groupBy((F.col("p_partkey") % 1000 - (F.col("p_partkey") % 1000) % 5).alias("length_bin_min"), F.col("p_size").alias("gc_percent")).agg(F.max("p_partkey").alias("expected_count"))
    return G.reference_counts(stored)


@query(with_sql("fragments", body=f"SELECT chrom, t AS tile, {', '.join(f"CAST(count(*) FILTER ({CHAN} = '{c}') AS INT) AS {c}" for c in C.SIX)}, CAST(count(*) AS INT) AS total FROM (SELECT *, unnest(generate_series(\"start\" // 100000, (\"end\" - 1) // 100000)) AS t FROM fragments WHERE length BETWEEN 65 AND 1000) GROUP BY ALL"))
def a2_fsc_truncated(spark, d):
    return C.fsc_tiles(frags(spark, d), 100000).select("chrom", "tile", *[F.col(c).cast("int").alias(c) for c in (*C.SIX, "total")])
