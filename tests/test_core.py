"""Hand-checked values, random intervals against naive joins, files, and every query against its SQL."""

from __future__ import annotations

import gzip
import math
import random
import struct
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from plasmaspark.functions import expressions as X
from plasmaspark.operators import cohort, coverage, gc, motifs, protection, reference, variants
from plasmaspark.operators.intervals import as_right, contains_point, overlap
from plasmaspark.plans import catalog
from plasmaspark.sources import bam, sinks, text

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def fragments(spark, rows):
    return frame(spark, [(i, "1", s, e, e - s, 50) for i, (s, e) in enumerate(rows)], "frag_id long, chrom string, start long, end long, length long, gc_pct int")


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


# ---- golden values ----


def test_bin_channels(spark):
    bins = frame(spark, [(1, "1", 0, 1000), (2, "1", 5000, 5050)], "bin long, chrom string, start long, end long")
    rows = {r.bin: r for r in coverage.fsc_bins(fragments(spark, [(100, 180), (200, 370), (500, 800)]), bins, "bin").collect()}
    one = rows[1]
    assert (one.ultra_short, one.core_short, one.mono_nucl, one.di_nucl, one.long, one.total) == (1, 0, 1, 0, 1, 3)
    assert (rows[2].total, rows[2].mean_gc) == (0, 0.0)


def test_two_bins(spark):
    bins = frame(spark, [(1, "1", 0, 1000), (2, "1", 1000, 2000)], "bin long, chrom string, start long, end long")
    rows = {r.bin: r for r in coverage.fsc_bins(fragments(spark, [(100, 220), (300, 500), (1200, 1500)]), bins, "bin").collect()}
    assert [(rows[i].total, rows[i].core_short, rows[i].mono_nucl, rows[i].long) for i in (1, 2)] == [(2, 1, 1, 0), (1, 0, 0, 1)]


def test_genes_by_midpoint(spark):
    genes = frame(spark, [("Gene1", "1", 0, 500, "a"), ("Gene2", "1", 600, 1000, "b")], "gene string, chrom string, start long, end long, name string")
    rows = {r.gene: r for r in coverage.fsc_genes(fragments(spark, [(100, 270), (200, 370), (700, 870)]), genes, ["gene"]).collect()}
    assert (rows["Gene1"].total, rows["Gene1"].mono_nucl, rows["Gene2"].total) == (2, 2, 1)


def test_first_exons(spark):
    rows = [("Gene1", 1000), ("Gene1", 500), ("Gene2", 2000), ("Gene2", 1500), ("Gene2", 3000)]
    found = coverage.first_exons(frame(spark, rows, "gene string, start long"), ["start"]).collect()
    assert sorted((r.gene, r.start) for r in found) == [("Gene1", 500), ("Gene2", 1500)]


def test_sequences(spark):
    assert value(spark, X.reverse_complement(F.lit("AACGTn"))) == "NACGTT"
    assert [value(spark, X.kmer_index(F.lit(k), 4)) for k in ("AAAA", "ACGT", "TTTT", "ACGN")] == [0, 27, 255, None]
    assert value(spark, X.gc_fraction(F.lit("GCNNA"))) == pytest.approx(2 / 3)


def test_diversity(spark):
    uniform = frame(spark, [(f"k{i}", 1) for i in range(256)], "kmer string, n long").withColumn("share", F.lit(1 / 256))
    assert uniform.agg(motifs.diversity(F.col("share"), 4, 0.0).alias("v")).first().v == pytest.approx(1)
    one = motifs.dense(frame(spark, [("ACGT", 5)], "kmer string, n long"))
    assert one.count() == 256 and one.agg(motifs.diversity(F.col("share"), 4, 0.0).alias("v")).first().v == 0


@pytest.mark.parametrize(("flag", "mapq", "length", "kept"), [(0x3, 30, 150, True), (0x7, 30, 150, False), (0x403, 30, 150, False), (0x3, 10, 150, False), (0x3, 30, 50, False), (0x203, 30, 150, False), (0x1, 30, 150, False)])
def test_read_filter(spark, flag, mapq, length, kept):
    assert value(spark, X.read_filter(F.lit(flag), F.lit(mapq), F.lit(length))) is kept


def test_baseline_deviation(spark):
    rows = [("a", float(x)) for x in (2, 4, 4, 4, 5, 5, 7, 9)] + [("b", 1.0)]
    out = {r.k: r for r in cohort.baseline(frame(spark, rows, "k string, v double"), ["k"], "v").collect()}
    assert out["a"].std ** 2 == pytest.approx(4.571, abs=1e-3) and out["b"].std == 0.1


def test_interpolation(spark):
    curve = lambda x: value(spark, gc.interpolate(F.lit(x), [0.3, 0.4, 0.5], [0.8, 1.0, 0.8]))
    assert [round(curve(x), 6) for x in (0.4, 0.2, 0.7, 0.35)] == [1.0, 0.8, 0.8, 0.9]


def test_likelihood_prefers_short_for_alt(spark):
    assert value(spark, X.log_likelihood_ratio(F.lit(140))) > 0 > value(spark, X.log_likelihood_ratio(F.lit(170)))


def test_blacklisted_fragment_goes(spark):
    left = overlap(fragments(spark, [(100, 250), (500, 660)]), as_right(frame(spark, [("1", 90, 260)], "chrom string, start long, end long")), "left_anti").collect()
    assert [r.start for r in left] == [500]


# ---- against naive computations ----


@pytest.mark.parametrize("seed", range(3))
def test_interval_joins(spark, seed):
    rng = random.Random(seed)
    left = [(i, str(rng.randrange(3)), s := rng.randrange(30_000), s + rng.randrange(0, 1000)) for i in range(300)]
    right = [(i, str(rng.randrange(3)), s := rng.randrange(30_000), s + rng.choice([0, 5, 300, 9000])) for i in range(80)]
    ldf = frame(spark, left, "i long, chrom string, start long, end long")
    rdf = as_right(frame(spark, right, "j long, chrom string, start long, end long"))
    for slack in (0, 60):
        want = sorted((a[0], b[0]) for a in left for b in right if a[1] == b[1] and a[2] < max(b[3], b[2] + 1) + slack and a[3] > b[2] - slack)
        assert sorted((r.i, r.j) for r in overlap(ldf, rdf, slack=slack).collect()) == want
        assert sorted(r.i for r in overlap(ldf, rdf, "left_semi", slack=slack).collect()) == sorted({i for i, _ in want})
        assert sorted(r.i for r in overlap(ldf, rdf, "left_anti", slack=slack).collect()) == sorted({a[0] for a in left} - {i for i, _ in want})
    want = sorted((a[0], b[0]) for a in left for b in right if a[1] == b[1] and b[2] <= (a[2] + a[3]) // 2 < max(b[3], b[2] + 1))
    assert sorted((r.i, r.j) for r in contains_point(ldf, rdf, F.expr("(start + end) div 2")).collect()) == want


def test_too_long_left_rows_fail(spark):
    with pytest.raises(Exception, match="longer than the join allows"):
        overlap(fragments(spark, [(0, 5000)]), as_right(frame(spark, [("1", 0, 10)], "chrom string, start long, end long"))).collect()


def test_bin_sums_are_exact_in_any_order(spark):
    rng = random.Random(3)
    rows = [(1, 1000, low, low + rng.randrange(1, 8), rng.choice([0.5, 1.0]), rng.choice(["cov", "span", "end"])) for low in (rng.randrange(0, 90) for _ in range(2000))]
    for order in (rows, rows[::-1]):
        parts = frame(spark, order, "region_idx long, size long, low long, high long, w double, what string")
        for r in protection.binned(parts).collect():
            twice = {what: sum(int(2 * w) * max(0, min(b, 10 * r.bin + 10) - max(a, 10 * r.bin)) for _, _, a, b, w, k in rows if k == what) for what in ("cov", "span", "end")}
            assert (r["cov"], r.span, r.ends) == tuple(twice[k] / 2 / 10 for k in ("cov", "span", "end"))


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_oriented_bins_broadcast_nothing_and_match_masks_of_crowded_baits(spark):
    assert broadcasts(__spark_entry__.queries()["n5_oriented_bins"](spark, SF)) == 0
    rng = random.Random(5)
    baits = [("1", s, s + rng.randrange(1, 600)) for s in (rng.randrange(0, 6000) for _ in range(12))] * 20  # over tiles' borders, many times each
    anchors = [(i, "1", s, s + 400, i % 2 == 0) for i, s in enumerate((0, 7, 900, 1015, 2000, 3333, 5400))]
    seen = {(0, 3), (1, 0), (2, 40), (3, 39), (4, 20), (5, 55), (6, 70)}  # the last two beyond the n bins: zeros alone
    bins = frame(spark, [(i, b, 1.0, 2.0, 1.0, 1.0, 0.5) for i, b in seen], "region_idx long, bin long, cov double, span double, ends double, wps double, prot_frac double")
    got = protection.oriented(bins, frame(spark, anchors, "region_idx long, chrom string, start long, end long, plus boolean"), 50, frame(spark, baits, "chrom string, start long, end long")).collect()
    inside = {p for _, a, b in baits for p in range(a + min(50, (b - a) // 4), min(b - min(50, (b - a) // 4) + 1, b))}
    want = {(i, b if plus else 49 - b): (float((i, b) in seen), all(s + 10 * b + k in inside for k in range(10))) for i, _, s, _, plus in anchors for b in range(50)}
    assert {(r.region_idx, r.bin): (r["cov"], r.reliable) for r in got} == want and len(got) == len(want) and {v[1] for v in want.values()} == {True, False}


def test_position_table_shuffles_no_positions_and_matches_brute_force(spark):
    plan = __spark_entry__.queries()["n6_position_table"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.find("Generate explode(sequence(") < plan.find("Exchange")
    rng = random.Random(11)
    anchors = [(i, f"r{i}", "1", s, s + n, i % 2 == 0) for i, (s, n) in enumerate([(1000, 60), (1020, 4), (1024, 1100), (2000, 300), (2100, 200), (5000, 50), (9000, 40)])]
    rows = [(s, s + rng.choice([50, 80, 120, 160, 170, 180, 300])) for s in (rng.randrange(500, 2600) for _ in range(150))]
    rows += [(4940 - 160, 4940), (1000 - 220, 940), (1024 - 180, 964), (2000 - 130, 1940)]  # end half a window before an anchor: not joined to it
    baits = [("1", 990, 1400), ("1", 1300, 2300)]
    got = protection.position_table(fragments(spark, rows), frame(spark, anchors, "region_idx long, region_id string, chrom string, start long, end long, plus boolean"), baits=frame(spark, baits, "chrom string, start long, end long")).collect()
    want = {}
    for i, _, _, r0, r1, plus in anchors:
        sums, touched = {(k, w): np.zeros(r1 - r0) for k in ("long", "short") for w in ("cov", "span", "end")}, 0
        for a, b in rows:
            for k, p, w in (("long", 60, 1.0 if 160 <= b - a <= 175 else 0.5 if 120 <= b - a <= 180 else 0), ("short", 8, float(35 <= b - a <= 80))):
                if w and a < r1 + 60 and b > r0 - 60:
                    for what, low, high in (("cov", a + 1, b), ("span", a + 1 + p, b - p + 1), ("end", a + 1 - p, a + 1 + p), ("end", b - p + 1, b + p + 1)):
                        low, high = max(low, r0), min(high, r1)
                        if low < high:
                            touched += 1
                            sums[k, what][low - r0 : high - r0] += w
        for x in range(r1 - r0) if touched else ():
            mask = int(any(b0 + 50 <= r0 + x <= b1 - 50 for _, b0, b1 in baits))
            want[i, x if plus else r1 - r0 - 1 - x] = (r0 + x, mask, *[sums[k, "cov"][x] for k in ("long", "short")], *[sums[k, "span"][x] - sums[k, "end"][x] for k in ("long", "short")])
    assert {(r.region_idx, r.row): (r.pos, r.capture_mask, r.cov_long, r.cov_short, r.wps_long, r.wps_short) for r in got} == want and len(got) == len(want)
    assert {i for i, _ in want} == set(range(5))


def test_protection_scores_match_difference_arrays(spark):
    rng = random.Random(7)
    rows = [(s, s + rng.randrange(120, 181)) for s in (rng.randrange(0, 2400) for _ in range(80))]
    anchors = frame(spark, [(1, "1", 300, 2300, True)], "region_idx long, chrom string, start long, end long, plus boolean")
    got = {r.bin: r for r in protection.binned(protection.ranges(fragments(spark, rows), anchors)).collect()}
    span, ends, p = np.zeros(2001), np.zeros(2001), 60

    def add(v, a, b, w):
        a, b = min(max(a, 0), 2000), min(max(b, 0), 2000)
        if a < b:
            v[a:b] += w

    for s, e in rows:
        w = 1.0 if 160 <= e - s <= 175 else 0.5
        if s < 2360 and e > 240:
            fs, fe = s + 1 - 300, e - 300
            add(span, fs + p, fe - p + 1, w)
            add(ends, fs - p, fs + p, w)
            add(ends, fe - p + 1, fe + p + 1, w)
    for b in range(200):
        want = (span - ends)[10 * b : 10 * b + 10].mean()
        assert (got[b].wps if b in got else 0) == pytest.approx(want)


def test_ks_matches_the_stepwise_loop(spark):
    rng = random.Random(3)
    a, b = sorted(rng.randrange(100, 130) for _ in range(40)), sorted(rng.randrange(105, 140) for _ in range(25))
    i = j = 0
    d = 0.0
    while i < len(a) and j < len(b):
        va, vb = a[i], b[j]
        i, j = i + (va <= vb), j + (vb <= va)
        d = max(d, abs(i / len(a) - j / len(b)))
    sizes = frame(spark, [(1, "ALT", x) for x in a] + [(1, "REF", x) for x in b] + [(2, "ALT", 5)], "variant_id long, class string, length long")
    rows = {r.variant_id: r for r in variants.ks(variants.class_sizes(sizes), "ALT", "REF").collect()}
    assert rows[1].ks == pytest.approx(d) and (rows[2].ks, rows[2].p_value) == (None, 1.0)


def test_lowess_follows_a_line():
    x = np.linspace(0, 1, 60)
    y = 2 + 3 * x + np.random.default_rng(1).normal(0, 0.01, 60)
    assert np.abs(gc.lowess(x, y) - (2 + 3 * x)).max() < 0.05


def test_periodicity_has_one_frequency_in_band():
    wave = protection.periodicity(np.sin(2 * np.pi * np.arange(30) / 15))
    assert wave["nrl"] == 150 and wave["score"] == pytest.approx(1 / 3) and wave["adjusted"] == 0
    assert protection.periodicity(np.ones(30))["deviation"] == 190


def test_calls_at_variants(spark):
    op = lambda s: [{"op": o, "len": n} for o, n in s]
    rows = [
        ("snv alt", 100, op([("M", 10)]), "AAAAATAAAA", 105, "A", "T", "ALT"),
        ("snv ref", 100, op([("S", 2), ("M", 8)]), "GGAAAAAAAA", 105, "A", "T", "REF"),
        ("snv other", 100, op([("M", 10)]), "AAAAAGAAAA", 105, "A", "T", "NonREF"),
        ("unknown", 100, op([("M", 10)]), "AAAAANAAAA", 105, "A", "T", "N"),
        ("mnv", 100, op([("M", 10)]), "AAAAAGTAAA", 105, "AC", "GT", "ALT"),
        ("ins", 100, op([("M", 6), ("I", 1), ("M", 4)]), "AAAAAATAAAA", 105, "A", "AT", "ALT"),
        ("no ins", 100, op([("M", 10)]), "AAAAAAAAAA", 105, "A", "AT", "REF"),
        ("del", 100, op([("M", 6), ("D", 1), ("M", 4)]), "AAAAAAAAAA", 105, "AC", "A", "ALT"),
    ]
    got = reference.classify_calls(frame(spark, rows, "what string, pos long, cigar array<struct<op:string,len:int>>, seq string, v_pos long, ref string, alt string, want string")).collect()
    assert len(got) == len(rows) and all(r["class"] == r.want for r in got)


def _naive_call(pos, cigar, seq, qual, v, ref, alt):
    """(class, quality) by walking single bases; None for reads that don't tell."""
    at, index, gaps, i, p, last = {}, 0, [], 0, pos, ""
    for o, n in cigar:
        if o in "M=X":
            at.update({p + k: i + k for k in range(n)})
        if o == "I" and last in ("M", "=", "X") or o == "D":
            gaps.append((o, n, p, i))
        p, i, last = p + n * (o in "M=XDN"), i + n * (o in "M=XIS"), o
    r, a = len(ref), len(alt)
    best = None
    if r < a and alt.startswith(ref):
        for o, n, g, index in gaps:
            d = abs(g - 1 - (v + max(r, 1) - 1))
            if o == "I" and n == a - r and d <= 5 and seq[index : index + n] == alt[r:] and (best is None or d < best[0]):
                best = (d, index)
        if best:
            piece = seq[best[1] - 1 : best[1] + a - r]
            return "N" if "N" in piece else "ALT" if r == 0 or piece == alt[r - 1 :] else "NonREF", qual[best[1] - 1]
        return None if v not in at else ("N" if seq[at[v]] == "N" else "REF", qual[at[v]])
    if r > a and ref.startswith(alt):
        for o, n, g, index in gaps:
            d = abs(g - (v + a))
            if o == "D" and n == r - a and d <= 5 and (best is None or d < best[0]):
                best = (d, index)
        if best:
            k = max(best[1] - 1, 0)
            return "N" if seq[k] == "N" else "ALT", qual[k]
    if any(v + k not in at for k in range(r)):
        return None
    block = "".join(seq[at[v + k]] for k in range(r))
    return "N" if "N" in block else "REF" if block == ref else "ALT" if block == alt else "NonREF", min(qual[at[v + k]] for k in range(r))


def test_calls_match_single_bases(spark):
    rng, rows, want = random.Random(4), [], {}
    for n in range(600):
        cigar = [("S", rng.randint(1, 3))] * rng.randint(0, 1) + [("M", rng.randint(1, 8))]
        for _ in range(rng.randint(0, 2)):
            cigar += [(rng.choice("IID"), rng.randint(1, 2)), ("M", rng.randint(1, 8))]
        seq = "".join(rng.choices("AACN" if n % 9 == 0 else "AAC", k=sum(k for o, k in cigar if o in "MIS")))
        qual, v = [rng.randint(2, 40) for _ in seq], 100 + rng.randint(-2, 14)
        ref, alt = rng.choice([("A", "C"), ("A", "AA"), ("A", "AC"), ("A", "AAC"), ("AA", "A"), ("AAC", "A"), ("AA", "CA"), ("AAC", "AC"), ("", "A"), ("C", ""), ("AC", "CAA"), ("AC", "ACA")])
        rows.append((n, 100, [(o, k) for o, k in cigar], seq, qual, v, ref, alt))
        if call := _naive_call(100, cigar, seq, qual, v, ref, alt):
            want[n] = call
    got = reference.classify_calls(frame(spark, rows, "n int, pos long, cigar array<struct<op:string,len:int>>, seq string, qual array<int>, v_pos long, ref string, alt string")).collect()
    assert {r.n: (r["class"], r.bq) for r in got} == want and len({c for c, _ in want.values()}) == 4


# ---- files ----


def _bgzf(raw: bytes) -> bytes:
    out = b""
    for i in range(0, len(raw), 100):
        part = raw[i : i + 100]
        engine = zlib.compressobj(wbits=-15)
        body = engine.compress(part) + engine.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out + bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def test_bam(spark, tmp_path):
    def record(name, flag, pos, cigar, tlen, seq, tags=b""):
        codes = {c: i for i, c in enumerate("=ACMGRSVTWYHKDBN")}
        packed = bytes(codes[a] << 4 | codes[b] for a, b in zip(seq[::2], [*seq[1::2], "="], strict=False))
        body = struct.pack("<iiBBHHHiiii", 0, pos, len(name) + 1, 60, 0, len(cigar), flag, len(seq), 0, 0, tlen) + name.encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(o)) for o, n in cigar) + packed + bytes([30] * len(seq)) + tags
        return struct.pack("<i", len(body)) + body

    raw = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)
    raw += record("read1", 99, 100, [("M", 5)], 150, "ACGTN", b"XMZZ.z\0cDC\x07") + record("read1", 147, 200, [("S", 1), ("M", 3)], -150, "TTTT")
    (tmp_path / "a.bam").write_bytes(_bgzf(raw))
    one, two = bam.read_bam(spark, str(tmp_path / "a.bam")).orderBy("pos").collect()
    assert (one.qname, one.flag, one.chrom, one.pos, one.tlen, one.seq, one.xm, one.cd, one.qual) == ("read1", 99, "chr1", 100, 150, "ACGTN", "Z.z", 7, [30] * 5)
    assert [(c.op, c.len) for c in two.cigar] == [("S", 1), ("M", 3)] and two.xm is None
    (tmp_path / "bad.bam").write_bytes(_bgzf(raw)[:80])
    with pytest.raises(Exception, match="truncated|ends within"):
        bam.read_bam(spark, str(tmp_path / "bad.bam")).count()


def test_local_regression_and_periodicity_against_slow_twins():
    import random

    import numpy as np

    from plasmaspark.operators import gc
    from plasmaspark.operators.protection import periodicity

    rng = random.Random(4)
    x = np.array(sorted(rng.uniform(0, 1) for _ in range(60)))
    y = np.sin(5 * x) + np.array([rng.gauss(0, 0.1) for _ in x])
    y[20] += 8  # robustness must ignore this
    k, robust = int(0.3 * len(x) + 1e-10), np.ones(len(x))
    for _ in range(4):
        fit = np.empty(len(x))
        for i in range(len(x)):
            reach = sorted(abs(x - x[i]))[k - 1]
            u = abs(x - x[i]) / reach
            w = np.where(u >= 0.999, 0, np.where(u <= 0.001, 1, (1 - u**3) ** 3)) * robust
            fit[i] = np.polyval(np.polyfit(x[w > 0], y[w > 0], 1, w=np.sqrt(w[w > 0])), x[i])
        left = abs(y - fit)
        u = left / (6 * np.median(left))
        robust = np.where(u >= 0.999, 0, np.where(u <= 0.001, 1, (1 - u**2) ** 2))
    assert np.allclose(gc.lowess(x, y), fit, atol=1e-6) and abs(fit[20] - np.sin(5 * x[20])) < 0.3
    profile = np.array([3 + 0.1 * i + np.cos(2 * np.pi * i / 15) for i in range(30)])
    flat = profile - np.polyval(np.polyfit(np.arange(30), profile, 1), np.arange(30))
    shaped = [(v - flat.mean()) / flat.std() * 0.5 * (1 - np.cos(2 * np.pi * i / 29)) for i, v in enumerate(flat)]
    power = {f: abs(sum(v * np.exp(-2j * np.pi * f * i / 30) for i, v in enumerate(shaped))) for f in range(1, 16) if 140 <= 300 / f <= 200}
    got = periodicity(profile)
    assert got["nrl"] == 300 / max(power, key=power.get) == 150 and abs(got["snr"] - max(power.values()) / np.mean(list(power.values()))) < 1e-9


def test_numbering_is_global(spark):
    from plasmaspark.operators.numbering import numbered

    rows = numbered(spark.range(0, 5000, 1, 7).selectExpr("id * 37 % 5000 as v"), ["v"], "place").collect()
    assert {r.v: r.place for r in rows} == {i: i + 1 for i in range(5000)}


def test_bam_by_ranges(spark, tmp_path):
    import random

    rng = random.Random(1)

    def record(i):
        name, seq = f"q{i}" + "n" * rng.randrange(20), "".join(rng.choice("ACGT") for _ in range(rng.choice([30, 40, 900])))
        codes = {c: k for k, c in enumerate("=ACMGRSVTWYHKDBN")}
        packed = bytes(codes[a] << 4 | codes[b] for a, b in zip(seq[::2], seq[1::2], strict=True))
        body = struct.pack("<iiBBHHHiiii", rng.randrange(-1, 2), rng.randrange(9000), len(name) + 1, 60, 0, 1, 99, len(seq), 0, 5, 150) + name.encode() + b"\0" + struct.pack("<I", len(seq) << 4) + packed + bytes(rng.randrange(41) for _ in seq)
        return struct.pack("<i", len(body)) + body

    raw = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 2) + b"".join(struct.pack("<i", 2) + n + b"\0" + struct.pack("<i", 9000) for n in (b"1", b"2"))
    (tmp_path / "a.bam").write_bytes(_bgzf(raw + b"".join(map(record, range(300)))))
    whole = sorted(map(str, bam.read_bam(spark, str(tmp_path / "a.bam")).collect()))
    assert len(whole) == 300
    for size in (1000, 7777, 30_000):
        parts = bam.read_bam(spark, str(tmp_path / "a.bam"), size)
        assert parts.rdd.getNumPartitions() > 2 and sorted(map(str, parts.collect())) == whole


def test_fasta_by_ranges(spark, tmp_path):
    import random

    rng = random.Random(2)
    seqs = {"1": "".join(rng.choice("ACGTN") for _ in range(1234)), "2": "".join(rng.choice("acgt") for _ in range(600)), "M": ""}
    (tmp_path / "g.fa").write_text("".join(f">chr{c} some\n" + "".join(s[i : i + 60] + "\n" for i in range(0, len(s), 60)) for c, s in seqs.items()))
    want = {(c, i): s[i * 100 : i * 100 + 150].upper() for c, s in seqs.items() for i in range(-(-len(s) // 100))}
    for _ in range(2):
        tiles = bam.read_fasta(spark, str(tmp_path / "g.fa"), 100, 50, 300)
        assert {(r.chrom, r.tile): r.seq for r in tiles.collect()} == want and tiles.rdd.getNumPartitions() == 7
        (tmp_path / "g.fa.fai").write_text("".join("\t".join(map(str, e)) + "\n" for e in bam.fasta_index(str(tmp_path / "g.fa"))))
    from plasmaspark.operators.reference import theoretical_gc

    lengths = [62, 67, 112]
    got = {(r.length_bin, r.gc_pct): r.n for r in theoretical_gc(bam.read_fasta(spark, str(tmp_path / "g.fa"), 100, 112).select("seq"), lengths, 10, owned=100).collect()}
    counted: dict = {}
    for s in map(str.upper, seqs.values()):
        for n in lengths:
            for i in range(0, len(s) - n + 1, 10):
                known = [c for c in s[i : i + n] if c != "N"]
                if n - len(known) <= 0.1 * n:
                    key = ((n - 60) // 5, int(sum(c in "GC" for c in known) / len(known) * 100 + 0.5))
                    counted[key] = counted.get(key, 0) + 1
    assert got == counted


def test_fasta(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">chr1 x\n" + "ACGT\n" * 10 + ">2\nGGCC\n")
    tiles = bam.read_fasta(spark, str(tmp_path / "g.fa"), 7)
    ranges = frame(spark, [(1, "1", 5, 23), (2, "2", 1, 3)], "i long, chrom string, start long, end long")
    got = {r.i: r.seq for r in bam.fetch(ranges, tiles, ["i"], 7).collect()}
    assert got == {1: ("ACGT" * 10)[5:23], 2: "GC"}


def test_lines_of_files(spark, tmp_path):
    with gzip.open(tmp_path / "f.bed.gz", "wt") as out:
        out.write("# head\nchr1\t100\t250\t0.45\nchrchr2\t5\t9\tbad\nchr1\tx\t9\t0.5\nchr1\t1\n")
    rows = text.fragments(text.lines(spark, str(tmp_path / "f.bed.gz"))).collect()
    assert sorted(map(tuple, rows)) == [("1", 100, 250, 150, 0.45), ("2", 5, 9, 4, 0.0)]
    (tmp_path / "t.tsv").write_text("Gene1\t1\t500000\t600000\t+\nGene2\t1\t0\t900\t-\n")
    (one,) = text.transcripts(text.lines(spark, str(tmp_path / "t.tsv"))).collect()
    assert (one.region_id, one.start, one.end, one.center) == ("Gene1", 549000, 551000, 550000)
    samples = frame(spark, [("P-01-T",), ("Q",)], "Tumor_Sample_Barcode string")
    assert text.maf_of_sample(samples, "p-01").count() == 1 and text.maf_of_sample(samples.toDF("other"), "p").count() == 2


def test_sinks(spark, tmp_path):
    df = frame(spark, [("a", 1.23456, 1), ("b", math.nan, 2)], "k string, v double, n long")
    assert sinks.write_table(df, str(tmp_path / "x.tsv.gz"), "both", decimals=2) == [f"{tmp_path}/x.tsv", f"{tmp_path}/x.parquet"]
    assert sinks.read_table(spark, str(tmp_path / "x.tsv")).count() == 2
    sinks.write_baselines(str(tmp_path / "pon"), fsd=frame(spark, [("1p", 0.5)], "arm string, mean double"), mds=frame(spark, [(0.9,)], "mean double"))
    assert sinks.read_baseline(spark, str(tmp_path / "pon"), "mds").columns == ["mean"]
    docs = {r.k: r.document for r in sinks.feature_document("k", f=df).collect()}
    assert docs["a"] == '{"f":[{"v":1.23456,"n":1}]}' and "NaN" not in docs["b"]
    sinks.write_fragments(fragments(spark, [(5, 9), (1, 4)]), str(tmp_path / "frags"))
    assert [r.start for r in spark.read.parquet(str(tmp_path / "frags")).collect()] == [1, 5]


# ---- the driver's contract ----


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, database, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in catalog.ORACLES:
        return
    result = database.sql(catalog.ORACLES[name])
    names = sorted(df.columns)
    assert sorted(result.columns) == names
    order = [result.columns.index(c) for c in names]
    want = sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in names) for r in rows), key=str) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
