"""Commands over small files, streams, and asset resolution."""

from __future__ import annotations

import pytest

from plasmaspark.plans.commands import main
from plasmaspark.sources.assets import Assets
from plasmaspark.streaming import fragments as stream
from tests.test_core import _bgzf


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    import struct

    d = tmp_path_factory.mktemp("in")

    def record(name, flag, pos, tlen, seq, tags=b""):
        codes = {c: i for i, c in enumerate("=ACMGRSVTWYHKDBN")}
        packed = bytes(codes[a] << 4 | codes[b] for a, b in zip(seq[::2], seq[1::2], strict=True))
        body = struct.pack("<iiBBHHHiiii", 0, pos, len(name) + 1, 60, 0, 1, flag, len(seq), 0, 0, tlen) + name.encode() + b"\0" + struct.pack("<I", len(seq) << 4) + packed + bytes([30] * len(seq)) + tags
        return struct.pack("<i", len(body)) + body

    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 9000)
    raw = head + record("r1", 99, 100, 150, "ACGT" * 10, b"XMZZZZ\0") + record("r2", 83, 500, -170, "TTTT" * 10) + record("r3", 99, 700, 300, "GGGG" * 10)
    (d / "a.bam").write_bytes(_bgzf(raw))
    (d / "g.fa").write_text(">chr1\n" + "ACGT" * 2250 + "\n")
    (d / "bins.bed").write_text("chr1\t0\t1000\nchr1\t1000\t2000\n")
    (d / "arms.bed").write_text("1\t0\t5000\t1p\n")
    (d / "labels.bed").write_text("chr1\t50\t400\tA\nchr1\t600\t900\tB\n")
    (d / "genes.bed").write_text("chr1\t0\t600\tG1\te1\nchr1\t600\t2000\tG2\te1\n")
    (d / "anchors.bed").write_text("chr1\t400\t500\tT1\t0\t-\n")
    (d / "black.bed").write_text("chr1\t690\t710\n")
    (d / "v.vcf").write_text("#h\nchr1\t106\t.\tC\tT\t.\tPASS\t.\n")
    return d


def read(spark, paths):
    return spark.read.option("sep", "\t").option("header", True).option("inferSchema", True).csv(paths[0]).collect()


def test_run_all(spark, folder, tmp_path):
    at = lambda n: str(folder / n)
    made = main(["run-all", "-i", at("a.bam"), "-o", str(tmp_path), "--bins", at("bins.bed"), "--arms", at("arms.bed"), "--labels", at("labels.bed"), "--genes", at("genes.bed"), "--anchors", at("anchors.bed"), "--reference", at("g.fa"), "--windows", "1"], spark)
    frags = sorted((r.start, r.end, r.gc_pct) for r in spark.read.parquet(made["extract"][0]).collect())
    assert frags == [(100, 250, 50), (370, 540, 50), (700, 1000, 50)]
    bins = {r.start: r for r in read(spark, made["fsc"])}
    assert (bins[0].total, bins[0].mono_nucl, bins[1000].total) == (3, 2, 0)
    assert sum(r.n for r in read(spark, made["motif"])) == 3
    assert {r.label for r in read(spark, made["region-entropy"])} == {"A", "B"}
    assert len(read(spark, made["wps"])) == 200 and {r.gene: r.total for r in read(spark, made["fsc-genes"])} == {"G1": 2, "G2": 1}


def test_gc_factors_metadata_and_document(spark, folder, tmp_path):
    import json

    at = lambda n: str(folder / n)
    rows = [(i, "1", 100 + i, 100 + i + 150, 150, i % 2 == 0, "ACGTACGTAC", 30 + i % 20) for i in range(400)]
    spark.createDataFrame(rows, "frag_id long, chrom string, start long, end long, length long, plus boolean, seq string, gc_pct int").write.parquet(str(tmp_path / "f.parquet"))
    stored = [(150, g, 20 if g < 40 else 5) for g in range(30, 50)]
    spark.createDataFrame(stored, "length_bin_min int, gc_percent int, expected_count long").write.parquet(str(tmp_path / "ref.parquet"))
    frags = ["-i", str(tmp_path / "f.parquet"), "--gc-reference", str(tmp_path / "ref.parquet"), "--least-count", "4"]
    made = main(["gc-factors", *frags, "-o", str(tmp_path)], spark)["gc-factors"]
    found = {r.gc_pct: r for r in read(spark, made)}
    assert len(found) == 20 and (found[30].observed, found[30].expected) == (20, 20) and found[30].factor > 1 > found[49].factor
    entropy = lambda *more: {r.label: r["count"] for r in read(spark, main(["region-entropy", *frags, "-r", at("labels.bed"), "-o", str(tmp_path / "e"), *more], spark)["region-entropy"])}
    computed, plain = entropy(), entropy("--no-gc")
    assert plain["A"] == 300 and computed["A"] != plain["A"]
    spark.createDataFrame([(150, 154, g, 1, 1, 3.0) for g in range(101)], "length_bin_min int, length_bin_max int, gc_pct int, observed long, expected long, factor double").write.parquet(str(tmp_path / "f.factors.parquet"))
    assert entropy()["A"] == 3 * plain["A"]  # those beside the input come first
    made = main(["motif", *frags, "--reference", at("g.fa"), "--targets", at("labels.bed"), "-o", str(tmp_path / "m")], spark)
    assert {n for n in made if n.endswith(".ontarget")} == {"motif.ontarget", "motif.mds.ontarget", "motif.first.ontarget", "motif.breakpoint.ontarget"}
    counts = {r.kmer: r.n for n in ("motif", "motif.ontarget") for r in read(spark, made[n]) if r.n}
    assert sum(r.n for n in ("motif", "motif.ontarget") for r in read(spark, made[n])) == 400 and set(counts) == {"ACGT", "GTAC"}
    cut = {r.kmer: r.n for n in ("motif.breakpoint", "motif.breakpoint.ontarget") for r in read(spark, made[n])}
    assert len(cut) == 256 and {k for k, n in cut.items() if n} <= {a + b for a in ("AC", "CG", "GT", "TA") for b in ("AC", "GT", "CG", "TA")}
    made = main(["wps", *frags, "-r", at("anchors.bed"), "--positions", "--targets", at("bins.bed"), "-o", str(tmp_path / "w")], spark)
    bins, places = (sorted(read(spark, made[n]), key=lambda r: r.pos if "pos" in r.asDict() else r.bin) for n in ("wps", "wps.positions"))
    assert len(bins) == 200 and {r.reliable for r in bins} == {True, False} and len(places) == 1451 and places[0].pos == 0 and places[0].row == 1450 and places[0].strand == "-"
    made = main(["run-all", "-i", at("a.bam"), "-o", str(tmp_path / "all"), "--bins", at("bins.bed"), "--labels", at("labels.bed"), "--variants", at("v.vcf"), "--markers", at("black.bed"), "--windows", "1", "--json", "--sample", "s1"], spark)
    (row,) = read(spark, made["metadata"])
    assert (row.sample_id, row.total_fragments, row.genome, row.panel_mode, row.gc_correction_computed) == ("s1", 3, "hg19", False, False) and row.timestamp
    (line,) = spark.read.text(made["document"][0]).collect()
    sections = json.loads(line.value)
    assert {"fsc", "fsr", "ocf", "region_entropy", "mfsd", "uxm", "metadata", "motif", "motif_mds", "motif_first"} == set(sections) and sections["metadata"][0]["total_fragments"] == 3 and len(sections["fsc"]) == 2


def test_single_commands(spark, folder, tmp_path):
    at = lambda n: str(folder / n)
    made = main(["extract", "-i", at("a.bam"), "-o", str(tmp_path), "--blacklist", at("black.bed"), "--format", "parquet"], spark)
    assert spark.read.parquet(made["extract"][0]).count() == 2
    (one,) = read(spark, main(["mfsd", "-i", at("a.bam"), "-r", at("v.vcf"), "-o", str(tmp_path)], spark)["mfsd"])
    assert (one.n_ref, one.n_alt) == (1, 0)
    (mark,) = read(spark, main(["uxm", "-i", at("a.bam"), "-r", at("black.bed"), "-o", str(tmp_path)], spark)["uxm"])
    assert mark.n == 0
    assert read(spark, main(["validate", "-i", at("bins.bed"), "-o", str(tmp_path), "--schema", "bed3"], spark)["validate"]) == []
    (tmp_path / "list").write_text(made["extract"][0] + "\n" + made["extract"][0])
    assert {"ks_alt_ref", "p_nonref_n", "delta_alt_n", "weight_alt"} <= set(one.asDict())
    (made_pon,) = main(["build-pon", "-i", str(tmp_path / "list"), "--arms", at("arms.bed"), "--labels", at("labels.bed"), "--bins", at("bins.bed"), "--anchors", at("anchors.bed"), "-o", str(tmp_path), "--format", "parquet"], spark)["build-pon"]
    pon = spark.read.parquet(made_pon)
    assert {r.table for r in pon.select("table").distinct().collect()} == {"gc_bias", "fsd_baseline", "region_entropy", "ocf_baseline", "fsc_baseline", "wps_baseline"}
    frags = made["extract"][0]
    (tmp_path / "factors.csv").write_text("length_bin_min,length_bin_max,gc_pct,observed,expected,factor\n150,154,50,1,1,2.0\n")
    weigh = ["--factors", str(tmp_path / "factors.csv")]
    plain, doubled = (read(spark, main(["region-entropy", "-i", frags, "-r", at("labels.bed"), "-o", str(tmp_path / n), *more], spark)["region-entropy"])[0]["count"] for n, more in (("p", []), ("w", weigh)))
    assert doubled == plain + 1
    for name, regions, z in (("region-entropy", "labels.bed", "z"), ("ocf", "labels.bed", "z"), ("fsc", "bins.bed", "log_ratio")):
        rows = read(spark, main([name, "-i", frags, "-r", at(regions), "--pon", made_pon, "-o", str(tmp_path / "pon")], spark)[name])
        assert rows and z in rows[0].asDict()
    rows = read(spark, main(["region-entropy", "-i", frags, "-r", at("labels.bed"), "--targets", at("genes.bed"), "-o", str(tmp_path / "on")], spark)["region-entropy"])
    assert {r.part for r in rows} <= {"all", "on", "off"} and "all" in {r.part for r in rows}
    assert read(spark, main(["fsd", "-i", frags, "-r", at("arms.bed"), "--targets", at("genes.bed"), "-o", str(tmp_path / "on")], spark)["fsd"])[0].on_target
    made = main(["fsc", "-i", frags, "-r", at("bins.bed"), "--targets", at("genes.bed"), "-o", str(tmp_path / "on")], spark)
    assert {n: sum(r.total for r in read(spark, p)) for n, p in made.items()} == {"fsc": 0, "fsc.ontarget": 2}
    parts = {n: read(spark, p) for n, p in main(["ocf", "-i", frags, "-r", at("labels.bed"), "--targets", at("genes.bed"), "-o", str(tmp_path / "on")], spark).items()}
    assert set(parts) == {"ocf", "ocf.ontarget", "ocf.offtarget"} and [r.ocf for r in parts["ocf"]] == [r.ocf for r in parts["ocf.ontarget"]]
    assert main(["build-gc-reference", "-i", at("g.fa"), "-o", str(tmp_path)], spark)


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("1", 100, 250, 150, 40), ("1", 99_950, 100_050, 100, 40)], stream.SCHEMA)
    rows.repartition(2).write.parquet(str(tmp_path / "f"))
    q = stream.running_tiles(stream.read_fragments(spark, str(tmp_path / "f"), 1)).writeStream.format("memory").queryName("tiles").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {r.tile: r.total for r in spark.sql("SELECT * FROM tiles").collect()} == {0: 2, 1: 1}


def test_assets(monkeypatch):
    a = Assets("GRCh37", root="store://assets")
    a.add("targets", "panel.bed", assay="p1")
    a.add("bins", "bins.bed")
    assert a.resolve("targets", assay="p1") == ("store://assets/panel.bed", "assay")
    assert a.resolve("targets", "mine.bed", "p1") == ("mine.bed", "explicit")
    assert a.resolve("bins", assay="p1")[1] == "genome" and a.resolve("bins", skip=True) == (None, "skipped") and a.resolve("pon") == (None, "none")
    with pytest.raises(ValueError):
        Assets("hg17")
