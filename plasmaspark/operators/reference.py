"""Reference genome work: valid regions, theoretical GC counts, breakpoint motifs, alignments against variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plasmaspark.functions.expressions import length_bin, reverse_complement, variant_type
from plasmaspark.operators.intervals import as_right, overlap


def valid_regions(chromosomes: DataFrame, blacklist: DataFrame, size: int = 100_000) -> DataFrame:
    """Whole tiles of each chromosome (chrom, length) that no blacklisted interval overlaps."""
    tiles = chromosomes.where(F.col("length") >= size).select("chrom", F.explode(F.expr(f"sequence(0L, length div {size} - 1)")).alias("i"))
    tiles = tiles.select("chrom", (F.col("i") * size).alias("start"), ((F.col("i") + 1) * size).alias("end"))
    return overlap(tiles, as_right(blacklist.select("chrom", "start", "end")), "left_anti", longest=size, bucket=size)


def theoretical_gc(sequences: DataFrame, lengths: list[int], step: int = 100, most_unknown: float = 0.1, owned: int | None = None) -> DataFrame:
    """(length_bin, gc_pct, n) of fragments of the given lengths that start at every step of each sequence (key, seq); those with too many unknown bases are left out.

    With owned, only those that start in a sequence's first so many bases:
    for tiles that hold the bases that follow them too.
    """
    starts = sequences.select("seq", F.explode(F.array(*[F.lit(x) for x in lengths])).alias("length")).where(F.length("seq") >= F.col("length"))
    cut = starts.select("length", F.explode(F.expr(f"transform(sequence(0, {f'least(length(seq) - length, {owned - 1})' if owned else 'length(seq) - length'}, {step}), i -> substring(seq, i + 1, length))")).alias("part"))
    known = F.length(F.regexp_replace("part", "[^ACGT]", ""))
    gc = F.length(F.regexp_replace("part", "[^GC]", ""))
    kept = cut.select("length", known.alias("known"), gc.alias("gc")).where((F.col("length") - F.col("known") <= most_unknown * F.col("length")) & (F.col("known") > 0))
    return kept.groupBy(length_bin(F.col("length")).alias("length_bin"), F.round(F.col("gc") / F.col("known") * 100).cast("int").alias("gc_pct")).agg(F.count("*").alias("n"))


def breakpoint_motifs(ends: DataFrame, k: int = 4) -> DataFrame:
    """(kmer, n) from rows (plus, before, after): the bases of the reference before a fragment's end and those of the fragment behind it; minus ends are complemented."""
    half = (k + 1) // 2
    plus = F.concat(F.expr(f"right(before, {half})"), F.substring("after", 1, k - half))
    minus = reverse_complement(F.concat(F.expr(f"right(after, {k - half})"), F.substring("before", 1, half)))
    kmer = F.upper(F.when(F.col("plus"), plus).otherwise(minus))
    return ends.select(kmer.alias("kmer")).where(F.col("kmer").rlike(f"^[ACGT]{{{k}}}$")).groupBy("kmer").agg(F.count("*").alias("n"))


def read_offset(cigar: Column, pos: Column, at: Column) -> Column:
    """Place (from 0) in the read's bases of the reference position `at`; null where the read has a gap there or ends before."""
    start = F.struct(pos.cast("bigint").alias("ref"), F.lit(0).cast("bigint").alias("read"), F.lit(None).cast("bigint").alias("hit"))

    def step(state: Column, op: Column) -> Column:
        n = op["len"].cast("bigint")
        both, ref, read = op["op"].isin("M", "=", "X"), op["op"].isin("D", "N"), op["op"].isin("I", "S")
        inside = both & (at >= state["ref"]) & (at < state["ref"] + n)
        return F.struct(
            (state["ref"] + F.when(both | ref, n).otherwise(0)).alias("ref"),
            (state["read"] + F.when(both | read, n).otherwise(0)).alias("read"),
            F.coalesce(state["hit"], F.when(inside, state["read"] + at - state["ref"])).alias("hit"),
        )

    return F.aggregate(cigar, start, step, lambda s: s["hit"])


def indel_after(cigar: Column, pos: Column, at: Column, op: str) -> Column:
    """Length of the insertion or deletion (op I or D) that directly follows reference position `at`; 0 without one."""
    start = F.struct(pos.cast("bigint").alias("ref"), F.lit(0).cast("bigint").alias("found"))

    def step(state: Column, c: Column) -> Column:
        n = c["len"].cast("bigint")
        moves = c["op"].isin("M", "=", "X", "D", "N")
        hit = (c["op"] == op) & (state["ref"] == at + 1)
        return F.struct((state["ref"] + F.when(moves, n).otherwise(0)).alias("ref"), F.when(hit, n).otherwise(state["found"]).alias("found"))

    return F.aggregate(cigar, start, step, lambda s: s["found"])


def alignment(cigar: Column, pos: Column) -> Column:
    """The operations with where each begins in the reference (ref) and in the read's bases (read), and the operation before it."""
    none = F.expr("cast(array() as array<struct<op:string,ref:bigint,read:bigint,len:bigint,before:string>>)")
    start = F.struct(none.alias("ops"), pos.cast("bigint").alias("ref"), F.lit(0).cast("bigint").alias("read"), F.lit("").alias("before"))

    def step(state: Column, c: Column) -> Column:
        n, op = c["len"].cast("bigint"), c["op"]
        here = F.struct(op.alias("op"), state["ref"].alias("ref"), state["read"].alias("read"), n.alias("len"), state["before"].alias("before"))
        return F.struct(
            F.array_append(state["ops"], here).alias("ops"),
            (state["ref"] + F.when(op.isin("M", "=", "X", "D", "N"), n).otherwise(0)).alias("ref"),
            (state["read"] + F.when(op.isin("M", "=", "X", "I", "S"), n).otherwise(0)).alias("read"),
            op.alias("before"),
        )

    return F.aggregate(cigar, start, step, lambda s: s["ops"])


def _index(ops: Column, at: Column) -> Column:
    """Place in the read's bases of reference position at; null in gaps."""
    block = F.get(F.filter(ops, lambda o: o["op"].isin("M", "=", "X") & (at >= o["ref"]) & (at < o["ref"] + o["len"])), F.lit(0))
    return block["read"] + at - block["ref"]


#: Fixed value: how far an aligner may have shifted an insertion or deletion.
SHIFT = 5


def classify_calls(pairs: DataFrame) -> DataFrame:
    """class (REF, ALT, NonREF, N) and bq of reads (pos, cigar, seq, qual if there) at variants (v_pos, ref, alt), by the variant's kind.

    Substitutions and complex variants compare all bases over the reference
    allele, and take the least quality of them. An insertion or deletion of the
    right length counts at SHIFT positions from its place too, the nearest one
    first; inserted bases have to be the same. Of these the base before gives
    the quality. Reads without a base at a position that is needed are left out.
    """
    r, a = F.length("ref"), F.length("alt")
    seq, ops, at, size = F.upper("seq"), F.col("__ops"), F.col("__at"), F.greatest(r, F.lit(1))
    cut = lambda first, n: F.substring(seq, first.cast("int"), n.cast("int"))
    nearest = lambda kept, distance: F.array_min(F.transform(F.filter(ops, kept), lambda o: F.struct(distance(o).alias("distance"), o["read"].alias("read"))))
    off_ins = lambda o: F.abs(o["ref"] - F.col("v_pos") - size)
    off_del = lambda o: F.abs(o["ref"] - F.col("v_pos") - a)
    inserted = nearest(lambda o: (o["op"] == "I") & (o["len"] == a - r) & o["before"].isin("M", "=", "X") & (off_ins(o) <= SHIFT) & (cut(o["read"] + 1, o["len"]) == F.substring("alt", r + 1, a - r)), off_ins)
    deleted = nearest(lambda o: (o["op"] == "D") & (o["len"] == r - a) & (off_del(o) <= SHIFT), off_del)
    kind = variant_type(F.col("ref"), F.col("alt"))
    placed = pairs.withColumn("__ops", alignment(F.col("cigar"), F.col("pos"))).withColumn("__at", F.transform(F.sequence(F.lit(0), size - 1), lambda i: _index(ops, F.col("v_pos") + i)))
    placed = placed.withColumn("__gap", F.when(kind == "INS", inserted).when(kind == "DEL", deleted))
    gap, before = F.col("__gap").isNotNull(), F.greatest(F.col("__gap.read"), F.lit(1))

    # the bases that decide, and where their quality is read
    block = F.array_join(F.transform(at, lambda i: cut(i + 1, F.lit(1))), "")
    whole = ~F.exists(at, lambda i: i.isNull()) & (F.length(block) == size)
    first = F.get(at, F.lit(0))
    bases = F.when(gap & (kind == "INS"), cut(before, a - r + 1)).when(gap, cut(before, F.lit(1))).when(kind == "INS", cut(first + 1, F.lit(1))).when(whole, block)
    places = F.when(gap, F.array(before - 1)).when(kind == "INS", F.array(first)).otherwise(at)
    # an insertion's base before it has to be the allele's, unless the allele is written without one
    same = F.when(r == 0, F.substring("__bases", 2, 1 << 20) == F.col("alt")).otherwise(F.col("__bases") == F.substring("alt", r, a - r + 1))
    alike = F.when(F.col("__bases") == F.col("ref"), "REF").when(F.col("__bases") == F.col("alt"), "ALT").otherwise("NonREF")
    by_kind = F.when(gap & (kind == "DEL"), "ALT").when(gap, F.when(same, "ALT").otherwise("NonREF")).when(kind == "INS", "REF").otherwise(alike)
    out = placed.withColumn("__bases", bases).where("__bases <> ''").withColumn("class", F.when(F.col("__bases").contains("N"), "N").otherwise(by_kind))
    if "qual" in pairs.columns:
        out = out.withColumn("bq", F.array_min(F.transform(places, lambda i: F.coalesce(F.get("qual", i.cast("int")), F.lit(0)))))
    return out.drop("__ops", "__at", "__gap", "__bases")
