"""Scalar expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# SAM flag bits.
PAIRED, PROPER, UNMAPPED, MATE1, SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 0x1, 0x2, 0x4, 0x40, 0x100, 0x200, 0x400, 0x800


def strip_chr(chrom: Column) -> Column:
    """The chromosome's name without any leading chr."""
    return F.regexp_replace(chrom, "^(chr)+", "")


def no_flags(flag: Column, bits: int) -> Column:
    return flag.bitwiseAND(F.lit(bits)) == 0


def read_filter(flag: Column, mapq: Column, length: Column, min_mapq: int = 20, shortest: int = 65, longest: int = 1000, skip_duplicates: bool = True, proper: bool = True, check_qc: bool = True) -> Column:
    """Reads that count: mapped, primary, good enough, of a fitting length."""
    bits = UNMAPPED | SECONDARY | SUPPLEMENTARY | (QC_FAIL if check_qc else 0) | (DUPLICATE if skip_duplicates else 0)
    kept = no_flags(flag, bits) & (mapq >= min_mapq) & length.between(shortest, longest)
    return kept & (flag.bitwiseAND(F.lit(PAIRED | PROPER)) == PAIRED | PROPER) if proper else kept


#: Size channels of bins (up to and with each length) and of genes (below each length).
CHANNELS = (("ultra_short", 100), ("core_short", 149), ("mono_nucl", 220), ("di_nucl", 260), ("long", 400))
GENE_CHANNELS = (("ultra_short", 100), ("core_short", 150), ("mono_nucl", 260), ("di_nucl", 400))
LEGACY_CHANNELS = (("short", 65, 150), ("intermediate", 151, 260), ("long", 261, 400))


def size_channel(length: Column) -> Column:
    out = F
    for name, most in CHANNELS:
        out = out.when(length <= most, name)
    return out.otherwise("ultra_long")


def gene_channel(length: Column) -> Column:
    out = F
    for name, below in GENE_CHANNELS:
        out = out.when(length < below, name)
    return out.otherwise("long")


def legacy_channel(length: Column) -> Column:
    out = F
    for name, low, high in LEGACY_CHANNELS:
        out = out.when(length.between(low, high), name)
    return out


CHROMOSOMES = tuple(str(i) for i in range(1, 23)) + ("X", "Y")


def main_chromosome(chrom: Column) -> Column:
    return strip_chr(chrom).isin(*CHROMOSOMES)


def natural_order(chrom: Column) -> list[Column]:
    """Sort keys: numbered chromosomes by number, then the others by name."""
    bare = strip_chr(chrom)
    return [F.when(bare.rlike("^[0-9]+$"), bare.cast("int")).otherwise(F.lit(10**6)), bare]


def gene_probe(name: Column) -> Column:
    """Whether a panel region targets a gene (and isn't a fingerprint or instability probe)."""
    return ~F.lower(name).rlike("^(fp_|snp_fp_|msi_|bat-)")


def valid_allele(allele: Column) -> Column:
    return allele.rlike("^[ACGTNacgtn-]+$")


def variant_type(ref: Column, alt: Column) -> Column:
    r, a = F.length(ref), F.length(alt)
    return F.when((r == 1) & (a == 1), "SNV").when(r == a, "MNV").when((r < a) & alt.startswith(ref), "INS").when((r > a) & ref.startswith(alt), "DEL").otherwise("COMPLEX")


def length_bin(length: Column) -> Column:
    """Number of the 5-bp bin in which GC factors are kept (60 to 1000 bp; others are put in the nearest)."""
    return F.greatest(F.lit(0), F.least(F.lit(187), F.floor((length - 60) / 5))).cast("int")


def reverse_complement(sequence: Column) -> Column:
    return F.reverse(F.translate(F.upper(sequence), "ACGT", "TGCA"))


def kmer_index(kmer: Column, k: int) -> Column:
    """Place of a k-mer in A C G T order, null if it holds anything else."""
    total = F.lit(0)
    for i in range(1, k + 1):
        total = total * 4 + (F.instr(F.lit("ACGT"), F.substring(kmer, i, 1)) - 1)
    return F.when(kmer.rlike(f"^[ACGT]{{{k}}}$"), total)


def gc_fraction(sequence: Column, empty: float | None = 0.0, all_bases: bool = False) -> Column:
    """Share of G and C among A, C, G, T (or among all letters)."""
    gc = F.length(F.regexp_replace(sequence, "[^GCgc]", ""))
    n = F.length(sequence) if all_bases else F.length(F.regexp_replace(sequence, "[^ACGTacgt]", ""))
    return F.when(n == 0, empty).otherwise(gc / n)


def zscore(x: Column, mean: Column, std: Column, least: float = 0.0, missing: float | None = None) -> Column:
    """(x - mean) / std; 0 where std isn't above `least`, `missing` where there is no baseline."""
    return F.when(mean.isNull() | std.isNull(), F.lit(missing).cast("double")).when(std > least, (x - mean) / std).otherwise(0.0)


def duplex_weight(depth: Column, qname: Column) -> Column:
    """ln(depth), at least 1: depth from the cD tag, else the sum of the read name's fields 4 and 5, else 1."""
    parts = F.split(qname, ":")
    named = F.try_add(F.get(parts, F.lit(3)).try_cast("int"), F.get(parts, F.lit(4)).try_cast("int"))
    d = F.coalesce(depth.cast("int"), named)
    return F.when(d.isNull() | (d < 1), 1.0).otherwise(F.greatest(F.log(d.cast("double")), F.lit(1.0)))


#: Mean and deviation of tumour and of healthy fragments, by kind of sample.
PRESETS = {"human": ((145.0, 35.0), (167.0, 30.0)), "canine": ((130.0, 30.0), (153.0, 25.0)), "ssdna": ((135.0, 35.0), (157.0, 30.0))}


def log_likelihood_ratio(length: Column, preset: str = "human") -> Column:
    """ln N(length; tumour) - ln N(length; healthy) of the preset, densities at least 1e-15."""

    def density(mean: float, std: float) -> Column:
        z = (length - mean) / std
        return F.greatest(F.exp(-0.5 * z * z) / (std * 2.5066282746310002), F.lit(1e-15))

    tumour, healthy = PRESETS[preset]
    return F.log(density(*tumour)) - F.log(density(*healthy))
