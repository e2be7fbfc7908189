"""Aligned reads from BAM files, and reference sequence from FASTA files, by byte ranges.

A BAM file is cut into ranges of compressed blocks. A task finds the first
block in its range, then the first record that starts there (a place from which
several records in a row make sense), and reads on to the end of the last
record that starts in its range. So any number of tasks share a file, each
record is read by one, and none holds more than a few blocks. A FASTA file is
cut by its index (made in one streaming pass where none lies beside it).
Files are opened through Arrow's file systems. CRAM and gzipped FASTA files
aren't read.
"""

from __future__ import annotations

import struct
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READS = "path string, qname string, flag int, chrom string, pos long, mapq int, cigar array<struct<op:string,len:int>>, tlen long, seq string, qual array<int>, xm string, cd int"

# The format's letters for bases and CIGAR operations, and sizes of tag values.
_BASES, _OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_NUMBERS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}


#: Compressed bytes of a BAM file that one task reads, and how many records in a row must make sense.
RANGE, SENSIBLE = 32 << 20, 6
_MAGIC = b"\x1f\x8b\x08\x04"


def opened(path: str):
    """The file at a path or address, open for reading at any place."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Path and size of the files under path; their contents aren't read."""
    return sorted((r.path, r.length) for r in spark.read.format("binaryFile").load(path).select("path", "length").collect())


def _over(spark: SparkSession, parts: list, read, schema: str) -> DataFrame:
    """The frames that read gives of each part, a task for each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in frame["id"]:
                yield from read(parts[i])

    return spark.range(0, len(parts), 1, max(1, len(parts))).mapInPandas(run, schema)


def _frames(rows: Iterator[tuple], names: list[str], size: int) -> Iterator[pd.DataFrame]:
    while some := list(islice(rows, size)):
        yield pd.DataFrame(some, columns=names)


def _block_size(head: bytes) -> int:
    """Size of the block whose first bytes these are; 0 if it isn't one of blocked gzip."""
    if len(head) < 18 or not head.startswith(_MAGIC):
        return 0
    at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 6 <= min(end, len(head)):
        if head[at : at + 2] == b"BC":
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + struct.unpack_from("<H", head, at + 2)[0]
    return 0


class _Blocks:
    """Uncompressed data from the block at a place on, and which block each byte of it is from."""

    def __init__(self, file, at: int):
        self.file, self.next, self.held, self.at, self.base = file, at, b"", 0, 0
        self.places: deque[tuple[int, int]] = deque()  # (end in uncompressed bytes, place in the file) of the held blocks

    def more(self) -> bool:
        self.file.seek(self.next)
        head = self.file.read(1 << 16)
        if not head:
            return False
        size = _block_size(head)
        if not size:
            raise ValueError("the file isn't one of blocked gzip")
        whole = head[:size] if size <= len(head) else head + self.file.read(size - len(head))
        if len(whole) < size:
            raise ValueError("the file is truncated")
        data = zlib.decompress(whole, wbits=31)
        self.held, self.base, self.at = self.held[self.at :] + data, self.base + self.at, 0
        self.places.append((self.base + len(self.held), self.next))
        self.next += size
        return True

    def place(self) -> int:
        """Place in the file of the block that holds the next byte."""
        while self.places and self.places[0][0] <= self.base + self.at:
            self.places.popleft()
        return self.places[0][1] if self.places else self.next

    def ready(self, n: int) -> bool:
        """Whether n bytes more could be held."""
        while len(self.held) - self.at < n:
            if not self.more():
                return False
        return True

    def take(self, n: int) -> bytes:
        if not self.ready(n):
            if len(self.held) > self.at:
                raise ValueError("the file ends within a record")
            return b""
        self.at += n
        return self.held[self.at - n : self.at]


def _header(stream: _Blocks) -> list[str]:
    """Names of the reference sequences; the stream is at the first record then."""
    if stream.take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    stream.take(struct.unpack("<i", stream.take(4))[0])
    names = []
    for _ in range(struct.unpack("<i", stream.take(4))[0]):
        names.append(stream.take(struct.unpack("<i", stream.take(4))[0])[:-1].decode())
        stream.take(4)
    return names


def _first_block(file, start: int, size: int) -> int | None:
    """Place of the first block at or after start: a block's head whose successor is one too, or the file's end."""
    file.seek(start)
    near = file.read((1 << 16) + (1 << 17))
    at = near.find(_MAGIC)
    while at >= 0:
        if n := _block_size(near[at : at + 18 + 256]):
            follows = start + at + n
            if follows == size:
                return start + at
            file.seek(follows)
            if _block_size(file.read(18 + 256)):
                return start + at
        at = near.find(_MAGIC, at + 1)
    return None


def _sensible(held: bytes, at: int, names: int) -> int:
    """Size of the record at a place if it can be one, else 0."""
    size, ref, pos, name_len, _, _, n_ops, _, length, mate, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", held, at)
    if not (size >= 32 and -1 <= ref < names and -1 <= mate < names and pos >= -1 and mate_pos >= -1 and name_len and length >= 0):
        return 0
    if 32 + name_len + 4 * n_ops + (length + 1) // 2 + length > size:
        return 0
    name = held[at + 36 : at + 36 + name_len]
    return 0 if name[-1:] not in (b"\0", b"") or any(not 33 <= c <= 126 for c in name[:-1]) else size + 4


def _seek_record(stream: _Blocks, names: int, end: int) -> bool:
    """Move the stream to the first place from which SENSIBLE records follow each other (or all up to the file's end)."""
    while stream.ready(1) and stream.place() < end:
        away, seen = 0, 0  # the stream's held bytes move, so places are counted from its own
        while 0 <= seen < SENSIBLE and (stream.ready(away + 36 + 256) or len(stream.held) - stream.at - away >= 36):
            size = _sensible(stream.held, stream.at + away, names)
            away, seen = away + size, seen + 1 if size and stream.ready(away + size) else -1
        if seen > 0:
            return True
        stream.at += 1
    return False


def _tags(raw: bytes) -> dict[str, object]:
    found, at = {}, 0
    while at + 3 <= len(raw):
        name, kind = raw[at : at + 2].decode(), chr(raw[at + 2])
        at += 3
        if kind in "ZH":
            end = raw.index(0, at)
            found[name], at = raw[at:end].decode(), end + 1
        elif kind == "B":
            sub, n = chr(raw[at]), struct.unpack_from("<i", raw, at + 1)[0]
            at += 5 + n * _SIZES[sub]
        else:
            if kind in _NUMBERS:
                found[name] = struct.unpack_from(_NUMBERS[kind], raw, at)[0]
            at += _SIZES[kind]
    return found


def _record(body: bytes, names: list[str]) -> tuple:
    ref, pos, name_len, mapq, _, n_ops, flag, length, _, _, tlen = struct.unpack_from("<iiBBHHHiiii", body)
    at = 32
    qname = body[at : at + name_len - 1].decode()
    at += name_len
    cigar = [{"op": _OPS[c & 15], "len": c >> 4} for c in struct.unpack_from(f"<{n_ops}I", body, at)]
    at += 4 * n_ops
    packed = body[at : at + (length + 1) // 2]
    seq = "".join(_BASES[b >> 4] + _BASES[b & 15] for b in packed)[:length]
    at += len(packed)
    qual = list(body[at : at + length])
    tags = _tags(body[at + length :])
    return qname, flag, names[ref] if ref >= 0 else None, pos, mapq, cigar, tlen, seq, qual, tags.get("XM"), tags.get("cD")


def records(path: str, size: int, start: int, end: int) -> Iterator[tuple]:
    """(path, qname, flag, chrom, pos, mapq, cigar, tlen, seq, qual, xm, cd) of the reads that start in blocks from start to end of a BAM file."""
    with opened(path) as file:
        stream = _Blocks(file, 0)
        names = _header(stream)
        if start > 0:
            first = _first_block(file, start, size)
            if first is None or first >= end:
                return
            stream = _Blocks(file, first)
            if not _seek_record(stream, len(names), end):
                return
        while stream.ready(1) and stream.place() < end and (head := stream.take(4)):
            yield path, *_record(stream.take(struct.unpack("<i", head)[0]), names)


def read_bam(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """All reads of the BAM files under path, by ranges of so many compressed bytes. An empty or cut-off file fails."""
    parts = [(file, length, at, min(at + size, length)) for file, length in _files(spark, path) for at in range(0, max(length, 1), size)]
    names = [f.split()[0] for f in READS.split(", ")]
    return _over(spark, parts, lambda part: _frames(records(*part), names, 20_000), READS)


def fasta_index(path: str) -> list[tuple[str, int, int, int, int]]:
    """(name, bases, place, bases a line, bytes a line) of each sequence, from the .fai beside the file or else from the file itself, in pieces."""
    try:
        with opened(path + ".fai") as file:
            return [(r[0], *map(int, r[1:5])) for r in (line.split("\t") for line in file.read().decode().splitlines() if line.strip())]
    except FileNotFoundError:
        pass
    found, at = [], 0
    with opened(path) as file:
        rest = b""
        while piece := file.read(8 << 20):
            *lines, rest = (rest + piece).split(b"\n")
            for line in lines:
                at = _index_line(found, line, at, len(line) + 1)
        if rest:
            _index_line(found, rest, at, len(rest) + 1)
    return [tuple(f[:5]) for f in found]


def _index_line(found: list, line: bytes, at: int, width: int) -> int:
    line = line.rstrip(b"\r")
    if line.startswith(b">"):
        found.append([line[1:].split()[0].decode(), 0, at + width, 0, 0, False])
    elif found and line.strip():
        own = found[-1]
        if own[5]:
            raise ValueError(f"lines of {own[0]} differ in length")
        if not own[3]:
            own[3], own[4] = len(line), width
        own[1], own[5] = own[1] + len(line), len(line) < own[3]
        if len(line) > own[3]:
            raise ValueError(f"lines of {own[0]} differ in length")
    return at + width


def read_fasta(spark: SparkSession, path: str, tile: int = 10_000, more: int = 0, size: int = 4 << 20) -> DataFrame:
    """(chrom, tile, seq): a reference as tiles of `tile` bases and the `more` that follow, so that ranges are looked up by an equi-join.

    A task reads the tiles of about `size` bases.
    """
    step = max(1, size // tile)
    parts = [(file, entry, first, min(first + step, -(-entry[1] // tile))) for file, _ in _files(spark, path) if not file.endswith((".fai", ".gzi")) for entry in fasta_index(file) for first in range(0, -(-entry[1] // tile), step)]

    def cut(part: tuple) -> Iterator[pd.DataFrame]:
        file, (name, bases, place, line, width), first, last = part
        begin, end = first * tile, min(bases, last * tile + more)
        at = lambda base: place + base // line * width + base % line
        with opened(file) as source:
            source.seek(at(begin))
            seq = source.read(at(end) - at(begin)).replace(b"\n", b"").replace(b"\r", b"").decode().upper()
        yield pd.DataFrame([(name.removeprefix("chr"), i, seq[i * tile - begin : min(i * tile + tile + more, end) - begin]) for i in range(first, last)], columns=["chrom", "tile", "seq"])

    return _over(spark, parts, cut, "chrom string, tile long, seq string")


def fetch(ranges: DataFrame, tiles: DataFrame, by: list[str], tile: int = 10_000) -> DataFrame:
    """ranges (chrom, start, end and the columns in by) with the sequence that they cover."""
    each = ranges.withColumn("tile", F.explode(F.expr(f"sequence(start div {tile}, (end - 1) div {tile})")))
    begin = F.greatest(F.col("start") - F.col("tile") * tile, F.lit(0))
    stop = F.least(F.col("end") - F.col("tile") * tile, F.lit(tile))
    parts = each.join(tiles, ["chrom", "tile"]).withColumn("part", F.substring("seq", begin.cast("int") + 1, (stop - begin).cast("int")))
    joined = parts.groupBy(*by, "chrom", "start", "end").agg(F.sort_array(F.collect_list(F.struct("tile", "part"))).alias("p"))
    return joined.select(*by, "chrom", "start", "end", F.concat_ws("", F.transform("p", lambda x: x["part"])).alias("seq"))
