"""Byte-level BPE encoding and decoding over a global distinct-word shuffle.

1. Texts are split into pre-tokens with positions. Rows of one task are
   gathered into blocks; a block keeps, per document, the sequence of local
   word numbers (positions are implied by order) and its distinct words.
2. The distinct words of a block are dealt by a hash of the word to buckets.
   A bucket sees every block's copy of a word and encodes it once.
3. The ids go back to their block, which reassembles its documents by
   position.
4. Decoding looks ids up in the token-byte table.

A word of any frequency reaches its bucket once per block, so frequent words
aren't hot. Words travel packed (one row per block and bucket). Texts are split
once for the words and once for the sequences, which costs less than writing
the sequences would; both carry a checksum of the block's words, and a task that
finds two that differ (rows that came in another order) fails.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points of text that a block holds before it is closed.
BLOCK = 8_000_000

_LETTER, _NUMBER, _SPACE = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\\t-\\r \\x85\\xa0"
#: The public pattern, restated for texts that fit Latin-1 (same matches; the standard engine is faster).
_LATIN = re.compile(rf" ?[{_LETTER}]+|'(?:[stmd]|re|ve|ll)| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")

BLOCKS = "block long, bucket int, mark long, idents array<long>, lengths array<int>, packed binary"


@functools.lru_cache(2)
def _any_pattern():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


def pre_tokens(text: str) -> list[str]:
    """The matches of public_tokenizers.PATTERN in text; together they are the text."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _any_pattern().findall(text)
    return _LATIN.findall(text)


@functools.lru_cache(2)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@functools.lru_cache(2)
def _table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths by id, and all tokens' bytes."""
    ranks = _ranks(path)
    table = [b""] * (1 + max(ranks.values()))
    for token, rank in ranks.items():
        table[rank] = token
    sizes = np.array([len(t) for t in table], np.int64)
    return np.cumsum(sizes) - sizes, sizes, np.frombuffer(b"".join(table), np.uint8)


def _decoded(path: str, ids: np.ndarray) -> bytes:
    starts, sizes, flat = _table(path)
    return _gather(starts[ids], sizes[ids], flat).tobytes()


@functools.lru_cache(2)
def _encoder(path: str):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks(path), special_tokens={})


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned integers, byte planes apart (high bytes are mostly zero), compressed."""
    head = np.array([len(a) for a in arrays], "<u4").tobytes()
    planes = [a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for a in arrays]
    return bytes([len(arrays)]) + head + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(raw: bytes) -> list[np.ndarray]:
    n = raw[0]
    sizes = np.frombuffer(raw, "<u4", n, 1)
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1 + 4 * n :]), np.uint8)
    out, at = [], 0
    for size in map(int, sizes):
        out.append(np.ascontiguousarray(body[at : at + 4 * size].reshape(4, size).T).view("<u4").reshape(-1))
        at += 4 * size
    return out


def _gather(starts: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The slices flat[start : start + length], one after the other."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    return flat[np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)]


def _split(buckets: int, block_size: int, sequences: bool):
    """Blocks of the rows: their sequences (bucket -1), or else their words by bucket."""
    def close(block: int, idents: list, lengths: list, codes: list, words: dict):
        listed = list(words)
        bucket = np.fromiter((zlib.crc32(w.encode()) for w in listed), np.int64, len(listed)) % buckets
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        mark, rows = zlib.crc32("\n".join(listed).encode()), []
        if sequences:
            rows.append((block, -1, mark, idents, lengths, _pack(np.concatenate(codes), rank)))
            order = order[:0]
        bounds = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=buckets)) if len(order) else np.zeros(1, int)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            own = [listed[i].encode() for i in order[a:b]]
            body = np.array([len(w) for w in own], "<u4").tobytes() + b"".join(own)
            packed = len(own).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(body)
            rows.append((block, int(bucket[order[a]]), mark, None, None, packed))
        names = [("block", pa.int64()), ("bucket", pa.int32()), ("mark", pa.int64()), ("idents", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("packed", pa.binary())]
        for i in range(0, len(rows), 256):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows[i : i + 256], strict=True), names, strict=True)], [n for n, _ in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        idents, lengths, codes, words, size = [], [], [], defaultdict(count().__next__), 0
        for batch in batches:
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                found = pre_tokens(text)
                idents.append(ident)
                lengths.append(len(found))
                codes.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
                size += len(text)
                if size >= block_size:
                    yield from close(block, idents, lengths, codes, words)
                    block, idents, lengths, codes, words, size = block + 1, [], [], [], defaultdict(count().__next__), 0
        if idents:
            yield from close(block, idents, lengths, codes, words)

    return run


def _encode_words(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path).encode_ordinary
        current, known = None, {}
        for batch in batches:
            packed = []
            for bucket, raw in zip(batch.column("bucket").to_pylist(), batch.column("packed"), strict=True):
                raw = raw.as_py()
                if bucket != current:
                    current, known = bucket, {}
                n = int.from_bytes(raw[:4], "little")
                body = zstandard.ZstdDecompressor().decompress(raw[4:])
                lengths, at, ids = np.frombuffer(body, "<u4", n), 4 * n, []
                for size in lengths.tolist():
                    word = body[at : at + size]
                    at += size
                    if (got := known.get(word)) is None:
                        got = known[word] = encode(word.decode())
                    ids.append(got)
                sizes = np.fromiter(map(len, ids), np.int64, n)
                packed.append(_pack(sizes, np.fromiter((i for x in ids for i in x), np.int64, int(sizes.sum()))))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("bucket"), batch.column("mark"), batch.column("idents"), batch.column("lengths"), pa.array(packed, pa.binary())], batch.schema.names)

    return run


def _reassemble(ident: str, path: str, into: str | None):
    def finish(head: dict, words: list[bytes]) -> Iterator[pa.RecordBatch]:
        codes, rank = _unpack(head["packed"])
        sizes = flat = np.zeros(0, np.int64)
        if words:
            parts = [_unpack(w) for w in words]
            sizes, flat = np.concatenate([p[0] for p in parts]).astype(np.int64), np.concatenate([p[1] for p in parts]).astype(np.int32)
        starts = np.cumsum(sizes) - sizes
        at, out, ends, size, idents = 0, [], [0], 0, []
        for one, length in zip(head["idents"], head["lengths"], strict=True):
            own = rank[codes[at : at + length]]
            at += length
            out.append(_gather(starts[own], sizes[own], flat))
            ends.append(ends[-1] + len(out[-1]))
            idents.append(one)
            size += len(out[-1])
            if size > 2_000_000:
                yield build(idents, ends, out)
                out, ends, size, idents = [], [0], 0, []
        if idents:
            yield build(idents, ends, out)

    def build(idents: list, ends: list, out: list) -> pa.RecordBatch:
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(out), pa.int32()))
        texts = [pa.array([_decoded(path, one) for one in out], pa.binary())] if into else []
        return pa.RecordBatch.from_arrays([pa.array(idents, pa.int64()), ids, *texts], [ident, "ids", *([into] if into else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, words = None, []
        for batch in batches:
            for i, bucket in enumerate(batch.column("bucket").to_pylist()):
                if bucket < 0:
                    if head is not None:
                        yield from finish(head, words)
                    head, words = batch.slice(i, 1).to_pylist()[0], []
                else:
                    if head is None or (batch.column("block")[i].as_py(), batch.column("mark")[i].as_py()) != (head["block"], head["mark"]):
                        raise RuntimeError("the rows of a block came in another order when they were read again")
                    words.append(batch.column("packed")[i].as_py())
        if head is not None:
            yield from finish(head, words)

    return run


def encode(docs: DataFrame, path: str, text: str = "text", ident: str = "doc_id", buckets: int | None = None, block_size: int = BLOCK, into: str | None = None) -> DataFrame:
    """(ident, ids): the BPE ids of each whole text under the ranks in path; with into, a column of the bytes that its ids decode to as well.

    One row per input row, repeated ids included; a null text counts as empty
    and has no ids, a null id stays null. buckets (four times the shuffle
    partitions by default) is how many ways the distinct words are dealt; it
    should follow the size of the corpus. docs is read twice and must give its
    rows in the same order both times, as files do. into saves a second set
    of Python workers beside those that put the ids together.
    """
    spark = docs.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(ident).cast("long").alias(ident), F.col(text).alias("__text"))
    words = rows.mapInArrow(_split(buckets, block_size, False), BLOCKS).repartition("bucket").sortWithinPartitions("bucket")
    coded = words.mapInArrow(_encode_words(path), BLOCKS)
    whole = rows.mapInArrow(_split(buckets, block_size, True), BLOCKS).unionAll(coded).repartition("block").sortWithinPartitions("block", "bucket")
    return whole.mapInArrow(_reassemble(ident, path, into), f"`{ident}` long, ids array<int>" + (f", `{into}` binary" if into else ""))


def decode(encoded: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """encoded with the bytes of its ids, by the token-byte table (fixed by the vocabulary, so each task holds it).

    A null or empty list gives no bytes; an id that isn't in the table fails.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(ids)
            out = []
            for one in lists:
                own = np.zeros(0, np.int64) if one.values is None else one.values.to_numpy(zero_copy_only=False)
                out.append(_decoded(path, own))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, into])

    from pyspark.sql.types import BinaryType, StructField, StructType

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField(into, BinaryType())]))
