"""Personal data by bootstrapped contextual extraction.

Seeds are the spans of four plain kinds. The whole words before the token that
holds a seed make lexical patterns (the last word, and the last two). A first
scan writes, per document, its seeds and its other candidates (runs of tokens
that hold digits but are no seed) with their patterns. A second scan counts
how often each pattern occurs at all, followed by anything. Spark then scores
the pattern-instance graph over some rounds: a pattern's score is the summed
score of its instances over all its occurrences, a candidate's score is that
of its best pattern. Candidates behind patterns of high confidence are added
as kind ``found``. Patterns and values travel as 64-bit hashes, whatever the
length of their words.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plasmaspark.llm.hashing import WordHashes, sequences
from plasmaspark.llm.store import written

KINDS = ("email", "ip", "card", "phone", "found")
#: A pattern counts from so many distinct instances, and is trusted from this share of its occurrences.
SUPPORT, TRUST, ROUNDS = 3, 0.5, 3
#: Bits of the table by which the second scan knows patterns that may count; fixed, whatever the corpus.
SIEVE = 1 << 24

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")
#: Neighbouring tokens with digits, at one blank and with no punctuation between them.
_DIGITS = re.compile(r"(?<!\S)[^\s0-9]*+[0-9]\S*+(?:(?<=\w) [^\s0-9]*+[0-9]\S*+)*+")
_DIGIT = re.compile(r"(?<!\S)[^\s0-9]*+[0-9]\S*+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: from the start of the run of local characters before an @, if a domain follows."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def _without_zeros(digits: str) -> str:
    return digits.lstrip("0")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the four plain kinds, by kind as listed and then start."""
    found = [(a, b, "email") for a, b in _emails(text)]
    found += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p) < 4 and int(p or 0) <= 255 for p in map(_without_zeros, m.group().split(".")))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), "card"))
    if "+" in text:
        found += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return found


def entities(text: str, hashes: WordHashes | None = None) -> list[tuple[str, int, int, int, list[int]]]:
    """(kind, start, end, value, patterns) of the seeds, and of candidates with an empty kind.

    Values and patterns are hashes; a pattern is of the last whole word before
    the token in which the entity starts, or of the last two, in lower case.
    """
    hashes = WordHashes() if hashes is None else hashes
    base = base_spans(text)
    taken = sorted((a, b) for a, b, _ in base)
    spans, i = [(a, b, k) for a, b, k in base], 0
    for m in _DIGITS.finditer(text):
        a, b = m.span()
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        parts, j = [(a, b)], i
        if i < len(taken) and taken[i][0] < b:  # a seed is among the tokens; the others are candidates one by one
            parts = []
            for n in _DIGIT.finditer(text, a, b):
                while j < len(taken) and taken[j][1] <= n.start():
                    j += 1
                if not (j < len(taken) and taken[j][0] < n.end()):
                    parts.append(n.span())
        for a, b in parts:
            value = text[a:b].rstrip(".,;:!?)\"'")
            spans.append((a, a + len(value), ""))
    if not spans:
        return []
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    starts, known, out = [t[0] for t in tokens], {}, []
    for a, b, kind in spans:
        at = bisect_right(starts, a) - 1
        if at not in known:
            before = hashes.of([text[x:y].lower().encode() for x, y in tokens[max(0, at - 2) : at]])
            known[at] = [int(sequences(before[-n:], n)[0]) for n in (1, 2) if len(before) >= n]
        out.append((kind, a, b, int(hashes.of([text[a:b].encode()])[0]), known[at]))
    return out


_ENTITY = T.ArrayType(T.StructType().add("kind", "string").add("start", "integer").add("end", "integer").add("value", "long").add("patterns", T.ArrayType(T.LongType())))


def _first_scan(text: str):
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.int64()), ("patterns", pa.list_(pa.int64()))]))
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, hashes = TaskContext.get().partitionId() << 40, WordHashes()
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b, "value": signed(v), "patterns": [signed(p) for p in ps]} for k, a, b, v, ps in entities(t.as_py() or "", hashes)] for t in batch.column(text)]
            rows = pa.array(range(row, row + len(found)), pa.int64())
            row += len(found)
            yield pa.RecordBatch.from_arrays([*batch.columns, rows, pa.array(found, arrow)], [*batch.schema.names, "__id", "__found"])

    return run


def _second_scan(sieve: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hashes = np.unpackbits(np.frombuffer(sieve, np.uint8), bitorder="little"), WordHashes()
        through = lambda p: p[bits[p % np.uint64(SIEVE)] == 1]
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                found = []
                for t in batch.column(0).slice(i, 500):
                    each = hashes.of([w.encode() for w in (t.as_py() or "").lower().split()])
                    found += [through(sequences(each, n)) for n in (1, 2) if len(each) >= n]
                patterns, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
                if len(patterns):
                    yield pa.RecordBatch.from_arrays([pa.array(patterns.view(np.int64)), pa.array(n)], ["pattern", "n"])

    return run


def _sieve(patterns: DataFrame) -> bytes:
    """A bit for each remainder of the patterns by SIEVE, of SIEVE bits, built by Spark in pieces of 32768."""
    slot = F.col("pattern").bitwiseAND(SIEVE - 1) + 1
    pieces = patterns.select(F.bitmap_bucket_number(slot).alias("piece"), F.bitmap_bit_position(slot).alias("bit")).groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(SIEVE // 8, np.uint8)
    for row in pieces.collect():  # SIEVE / 8 bytes at most
        out[(row.piece - 1) * 4096 : row.piece * 4096] = np.frombuffer(bytes(row.bits), np.uint8)
    return out.tobytes()


def _discover(docs: DataFrame, text: str, first: DataFrame) -> DataFrame:
    """(__id, place) of the candidates that trusted patterns reach."""
    each = first.select("__id", F.posexplode("__found").alias("place", "e")).select("__id", "place", "e.value", (F.col("e.kind") != "").alias("seed"), F.explode("e.patterns").alias("pattern"))
    # distinct instances per pattern, without gathering a frequent pattern's instances
    instances = each.groupBy("pattern", "value").agg(F.max("seed").alias("seed"), F.count("*").alias("times"))
    graph = written(instances, "pattern-graph")
    support = graph.groupBy("pattern").agg(F.count("*").alias("values")).where(F.col("values") >= SUPPORT)
    supported = written(support.select("pattern"), "patterns")
    counted = docs.select(F.col(text).alias("__text")).mapInArrow(_second_scan(_sieve(supported)), "pattern long, n long")
    totals = counted.groupBy("pattern").agg(F.sum("n").alias("occurs")).join(supported, "pattern")
    totals = written(totals, "pattern-totals")
    known = written(graph.join(totals, "pattern"), "graph")
    score = known.groupBy("pattern", "occurs").agg(F.sum(F.when(F.col("seed"), F.col("times")).otherwise(0)).cast("double").alias("own"), F.count_if("seed").alias("seeds"))
    score = score.select("pattern", F.when(F.col("seeds") >= SUPPORT, F.least(F.lit(1.0), F.col("own") / F.col("occurs"))).otherwise(0.0).alias("score"))
    for _ in range(ROUNDS - 1):
        values = known.join(score, "pattern").groupBy("value").agg(F.max(F.when(F.col("score") >= TRUST, F.col("score"))).alias("reached"))
        worth = F.when(F.col("seed"), 1.0).otherwise(F.coalesce("reached", F.lit(0.0)))
        score = known.join(values, "value").groupBy("pattern", "occurs").agg(F.sum(F.col("times") * worth).alias("own"), F.count_if(worth > 0).alias("values"))
        score = written(score.select("pattern", F.when(F.col("values") >= SUPPORT, F.least(F.lit(1.0), F.col("own") / F.col("occurs"))).otherwise(0.0).alias("score")), "pattern-scores")
    trusted = score.where(F.col("score") >= TRUST).select("pattern")
    return each.where(~F.col("seed")).join(trusted, "pattern", "left_semi").select("__id", "place").distinct()


def _spanned(docs: DataFrame, text: str) -> DataFrame:
    """docs with base and spans (arrays of kind, start, end)."""
    first = written(docs.mapInArrow(_first_scan(text), T.StructType([*docs.schema.fields, T.StructField("__id", T.LongType()), T.StructField("__found", _ENTITY)])), "entities")
    found = _discover(docs, text, first).groupBy(F.col("__id").alias("__of")).agg(F.sort_array(F.collect_list("place")).alias("__places"))
    span = lambda e: F.struct(e["kind"].alias("kind"), e["start"].alias("start"), e["end"].alias("end"))
    base = F.transform(F.filter("__found", lambda e: e["kind"] != ""), span)
    more = F.transform(F.coalesce("__places", F.array().cast("array<int>")), lambda p: F.struct(F.lit("found").alias("kind"), F.element_at("__found", p + 1)["start"].alias("start"), F.element_at("__found", p + 1)["end"].alias("end")))
    joined = first.join(found, F.col("__id") == F.col("__of"), "left")
    return joined.select(*[joined[c] for c in docs.columns], base.alias("__base"), F.concat(base, more).alias("__spans"))


def find(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(doc_id, base, spans) per row: spans by kind as listed, then start; code points, ends exclusive.

    Null texts count as empty; null ids stay null; repeated rows are returned
    each. An empty table gives an empty result.
    """
    return _spanned(docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("__text")), "__text").select("doc_id", F.col("__base").alias("base"), F.col("__spans").alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs, with every span in text replaced by its kind in angle brackets (overlapping spans by the first's). Null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, spans in zip(batch.column(text), batch.column("__spans").to_pylist(), strict=True):
                t, parts, at = t.as_py(), [], 0
                for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
                    if s["start"] >= at:
                        parts += [t[at : s["start"]], f"<{s['kind']}>"]
                    at = max(at, s["end"])
                out.append(t if not spans else "".join(parts) + t[at:])
            place = batch.schema.get_field_index(text)
            columns = [pa.array(out, pa.string()) if i == place else c for i, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    spanned = _spanned(docs, text)
    return spanned.select(*docs.columns, "__spans").mapInArrow(run, docs.schema)
