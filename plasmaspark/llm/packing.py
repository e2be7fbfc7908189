"""Packing by concatenate and cut.

Pass one tokenises every document, gives each its offset within its partition
and writes the ids once. The partition totals (one number each) are summed to
the partition's global offset. Pass two cuts the global stream into fixed
windows: a document that crosses a window's end leaves one record per window.
No row is shuffled in either pass.
"""

from __future__ import annotations

import functools
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plasmaspark.llm.store import written

LIMIT = 4096
END = 2
#: Distinct words that a Python worker remembers before it starts anew.
REMEMBERED = 1_000_000

_LETTER, _NUMBER, _SPACE = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾", "\\t-\\r \\x85\\xa0"
#: The vocabulary's own split into words, restated for lower-cased texts that fit Latin-1.
_LATIN = re.compile(rf"[{_LETTER}]+|'(?:[stmd]|re|ve|ll)|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")


class WordTokenizer:
    """ids of whole texts; each distinct word is given to the library once.

    Texts that don't fit Latin-1, or that hold one of the vocabulary's special
    tokens, go to the library whole, which reads these as it does in a plain call.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = re.compile("|".join(re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()) or r"(?!)", re.IGNORECASE)
        vocabulary = self.library.get_vocab()
        self.closes = np.zeros(1 + max(vocabulary.values()), bool)
        self.dtype = np.dtype("<u2" if len(self.closes) <= 1 << 16 else "<u4")
        for token, i in vocabulary.items():
            self.closes[i] = token.endswith("</w>")
        self.forget()

    def forget(self) -> None:
        self.codes: dict[str, int] = defaultdict(count().__next__)
        self.known = 0
        self.starts, self.sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.flat, self.filled = np.zeros(1 << 18, self.dtype), 0

    def _learn(self, words: list[str]) -> None:
        """Encode new words, many to a call; the last piece of each word shows where it ends."""
        for i in range(0, len(words), 2000):
            own = words[i : i + 2000]
            ids = np.array(self.library.encode(" ".join(own), add_special_tokens=False).ids, np.int64)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(own):  # a word that isn't whole on its own; none is known
                each = [self.library.encode(w, add_special_tokens=False).ids for w in own]
                ids, ends = np.array([j for x in each for j in x], np.int64), np.cumsum([len(x) for x in each])
            while self.known + len(own) > len(self.starts):
                self.starts, self.sizes = np.concatenate([self.starts, np.zeros_like(self.starts)]), np.concatenate([self.sizes, np.zeros_like(self.sizes)])
            while self.filled + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            begins = np.concatenate([[0], ends[:-1]])
            self.starts[self.known : self.known + len(own)] = self.filled + begins
            self.sizes[self.known : self.known + len(own)] = ends - begins
            self.flat[self.filled : self.filled + len(ids)] = ids
            self.known, self.filled = self.known + len(own), self.filled + len(ids)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        from plasmaspark.llm.byte_bpe import _gather

        if self.known > REMEMBERED:
            self.forget()
        coded: list = []
        for text in texts:
            try:
                (text or "").encode("latin-1")
                whole = self.special.search(text or "")
            except UnicodeEncodeError:
                whole = True
            if whole:
                coded.append(text)
                continue
            words = _LATIN.findall((text or "").lower())
            coded.append(np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words)))
        if len(self.codes) > self.known:
            self._learn(list(self.codes)[self.known :])
        return [np.array(self.library.encode(c, add_special_tokens=False).ids, self.dtype) if isinstance(c, str) else _gather(self.starts[c], self.sizes[c], self.flat) for c in coded]


@functools.lru_cache(1)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


TOKENS = "doc_id long, pid int, shift long, doc_tokens long, ids binary"


def _tokenise(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, shift, own = TaskContext.get().partitionId(), 0, tokenizer(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                ids = [np.append(x, own.dtype.type(end)) for x in own.encode(part.column(1).to_pylist())]
                sizes = np.array([len(x) for x in ids], np.int64)
                shifts = shift + np.cumsum(sizes) - sizes
                shift += int(sizes.sum())
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([pid] * len(ids), pa.int32()), pa.array(shifts), pa.array(sizes), pa.array([x.astype(own.dtype).tobytes() for x in ids], pa.binary())], ["doc_id", "pid", "shift", "doc_tokens", "ids"])

    return run


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, boundary boolean"


def _cut(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PIECES.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        for batch in batches:
            rows, size = [], 0
            for doc, at, tokens, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "at", "doc_tokens")), batch.column("ids"), strict=True):
                ids, start = np.frombuffer(raw := raw.as_py(), f"<u{len(raw) // tokens}").astype("<u4"), 0
                while start < tokens:
                    sequence, offset = divmod(at + start, limit)
                    length = min(limit - offset, tokens - start)
                    rows.append((doc, start, length, ids[start : start + length].tobytes(), tokens, sequence, offset, start > 0 or length < tokens))
                    start += length
                    size += length
                if size > 2_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return run


def pack(docs: DataFrame, path: str, text: str = "text", ident: str = "doc_id", limit: int = LIMIT, end: int = END) -> DataFrame:
    """Pieces of documents in sequences of at most limit tokens; all but the last sequence are full.

    A document is its ids and then end. Each row is a piece: start and length
    within its document, its ids (little-endian unsigned 32-bit), sequence_id,
    offset there, and whether its document was cut (boundary). A null text
    counts as empty: its only token is end. Repeated rows are packed each for
    itself. An empty table gives no pieces.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("__text"))
    tokens = written(rows.mapInArrow(_tokenise(path, end), TOKENS), "tokens")
    totals = sorted(tokens.groupBy("pid").agg(F.sum("doc_tokens")).collect())  # one number per input partition
    bases, at = [], 0
    for pid, n in totals:
        bases.append((pid, at))
        at += n
    base = spark.createDataFrame(bases, "pid int, base long")
    if len(bases) <= 1_000_000:  # 12 bytes each; beyond that Spark chooses the join
        base = F.broadcast(base)
    placed = tokens.join(base, "pid").select("doc_id", (F.col("base") + F.col("shift")).alias("at"), "doc_tokens", "ids")
    return placed.mapInArrow(_cut(limit), PIECES)
