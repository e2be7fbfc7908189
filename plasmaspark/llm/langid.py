"""Language identification by multilingual mixture inference.

Each language has a smoothed model of letter trigrams. A document is a
mixture: every word comes from one language, with the document's proportions.
Expectation-maximisation estimates the proportions; the languages are then
taken in order of their share, and of the nested sets the one with the best
likelihood less a penalty per language is chosen. The prediction is the
largest language of that set, its score its proportion there.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plasmaspark.llm.store import sampled

UNKNOWN = "und"
#: Documents that the models are learned from, about, at most.
TRAIN_ROWS = 20_000
#: Log-likelihood that a further language must gain, as a multiple of the log of the document's words.
PENALTY = 3.0
STEPS, REMEMBERED = 8, 300_000

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> Counter:
    """The words of letters in a whole text, lower-cased, with their counts."""
    return Counter(w for w in _WORD.findall((text or "").lower()) if w.isalpha())


def grams(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: dict[str, Counter] = defaultdict(Counter)
        for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            own = found[lang]
            for w, n in words(text.as_py()).items():
                for g in grams(w):
                    own[g] += n
        rows = [(lang, g, n) for lang, own in found.items() for g, n in own.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["lang", "gram", "n"])


class Models:
    """Log-probabilities of trigrams, a row per trigram and a column per language; the last row is for unseen ones."""

    def __init__(self, rows: list[tuple[str, str, int]]):
        self.langs = sorted({r[0] for r in rows})
        self.place = {g: i for i, g in enumerate(sorted({r[1] for r in rows}))}
        table = np.full((len(self.place) + 1, len(self.langs)), 0.5)
        at = {lang: j for j, lang in enumerate(self.langs)}
        for lang, g, n in rows:
            table[self.place[g], at[lang]] += n
        self.logs = np.log(table / table.sum(axis=0)).astype(np.float32)

    def word(self, w: str) -> np.ndarray:
        """Log-likelihood of a word under each language; long words count no more than eight trigrams."""
        own = self.logs[[self.place.get(g, len(self.place)) for g in grams(w)]]
        return own.sum(axis=0) * min(1.0, 8 / len(own))


def _mixture(logs: np.ndarray, n: np.ndarray, doc: np.ndarray, starts: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each document. logs: a row per (document, word); allowed: languages open to each document."""
    top = np.where(allowed[doc], logs, -np.inf).max(axis=1)
    like = np.where(allowed[doc], np.exp(logs - top[:, None]), 0)
    share = allowed / allowed.sum(axis=1, keepdims=True)
    total = np.add.reduceat(n, starts)
    for _ in range(STEPS):
        each = like * share[doc]
        each *= (n / each.sum(axis=1).clip(1e-300))[:, None]
        share = np.add.reduceat(each, starts, axis=0) / total[:, None]
    fit = np.log((like * share[doc]).sum(axis=1).clip(1e-300)) + top
    return share, np.add.reduceat(n * fit, starts)


def infer(logs: np.ndarray, n: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Proportions over the chosen set of each document, zero outside it. sizes: distinct words of each document, none zero."""
    logs, n = logs.astype(np.float64), n.astype(np.float64)
    starts, doc = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
    k = logs.shape[1]
    share, fit = _mixture(logs, n, doc, starts, np.ones((len(sizes), k), bool))
    order = np.argsort(-share, axis=1, kind="stable")
    price = PENALTY * np.log(1 + np.add.reduceat(n, starts))
    best, chosen = np.full(len(sizes), -np.inf), np.zeros_like(share)
    for size in range(1, k + 1):
        allowed = np.zeros_like(share, bool)
        np.put_along_axis(allowed, order[:, :size], True, axis=1)
        own, value = (share, fit) if size == k else _mixture(logs, n, doc, starts, allowed)
        better = value - size * price > best
        chosen[better], best[better] = own[better], (value - size * price)[better]
    return chosen


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", ident: str = "doc_id", train_rows: int = TRAIN_ROWS) -> Models | None:
    """Models of the languages of docs' rows with a language, from about train_rows of them at most; None without any.

    Rows are chosen by a hash of id and text, so that neither one text's many
    copies nor one id's many texts are in or out together; ids have no other use.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("l"), F.xxhash64(ident, text).alias("h"))
    rows = sampled(known, F.col("h"), train_rows).select("t", "l").mapInArrow(_count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()  # bounded by the sample
    return Models([tuple(r) for r in rows]) if rows else None


NAMES = ["lang_pred", "score", "languages", "proportions"]
RESULT = "lang_pred string, score double, languages array<string>, proportions array<double>"


def predict(docs: DataFrame, models: Models | None, text: str = "text") -> DataFrame:
    """docs without text, with lang_pred, score, and the chosen languages and their proportions (largest first).

    Null texts, texts without a letter, and all texts when nothing was learned
    are `und` with score 0 and no languages. Columns of docs with these names
    are replaced.
    """
    docs = docs.drop(*[c for c in NAMES if c != text])
    kept = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, rows = defaultdict(count().__next__), np.zeros((0, 0), np.float32)
        known = 0
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                batch = whole.slice(i, 500)
                found = [words(t.as_py()) if models else Counter() for t in batch.column(text)]
                if len(codes) > REMEMBERED:
                    codes, known = defaultdict(count().__next__), 0
                own = [np.fromiter(map(codes.__getitem__, f), np.int64, len(f)) for f in found]
                if len(codes) > known:
                    if len(codes) > len(rows):
                        rows = np.concatenate([rows[:known].reshape(known, len(models.langs)), np.zeros((2 * len(codes) - known, len(models.langs)), np.float32)])
                    rows[known : len(codes)] = [models.word(w) for w in islice(codes, known, None)]
                    known = len(codes)
                full = [j for j, f in enumerate(found) if f]
                result: list[tuple] = [(UNKNOWN, 0.0, [], [])] * len(found)
                if full:
                    logs = rows[np.concatenate([own[j] for j in full])]
                    n = np.concatenate([np.fromiter(found[j].values(), np.int64, len(found[j])) for j in full])
                    for j, share in zip(full, infer(logs, n, np.array([len(found[j]) for j in full])), strict=True):
                        order = [x for x in np.argsort(-share, kind="stable") if share[x] > 0]
                        result[j] = (models.langs[order[0]], min(1.0, float(share[order[0]])), [models.langs[x] for x in order], [float(share[x]) for x in order])
                columns = [pa.array(c, t) for c, t in zip(zip(*result, strict=True), (pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64())), strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *columns], [*kept, *NAMES])

    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text]
    return docs.mapInArrow(run, ", ".join([*types, RESULT]))
