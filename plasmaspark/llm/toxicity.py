"""Toxicity by a classifier chain.

Categories are predicted one after the other; each one's linear model sees the
text's features and the probabilities of the categories before it. In
training these are out-of-fold predictions, so that a later model learns how
far an earlier one can be trusted on texts that it hasn't seen.

Features are the distinct words of a text and their beginnings, hashed, and
beginnings that two distinct words share; those that differ between a
category's two classes are kept. A table with one toxic flag has its kinds of
toxic texts as earlier categories, told apart by the features that between them
cover the most. The chain is fitted on a bounded sample of the labelled rows;
it is then applied to every whole text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plasmaspark.llm.store import sampled, written

#: Labelled rows that a chain is fitted on, about, at most.
TRAIN_ROWS = 20_000
HASHED = 1 << 20
#: Features that are kept for a category at most, and how many deviations apart the classes must be.
KEPT, APART = 2000, 5.0
#: Features that the driver looks at, at most.
POOL = 4 * KEPT
FOLDS = 3
#: Kinds of toxic texts that come before the flag in the chain, at most; and the share of the sample that decides which, and isn't fitted on.
KINDS, DEFINING = 3, 0.25
#: Lengths of the beginnings of words that are features, and what marks one that several words share.
PREFIXES, SHARED = (3, 4, 5, 6, 7), 0x5A5A5

_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> tuple[int, ...]:
    """The word itself, then its proper beginnings."""
    return (zlib.crc32(word.encode()) % HASHED, *(zlib.crc32(b"^" + word[:n].encode()) % HASHED for n in PREFIXES if n < len(word)))


def features(text: str | None) -> np.ndarray:
    """Distinct hashed features of a whole text."""
    return _distinct(Counter(i for w in set(_WORD.findall((text or "").lower())) for i in word_features(w)))


def _distinct(hits: Counter) -> np.ndarray:
    found = {*hits, *(i ^ SHARED for i, n in hits.items() if n > 1)}
    return np.fromiter(sorted(found), np.int64, len(found))


@dataclass
class Linear:
    """A logistic model over kept features and the earlier categories' probabilities."""

    kept: np.ndarray
    weights: np.ndarray
    chain: np.ndarray
    bias: float


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _keep(rows: np.ndarray, cols: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Features whose shares in the two classes lie most deviations apart."""
    pos, neg = max(1.0, y.sum()), max(1.0, (1 - y).sum())
    with_y = np.bincount(cols, weights=y[rows], minlength=HASHED)
    seen = np.bincount(cols, minlength=HASHED).astype(float)
    share = (seen + 0.5) / (pos + neg + 1)
    z = (with_y / pos - (seen - with_y) / neg) / np.sqrt(share * (1 - share).clip(1e-9) * (1 / pos + 1 / neg))
    best = np.argsort(-np.abs(z), kind="stable")[:KEPT]
    return np.sort(best[np.abs(z[best]) >= APART])


def _fit(rows: np.ndarray, cols: np.ndarray, chain: np.ndarray, y: np.ndarray, steps: int = 150) -> Linear:
    """Class-balanced logistic regression with L2, by Nesterov steps."""
    kept = _keep(rows, cols, y)
    place = np.full(HASHED, -1)
    place[kept] = np.arange(len(kept))
    own = place[cols] >= 0
    rows, cols, n, m = rows[own], place[cols[own]], len(y), chain.shape[1]
    weight = np.where(y == 1, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum()))
    w = v = np.zeros(len(kept) + m + 1)
    per_row = np.bincount(rows, minlength=n) + (chain**2).sum(axis=1) + 1
    rate = 4 / max(1.0, float((weight * per_row).sum()) / weight.sum())
    for step in range(steps):
        margin = np.bincount(rows, weights=v[cols], minlength=n) + chain @ v[len(kept) : -1] + v[-1]
        g = weight * (_sigmoid(margin) - y)
        grad = np.concatenate([np.bincount(cols, weights=g[rows], minlength=len(kept)), chain.T @ g, [g.sum()]])
        grad[:-1] += 1e-4 * v[:-1]
        new = v - rate * grad
        v = new + step / (step + 3) * (new - w)
        w = new
    return Linear(kept, w[: len(kept)], w[len(kept) : -1], float(w[-1]))


def _apply(model: Linear, rows: np.ndarray, cols: np.ndarray, chain: np.ndarray) -> np.ndarray:
    weights = np.zeros(HASHED)
    weights[model.kept] = model.weights
    return _sigmoid(np.bincount(rows, weights=weights[cols], minlength=len(chain)) + chain @ model.chain + model.bias)


def fit_chain(lists: list[np.ndarray], labels: dict[str, np.ndarray], fold: np.ndarray | None = None) -> list[tuple[str, Linear]]:
    """The chain over categories in the order of labels. lists: each row's features; fold: each row's, in turn if not given."""
    n = len(lists)
    rows = np.repeat(np.arange(n), [len(x) for x in lists])
    cols = np.concatenate([np.zeros(0, np.int64), *lists])
    fold = np.arange(n) % FOLDS if fold is None else fold
    chain, models = np.zeros((n, 0)), []
    for category, y in labels.items():
        y = y.astype(float)
        unseen = np.zeros(n)
        for k in range(FOLDS):
            inside = fold != k
            to = np.cumsum(inside) - 1
            use = inside[rows]
            part = _fit(to[rows[use]], cols[use], chain[inside], y[inside])
            to = np.cumsum(~inside) - 1
            unseen[~inside] = _apply(part, to[rows[~use]], cols[~use], chain[~inside])
        models.append((category, _fit(rows, cols, chain, y)))
        chain = np.column_stack([chain, unseen])
    return models


def lead_features(lists: list[np.ndarray], toxic: np.ndarray, most: int = KINDS) -> list[int]:
    """Indicative features that between them cover the most toxic rows: each covers the most of those that the ones before it left."""
    rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    cols = np.concatenate([np.zeros(0, np.int64), *lists])
    y = toxic.astype(float)
    kept = _keep(rows, cols, y)
    more = kept[np.bincount(cols, weights=y[rows], minlength=HASHED)[kept] > 0.9 * np.bincount(cols, minlength=HASHED)[kept]]
    use = np.isin(cols, more) & toxic[rows]
    rows, cols, leads = rows[use], cols[use], []
    while len(cols) and len(leads) < most:
        leads.append(int(np.argmax(np.bincount(cols, minlength=HASHED))))
        left = ~np.isin(rows, rows[cols == leads[-1]])
        rows, cols = rows[left], cols[left]
    return leads


def categories(leads: list[int], lists: list[np.ndarray], toxic: np.ndarray) -> dict[str, np.ndarray]:
    """Categories for tables with one toxic flag: kind_1 ... (toxic texts with a lead feature), then toxic itself."""
    has = {f"kind_{i + 1}": toxic & np.array([lead in x for x in map(set, lists)], bool) for i, lead in enumerate(leads)}
    return {**{c: y for c, y in has.items() if y.any()}, "toxic": toxic}


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [features(t.as_py()) for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([_list_array(lists), *batch.columns[1:]], ["features", *batch.schema.names[1:]])


def _candidates(features_of: DataFrame) -> np.ndarray:
    """The features that set toxic texts apart most in all rows or in those outside one fold, POOL at most, ascending; counted by Spark, so that the driver sees no others.

    So whatever a fold's model could choose from its own rows is among them.
    """
    parts = range(FOLDS)
    n, y = (lambda k: F.count_if(F.col("fold") == k)), (lambda k: F.sum(F.when(F.col("fold") == k, F.col("toxic")).otherwise(0)))
    total = features_of.agg(*[n(k).alias(f"n{k}") for k in parts], *[F.coalesce(y(k), F.lit(0)).alias(f"y{k}") for k in parts]).first()
    counts = features_of.select("toxic", "fold", F.explode("features").alias("feature")).groupBy("feature").agg(*[n(k).alias(f"n{k}") for k in parts], *[y(k).alias(f"y{k}") for k in parts])

    def z(kept: list[int]):
        rows, pos = sum(total[f"n{k}"] for k in kept), max(1, sum(total[f"y{k}"] for k in kept))
        seen, bad = sum((F.col(f"n{k}") for k in kept), F.lit(0)), sum((F.col(f"y{k}") for k in kept), F.lit(0))
        neg, share = max(1, rows - pos), (seen + 0.5) / (rows + 1)
        return F.abs((bad / pos - (seen - bad) / neg) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-9)) * (1 / pos + 1 / neg)))

    most = F.greatest(z(list(parts)), *[z([k for k in parts if k != out]) for out in parts])
    best = counts.select("feature", most.alias("z")).where(F.col("z") >= APART).orderBy(F.col("z").desc(), "feature").limit(POOL)
    return np.sort(np.array([r.feature for r in best.collect()], np.int64))


def _only(pool: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.intersect1d(x.values.to_numpy(zero_copy_only=False), pool) for x in batch.column("features")]
            yield pa.RecordBatch.from_arrays([_list_array(lists), *batch.columns[1:]], batch.schema.names)

    return run


def _list_array(lists: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, lists)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *lists]).astype(np.int32)))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", ident: str = "doc_id", train_rows: int = TRAIN_ROWS) -> list[tuple[str, Linear]]:
    """The chain, fitted on about train_rows labelled documents at most (chosen by a hash of the id).

    A quarter of these decides which kinds of toxic texts there are; the chain
    is fitted on the others, so that its out-of-fold predictions come from
    nothing that has seen their rows. Rows
    of labels without an id or a flag are left out; of several flags for an
    id the largest counts, of several texts the least. Without any labelled
    document, with only one class, or where no feature sets the classes apart,
    the chain is empty and nothing is toxic.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sample = sampled(known, F.xxhash64("__id"), train_rows)
    texts = docs.select(F.col(text).alias("text"), F.col(ident).cast("long").alias("__doc"))
    chosen = texts.join(F.broadcast(sample), F.col("__doc") == F.col("__id"))  # train_rows bounds the broadcast
    chosen = chosen.groupBy("__id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic", "__id")
    features_of = written(chosen.mapInArrow(_features_of, "features array<int>, toxic int, __id long"), "toxic-features")
    draw = F.pmod(F.xxhash64("__id", F.lit("part")), F.lit(1000 * FOLDS))
    features_of = features_of.withColumn("defines", draw < int(DEFINING * 1000 * FOLDS)).withColumn("fold", (draw % FOLDS).cast("int"))
    pool = _candidates(features_of)
    found = features_of.mapInArrow(_only(pool), "features array<int>, toxic int, __id long, defines boolean, fold int").toArrow().sort_by("__id")  # train_rows lists over the pool
    lists = [np.array(x.values.to_numpy(zero_copy_only=False), np.int64) for x in found.column("features")]
    toxic, first = (np.array(found.column(c).to_pylist(), bool) for c in ("toxic", "defines"))
    if toxic[~first].all() or not toxic[~first].any():
        return []
    pick = lambda keep: [x for x, k in zip(lists, keep, strict=True) if k]
    leads = lead_features(pick(first), toxic[first])
    chain = fit_chain(pick(~first), categories(leads, pick(~first), toxic[~first]), np.array(found.column("fold").to_pylist(), int)[~first])
    return chain if len(chain[-1][1].kept) else []


def classify(docs: DataFrame, chain: list[tuple[str, Linear]], text: str = "text", prefix: str = "p_") -> DataFrame:
    """docs with a probability (double) for each of the chain's categories, in order; every whole text is read.

    A null text counts as empty. The columns p_<category> come last and
    replace columns of docs with these names.
    """
    names = [f"{prefix}{c}" for c, _ in chain]
    docs = docs.drop(*names)
    table = {}  # feature -> its weight in each category; a few thousand at most
    for j, (_, model) in enumerate(chain):
        for i, w in zip(model.kept.tolist(), model.weights.tolist(), strict=True):
            table.setdefault(i, np.zeros(len(chain)))[j] = w
    heads = [(m.chain, m.bias) for _, m in chain]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            out = []
            if len(known) > 500_000:
                known.clear()
            for t in batch.column(text):
                hits: Counter = Counter()
                for w in set(_WORD.findall((t.as_py() or "").lower())):
                    if (ids := known.get(w)) is None:
                        ids = known[w] = tuple(i for i in word_features(w) if i in table or i ^ SHARED in table)
                    if ids:
                        hits.update(ids)
                margins = sum((table[i] for i in _distinct(hits).tolist() if i in table), np.zeros(len(heads)))
                row: list[float] = []
                for j, (weights, bias) in enumerate(heads):
                    row.append(float(_sigmoid(margins[j] + np.dot(weights, row) + bias)))
                out.append(row)
            columns = [pa.array([r[j] for r in out], pa.float64()) for j in range(len(heads))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])) if chain else docs


def rejected(docs: DataFrame, labels: DataFrame, text: str = "text", ident: str = "doc_id", limit: float = 0.5) -> DataFrame:
    """(doc_id, p_kind_1, ..., p_toxic, toxic): one row per row of docs; toxic (to be rejected) where the last category reaches limit.

    Null texts count as empty, null ids stay null, repeated rows are returned
    each, an empty table gives an empty result. Probabilities of kinds that
    the labels don't show, and all where there is no chain, are zero.
    """
    chain = fit(docs, labels, text, ident)
    scored = classify(docs.select(F.col(ident).alias("doc_id"), F.col(text).alias("text")), chain)
    names = [f"p_{c}" for c in (*[f"kind_{i + 1}" for i in range(KINDS)], "toxic")]
    return scored.select("doc_id", *[F.col(n) if n in scored.columns else F.lit(0.0).alias(n) for n in names]).withColumn("toxic", F.col("p_toxic") >= limit)


def clean(docs: DataFrame, labels: DataFrame, text: str = "text", ident: str = "doc_id", limit: float = 0.5) -> DataFrame:
    """docs without the rows that the chain rejects; columns as they were, whatever their names. Null and empty texts, and all rows without labels to learn from, stay."""
    chain = fit(docs, labels, text, ident)
    if not chain:
        return docs
    scored = classify(docs, chain, text, "__plasmaspark_p_")
    return scored.where(F.col("__plasmaspark_p_toxic") < limit).select(*docs.columns)
