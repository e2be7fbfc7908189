"""Near-duplicate texts: wide SimHash codes in a Gray-order hierarchical index, decided by exact similarity.

A text's distinct word shingles give a code of 256 bits. Texts whose shingles
are alike to a Jaccard similarity of `limit` differ in a known share of them,
so the search takes codes that differ by that many bits and 1.7 deviations.
Each distinct code is filed under the bits that it has in several masks of few
bits: these shared masked patterns are the top nodes. The masks' length follows
the logarithm of the number of codes, which keeps top nodes at the same size
however many texts there are, and their number follows from their length, so
that two codes at the limit share a top node as often at any size. Within top
nodes members are in Gray order, in leaves and groups that know the bits their
members share, and whole groups are skipped by accumulated differences
(see ``simhash``). A crowded top node is cut into blocks, and each pair of
blocks is a task's; none of its pairs is left out.

Whatever is found is compared by all shingles of the whole texts, a text's
nearest first. Links that hold form groups; a text with many neighbours is then
compared with all that are in other groups. So a large group of near copies is
connected by a few links for each text, and no pair between groups is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plasmaspark.llm.components import stars
from plasmaspark.llm.hashing import ODD, WordHashes, mixed, sequences
from plasmaspark.llm.simhash import Sets, by_node, gray, near
from plasmaspark.llm.store import written

#: 64-bit words of a code.
WIDTH = 4
CODE = [f"w{i}" for i in range(WIDTH)]
#: Members of an average top node; and of a block of a crowded one, or how many shingles these have.
MEMBERS, CROWDED, BLOCK = 1024, 20_000, 4_000_000
#: Share of pairs at the limit that meet in a top node, and deviations from the expected number of differing bits that are still searched.
MEET, DEVIATIONS = 0.98, 1.7


def shingles(text: str | None, words: int, hashes: WordHashes | None = None) -> np.ndarray:
    """The distinct 64-bit hashes of the whole text's word shingles, ascending. A-Z are lower-cased; fewer words: their sequence; none: one, zero."""
    own = (text or "").encode().lower().split()
    if not own:
        return np.zeros(1, np.uint64)
    hashes = WordHashes() if hashes is None else hashes
    return np.unique(sequences(hashes.of(own), min(words, len(own))))


def codes(sets: list[np.ndarray]) -> np.ndarray:
    """A row of WIDTH words for each set of shingles: bit b is set if it is in over half of the shingles' own b-th bits."""
    lanes, sizes = np.uint64(0x0101010101010101), np.array([len(s) for s in sets])
    # runs of 255 shingles at most, so that eight counters fit a 64-bit word
    runs = np.concatenate([np.arange(0, n, 255) + at for n, at in zip(sizes.tolist(), (np.cumsum(sizes) - sizes).tolist(), strict=True)])
    per_text = -(-sizes // 255)
    first, every, out = np.cumsum(per_text) - per_text, np.concatenate(sets), np.empty((len(sets), WIDTH), np.uint64)
    for w in range(WIDTH):
        own, bits = mixed(every + np.uint64(ODD * (w + 1) % (1 << 64))), np.empty((len(sets), 8, 8), bool)
        for shift in range(8):
            counts = np.add.reduceat((own >> np.uint64(shift)) & lanes, runs).astype("<u8").view(np.uint8).reshape(-1, 8)
            bits[:, :, shift] = 2 * np.add.reduceat(counts.astype(np.int64), first, axis=0) > sizes[:, None]
        out[:, w] = np.packbits(bits.reshape(len(sets), 64), axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def apart(limit: float) -> float:
    """Share of a code's bits in which texts alike to limit differ, on average and at most."""
    return math.acos(2 * limit / (1 + limit)) / math.pi


def reach(limit: float) -> int:
    """Differing bits up to which codes are searched."""
    p, n = apart(limit), 64 * WIDTH
    return int(n * p + DEVIATIONS * math.sqrt(n * p * (1 - p)))


def masks(n: int, limit: float) -> list[list[int]]:
    """Masks (a number for each word) under which n codes are filed; those of one round share no bit."""
    bits = max(8, math.ceil(math.log2(max(1, n) / MEMBERS)))
    tables = math.ceil(math.log(1 - MEET) / math.log(1 - (1 - apart(limit)) ** bits))
    rng, out = np.random.default_rng(1), []
    while len(out) < tables:
        places = rng.permutation(64 * WIDTH)
        for i in range(0, len(places) - bits + 1, bits):
            out.append([sum(1 << int(b % 64) for b in places[i : i + bits] if b // 64 == w) for w in range(WIDTH)])
    return out[:tables]


def _filed(rows: DataFrame, under: list[list[int]], members: int, shingles: int) -> DataFrame:
    """rows (CODE, id, shingles and other columns) once per top node (node, part), whole top nodes together and in Gray order.

    Top nodes with more than so many members or shingles are cut into blocks,
    and their parts are the pairs of blocks.
    """
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table = F.array(*[F.struct(F.lit(i).alias("i"), *[F.lit(signed(x)).alias(c) for x, c in zip(mask, CODE, strict=True)]) for i, mask in enumerate(under)])
    node = F.xxhash64("m.i", *[F.col(c).bitwiseAND(F.col(f"m.{c}")) for c in CODE])
    each = lambda of, columns: of.select("*", F.explode(table).alias("m")).select(*columns, node.alias("node"))
    blocks = F.ceil(F.greatest(F.count("*") / members, F.sum("shingles") / shingles)).cast("long")
    large = each(rows.select(*CODE, "shingles"), ["shingles"]).groupBy("node").agg(blocks.alias("blocks")).where("blocks > 1").select(F.col("node").alias("large"), "blocks")
    large, filed, part = written(large, "crowded"), each(rows, rows.columns), F.lit(0).cast("long")
    if large.head(1):
        blocks = F.coalesce("blocks", F.lit(1).cast("long"))
        own = F.pmod(F.xxhash64("id"), blocks)
        filed = filed.join(large, F.col("node") == F.col("large"), "left")
        part = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda other: F.least(own, other) * (1 << 31) + F.greatest(own, other)))
    filed = filed.select(*rows.columns, "node", part.alias("part"))
    return filed.repartition("node", "part").sortWithinPartitions("node", "part", gray(F.col(CODE[0]))).select("node", "part", *rows.columns)


def _rank(sorted_: np.ndarray) -> np.ndarray:
    """Place of each element within its run of equal ones."""
    at = np.arange(len(sorted_))
    return at - np.maximum.accumulate(np.where(np.append(True, sorted_[1:] != sorted_[:-1]), at, 0))


def _nearest(found: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Of found pairs (rows: place, place, differing bits): those that are among the `budget` nearest of either place; and the places that have more."""
    both = np.concatenate([found, found[[1, 0, 2]]], axis=1)
    order = np.lexsort((both[1], both[2], both[0]))
    over = np.empty(both.shape[1], bool)
    over[order] = _rank(both[0, order]) >= budget
    left = over.reshape(2, -1).all(axis=0)
    return found[:, ~left], np.unique(found[:2, left])


def _columns(rows: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Codes, ids and numbers of shingles."""
    return [rows.column(c).to_numpy().view(np.uint64) for c in CODE], rows.column("id").to_numpy(), rows.column("shingles").to_numpy()


def _sized(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, limit: float) -> np.ndarray:
    """Pairs x < y whose numbers of shingles don't exclude limit."""
    return (x < y) & (np.minimum(sizes[x], sizes[y]) >= limit * np.maximum(sizes[x], sizes[y]))


def _few(k: int, limit: float, budget: int):
    """Of whole top nodes' rows: (x, y) of pairs that differ by at most k, each among the `budget` nearest of either id; (x, x) marks an id that has more."""

    def solve(node: np.ndarray, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        code, ids, sizes = _columns(rows)
        held, more, kept = [], [], 0
        for x, y, bits in near(node, code, k):
            ok = _sized(x, y, sizes, limit)
            if ok.any():
                held.append(np.stack([x[ok], y[ok], bits[ok]]))
                kept += held[-1].shape[1]
                if kept > 2_000_000 + 2 * budget * len(ids):
                    pairs, cut = _nearest(np.concatenate(held, axis=1), budget)
                    held, kept = [pairs], pairs.shape[1]
                    more.append(cut)
        if held:
            pairs, cut = _nearest(np.concatenate(held, axis=1), budget)
            more = np.unique(ids[np.concatenate([*more, cut])])
            pairs = np.sort(ids[pairs[:2]], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(pairs[i], more)) for i in (0, 1)], ["x", "y"])

    return solve


def _many(k: int, limit: float):
    """Of whole top nodes' rows with all shingles (own): links that connect the texts which differ by at most k and are alike, over those of one root."""

    def solve(node: np.ndarray, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        code, ids, sizes = _columns(rows)
        every = np.unique(rows.column("own").combine_chunks().flatten().to_numpy(), return_inverse=True)[1]
        starts, sets, mark = np.cumsum(sizes) - sizes, Sets(len(ids)), np.zeros(len(every), bool)
        roots = rows.column("root").to_numpy()
        order = np.argsort(roots, kind="stable")
        joined = roots[order[1:]] == roots[order[:-1]]
        sets.join(order[:-1][joined], order[1:][joined])
        sets.used = []
        for x, y, _ in near(node, code, k):
            ok = _sized(x, y, sizes, limit)
            x, y = x[ok], y[ok]
            ok = sets.roots(x) != sets.roots(y)
            order = np.argsort(x[ok], kind="stable")
            x, y = x[ok][order], y[ok][order]
            if not len(x):
                continue
            cuts = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(x)], strict=True):
                one = int(x[a])
                for i in range(a, b, 512):
                    two = y[i : min(b, i + 512)]
                    two = two[sets.roots(two) != sets.roots(x[a : a + 1])]
                    if not len(two):
                        continue
                    own = every[starts[one] : starts[one] + sizes[one]]
                    mark[own] = True
                    ends = np.cumsum(sizes[two])
                    at = np.arange(ends[-1]) + np.repeat(starts[two] - ends + sizes[two], sizes[two])
                    both = np.add.reduceat(mark[every[at]], ends - sizes[two], dtype=np.int64)
                    mark[own] = False
                    two = two[both >= limit * (sizes[one] + sizes[two] - both)]
                    sets.join(np.full(len(two), one), two)
        if sets.used:
            pairs = np.sort(ids[np.concatenate(sets.used)], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["x", "y"])

    return solve


CODED = ", ".join(["id long", "shingles long", *[f"{c} long" for c in CODE]])


def _coded(words: int, whole: bool):
    """(id, shingles, CODE) of (id, text), and with whole all shingles (own)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            at, held, sets = 0, 0, []
            for text in batch.column(1):
                sets.append(shingles(text.as_py(), words, hashes))
                held += len(sets[-1])
                if (end := at + len(sets)) == batch.num_rows or held > 500_000:
                    columns = [batch.column(0).slice(at, len(sets)), pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, codes(sets).view(np.int64).T.copy())]
                    own = [pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))] if whole else []
                    yield pa.RecordBatch.from_arrays([*columns, *own], ["id", "shingles", *CODE, "own"][: len(columns) + whole])
                    at, held, sets = end, 0, []

    return run


def _texts(docs: DataFrame, text: str, ident: str) -> DataFrame:
    return docs.select(F.col(ident).cast("long").alias("id"), F.col(text).alias("__text")).where("id IS NOT NULL")


def coded(docs: DataFrame, words: int = 5, text: str = "text", ident: str = "doc_id", whole: bool = False) -> DataFrame:
    """(id, shingles, CODE): the number of distinct shingles and the code of every whole text with an id; with whole, also its shingles (own)."""
    return _texts(docs, text, ident).mapInArrow(_coded(words, whole), CODED + ", own array<long>" * whole)


def alike(docs: DataFrame, pairs: DataFrame, words: int = 5, limit: float = 0.8, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """Those of pairs (x, y) whose whole texts have a Jaccard similarity of at least limit, counted over all their shingles."""
    asked = pairs.select(F.explode(F.array("x", "y")).alias("asked")).distinct()
    texts = docs.join(asked, F.col(ident).cast("long") == F.col("asked"), "left_semi")
    own = written(coded(texts, words, text, ident, True).select("id", "own").distinct(), "shingles")
    one, two = (own.select(F.col("id").alias(c), F.col("own").alias(s)) for c, s in (("x", "left"), ("y", "right")))
    both = F.size(F.array_intersect("left", "right"))
    return pairs.join(one, "x").join(two, "y").where(both >= limit * (F.size("left") + F.size("right") - both)).select("x", "y").distinct()


def links(docs: DataFrame, words: int = 5, limit: float = 0.8, text: str = "text", ident: str = "doc_id", budget: int = 4, members: int = CROWDED, size: int = BLOCK) -> DataFrame:
    """(x, y): pairs of ids, alike to limit, that connect all ids which are alike over any of their pairs (see thinned for what isn't found).

    First each id's `budget` nearest in every top node are compared. The texts
    that have more neighbours are then filed with their shingles, and compared
    there with all neighbours that the links so far left in other groups. To
    file a text so costs less than to send it to each of these; only links
    that connect a task's texts leave it.
    """
    known = written(coded(docs, words, text, ident), "codes")
    # one row per code in the index; the other ids with its code are compared with the first
    heads = written(known.groupBy(*CODE).agg(F.min(F.struct("id", "shingles")).alias("h"), F.max("id").alias("last")).select(*CODE, "h.id", "h.shingles", "last"), "heads")
    under, k = masks(heads.count(), limit), reach(limit)
    filed = _filed(heads.drop("last"), under, members, 1 << 62)
    pairs = written(filed.mapInArrow(by_node(_few(k, limit, budget), ("node", "part")), "x long, y long").distinct(), "near")
    same = known.join(heads.where("id != last").select(*CODE, F.col("id").alias("x")), CODE).where("id != x").select("x", F.col("id").alias("y")).distinct()
    found = written(alike(docs, pairs.where("x != y").unionAll(same), words, limit, text, ident), "alike")
    more = pairs.where("x = y").select(F.col("x").alias("more"))
    if not more.head(1):
        return found
    rows = coded(docs.join(more, F.col(ident).cast("long") == F.col("more"), "left_semi"), words, text, ident, True)
    rows = rows.join(stars(found, "x", "y"), F.col("id") == F.col("node"), "left").select(*CODE, "id", "shingles", F.coalesce("root", "id").alias("root"), "own")
    filed = _filed(written(rows, "many"), under, members, size)
    return found.unionAll(written(filed.mapInArrow(by_node(_many(k, limit), ("node", "part")), "x long, y long").distinct(), "links"))


def thinned(docs: DataFrame, words: int = 5, limit: float = 0.8, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """docs with one row of each group of near-duplicates: that with the least id.

    A group is what pairs of texts connect whose distinct word shingles have a
    Jaccard similarity of at least limit. No pair below it is linked; of
    those at the limit itself about 93 % are found, of nearer ones more (the
    README has figures). A null or empty text counts as one shingle of its
    own, so that all empty texts are alike. Rows without an id stay; rows that
    repeat an id stay or go together. An empty table stays empty.
    """
    gone = stars(links(docs, words, limit, text, ident), "x", "y").select(F.col("node").alias("__gone"))
    return docs.join(gone, F.col(ident).cast("long") == F.col("__gone"), "left_anti")
