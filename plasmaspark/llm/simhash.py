"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints that differ in at most k of 64 bits agree on at least two of k + 2
bit blocks. So each distinct fingerprint is filed once per pair of blocks under
the bits it has there: this shared masked pattern is the top node, and its
members differ by nothing in it. Within a top node members are sorted by Gray
rank, which puts similar ones together, and runs of them form leaves that know
the bits their members share; leaves form groups the same way. Two groups, and
then two leaves, are compared only if the differences that have accumulated in
the bits which all of their members share stay within k. Of what is found, a
task emits links that connect the same fingerprints, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plasmaspark.llm.components import stars
from plasmaspark.llm.store import written

LEAF = 64
#: A top node of more members is filed again by two of the blocks of its remaining bits.
CROWDED = 20_000


def _hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of each of the text's word shingles, in parts; A-Z are lower-cased. No words: nothing."""
    body = b" ".join((text or "").encode().lower().split())
    if not body:
        return
    spaces = np.flatnonzero(np.frombuffer(body, np.uint8) == 32)
    starts, ends = np.concatenate([[0], spaces + 1]), np.append(spaces, len(body))
    n = max(1, len(starts) - words + 1)
    starts, ends = starts[:n].tolist(), ends[min(words, len(ends)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, 1 << 16):
        yield np.fromiter((digest(body[a:b], 42) for a, b in zip(starts[i : i + (1 << 16)], ends[i : i + (1 << 16)], strict=True)), np.uint64, min(n - i, 1 << 16))


def fingerprint(text: str | None, words: int = 4) -> int:
    """SimHash of the text's word shingles, each with XXH64 (seed 42); A-Z are lower-cased. No words: zero."""
    total, n = np.zeros(64, np.int64), 0
    for hashes in _hashes(text, words):
        total += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int.from_bytes(np.packbits(2 * total > n).tobytes())


def fingerprints(docs: DataFrame, words: int = 4, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(doc_id, code): the fingerprint of every whole text as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.int64())], ["doc_id", "code"])

    return docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("__text")).mapInArrow(run, "doc_id long, code long")


def block_masks(bits: int, blocks: int, within: int = (1 << 64) - 1) -> list[int]:
    """Masks of every pair of `blocks` even blocks of the bits set in within."""
    places = [b for b in range(64) if within >> b & 1][:bits]
    cuts = np.linspace(0, len(places), blocks + 1).round().astype(int)
    each = [sum(1 << b for b in places[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
    return [x | y for x, y in combinations(each, 2)]


def gray(code: Column) -> Column:
    """Gray rank of a long of bits: the number whose Gray code it is, which puts similar codes together."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code


class Sets:
    """Disjoint sets over 0..n-1; join() takes arrays of linked places."""

    def __init__(self, n: int):
        self.parent, self.used = np.arange(n), []

    def roots(self, x: np.ndarray) -> np.ndarray:
        at = self.parent[x]
        while True:
            up = self.parent[at]
            if np.array_equal(up, at):
                self.parent[x] = at
                return at
            at = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the sets of a and b, pair by pair; pairs that joined two sets are added to used."""
        pairs = np.stack([a, b], axis=1)
        while len(pairs):
            x, y = self.roots(pairs[:, 0]), self.roots(pairs[:, 1])
            apart = x != y
            pairs, x, y = pairs[apart], x[apart], y[apart]
            if not len(pairs):
                return
            high, low = np.maximum(x, y), np.minimum(x, y)
            # one parent for each root in a round: the least of those offered
            order = np.lexsort((low, high))
            first = np.append(True, high[order][1:] != high[order][:-1])
            take = order[first]
            self.parent[high[take]] = low[take]
            self.used.append(pairs[take])
            pairs = pairs[order[~first]]

    def nearest_first(self, a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> None:
        """join(), the least differences first."""
        for d in np.unique(apart):
            self.join(a[apart == d], b[apart == d])


#: Codes are lists of arrays, one for each of their 64-bit words.
Codes = list[np.ndarray]


def _differing(one: Codes, two: Codes) -> np.ndarray:
    """Differing bits of codes, pair by pair (arrays that broadcast)."""
    total = np.bitwise_count(one[0] ^ two[0])
    for x, y in zip(one[1:], two[1:], strict=True):
        total = total + np.bitwise_count(x ^ y).astype(np.uint16)
    return total


def _shared(codes: Codes, size: int) -> tuple[Codes, Codes]:
    """Of each run of `size` codes: the bits that all have in common (masks), and a member."""
    at = np.arange(0, len(codes[0]), size)
    return [~(np.bitwise_and.reduceat(c, at) ^ np.bitwise_or.reduceat(c, at)) for c in codes], [c[at] for c in codes]


def _apart_in_shared(masks: Codes, members: Codes, one: int, others: np.ndarray) -> np.ndarray:
    """Bits in which all members of run `one` differ from all members of each of the others."""
    return _differing([m[others] & x[others] & x[one] for m, x in zip(members, masks, strict=True)], [m[one] & x[others] & x[one] for m, x in zip(members, masks, strict=True)])


def _search(codes: Codes, at: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, places, differing bits) of all members of one top node that differ by at most k. codes are in Gray order; at: place of the first."""
    mask, member = _shared(codes, LEAF)
    upper_mask, upper = _shared(codes, LEAF * LEAF)
    n, size = len(mask[0]), len(codes[0])
    for g in range(len(upper[0])):
        groups = np.arange(g, len(upper[0]))
        groups = groups[_apart_in_shared(upper_mask, upper, g, groups) <= k]
        leaves = (groups[:, None] * LEAF + np.arange(LEAF)).ravel()
        leaves = leaves[leaves < n]
        for a in range(g * LEAF, min(n, (g + 1) * LEAF)):
            others = leaves[leaves >= a]
            others = others[_apart_in_shared(mask, member, a, others) <= k]
            own = [c[a * LEAF : (a + 1) * LEAF] for c in codes]
            places = (others[:, None] * LEAF + np.arange(LEAF)).ravel()
            places = places[places < size]
            for i in range(0, len(places), 1 << 16):
                part = places[i : i + (1 << 16)]
                # differences accumulate over a code's words: what is past k after the first two is left there
                x, y = np.nonzero(_differing([c[:, None] for c in own[:2]], [c[part][None, :] for c in codes[:2]]) <= k)
                apart = _differing([c[x] for c in own], [c[part[y]] for c in codes])
                near = apart <= k
                yield at + a * LEAF + x[near], at + part[y[near]], apart[near]


def near(node: np.ndarray, codes: Codes, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, places, differing bits) of all that differ by at most k within a top node. node: number of each row's top node, ascending."""
    n = len(node)
    starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    sizes = np.diff(np.append(starts, n))
    left = np.repeat(sizes, sizes) - (np.arange(n) - np.repeat(starts, sizes)) - 1  # members after this one
    small = np.repeat(sizes, sizes) <= LEAF
    at, near = np.flatnonzero(small & (left > 0)), []
    for step in range(1, LEAF):
        at = at[left[at] >= step]
        if not len(at):
            break
        x = at[_differing([c[at] for c in codes[:2]], [c[at + step] for c in codes[:2]]) <= k]
        apart = _differing([c[x] for c in codes], [c[x + step] for c in codes])
        near.append(np.stack([x[apart <= k], x[apart <= k] + step, apart[apart <= k]]))
    if near:
        yield tuple(np.concatenate(near, axis=1))
    for start, size in zip(starts[sizes > LEAF].tolist(), sizes[sizes > LEAF].tolist(), strict=True):
        yield from _search([c[start : start + size] for c in codes], start, k)


def _linked(k: int):
    """Of whole top nodes' rows (code): links that connect what differs by at most k."""

    def solve(node: np.ndarray, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        codes, sets = rows.column("code").to_numpy(), Sets(rows.num_rows)
        for found in near(node, [codes.view(np.uint64)], k):
            sets.nearest_first(*found)
        if sets.used:
            pairs = np.sort(codes[np.concatenate(sets.used)], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return solve


def by_node(solve, node: tuple[str, str]):
    """solve() over whole top nodes (two columns name them), from rows sorted by (top node, Gray rank)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # whole top nodes are solved; the last one may go on in the next batch
            rows = pa.Table.from_batches([*held, batch])
            first, second = (rows.column(c).to_numpy() for c in node)
            new = np.append(False, (first[1:] != first[:-1]) | (second[1:] != second[:-1]))
            cut = len(new) - 1 - int(np.argmax(new[::-1])) if new.any() else 0
            if cut:
                yield from solve(np.cumsum(new[:cut]), rows.slice(0, cut))
            held = rows.slice(cut).to_batches()
        if held:
            rows = pa.Table.from_batches(held)
            yield from solve(np.zeros(rows.num_rows, int), rows)

    return run


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _filed(rows: DataFrame, k: int, crowded: int) -> DataFrame:
    """rows (code and other columns) once per top node (mask, pattern), whole top nodes together and in Gray order.

    A top node with more than `crowded` members is filed again by pairs of
    blocks of its other bits.
    """
    if k > 12:
        raise ValueError("two of k + 2 blocks would be too short to file by")
    masks = block_masks(64, k + 2)
    filed = rows.select("*", gray(F.col("code")).alias("gray"), F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask")).withColumn("pattern", F.col("code").bitwiseAND(F.col("mask")))
    nodes = filed.groupBy("mask", "pattern").count().where(F.col("count") > crowded).select(F.col("mask").alias("m"), F.col("pattern").alias("p"))
    nodes = written(nodes, "crowded")
    if nodes.head(1):  # few: each has over `crowded` members
        on = (F.col("mask") == F.col("m")) & (F.col("pattern") == F.col("p"))
        again = None
        for m in masks:
            finer = F.array(*[F.lit(_signed(m | x)) for x in block_masks(64, k + 2, ~m & (1 << 64) - 1)])
            part = filed.where(F.col("mask") == _signed(m)).join(nodes, on, "left_semi").select(*rows.columns, "gray", F.explode(finer).alias("mask"))
            again = part if again is None else again.unionAll(part)
        again = again.distinct().withColumn("pattern", F.col("code").bitwiseAND(F.col("mask")))
        filed = filed.join(nodes, on, "left_anti").unionAll(again.select(*filed.columns))
    return filed.repartition("mask", "pattern").sortWithinPartitions("mask", "pattern", "gray").select("mask", "pattern", *rows.columns)


def near_links(codes: DataFrame, k: int = 4, crowded: int = CROWDED) -> DataFrame:
    """(a, b): links between distinct codes such that codes reach each other over links of at most k bits exactly if they reach each other over these.

    Each pair itself differs by at most k, the nearest that connect what they
    do.
    """
    distinct = codes.select("code").where("code IS NOT NULL").distinct()
    return _filed(distinct, k, crowded).mapInArrow(by_node(_linked(k), ("mask", "pattern")), "a long, b long").distinct()


def classes(docs: DataFrame, words: int = 4, k: int = 4, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    component_id is the least doc_id that can be reached over fingerprints
    that differ by at most k bits. Empty and null texts have fingerprint zero
    and are linked like any other. Rows without an id keep a null doc_id and
    don't count as least; repeated rows are returned each.
    """
    codes = written(fingerprints(docs, words, text, ident), "fingerprints")
    root = stars(near_links(codes, k), "a", "b")
    least = codes.groupBy("code").agg(F.min("doc_id").alias("least"))
    placed = least.join(root, least.code == root.node, "left").select("code", "least", F.coalesce("root", "code").alias("root"))
    placed = written(placed, "roots")
    component = placed.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r")
    by_code = placed.join(component, F.col("root") == F.col("r")).select(F.col("code").alias("c"), "component_id")
    return codes.join(by_code, F.col("code") == F.col("c")).select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")
