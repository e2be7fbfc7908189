"""Exact de-duplication by Patricia-trie owners.

Rows are dealt to owners by (length, content hash). An owner inserts the full
byte strings into a compressed radix trie (path-compressed, so a chain of
single children is one edge); a terminal node stores which row of that text
stays and how many rows it stands for. Memory is bounded by spilling by
subtree: an owner reads its strings in byte order, so that once a string has
been inserted every subtree to the left of its path can get no more strings;
past a budget of bytes these subtrees are emitted and dropped. Before the
shuffle each map task folds its own rows with the same trie, so that a text
with any number of copies reaches its owner at most once per spill of a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 32 << 20


class _Node:
    __slots__ = ("label", "children", "terminal")

    def __init__(self, label: bytes):
        self.label, self.children, self.terminal = label, {}, None


def _shared_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by bisection over slices."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class PatriciaTrie:
    """A compressed radix trie over byte strings; terminals hold a small list."""

    def __init__(self):
        self.root = _Node(b"")

    def terminal(self, key: bytes) -> list:
        """The terminal of key, empty when it is new."""
        node, rest = self.root, key
        while rest:
            child = node.children.get(rest[0])
            if child is None:
                child = node.children[rest[0]] = _Node(rest)
                node, rest = child, b""
                break
            if rest.startswith(child.label):
                node, rest = child, rest[len(child.label) :]
                continue
            k = _shared_prefix(rest, child.label)
            upper = _Node(child.label[:k])
            child.label = child.label[k:]
            upper.children[child.label[0]] = child
            node.children[rest[0]] = upper
            node, rest = upper, rest[k:]
        if node.terminal is None:
            node.terminal = []
        return node.terminal

    def terminals(self) -> Iterator[list]:
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node.terminal is not None:
                yield node.terminal
            stack.extend(node.children.values())


def _better(a: int | None, b: int | None) -> bool:
    return a is not None and (b is None or a > b)


def _fold(key: str, ident: str, count: str, budget: int, ordered: bool):
    """An Arrow function that keeps one row of each text: the one with the largest id, with the summed count.

    ordered: rows come in byte order of the text, so only the last text of a
    spill can come again; it is carried over, and each text leaves once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, held, rows, size, last = PatriciaTrie(), [], 0, 0, None

        def spill(keep: list | None):
            # a terminal is [row in held, id, count]
            out = [t for t in trie.terminals() if t is not keep]
            table = pa.Table.from_batches(held)
            left = table.take(pa.array([keep[0]])).combine_chunks().to_batches() if keep else []
            if not out:
                return None, left
            out.sort()
            taken = table.take(pa.array([t[0] for t in out]))
            taken = taken.set_column(taken.schema.get_field_index(count), count, pa.array([t[2] for t in out], pa.int64()))
            return taken, left

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            texts, ids, counts = batch.column(key), batch.column(ident).to_pylist(), batch.column(count).to_pylist()
            for i, text in enumerate(texts):
                raw = text.as_buffer().to_pybytes()
                size += len(raw)
                t = trie.terminal(raw)
                if not t:
                    t.extend((rows + i, ids[i], counts[i]))
                else:
                    t[2] += counts[i]
                    if _better(ids[i], t[1]):
                        t[0], t[1] = rows + i, ids[i]
                last = (raw, t)
            rows += batch.num_rows
            if size > budget:
                taken, left = spill(last[1] if ordered else None)
                if taken is not None:
                    yield from taken.to_batches()
                trie, held, rows, size = PatriciaTrie(), left, len(left), 0
                if left:
                    again = trie.terminal(last[0])
                    again.extend((0, last[1][1], last[1][2]))
        if held:
            taken, _ = spill(None)
            yield from taken.to_batches()

    return run




def survivors(docs: DataFrame, text: str = "text", ident: str = "doc_id", count: str = "group_size", budget: int = BUDGET) -> DataFrame:
    """One whole row per distinct text, that with the largest ident, plus its group's size.

    A null text counts as empty for the comparison; the kept row's own columns
    are returned as they were. A null id is below any other. Of rows that are
    equal in text and id one stays. An empty table gives an empty table.
    Other columns of any name are carried along; one with the name of the
    group's size is replaced by it.
    """
    row, key, ident_, n = "__row", "__key", "__ident", "__n"
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns if c != count]).alias(row), F.coalesce(docs[text], F.lit("")).cast("binary").alias(key), docs[ident].cast("long").alias(ident_), F.lit(1).cast("long").alias(n))
    local = packed.mapInArrow(_fold(key, ident_, n, budget, ordered=False), packed.schema)
    dealt = local.repartition(F.octet_length(key), F.xxhash64(key)).sortWithinPartitions(key)
    owned = dealt.mapInArrow(_fold(key, ident_, n, budget, ordered=True), packed.schema)
    return owned.select(f"{row}.*", F.col(n).alias(count))


def membership(docs: DataFrame, text: str = "text", ident: str = "doc_id", budget: int = BUDGET) -> DataFrame:
    """One row per row of docs: ident, keep_id, group_size, kept, text_sha256.

    The owners tell of each distinct text which id stays; rows find their text
    by length and SHA-256. kept is true for one row of each text. Null texts
    count as empty, null ids lose to any other id.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), F.sha2(body.cast("binary"), 256).alias("text_sha256"), F.octet_length(body).alias("__length"))
    found = survivors(docs.select(F.col(ident).cast("long").alias("keep_id"), body.alias("__text")), "__text", "keep_id", "group_size", budget)
    found = found.select("keep_id", "group_size", F.sha2(F.col("__text").cast("binary"), 256).alias("__sha"), F.octet_length("__text").alias("__len"))
    joined = rows.join(found, (F.col("text_sha256") == F.col("__sha")) & (F.col("__length") == F.col("__len")))
    once = F.row_number().over(Window.partitionBy("text_sha256", "doc_id").orderBy(F.lit(1))) == 1
    return joined.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & once).alias("kept"), "text_sha256")
