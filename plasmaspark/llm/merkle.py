"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces. DataFrame functions only.

A text is split at blank lines into sections, at line ends into paragraphs,
and at sentence ends (or after 64 code points) into pieces; all separators
count, so only equal texts have equal trees. A leaf is a piece's 64-bit hash,
a paragraph hashes its leaves, a section its paragraphs, and the root is the
SHA-256 of the sections' hashes. Equal roots mean equal texts; otherwise only
branches whose hashes differ need to be followed.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECE = 64
#: Ranges of ids that neighbours are looked up in, at most; each is read whole by one task.
MOST_RANGES = 10_000


def tree(text: Column, piece: int = PIECE) -> Column:
    """array of sections, each an array of paragraphs, each an array of leaf hashes."""
    pieces = rf"[^.!?]{{1,{piece}}}[.!?]*|[.!?]+"
    leaves = lambda p: F.transform(F.regexp_extract_all(p, F.lit(pieces), F.lit(0)), lambda x: F.xxhash64(x))
    return F.transform(F.split(text, "\n\n"), lambda s: F.transform(F.split(s, "\n"), leaves))


def _hex(x: Column) -> Column:
    return F.lower(F.lpad(F.hex(x), 16, "0"))


def root(sections: Column) -> Column:
    hashed = F.transform(sections, lambda s: F.xxhash64(F.transform(s, lambda p: F.xxhash64(p))))
    return F.sha2(F.concat_ws(".", F.transform(hashed, _hex)), 256)


def fingerprint(sections: Column) -> Column:
    """The tree as text: root, then sections ``hash[paragraphs]``, paragraphs ``hash(leaves)``."""
    paragraph = lambda p: F.concat(_hex(F.xxhash64(p)), F.lit("("), F.concat_ws(".", F.transform(p, _hex)), F.lit(")"))
    section = lambda s: F.concat(_hex(F.xxhash64(F.transform(s, lambda p: F.xxhash64(p)))), F.lit("["), F.concat_ws(",", F.transform(s, paragraph)), F.lit("]"))
    return F.concat(root(sections), F.lit(":"), F.concat_ws(";", F.transform(sections, section)))


def leaves(sections: Column) -> Column:
    return F.array_distinct(F.flatten(F.flatten(sections)))


def likeness(a: Column, b: Column) -> Column:
    """Share of distinct leaves that two trees have in common, of those they have on average (0 to 1); 1 if both have none."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def fingerprints(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(doc_id, root, fingerprint, tree) of every row; a null text counts as empty."""
    cut = docs.select(F.col(ident).alias("doc_id"), tree(F.coalesce(F.col(text), F.lit(""))).alias("tree"))
    return cut.select("doc_id", root(F.col("tree")).alias("root"), fingerprint(F.col("tree")).alias("fingerprint"), "tree")


def differing(a: Column, b: Column) -> Column:
    """Where two trees differ, top down: (section, paragraph) pairs from 0, empty if equal. Only sections with other hashes are entered."""
    at = lambda x, i: F.coalesce(F.get(x, i), F.array().cast("array<array<bigint>>"))
    counted = lambda x, y: F.sequence(F.lit(0), F.greatest(F.size(x), F.size(y), F.lit(1)) - 1)
    sections = F.filter(counted(a, b), lambda i: ~F.get(a, i).eqNullSafe(F.get(b, i)))
    inner = lambda i: F.transform(F.filter(counted(at(a, i), at(b, i)), lambda j: ~F.get(at(a, i), j).eqNullSafe(F.get(at(b, i), j))), lambda j: F.struct(i.alias("section"), j.alias("paragraph")))
    return F.flatten(F.transform(sections, inner))


def _range_of(ident: Column, bounds: list[int]) -> Column:
    """How many bounds are at most ident, by a coarse and a fine step; -1 for null."""
    step = max(1, isqrt(len(bounds)))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    coarse = F.array(*[F.lit(g[0]) for g in groups]).cast("array<bigint>")
    fine = F.array(*[F.array(*[F.lit(x) for x in g]).cast("array<bigint>") for g in groups])
    k = F.size(F.filter(coarse, lambda x: x <= ident))
    within = F.size(F.filter(F.element_at(fine, F.greatest(k, F.lit(1))), lambda x: x <= ident))
    return F.when(ident.isNull(), -1).otherwise(F.when(k == 0, 0).otherwise((k - 1) * step + within)).cast("int")


def with_next(docs: DataFrame, ident: str, columns: list[str], ranges: int | None = None) -> DataFrame:
    """docs with `next_` columns of the row that follows by descending ident (ties by the columns; null ids last; after the last row the first).

    Ids are cut into ranges at their quantiles. A range's rows are ordered
    together; the head of the following range joins each as a ghost row, so
    neither one task nor the driver sees more than a range and a row for each.
    Rows that share an id, or have none, are ordered in one task, which spills.
    """
    ranges = ranges or min(MOST_RANGES, 16 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = docs.select(F.percentile_approx(ident, [i / ranges for i in range(1, ranges)], 100 * ranges).alias("b")).first().b or [0]
    placed = docs.withColumn("__range", _range_of(F.col(ident), sorted(set(bounds))))
    heads = placed.groupBy("__range").agg(F.max(ident).alias("__head"))
    rows = sorted(heads.collect(), key=lambda r: -r["__range"])  # MOST_RANGES + 1 at most
    targets = [(r["__range"], rows[(i + 1) % len(rows)]["__head"]) for i, r in enumerate(rows)]
    ghosts = docs.sparkSession.createDataFrame(targets, "__range int, __head long")
    ghost = docs.join(F.broadcast(ghosts), docs[ident].eqNullSafe(F.col("__head"))).groupBy("__range").agg(F.min(F.struct(*[F.col(c).alias(f"__{c}") for c in columns])).alias("__first"))
    # of a head's rows the first alone is a ghost; other columns of ghosts aren't read
    ghost = ghost.select("__range", F.lit(1).alias("__ghost"), *[F.col(f"__first.__{c}").alias(c) for c in columns])
    own = placed.withColumn("__ghost", F.lit(0))
    order = Window.partitionBy("__range").orderBy("__ghost", F.col(ident).desc_nulls_last(), *[F.col(c) for c in columns])
    both = own.unionByName(ghost, allowMissingColumns=True)
    return both.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]).where("__ghost = 0").drop("__range", "__ghost")


def edits(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """Fingerprints of every text and of the text whose last third is replaced from the next document's start.

    Null texts count as empty. A lone row is its own next. Repeated rows are
    returned each; an empty table gives an empty result.
    """
    body = docs.select(F.col(ident).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    if not body.head(1):
        near = body.select("doc_id", F.length("body").cast("long").alias("n_chars"), F.lit("").alias("edited_sha256"), F.lit("").alias("fingerprint"), F.lit("").alias("edited_fingerprint"), F.lit(0.0).alias("near_edited"), F.lit(0.0).alias("near_next"))
        return near
    paired = with_next(body, "doc_id", ["body"])
    kept = F.length("body") - F.floor(F.length("body") / 3).cast("int")
    edited = F.concat(F.substring("body", F.lit(1), kept), F.substring("next_body", F.lit(1), F.length("body") - kept))
    cut = paired.select("doc_id", F.length("body").cast("long").alias("n_chars"), tree(F.col("body")).alias("own"), edited.alias("edited"), leaves(tree(F.col("next_body"))).alias("next"))
    cut = cut.select("doc_id", "n_chars", "own", F.sha2("edited", 256).alias("edited_sha256"), tree(F.col("edited")).alias("changed"), "next")
    return cut.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("changed")).alias("edited_fingerprint"),
        likeness(leaves(F.col("own")), leaves(F.col("changed"))).alias("near_edited"),
        likeness(leaves(F.col("own")), F.col("next")).alias("near_next"),
    )
