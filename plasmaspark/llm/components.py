"""Connected components of a link table by alternating large-star and small-star steps.

Each step only takes minima per node and joins them back, so no node's
neighbours are gathered anywhere; a hub is an ordinary skewed join key. Links
are written in the shared folder after each round, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plasmaspark.llm.store import written


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """pairs (a, b) with a's neighbours b. Large: larger neighbours move to the least; small: the smaller ones and the node itself."""
    low = pairs.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    joined = pairs.join(low, pairs.a == low.n)
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return moved.where("a != b").distinct()


def stars(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every node with a link to another; root is the component's least node. Null ends and self-links are ignored."""
    flat = links.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).where(f"`{left}` != `{right}`").distinct()
    state = written(flat, "links")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = mark(state)
    while before[0]:
        both = state.unionAll(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # every pair of the large step has its greater end first, as the small step needs
        state = written(_star(_star(both, True), False), "links")
        if (now := mark(state)) == before:
            break
        before = now
    return state.select(F.col("a").alias("node"), F.col("b").alias("root"))
