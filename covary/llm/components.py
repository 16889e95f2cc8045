"""Connected components of an edge table, by DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covary.llm._common import attach, saved


def _mark(edges: DataFrame) -> tuple:
    """A fingerprint of an edge set: its size and two sums of hashes."""
    h = F.xxhash64("a", "b")
    row = edges.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")),
                    F.sum(F.hash("b", "a").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of ``edges``; ``root`` is the smallest
    node that can be reached, the node itself included.

    Large-star and small-star steps alternate (Kiveris et al., 2014): a node
    hands its neighbours to the smallest one it knows, which halves paths, so
    the rounds grow with the logarithm of the longest path. A step is a
    minimum per node, combined before the shuffle, and a join back in which
    hot nodes come by broadcast (:func:`covary.llm._common.attach`); the
    neighbours of a node are never gathered. Each round is saved, so a lost
    executor costs one round at most. Null ends, loops and repeated edges are
    ignored; no edges give an empty result.
    """
    x, y = F.col(a), F.col(b)
    cur = saved(edges.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
                .filter(x.isNotNull() & y.isNotNull() & (F.col("a") < F.col("b"))).distinct(), "cc-edges")
    mark = _mark(cur)
    while mark[0]:
        # large-star: every larger neighbour v of u moves to the minimum around u
        both = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            cur.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"),
                                          F.count(F.lit(1)).alias("n")), "cc-low")
        large = saved(attach(both, low, ["u"], "n", 2 * mark[0]).filter("v > u")
                      .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct(), "cc-large")
        # small-star: u and its smaller neighbours move to the smallest of them
        low = saved(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "cc-low")
        moved = attach(large, low, ["u"], "n", 2 * mark[0]).select(F.col("m").alias("a"), F.col("v").alias("b"))
        nxt = saved(moved.unionByName(low.select(F.col("m").alias("a"), F.col("u").alias("b")))
                    .filter("a < b").distinct(), "cc-edges")
        before, mark, cur = mark, _mark(nxt), nxt
        if mark == before:
            break
    return (cur.select(F.col("b").alias("node"), F.col("a").alias("root"))
            .unionByName(cur.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct())
