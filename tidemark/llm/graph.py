"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """One round: every node's neighbours are tied to the least node around it.

    With ``both_ways`` the larger neighbours are moved, else the smaller ones and the node itself.
    """
    if both_ways:
        way = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        way = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = way.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    tied = way.join(least, "a")
    if both_ways:
        moved = tied.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the least node of its component) for every node of ``edges`` (a, b).

    Large-star and small-star rounds alternate until the edges stay as they are.  The number of
    rounds grows with the logarithm of the longest path; each round's edges are written to the
    shared checkpoint folder, and only their count and hash reach the driver.
    """
    mark = [F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))]
    edges = cut_lineage(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = tuple(edges.agg(*mark).first())
    for _ in range(rounds):
        if not seen[0]:
            break
        edges = cut_lineage(_star(_star(edges, True), False))
        now = tuple(edges.agg(*mark).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root")).distinct()
