"""Connected components of a table of links, by alternating stars, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.shared import stored


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the least node of its component.

    Each round hangs every larger neighbour of a node, then every smaller one, below the least neighbour
    known, until the links are stars. The least neighbour is aggregated before it is joined, so a node with
    many links is never gathered in one task; each round is stored. Loops (a, a)
    are left out, and so are nodes without other links.
    """
    edges = stored(_directed(links.select("a", "b")), "stars")
    for _ in range(most_rounds):
        before = _summary(edges)
        edges = stored(_small_star(_large_star(edges)), "stars")
        if _summary(edges) == before:
            break
    else:
        raise RuntimeError("components did not converge")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return stars.union(roots).groupBy("node").agg(F.min("root").alias("root"))


def _directed(edges: DataFrame) -> DataFrame:
    """Each link once, from the larger node to the smaller one."""
    return (
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Stored, so that the join can split a node with very many links.
    least = stored(both.groupBy("a").agg(F.min("b").alias("least")), "least")
    found = both.where(F.col("b") > F.col("a")).join(least, "a")
    return _directed(found.select(F.col("b").alias("a"), F.least("a", "least").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    moved = edges.join(least, "a").where(F.col("b") != F.col("least"))
    moved = moved.select(F.col("b").alias("a"), F.col("least").alias("b"))
    return _directed(moved.union(least.select("a", F.col("least").alias("b"))))


def _summary(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
