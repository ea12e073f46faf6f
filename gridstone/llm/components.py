"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstone.session import shared_folder


def _stars(pairs: DataFrame, sym: bool) -> DataFrame:
    """One contraction. ``sym``: large star (larger neighbours move to the least of all), else small star."""
    if sym:
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("to"))
        return both.join(least, "u").where("v > u and v > to").select(F.col("v").alias("u"), F.col("to").alias("v"))  # the small star drops repeats
    least = pairs.groupBy("u").agg(F.min("v").alias("to"))
    moved = pairs.join(least, "u").where("v > to").select(F.col("v").alias("u"), F.col("to").alias("v"))
    return moved.union(least.select("u", F.col("to").alias("v"))).distinct()


def _unsettled(pairs: DataFrame) -> int:
    """How many nodes of ``pairs`` have several neighbours of lower number, or one that has such a neighbour itself: 0 where all are stars, which contractions leave as they are. Counts are combined before the shuffle."""
    ends = pairs.select(F.col("u").alias("x"), F.lit(1).alias("up")).union(pairs.select("v", F.lit(0)))
    roles = ends.groupBy("x").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
    return roles.agg(F.count_if((F.col("up") > 1) | (F.col("up") > 0) & (F.col("n") > F.col("up")))).first()[0]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges``; root is the component's least node.

    The neighbours of a hub are never gathered: each round takes minima (combined before the shuffle) and
    joins them back (split by adaptive execution where skewed). The number of rounds grows with the logarithm
    of the longest path; none follows once all are stars. Each round ends in a checkpoint, so a lost executor costs one round at most.
    Loops and repeated edges are allowed, nulls are dropped, an empty table gives an empty one.
    """
    shared_folder(edges.sparkSession)
    x, y = F.col(a), F.col(b)
    pairs = edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct().checkpoint()
    pairs = _stars(pairs, False).checkpoint()  # many edges to few hubs shrink to few at once
    for _ in range(max_rounds):
        if not _unsettled(pairs):
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(pairs.select("v", "v").distinct())
        pairs = _stars(_stars(pairs, True), False).checkpoint()
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
