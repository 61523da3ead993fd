"""Connected components of links in a table, by alternating star contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemagate.llm.common import keep


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (a, b), component being the smallest node reachable.

    Each round hangs every larger neighbour, then every smaller one, on the smallest neighbour of a node; the number
    of rounds grows with the logarithm of the longest chain, the rows per round never exceed the links. Both minima
    are aggregated before they are shuffled, so a node with very many links is no group of its own, and no link
    leaves the executors: the driver sees one count a round.
    """
    edges = keep(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        large = keep(large.distinct(), "links")
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(lowest.select("a", F.col("m").alias("b")))
        edges = keep(small.where("a != b").distinct(), "links")
        # each node hangs on one smaller node, and none of those hangs on another: done
        state = edges.agg(F.count(F.lit(1)), F.countDistinct("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest row of the component of each of n rows under links (i, j)."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        root = root[root]
        if (root == before).all():
            return root
