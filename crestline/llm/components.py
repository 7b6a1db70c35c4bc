"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def told(edges: DataFrame) -> tuple:
    """Number of the edges and two 64-bit sums over their hashes, which tell whether a step changed any."""
    return tuple(edges.agg(F.count("*"), *(F.bit_xor(F.xxhash64("u", "v", F.lit(i))) for i in (0, 1))).first())


def label(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: for every node of a link, the smallest node reachable. Links may repeat and may be loops.

    A step relinks neighbours to the smallest node near them; the number of steps grows with the logarithm of the
    nodes. Each step is written, so a lost executor costs that step at most. A node with very many neighbours is one
    aggregated row joined with a run that can be split.
    """
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    state = told(edges)
    while state[0]:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges, last = cut(small, tidy=False), state
        state = told(edges)
        if state == last:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
