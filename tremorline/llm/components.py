"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def connected_components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of an edge.

    ``edges`` has two long columns a and b; null and self edges are ignored.  The
    large-star and small-star steps alternate until no edge changes; each joins every
    node's neighbours with their minimum, so a hub's edges are never gathered: the
    minima are pre-aggregated and hot keys of the join can be split.  After each round
    the edges are written to the shared folder.
    """

    def distinct(df: DataFrame) -> DataFrame:
        return df.where("a > b").distinct()

    def star(pairs: DataFrame) -> DataFrame:
        """From (u, v), v a neighbour of u: each v with the least of u and its neighbours."""
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return pairs.join(least, "u")

    now = shared.materialize(distinct(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), name)
    state = None
    for _ in range(most_rounds):
        n = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if n == state or n[0] == 0:
            break
        state = n
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = star(both).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        own = distinct(large).select(F.col("a").alias("u"), F.col("b").alias("v"))
        small = star(own)
        now = shared.materialize(distinct(small.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(small.select(F.col("u").alias("a"), F.col("m").alias("b")))), name)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
