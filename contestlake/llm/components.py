"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from contestlake.functions.plan import durable


def _contract(pairs: DataFrame, large: bool) -> DataFrame:
    """Every neighbour of a node goes to the node's smallest neighbour (or itself)."""
    if large:
        sides = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        sides = pairs
    low = sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    met = sides.join(low, "a")
    if large:
        out = met.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b")))
    return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def smallest_member(pairs: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node that it reaches.

    ``pairs`` has columns a, b (longs).  Each round is two aggregations with a join; it ends when a round
    changes no link, after a number of rounds that grows with the logarithm of a component's size.
    """
    links = durable(pairs.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"))
    before = links.agg(mark).first()[0]
    while before["n"]:
        links = durable(_contract(_contract(links, True), False))
        now = links.agg(mark).first()[0]
        if now == before:
            break
        before = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
