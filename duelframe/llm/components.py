"""Connected components by alternating large and small stars, as joins and minima only.

In a large star every node sends its larger neighbours to the smallest node it knows; in a small star a node sends
itself and its smaller neighbours there.  The two keep the components and end with every node linked to the smallest of
its component, after a number of rounds that grows with the logarithm of the size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected(links: DataFrame) -> DataFrame:
    """``links``: columns ``a`` and ``b``.  One row per linked node: ``node`` and ``root``, the component's smallest node."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges)
    state = _state(edges)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
        edges = materialize(small.select(F.col("e.a").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct())
        before, state = state, _state(edges)
        if state == before:
            stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return stars.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
