"""Connected components of an edge table, as a plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.llm.common import checkpointed, settled, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node of an edge; component is the smallest node reached.

    Alternates the large-star and small-star steps of Kiveris et al. (2014)
    until the edges stay as they are: a logarithmic number of rounds of
    joins and map-side combined minima, each written once and deleted after
    the next. Nothing but a count and a checksum
    comes to the driver. Loops, repeated edges and either direction are fine;
    an edge with a null end is no edge. No edges give no rows.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    edges = edges.where(x.isNotNull() & y.isNotNull()).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
    edges = checkpointed(edges.distinct())
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b"))
    edges = edges.where("a > b")
    state, at = _state(edges), written()
    while state[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        edges = both.join(least, both.a == least.n).where("b > n and b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        star = edges.join(least, edges.a == least.n)
        edges = star.select("b", "m").where("b > m").union(star.select("n", "m")).toDF("a", "b").distinct()
        edges = settled(edges, at)
        before, state = state, _state(edges)
        if before == state:
            break
    root = edges.groupBy("a").agg(F.min("b").alias("component"))
    return nodes.distinct().join(root, nodes.node == root.a, "left").select("node", F.coalesce("component", "node").alias("component"))
