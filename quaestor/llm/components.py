"""Connected components of an edge table, by hooking to the smallest neighbour and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, spread_join


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node that has an edge to another; label: the smallest node of its component.

    edges: columns a and b, long. Rounds keep one smaller neighbour for each node, the smallest, and hand the others on
    to it; then every node has one, and jumping over parents halves the depth each time. No step gathers a component or a
    node's neighbours: the smallest is a partial aggregate, and nodes of many edges get it by broadcast.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    while True:
        e = cut(e)
        low = cut(e.groupBy("hi").agg(F.min("lo").alias("low"), F.count(F.lit(1)).alias("n")))
        g = cut(spread_join(e, low, ["hi"]).select("hi", "lo", "low"))
        rest = g.where("lo <> low")
        if rest.isEmpty():
            break
        handed = rest.select(F.greatest("lo", "low").alias("hi"), F.least("lo", "low").alias("lo"))
        e = g.select("hi", F.col("low").alias("lo")).unionByName(handed).distinct()
    parent = e.select(F.col("hi").alias("node"), F.col("lo").alias("label"))
    while True:
        up = parent.select(F.col("node").alias("label"), F.col("label").alias("higher"))
        jumped = cut(parent.join(up, "label", "left").select("node", F.coalesce("higher", "label").alias("label"), F.col("higher").isNotNull().alias("moved")))
        parent = jumped.select("node", "label")
        if jumped.where("moved").isEmpty():
            break
    return parent.unionByName(parent.select(F.col("label").alias("node"), "label").distinct())
