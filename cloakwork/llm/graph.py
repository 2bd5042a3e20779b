"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch, materialize


def components(edges: DataFrame, a: str = "a", b: str = "b", scratch: Scratch | None = None) -> DataFrame:
    """``node, component`` (smallest node reachable) for every node with an edge.

    Labels start at the smallest neighbour; each round takes the smallest
    label around a node and then the label of that label, so a chain's length
    halves or better. Rounds end when no label changes. Labels are written to
    the shared folder each round; a node with very many edges is summed before
    the shuffle, and its join partition is split by AQE. Nulls, loops and
    repeated edges have no effect. With ``scratch``, all files are its own.
    """
    keep = scratch.keep if scratch else materialize
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    e = keep(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = keep(e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        near = e.join(labels.select(F.col("node").alias("v"), F.col("component").alias("c")), "v").groupBy(F.col("u").alias("node")).agg(F.min("c").alias("c"))
        low = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "c").alias("c"))
        jump = labels.select(F.col("node").alias("c"), F.col("component").alias("cc"))
        new = keep(low.join(jump, "c", "left").select("node", "old", F.least("c", F.coalesce("cc", "c")).alias("component")))
        changed = new.filter("component <> old").limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            return labels
