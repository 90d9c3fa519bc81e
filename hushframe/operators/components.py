"""Connected components by alternating large-star and small-star steps; nothing of the graph reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.storage import materialize


def _relabel(edges: DataFrame, large: bool) -> DataFrame:
    """A star step over (u, v) with u > v: links each neighbour of a node (larger ones, or smaller ones and itself) to the least of its neighbourhood."""
    arcs = edges.select("u", "v")
    if large:
        arcs = arcs.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # As a table of its own it meets the arcs in a join whose hot partitions Spark can split.
    least = materialize(arcs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    linked = arcs.join(least, "u")
    if large:
        linked = linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return linked.filter("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of the component, for each node other than it. ``edges``: two long columns u and v in any order."""
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    now = materialize(now, "edges")
    state = None
    while True:
        now = materialize(_relabel(_relabel(now, True), False), "stars")
        seen = now.agg(F.count("u"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
        state = seen
