"""Connected components by alternating star contractions; every round is joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_salt, materialize, salt, salts_seen


def _least(edges: DataFrame, self_too: bool) -> DataFrame:
    """u, salt and m, u's least neighbour (or itself), once for each salt that u's edges have: a hub meets its edges in many tasks."""
    found = F.min("v")
    held = edges.groupBy("u").agg((F.least(found, F.col("u")) if self_too else found).alias("m"), salts_seen().alias("seen"))
    return held.select("u", "m", each_salt("seen").alias("salt"))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hook each node's larger (or not larger) neighbours to its least one. Edges are (u, v) with u > v."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).withColumn("salt", salt("v"))
        return both.filter("v > u").join(_least(both, self_too=True), ["u", "salt"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    edges = edges.withColumn("salt", salt("v"))
    hooked = edges.join(_least(edges, self_too=False), ["u", "salt"])
    # Each neighbour hangs on the least one; the node itself does, once, through the row of that neighbour.
    return hooked.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: (u, v) of one type -> (node, component), the least node of each component, for nodes with an edge to another."""
    edges = materialize(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        edges = materialize(_star(_star(edges, large=True), large=False), "stars")
        # Done when every edge hangs on a root: no target is itself hooked, and nothing changes any more.
        mark = tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.shiftright(F.xxhash64("u", "v"), 20)), F.lit(0))).first())
        if mark == before:
            break
        before = mark
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
