"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), u > v. Joins neighbours to the smallest node of each star: larger ones only, or smaller ones only."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        joined = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        joined = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return joined.filter("u != v").distinct()


def components(edges: DataFrame, name: str = "components", rounds: int = 50) -> DataFrame:
    """(node, component) of all nodes that edges (u, v) name: the smallest node reachable. Nodes are longs.

    Rounds end when edges form stars whose centres are the smallest nodes. Each round's edges are written to the shared
    folder. Nodes without edges are not named; loops and repeated edges do nothing; no edges give no rows.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct()
    edges, mark = written(edges, name), None
    for _ in range(rounds):
        edges = written(_stars(_stars(edges, True), False), name)
        found = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(found) == mark:
            break
        mark = tuple(found)
    else:
        raise RuntimeError(f"no stars after {rounds} rounds")
    centres = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centres)
