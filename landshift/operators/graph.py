"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is one aggregation and one join by node; its result is written to the shared folder, so lineage
stays short and a lost executor repeats one step. Links and components never leave Spark; only their count
and a checksum do, to see that a step changed nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landshift.sources.shared import removed, written


def _star(both: DataFrame, large: bool) -> DataFrame:
    """Link the larger (or the not larger) neighbours of each node, and the node, to its least neighbour."""
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    linked = both.join(least, "u")
    if large:
        return linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.where("m < u").select("u", F.col("m").alias("v"))
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(own)


def components(links: DataFrame, most_steps: int = 60) -> DataFrame:
    """(node, component): every node of ``links`` (u, v), with the least node it is connected to."""
    edges = written(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    for _ in range(most_steps):
        check = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if check["n"] == 0 or (check["n"], check["h"]) == seen:
            break
        seen = (check["n"], check["h"])
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        wide = _star(both, large=True).where("u != v").distinct()
        # Small-star looks at smaller neighbours only, which is how links are kept: u > v.
        after = written(_star(wide, large=False).where("u != v").distinct(), "links")
        removed(edges)
        edges = after
    else:
        raise RuntimeError(f"components did not settle in {most_steps} steps")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
