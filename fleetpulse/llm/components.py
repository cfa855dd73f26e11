"""Connected components of a link table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _with_least(pairs: DataFrame) -> DataFrame:
    """``pairs`` (u, v) with the least neighbour of u.  The minimum is combined before its
    shuffle, and a hot u is a skewed join that Spark splits."""
    return pairs.join(pairs.groupBy("u").agg(F.min("v").alias("m")), "u")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v); the root is the least node it can reach.

    Alternates large-star and small-star steps until the links no longer
    change; every node then links straight to its root.  A step is a written
    table, so a lost executor costs one step.  No step gathers a node's
    neighbours: each link only learns its node's minimum.  Links of a node with
    itself are kept as its own root; no links give no rows.
    """
    edges = written(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"
    )
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            _with_least(both)
            .where("v > u")
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
            .where("u <> v")
            .distinct()
        )
        large = written(large, "large-star")
        near = _with_least(large)
        edges = written(
            near.select("u", F.col("m").alias("v"))
            .unionByName(near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
            .distinct(),
            "small-star",
        )
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
