"""Distributed union-find: connected components by alternating star contractions.

Each round rewrites every edge to point at the smallest node known nearby (large star, then small
star), so chains halve and hubs stay plain equi-joins. Only DataFrame operations are used; the
driver sees one number per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every neighbour that is larger than a node on that node's smallest neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them; edges run from larger to smaller."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph.

    ``edges``: columns ``u``, ``v`` of one orderable type; nulls and self-loops are ignored, repeated
    edges count once. Returns (node, component) with component the smallest node of the component,
    for every node that has an edge; an empty edge table gives an empty result.
    """
    now = scratch.save(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    before = None
    for _ in range(max_rounds):
        after = scratch.save(_small_star(_large_star(now)), "star")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        now = after
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    low = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        low.select(F.col("v").alias("node"), F.col("v").alias("component"))
    )
