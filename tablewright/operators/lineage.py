"""Lineage graphs: edges (source, target, transformation) and walks over them."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.session import stage


def _oriented(edges: DataFrame, direction: str) -> DataFrame:
    a, b = ("source", "target") if direction == "downstream" else ("target", "source")
    return edges.select(F.col(a).alias("_from"), F.col(b).alias("_to"), "transformation")


def trace(edges: DataFrame, starts: DataFrame, direction: str = "downstream", max_hops: int | None = None) -> DataFrame:
    """Everything reachable from ``starts`` (column ``node``) with its smallest depth.

    A breadth-first walk: each hop joins the new nodes with the edges and drops
    nodes met before, so cycles end and paths never multiply; it goes on until
    a hop meets nothing new, or for ``max_hops``. Edges and hops are written to
    the shared checkpoint folder, which keeps every plan one join deep.
    """
    if direction == "both":
        up = trace(edges, starts, "upstream", max_hops).withColumn("direction", F.lit("upstream"))
        return up.unionByName(trace(edges, starts, "downstream", max_hops).withColumn("direction", F.lit("downstream")))
    steps = stage(_oriented(edges, direction))
    seen = starts.select("node", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("transformation")).distinct()
    frontier = seen.select("node")
    for hop in itertools.count(1) if max_hops is None else range(1, max_hops + 1):
        found = (
            frontier.join(steps, F.col("node") == F.col("_from"))
            .groupBy(F.col("_to").alias("node"))
            .agg(F.lit(hop).alias("depth"), F.min("transformation").alias("transformation"))
            .join(seen.select("node"), "node", "left_anti")
        )
        found = stage(found)
        if found.isEmpty():
            break
        seen = seen.unionByName(found)
        frontier = found.select("node")
    return seen.filter("depth > 0")


def direct_edges(edges: DataFrame, node: str) -> DataFrame:
    """Edges into and out of one node."""
    way = F.when(F.col("target") == node, "upstream").otherwise("downstream")
    return edges.filter((F.col("source") == node) | (F.col("target") == node)).select(way.alias("direction"), "source", "target", "transformation")


def lineage_paths(edges: DataFrame, start: str, direction: str = "downstream", max_hops: int | None = None) -> DataFrame:
    """The full tree below a node as paths; a branch that meets itself is marked."""
    steps = stage(_oriented(edges, direction).drop("transformation"))
    level = edges.sparkSession.createDataFrame([(start, [start])], "node string, path array<string>")
    out = None
    for _ in itertools.count() if max_hops is None else range(max_hops):
        grown = stage(
            level.join(steps, F.col("node") == F.col("_from")).select(
                F.col("_to").alias("node"),
                F.concat("path", F.array("_to")).alias("path"),
                F.array_contains("path", F.col("_to")).alias("circular"),
            )
        )
        if grown.isEmpty():
            break
        part = grown.select("node", F.concat_ws(">", "path").alias("path"), (F.size("path") - 1).alias("depth"), "circular")
        out = part if out is None else out.unionByName(part)
        level = grown.filter(~F.col("circular")).select("node", "path")
    if out is None:
        return level.limit(0).select("node", F.lit("").alias("path"), F.lit(0).alias("depth"), F.lit(False).alias("circular"))
    return out
