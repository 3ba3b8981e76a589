"""Distributed connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.durable import durable, released, unpartitioned


def _minima(edges: DataFrame) -> DataFrame:
    """The smallest neighbour of each ``u``. Pre-aggregated, so a hub sends one row a task."""
    return edges.groupBy("u").agg(F.min("v").alias("low")).select(unpartitioned("u").alias("hub"), "low")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")
    joined = both.join(_minima(both), F.col("u") == F.col("hub")).filter("v > u")
    return joined.select(F.col("v").alias("a"), F.least("u", "low").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    joined = down.join(_minima(down), F.col("u") == F.col("hub"))
    moved = F.array(F.struct(F.col("v").alias("a"), F.col("low").alias("b")), F.struct(F.col("u").alias("a"), F.col("low").alias("b")))
    return joined.select(F.explode(moved).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()


def _are_stars(links: DataFrame) -> bool:
    """Whether every node hangs on one smaller node, which hangs on none."""
    ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e"))
    nodes = ends.groupBy("e.node").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
    return not nodes.agg(F.bool_or((F.col("up") > 1) | (F.col("up") + F.col("down") > 1))).head()[0]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the links ``edges`` (a, b: long).

    The component is its smallest node. Links may repeat, run either way or
    join a node to itself; a node with no other link is left out, null ends are
    ignored, and no links give an empty table. Every round is stored in the
    checkpoint folder, in place of the one before, and holds at most one row
    for each link; links that are stars from the start need no round.
    """
    known = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a is not null and b is not null and a <> b")
    current = durable(known.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _are_stars(current):
        before, current = current, durable(_small_star(_large_star(current)))
        released(before)
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
