"""Connected components of a table of links, in rounds of large and small stars; labels are the smallest ids.

Each round is two aggregations and joins on the links; rounds end when the links are stars. Every round is written to the shared
folder, which cuts the plan and keeps the work of lost executors. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, materialize


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u and v <> m").select(F.col("m").alias("u"), F.col("v"))


def _small(edges: DataFrame) -> DataFrame:
    """Links (u, v) with u < v: each v's smaller neighbours and v itself move to the smallest."""
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    moved = edges.join(least, "v").where("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))
    return moved.union(least.select(F.col("m").alias("u"), "v")).distinct()


def _stars(edges: DataFrame) -> bool:
    """Each node hangs on one node, which hangs on none."""
    twice = edges.groupBy("v").agg(F.count("*").alias("n")).where("n > 1")
    chained = edges.select("u").distinct().join(edges.select(F.col("v").alias("u")), "u", "left_semi")
    return twice.select("v").union(chained).isEmpty()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of links(a, b) that is not its component's smallest."""
    edges = materialize(links.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u < v").distinct())
    while not _stars(edges):
        last, edges = edges, materialize(_small(_large(edges)))
        drop_scratch(last)
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component"))
