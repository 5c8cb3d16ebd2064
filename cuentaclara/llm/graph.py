"""Connected components of an edge table by alternating large-star and small-star steps.

Each step gives every node the smallest node it has seen and keeps the number of edges. Tables between the steps live in
the shared folder; nothing about nodes or edges reaches the driver but whether they have settled. A node with very many
edges is split by the skew handling of the joins, as both sides are plain tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuentaclara.llm.common import dropped, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = written(both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m")), "star-least")
    larger = both.where("v > u").join(smallest, "u")
    return larger.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` point from a larger node u to a smaller one v."""
    smallest = written(edges.groupBy("u").agg(F.min("v").alias("m")), "star-least")
    onwards = edges.join(smallest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return onwards.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether each node u points to one node v, and no v points on: then every v is the smallest node of its component."""
    out = edges.groupBy("u").agg(F.count(F.lit(1)).alias("targets"), F.lit(0).alias("sources"))
    into = edges.groupBy(F.col("v").alias("u")).agg(F.lit(0).cast("long").alias("targets"), F.lit(1).alias("sources"))
    nodes = out.unionByName(into).groupBy("u").agg(F.sum("targets").alias("targets"), F.max("sources").alias("sources"))
    return nodes.where("targets > 1 OR (targets = 1 AND sources = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node on an edge; ``edges`` has two long columns."""
    a, b = edges.columns
    plain = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    current = written(plain, "star-edges")
    while not _settled(current):
        new = written(_small_star(written(_large_star(current), "star-large")), "star-edges")
        dropped(current)
        current = new
    roots = current.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
