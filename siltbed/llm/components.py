"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.llm.scratch import drop_scratch, materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Ties each vertex's larger (large) or smaller (small) neighbours to the least vertex around."""
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    around = edges.unionByName(back) if large else back.filter("b < a").unionByName(edges.filter("b < a"))
    least = around.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    tied = around.join(least, "a")
    if large:
        out = tied.filter("b > a").select(F.col("b").alias("b"), F.col("m").alias("a"))
    else:
        out = tied.select(F.col("b").alias("b"), F.col("m").alias("a")).unionByName(least.select(F.col("a").alias("b"), F.col("m").alias("a")))
    return out.filter("a < b").select("a", "b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(vertex, root) of every vertex with an edge; the root is the least vertex of its component.

    ``edges`` has longs a < b. Rounds stop when the edges no longer change; at
    the end each is a star around its root. Only a count and a sum of hashes
    come to the driver, and one round's edges are stored at a time.
    """
    edges = materialize(edges.select("a", "b").distinct(), "edges")
    before = _state(edges)
    while before[0]:
        earlier, edges = edges, materialize(_stars(_stars(edges, True), False), "edges")
        drop_scratch(earlier)
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select("a").distinct().select(F.col("a").alias("vertex"), F.col("a").alias("root"))
    return edges.select(F.col("b").alias("vertex"), F.col("a").alias("root")).unionByName(roots)
