"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bundlelens.session import written


def _smallest(edges: DataFrame) -> DataFrame:
    """The smallest neighbour (or the node itself) of each node that has a row (u, v)."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _pulled(edges: DataFrame) -> DataFrame:
    """(v, smallest of u's neighbourhood) for every edge (u, v)."""
    least = written(_smallest(edges).withColumnRenamed("u", "_u"), "smallest")
    return edges.join(least, F.col("u") == F.col("_u")).select("u", "v", "m")


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of the edges (u, v) of two long columns.

    Large-star and small-star steps in turn until the edges are stars. A step moves each edge once;
    its state is a table in the shared folder, which cuts the lineage, and only a count and a hash of
    the edges come to the driver. Both sides of its join are plain shuffles, so AQE splits a hub.
    Self-loops, repeated edges and either direction are fine. No edges give no rows.
    """
    edges = written(edges.filter("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(edges)
    while state[0]:
        both = written(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both")
        large = written(_pulled(both).filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        small = _pulled(large)
        edges = written(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "small")
        last, state = state, _state(edges)
        if state == last:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
