"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_io import discard, materialize


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    Each step replaces a node's edges by edges to the smallest neighbour: minima are aggregated, so a node
    of any degree needs no list of neighbours. In the first half of a step, minima and edges are read from the shared
    folder when they are joined, so that Spark can split the edges of a node with very many; in the second half
    a node has edges to smaller ones only, of which the first half has left few.
    Null ends, loops and repeated edges are ignored.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    now = edges.filter(F.col(a) != F.col(b)).select(u.alias("u"), v.alias("v")).distinct()
    now = materialize(now, "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima")
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(lower, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = rest.unionByName(lower.select("u", F.col("m").alias("v")))
        small = small.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        step = materialize(small, "edges")
        new = _mark(step)
        for spent in (now, least):
            discard(spent)
        now = step
        if new == mark:
            break
        mark = new
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row.n, row.x or 0
