"""Connected components of a graph that no machine can hold.

Alternating star contraction: every node points its larger neighbours at its smallest one, then its
smaller neighbours, until nothing moves; what is left is a star around each component's smallest
node.  A step is two aggregations by node and joins on it, so no list of neighbours is ever built,
and each step's edges and minima are written to the shared folder, so that the join can split a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finweave.llm.common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction of edges (u > v)."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
        moved = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v")).distinct()


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], int(row["s"] or 0)


def components(links: DataFrame, max_steps: int = 60) -> DataFrame:
    """(node, label) of every node of ``links`` (a, b): the smallest node that it is connected with."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") != F.col("v")).distinct()
    edges = materialize(edges, "edges")
    before = _mark(edges)
    for _ in range(max_steps):
        edges = materialize(_star(_star(edges, True), False), "edges")
        after = _mark(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
