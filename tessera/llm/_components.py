"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._store import discard, freeze


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (larger ones, or else smaller ones and itself) are linked to its least neighbour."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if large else edges
    least = both.groupBy("src").agg(F.min("dst").alias("least")).withColumn("least", F.least("src", "least"))
    if large:
        # Written, so that the join reads both sides by its own exchanges: then Spark can split a node with very many neighbours.
        least = freeze(least, "least")
    joined = both.join(least, "src")
    if large:
        out = joined.where("dst > src").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    else:
        out = joined.select(F.col("dst").alias("src"), F.col("least").alias("dst")).unionByName(least.select("src", F.col("least").alias("dst")))
    return out.where("src != dst").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` for every node of an edge; a component is named by its least node.

    Edges are long columns ``a`` and ``b``; nulls and loops are left out, directions and
    repeats don't matter.  Each round is written to the shared folder; the rounds grow
    with the logarithm of the longest path.
    """
    now = freeze(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("src"), F.least(a, b).alias("dst")).distinct(), "edges")
    seen, spark = None, edges.sparkSession
    while True:
        last, now = now, freeze(_star(_star(now, True), False), "stars")
        discard(spark, last.frozen)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
